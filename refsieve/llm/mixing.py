"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are dealt in blocks of equal size; only a source whose target is too small for that has finer
blocks, of its own. The mix of all sources with one block size is a number of blocks, and these go to
the sources by highest quotients of their targets, then from each source to its shards by highest
quotients of the shards' sizes. A shard is a slice of a source by a seeded hash of the document's id
and text, so a large source is many shards and no task holds one whole, also where ids are missing or
repeated. In a shard the documents lie in seeded
order as one stream of words, cut into blocks. Its quota is taken as whole passes over all blocks,
then the blocks that a seeded hash puts first, so that no word is taken more than twice.

Size 1 row per source and shard is all that is apportioned on the driver and in one task per
source: shards of a source are at most ``MOST_SHARDS``. Ties go to the source or shard that comes
first, and documents are ordered by hash, id, size and hash of the text, so reruns agree.

Defined results: a null text has size 0 and nothing taken. Sources of size 0 get target 0. Rows of
one id are documents of their own.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refsieve.llm.common import WORD, free_name, numbered, steps
from refsieve.session import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 20_240
# Words of a block, fewer for a source whose own target would get less than this many blocks.
BLOCK_WORDS, LEAST_BLOCKS = 64, 64
# Words that a shard should hold, and most shards of a source.
SHARD_WORDS, MOST_SHARDS = 32_768, 65_536


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by the highest quotients ``vote / (2 * seats + 1)``, none above its ``most``.

    Starts from the rounded shares and moves single seats until no quotient that got a seat lies
    under one that did not. Ties go to the first. Seats beyond the sum of ``most`` are not dealt.
    """
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    got = [min(m, int(v * seats / total + 0.5)) for v, m in zip(votes, most)]
    left = seats - sum(got)
    if left > 0:
        heap = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, got, most)) if v > 0 and g < m]
        heapq.heapify(heap)
        while left and heap:
            _, i = heapq.heappop(heap)
            got[i] += 1
            left -= 1
            if got[i] < most[i]:
                heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif left < 0:
        heap = [(v / (2 * g - 1), -i) for i, (v, g) in enumerate(zip(votes, got)) if g > 0]
        heapq.heapify(heap)
        while left:
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            left += 1
            if got[-i] > 0:
                heapq.heappush(heap, (votes[-i] / (2 * got[-i] - 1), i))
    return got


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Words of each source: by weight, but at most ``cap`` times its size, the rest reshared."""
    total = share * sum(sizes)
    target, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if total * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = total * weights[i] / weight
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            total -= target[i]
        open_ = [i for i in open_ if i not in set(over)]
    return target


def _blocks(size: int, block: int) -> int:
    return -(-size // block)


def take(sizes: np.ndarray, quota: int, block: int, draw: np.ndarray) -> np.ndarray:
    """Times that each block of a shard's stream is taken; ``draw`` has a number per block."""
    n = len(draw)
    passes, rest = divmod(quota, n)
    times = np.full(n, passes, np.int64)
    times[np.argsort(draw, kind="stable")[:rest]] += 1
    return times


def _draws(shard: int, source: int, n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[seed, (source << 32) | shard])).random(n)


def _select(group: pd.DataFrame, seed: int, spans: bool) -> pd.DataFrame:
    """Words taken of each document of a shard; with ``spans`` the ranges of words, per pass."""
    group = group.sort_values(["__order", "__doc", "size", "__mark"], kind="stable")
    size = group["size"].to_numpy(np.int64)
    ends = np.cumsum(size)
    total, quota, block = int(ends[-1]), int(group["__quota"].iloc[0]), int(group["__block"].iloc[0])
    group["taken"], ranges = 0, [[] for _ in size]
    if total and quota:
        times = take(size, quota, block, _draws(
            int(group["__shard"].iloc[0]), int(group["__source"].iloc[0]), _blocks(total, block), seed))
        cuts = np.minimum(np.arange(len(times) + 1) * block, total)
        before = np.concatenate([[0], np.cumsum(times * np.diff(cuts))])

        def until(word):
            inside = np.minimum(word // block, len(times) - 1)
            return before[inside] + times[inside] * (word - cuts[inside])

        group["taken"] = until(ends) - until(ends - size)
        if spans:
            for i, (end, own) in enumerate(zip(ends, size)):
                ranges[i] = _ranges(times, block, end - own, end)
    if spans:
        group["ranges"] = ranges
        return group[["__row", "taken", "ranges"]]
    return group[["__row", "doc_id", "__name", "size", "taken"]]


def _ranges(times: np.ndarray, block: int, start: int, end: int) -> list[list[int]]:
    """``[pass, first word, end word]`` of a document that holds words ``start:end`` of the stream."""
    if end <= start:
        return []
    own = times[start // block: (end - 1) // block + 1]
    edge = np.arange(start // block, (end - 1) // block + 2) * block
    edge = np.clip(edge, start, end) - start
    out = []
    for turn in range(int(own.max(initial=0))):
        held = np.concatenate([[False], own > turn, [False]])
        first, last = np.flatnonzero(held[1:] & ~held[:-1]), np.flatnonzero(held[:-1] & ~held[1:])
        out += [[turn, int(edge[a]), int(edge[b])] for a, b in zip(first, last)]
    return out


def _sized(docs: DataFrame, number: str | None) -> DataFrame:
    """Slim rows: row number, id, source, size and a hash of id and text of each document."""
    return docs.select(
        (F.col(number) if number else F.lit(0).cast("long")).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("__name"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id").cast("long"), "text").alias("__mark"),
    )


class Mix:
    """Targets, quotas and selection for one table of documents; see the module's text."""

    def __init__(
        self, docs: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED, block=BLOCK_WORDS, number=None
    ):
        self.spark, self.cap, self.seed = docs.sparkSession, cap, seed
        self.rows = stored(_sized(docs, number), "mix-sizes")
        # One row per source.
        self.sources = self.rows.groupBy("__name").agg(F.sum("size").alias("source_size")).toPandas()
        self.sources["key"] = [(n is None, (n or "").encode()) for n in self.sources["__name"]]
        self.sources = self.sources.sort_values("key").drop(columns="key").reset_index(drop=True)
        sizes = [int(s) for s in self.sources["source_size"]]
        target = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, cap)
        blocks = [max(1, min(block, int(t) // LEAST_BLOCKS)) for t in target]
        quota = [0] * len(sizes)
        for own in set(blocks):
            alike = [i for i, b in enumerate(blocks) if b == own]
            votes, most = [target[i] for i in alike], [int(cap * sizes[i]) // own + 1 for i in alike]
            for i, seats in zip(alike, sainte_lague(votes, round(sum(votes) / own), most)):
                quota[i] = seats
        shards = [max(1, min(MOST_SHARDS, _blocks(s, SHARD_WORDS))) for s in sizes]
        self.sources = self.sources.assign(
            source_size=sizes, target=target, __source=range(len(sizes)), __seats=quota, __shards=shards,
            __block=blocks,
        )

    def _named(self) -> DataFrame:
        schema = "__name string, source_size long, target double, __source long, __seats long, __shards long, __block long"
        rows = [
            (None if n is None else str(n), int(s), float(t), int(i), int(q), int(c), int(b))
            for n, s, t, i, q, c, b in self.sources.itertuples(index=False)
        ]
        return self.spark.createDataFrame(rows, schema)

    def _dealt(self) -> DataFrame:
        """Documents with their shard and its quota."""
        named = F.broadcast(self._named().withColumnRenamed("__name", "__key"))
        rows = self.rows.join(named, F.col("__name").eqNullSafe(F.col("__key"))).drop("__key")
        order = F.xxhash64("doc_id", F.lit(self.seed))
        rows = rows.withColumn("__order", order).withColumn("__doc", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
        rows = rows.withColumn("__shard", F.pmod(F.xxhash64("__order", "__mark"), F.col("__shards")))
        shards = rows.groupBy("__source", "__seats", "__block", "__shard").agg(F.sum("size").alias("words"))
        cap = self.cap

        def deal(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("__shard")
            words = [int(w) for w in group["words"]]
            # No more than ``cap`` passes over the blocks of a shard.
            most = [int(cap) * _blocks(w, int(group["__block"].iloc[0])) for w in words]
            group["__quota"] = sainte_lague(words, int(group["__seats"].iloc[0]), most)
            return group[["__source", "__shard", "__quota"]]

        quotas = shards.groupBy("__source").applyInPandas(deal, "__source long, __shard long, __quota long")
        return rows.join(quotas, ["__source", "__shard"])

    def report(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken`` of every document."""
        seed = self.seed
        taken = self._dealt().groupBy("__source", "__shard").applyInPandas(
            lambda group: _select(group, seed, False),
            "__row long, doc_id long, __name string, size long, taken long",
        )
        named = F.broadcast(self._named().withColumnRenamed("__name", "__key"))
        return taken.join(named, F.col("__name").eqNullSafe(F.col("__key"))).select(
            "doc_id", "size", "source_size", "target", "taken"
        )

    def ranges(self) -> DataFrame:
        """``__row, taken, ranges``: which words of each document, per pass; ``__row`` is its number."""
        seed = self.seed
        return self._dealt().groupBy("__source", "__shard").applyInPandas(
            lambda group: _select(group, seed, True),
            "__row long, taken long, ranges array<array<long>>",
        )


def _cut(text: str | None, ranges) -> list[tuple[int, str]]:
    """The taken words of a text, per pass, stretches joined by line feeds."""
    places = [m.span() for m in re.finditer(WORD, text or "")]
    passes: dict[int, list[str]] = {}
    for turn, first, end in ranges:
        passes.setdefault(int(turn), []).append(text[places[first][0]: places[end - 1][1]])
    return [(turn, "\n".join(parts)) for turn, parts in sorted(passes.items())]


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Documents of the mix, with all columns of ``docs``: a row per pass that takes words of one.

    A pass that takes a whole document gives its text as it is, others the taken stretches.
    """
    names = docs.columns
    given, number = numbered(docs)
    ranges_, pass_ = free_name("ranges", *given.columns), free_name("pass", *given.columns)
    taken = Mix(given, number=number).ranges().filter("taken > 0").select(
        F.col("__row").alias(number), F.col("ranges").alias(ranges_)
    )
    schema = T.StructType([T.StructField(pass_, T.IntegerType()), *docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            owner, turns, texts = [], [], []
            for i, (text, ranges) in enumerate(
                zip(step.column("text").to_pylist(), step.column(ranges_).to_pylist())
            ):
                for turn, cut in _cut(text, ranges):
                    owner.append(i)
                    turns.append(turn)
                    texts.append(cut)
            rows = step.select(names).take(pa.array(owner, pa.int64()))
            columns = [pa.array(texts, rows.schema.field(n).type) if n == "text" else rows.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(turns, pa.int32()), *columns], [pass_, *names])

    return given.join(taken, number).drop(number).mapInArrow(run, schema).select(*names)
