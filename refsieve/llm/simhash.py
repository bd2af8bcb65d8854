"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints of all whole texts come from one pass over Arrow batches. Equal fingerprints become
one row, so copies are never paired. Two fingerprints that differ in at most ``radius`` bits agree
in one of ``radius + 1`` bands of bits, so each fingerprint is dealt to one bucket per band.

A bucket is sorted by Gray rank, the place of a fingerprint in the reflected Gray code, where
neighbours share long patterns. Runs of it are leaves; an upper node keeps the bits that all its
fingerprints share, as a mask and a pattern. Two nodes differ at least in the bits where both masks
hold and the patterns do not; pairs of nodes are walked from the root down, and a pair whose
differences already pass the radius is pruned with all its fingerprints. Leaves that remain are
compared bit by bit. What a bucket gives are links that join its fingerprints into the same groups
as all its pairs would, at most one per fingerprint, and no listing of pairs.

A bucket above ``BUCKET_ROWS`` fingerprints is cut into chunks in Gray order, and every two chunks
meet in a cell of their own, so that no task holds a large bucket whole. Cells whose chunks the
upper nodes already tell apart are not made.

Groups are connected components over fingerprints, by alternating rounds that hang the larger on
the smaller neighbour; each round is written to the shared folder.

Defined results: texts without words (null, empty, white space) have fingerprint zero and are
linked like any other. A row without an id is part of its group but never names it, unless no row
of the group has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import mapped, numbered, words_of
from refsieve.llm.components import components
from refsieve.session import stored

BITS, SEED = 64, 42
SHINGLE, RADIUS = 3, 2
# Fingerprints of a bucket that one task compares; of a leaf.
BUCKET_ROWS, LEAF = 4_096, 32

_U = np.uint64


def shingle_hashes(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and where those of a text begin."""
    words = words_of(texts, lower=True)
    n_texts, n = len(words.base) - 1, words.counts()
    # The same words again, one space after each, so that a shingle is a slice of bytes.
    size = words.end - words.start + 1
    place = np.concatenate([[0], np.cumsum(size)])
    spaced = np.full(place[-1], 0x20, np.uint8)
    inside = np.ones(place[-1], bool)
    inside[place[1:] - 1] = False
    depth = np.zeros(len(words.data) + 1, np.int8)
    depth[words.start] += 1
    np.add.at(depth, words.end, -1)
    spaced[inside] = words.data[np.cumsum(depth[:-1]) > 0]
    # Shingle ``s`` of a text begins at word ``s``; a short text is one shingle.
    per_text = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(per_text)])
    owner = np.repeat(np.arange(n_texts), per_text)
    begin = words.first[:-1][owner] + np.arange(first[-1]) - first[:-1][owner]
    last = np.minimum(begin + width, words.first[1:][owner])
    buffer, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(buffer[a:b], SEED) for a, b in zip(place[begin].tolist(), (place[last] - 1).tolist())),
        np.uint64, len(begin),
    )
    return hashes, first


def fingerprints(texts: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as unsigned numbers."""
    hashes, first = shingle_hashes(texts, width)
    per_text = np.diff(first)
    out = np.zeros(len(per_text), np.uint64)
    some = np.flatnonzero(per_text)
    if not len(some):
        return out
    for bit in range(BITS):
        ones = np.add.reduceat(((hashes >> _U(bit)) & _U(1)).astype(np.int32), first[some])
        out[some] |= (2 * ones > per_text[some]).astype(np.uint64) << _U(bit)
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> _U(shift)
    return x


class Level:
    """Nodes of one level: the bits that all fingerprints of a run share, and their values."""

    def __init__(self, mask: np.ndarray, pattern: np.ndarray):
        self.mask, self.pattern = mask, pattern

    def above(self) -> Level:
        """The level over this one, two nodes to one."""
        mask, pattern = self.mask, self.pattern
        if len(mask) % 2:
            mask, pattern = np.append(mask, mask[-1]), np.append(pattern, pattern[-1])
        shared = mask[::2] & mask[1::2] & ~(pattern[::2] ^ pattern[1::2])
        return Level(shared, pattern[::2] & shared)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least number of bits in which fingerprints of nodes ``a`` and ``b`` differ."""
        return np.bitwise_count((self.pattern[a] ^ self.pattern[b]) & self.mask[a] & self.mask[b])


class GrayIndex:
    """Distinct fingerprints in Gray order under a hierarchy of shared patterns."""

    def __init__(self, values: np.ndarray, leaf: int = LEAF):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        self.leaf = leaf
        starts = np.arange(0, len(values), leaf)
        every, some = (f.reduceat(self.values, starts) for f in (np.bitwise_and, np.bitwise_or))
        self.levels = [Level(~(every ^ some), every)]
        while len(self.levels[-1].mask) > 1:
            self.levels.append(self.levels[-1].above())

    def near_leaves(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves (first not after second) that shared patterns cannot tell apart."""
        a = b = np.zeros(1, np.int64)
        for level in reversed(self.levels[:-1]):
            n = len(level.mask)
            a, b = (np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1]),
                    np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1]))
            fine = (a < n) & (b < n) & (a <= b)
            a, b = a[fine], b[fine]
            near = level.differ(a, b) <= radius
            a, b = a[near], b[near]
        return a, b

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of fingerprints that differ in at most ``radius`` bits, a few leaves at a time."""
        a, b = self.near_leaves(radius)
        values, n, step = self.values, len(self.values), 2_048
        inner = np.arange(self.leaf)
        for at in range(0, len(a), step):
            i = (a[at: at + step, None] * self.leaf + inner)[:, :, None]
            j = (b[at: at + step, None] * self.leaf + inner)[:, None, :]
            near = np.bitwise_count(values[np.minimum(i, n - 1)] ^ values[np.minimum(j, n - 1)]) <= radius
            near &= (i < j) & (j < n)
            pair, x, y = np.nonzero(near)
            yield i[pair, x, 0], j[pair, 0, y]


def joined(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(fingerprint, least of its group)`` within a bucket, none for single ones."""
    if len(values) < 2:
        return values[:0], values[:0]
    index = GrayIndex(values)
    parent = np.arange(len(index.values))
    for a, b in index.pairs(radius):
        while True:
            # Hang the larger root on the smaller one until both ends of all pairs agree.
            x, y = parent[a], parent[b]
            if (x == y).all():
                break
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while (parent != parent[parent]).any():
                parent = parent[parent]
    least = np.full(len(parent), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, parent, index.values)
    group = least[parent]
    other = group != index.values
    return index.values[other], group[other]


def fingerprint_table(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every row, as a signed long."""
    return mapped(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text",
        lambda step: {
            "doc_id": step.column("doc_id"), "fp": fingerprints(step.column("text"), width).view(np.int64)
        },
        "doc_id long, fp long",
    )


def _gray_order(x: Column) -> Column:
    """Gray rank of a fingerprint as a long that sorts as the unsigned rank does."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def _bands(radius: int) -> list[tuple[int, int]]:
    """First bit and width of ``radius + 1`` bands of nearly equal width."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of every bucket of a partition that is sorted by ``bucket``."""
    held_key = held = None

    def links(keys: np.ndarray, values: np.ndarray) -> tuple[list, list]:
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        a, b = [], []
        pairs = ends - starts == 2
        x, y = values[starts[pairs]], values[starts[pairs] + 1]
        near = np.bitwise_count(x ^ y) <= radius
        a.append(np.maximum(x, y)[near])
        b.append(np.minimum(x, y)[near])
        for i in np.flatnonzero(ends - starts > 2):
            found = joined(np.unique(values[starts[i]: ends[i]]), radius)
            a.append(found[0])
            b.append(found[1])
        return a, b

    def batch(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"]
        )

    for rows in batches:
        if not rows.num_rows:
            continue
        keys = rows.column("bucket").to_numpy(zero_copy_only=False)
        values = rows.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if held is not None:
            keys, values = np.concatenate([held_key, keys]), np.concatenate([held, values])
        # The last bucket may go on in the next batch.
        others = np.flatnonzero(keys != keys[-1])
        whole = int(others[-1]) + 1 if len(others) else 0
        held_key, held = keys[whole:], values[whole:]
        if whole:
            yield batch(*links(keys[:whole], values[:whole]))
    if held is not None and len(held):
        yield batch(*links(held_key, held))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that join all groups."""
    parts = F.array(*[
        F.struct(F.lit(i).alias("band"), F.expr(f"shiftrightunsigned(fp, {start}) & {(1 << width) - 1}L").alias("part"))
        for i, (start, width) in enumerate(_bands(radius))
    ])
    dealt = distinct.select("fp", F.inline(parts))
    large = dealt.groupBy("band", "part").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows)
    marked = dealt.join(large, ["band", "part"], "left")
    usual = marked.filter(F.col("n").isNull()).select(
        "fp", F.xxhash64("band", "part", F.lit(0), F.lit(0)).alias("bucket"))
    crowded = marked.filter(F.col("n").isNotNull()).select(
        "band", "part", "fp", _gray_order(F.col("fp")).alias("rank"))
    chunked = stored(_chunks(crowded, bucket_rows // 2), "chunks")
    cells = _cells(chunked, radius).withColumn("bucket", F.xxhash64("band", "part", "i", "j"))
    in_cells = chunked.withColumnRenamed("chunk", "i").join(
        cells.select("band", "part", "i", "bucket"), ["band", "part", "i"]
    ).select("fp", "bucket").unionByName(
        chunked.withColumnRenamed("chunk", "j").join(
            cells.filter("i <> j").select("band", "part", "j", "bucket"), ["band", "part", "j"]
        ).select("fp", "bucket")
    )
    buckets = usual.unionByName(in_cells)
    return buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        lambda batches: _bucket_links(batches, radius), "a long, b long"
    )


def _chunks(crowded: DataFrame, rows: int) -> DataFrame:
    """Large buckets with the number of the chunk of the Gray order that a fingerprint is in.

    All large buckets are sorted together over many tasks, and each task cuts its range.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, task = 0, TaskContext.get().partitionId() << 32
        for rows_ in batches:
            chunk = task + (at + np.arange(rows_.num_rows)) // rows
            at += rows_.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(rows_.column(c) for c in ("band", "part", "fp")), pa.array(chunk)],
                ["band", "part", "fp", "chunk"],
            )

    order = ["band", "part", "rank"]
    return crowded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        cut, "band int, part long, fp long, chunk long"
    )


def _cells(chunked: DataFrame, radius: int) -> DataFrame:
    """Pairs of chunks (first not after second) of a bucket whose shared bits do not part them."""
    nodes = chunked.groupBy("band", "part", "chunk").agg(
        F.expr("bit_and(fp)").alias("every"), F.expr("bit_or(fp)").alias("some")
    ).select("band", "part", "chunk", "every", F.expr("~(every ^ some)").alias("mask"))
    left = nodes.select("band", "part", F.col("chunk").alias("i"), F.col("every").alias("p"), F.col("mask").alias("m"))
    right = nodes.select("band", "part", F.col("chunk").alias("j"), F.col("every").alias("q"), F.col("mask").alias("o"))
    return left.join(right, ["band", "part"]).filter(
        (F.col("i") <= F.col("j")) & (F.expr("bit_count((p ^ q) & m & o)") <= radius)
    ).select("band", "part", "i", "j")


def _groups(rows: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """``fp, least, root, component_id`` of each distinct fingerprint of ``rows`` (``doc_id, fp``)."""
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(distinct.select("fp"), radius, bucket_rows))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root")


def near_groups(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: its fingerprint and the least id of its group."""
    rows = stored(fingerprint_table(docs, width), "fingerprints")
    groups = _groups(rows, radius, bucket_rows).select("fp", "component_id")
    return rows.join(groups, "fp").select("doc_id", "fp", "component_id")


def one_per_group(
    docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row of each group of near-copies, with all columns of ``docs``.

    It is the row with the least id (none last), of several the one that was numbered first. Only
    rows' numbers, ids and fingerprints are shuffled.
    """
    given, number = numbered(docs)
    slim = given.select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(
        mapped(
            slim, "text",
            lambda step: {
                "row": step.column("row"), "doc_id": step.column("doc_id"),
                "fp": fingerprints(step.column("text"), width).view(np.int64),
            },
            "row long, doc_id long, fp long",
        ),
        "fingerprints",
    )
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = rows.groupBy("fp").agg(F.min(order).alias("first"))
    groups = _groups(rows, radius, bucket_rows).select("fp", "root")
    kept = first.join(groups, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(number))
    return given.join(kept, number, "left_semi").drop(number)


def near_report(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` with the fingerprint as 16 hexadecimal digits."""
    return near_groups(docs, width, radius).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
