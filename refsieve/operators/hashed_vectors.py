"""Cosine pairs of embedding vectors among hashed candidates: most pairs, at a stated share.

Random planes cut space: the sides on which a vector lies are the bits of its bucket. Every vector is
put into several tables of buckets, each with planes of its own, and in each table also into the
buckets across the planes it lies nearest to. Two vectors are candidates where one is at home and the
other is at home or a guest. How many tables a share of the pairs needs follows from the angle of the
threshold alone, since the distances of two vectors to random planes are normal with their cosine as
correlation; it is computed before the vectors are hashed. ``embeddings.embedding_pairs`` is the exact way.

Buckets are joined as tokens of a prefix join, so that a full bucket is dealt over cells. Every
candidate pair is checked by its cosine: what is returned is right, only some pairs may be missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.operators.copies import collapse, copy_pairs, counted_pairs
from refsieve.operators.prefix_join import candidate_pairs, with_both
from refsieve.session import stored

# Vectors that share a bucket on average, where vectors lie evenly.
PER_BUCKET = 16
FEWEST_BITS, MOST_BITS = 4, 24
# Buckets across near planes that a vector visits in every table.
GUESTS = 3
RECALL = 0.97
TRIALS = 20_000
SEED = 20_240_819


def bits_for(vectors: int) -> int:
    """Planes of a table: a bucket holds about as many vectors for any input."""
    return min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(max(1, vectors) / PER_BUCKET))))


def meeting_share(bits: int, cosine: float, guests: int = GUESTS) -> float:
    """Share of pairs with this cosine that meet in one table, by trial on normal distances."""
    draws = np.random.default_rng(SEED).standard_normal((2, TRIALS, bits))
    first = draws[0]
    second = cosine * first + math.sqrt(max(0.0, 1 - cosine * cosine)) * draws[1]
    apart = (first > 0) != (second > 0)
    meets = apart.sum(1) == 0
    for side in (first, second):
        nearest = np.argsort(np.abs(side), axis=1)[:, :guests]
        crossed = np.take_along_axis(apart, nearest, 1).any(1)
        meets |= (apart.sum(1) == 1) & crossed
    return float(meets.mean())


def tables_for(bits: int, cosine: float, recall: float, guests: int = GUESTS) -> int:
    """Tables with which a pair at the threshold is met with probability ``recall``."""
    share = meeting_share(bits, cosine, guests)
    if share >= 1:
        return 1
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - max(share, 1 / TRIALS))))


def _buckets(groups: DataFrame, bits: int, tables: int, guests: int) -> DataFrame:
    """``id, token, own``: a row per table and bucket of a vector."""
    guests = min(guests, bits)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            vectors = np.stack(batch["value"]).astype(np.float64)
            width = vectors.shape[1]
            if width not in planes:
                planes[width] = np.random.default_rng(SEED + 1).standard_normal((width, tables * bits))
            away = (vectors @ planes[width]).reshape(len(vectors), tables, bits)
            home = ((away > 0) * weights).sum(2)
            nearest = np.argsort(np.abs(away), axis=2)[:, :, :guests]
            visited = home[:, :, None] ^ weights[nearest]
            codes = np.concatenate([home[:, :, None], visited], 2)
            codes = codes + (np.arange(tables, dtype=np.int64) << bits)[None, :, None]
            own = np.zeros(codes.shape, bool)
            own[:, :, 0] = True
            yield pd.DataFrame({
                "id": np.repeat(batch["id"].to_numpy(), tables * (guests + 1)),
                "token": codes.ravel(), "own": own.ravel(),
            })

    id_type = groups.schema["id"].dataType.simpleString()
    return groups.select("id", "value").mapInPandas(hashed, f"id {id_type}, token long, own boolean")


def _cosines(candidates: DataFrame, threshold: float) -> DataFrame:
    """Candidates that reach the threshold, with ``score``."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sides = []
            for name in ("value1", "value2"):
                rows = np.stack(batch[name]).astype(np.float64)
                sides.append(rows / np.linalg.norm(rows, axis=1, keepdims=True))
            batch["score"] = np.einsum("ij,ij->i", *sides)
            yield batch.loc[batch["score"] >= threshold, ["id1", "id2", "copies1", "copies2", "score"]]

    id_type = candidates.schema["id1"].dataType.simpleString()
    return candidates.mapInPandas(
        score, f"id1 {id_type}, id2 {id_type}, copies1 long, copies2 long, score double"
    )


def hashed_embedding_pairs(
    df: DataFrame,
    threshold: float = 0.8,
    id_column: str = "vec_id",
    column: str = "embedding",
    recall: float = RECALL,
    bits: int | None = None,
    guests: int = GUESTS,
) -> DataFrame:
    """Pairs of distinct vectors with a cosine of at least ``threshold``, each found with probability ``recall``.

    The columns are those of ``embeddings.embedding_pairs``. A zero vector has no direction and no
    partner; copies of a vector are never missed. ``threshold`` is above 0 and below 1.
    """
    nonzero = df.filter(F.exists(column, lambda x: x != 0))
    groups = stored(collapse(nonzero, column, id_column), "vectors")
    bits = bits_for(groups.count()) if bits is None else bits
    tables = tables_for(bits, threshold, recall, guests)
    # Read for the counts of buckets and by both sides of the join.
    rows = stored(_buckets(groups, bits, tables, guests), "buckets")
    # Guests meet those at home, so a bucket in which nobody is at home joins nothing.
    full = rows.groupBy("token").agg(F.count("*").alias("freq"), F.count_if("own").alias("home"))
    entry = F.array(F.struct("freq", "token", "own")).alias("prefix")
    records = rows.join(full.filter("home > 0 AND freq > 1").drop("home"), "token").select("id", entry)
    found = candidate_pairs(records, [], lambda a, b: a("own") | b("own"), ["own"])
    near = _cosines(with_both(found, groups, ["copies", "value"]), threshold)
    pairs = counted_pairs(near).unionByName(copy_pairs(groups))
    return pairs.withColumn("score", F.round("score", 3))
