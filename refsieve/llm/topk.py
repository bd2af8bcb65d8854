"""Exact top-k by inner product: branch and bound over vectors in vertical layout.

Queries and candidates are dealt over a grid of cells. A cell holds a bounded number of both, all
cells of a row or column of the grid see the same queries or candidates, and every pair of a query
and a candidate meets in one cell. In a cell the candidates lie dimension by dimension. Scores of all
queries of a cell are accumulated block by block of dimensions, the heaviest first. What remains of
a score is bounded by the norms of the remaining parts of both vectors, so a candidate whose best
possible score stays under the k-th best certain score is dropped. Once few are left, the survivors are
compacted to pairs. A query starts with the k-th best of its scores against ``SEEDS`` rows, so that no
cell starts without a bound.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part.
A missing dimension counts as zero. Equal rows (same id and vector) are counted, worked on once and
repeated in the result; each of them has the others as candidates. Rows without an id are
candidates, after all others in ties, but never queries. Scores outside the range of a long are cut
to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refsieve.session import stored

# Rows of each side in one cell; with 64 dimensions a cell takes a few MB.
CANDIDATES_PER_CELL = 1_024
QUERIES_PER_CELL = 1_024
# Dimensions that are accumulated between two rounds of pruning.
BLOCK = 8
# Rows that give every query a first bound; all that passes through the driver.
SEEDS = 256
# Share of the pairs of a cell from which on the survivors are worked on alone.
COMPACT = 0.25
_NO_ID = np.iinfo(np.int64).max
_LONG = np.iinfo(np.int64)


def scaled(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """``vec_id, x, n``: whole numbers ``floor(scale * component)`` of each valid row, equal rows once."""
    x = F.col(f"`{vector}`")
    valid = x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))
    )
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return (
        vectors.filter(F.coalesce(valid, F.lit(False)))
        .select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), whole.alias("x"))
        .groupBy("vec_id", "x")
        .agg(F.count("*").alias("n"))
    )


def _matrix(rows: pd.Series) -> np.ndarray:
    width = max(map(len, rows))
    if all(len(row) == width for row in rows):
        return np.array(rows.tolist(), np.int64)
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _exact_type(queries: np.ndarray, candidates: np.ndarray) -> type:
    """Numbers in which every partial score is exact: doubles, longs, or Python's integers."""
    largest = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (queries, candidates)]
    bound = largest[0] * largest[1] * queries.shape[1]
    return np.float64 if bound < 2**52 else np.int64 if bound < 2**62 else object


def search(
    queries: np.ndarray, own: np.ndarray, columns: np.ndarray, ids: np.ndarray, copies: np.ndarray,
    k: int, block: int = BLOCK, floors: np.ndarray | None = None,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its ``k`` best candidates of a cell: places and scores, ties to smaller ids.

    ``columns`` has a row per dimension. ``own[q]`` is the place of the query itself or -1; it
    counts ``copies - 1`` times. ``floors`` holds a score per query that ``k`` rows are known to reach;
    candidates that cannot reach it are left out.
    """
    kind = _exact_type(queries, columns.T)
    mass, held = np.square(queries.astype(np.float64)), np.square(columns.astype(np.float64))
    mine, columns = queries.astype(kind), columns.astype(kind)
    # The heaviest dimensions of the cell's queries come first.
    order = np.argsort(-mass.sum(0), kind="stable")
    cuts = [order[i: i + block] for i in range(0, len(order), block)]
    floors = np.full(len(mine), -np.inf) if floors is None else floors
    alive = np.repeat((copies > 0)[None, :], len(mine), 0)
    here = np.flatnonzero(own >= 0)
    alive[here, own[here]] = copies[own[here]] > 1
    score, pairs = mine[:, cuts[0]] @ columns[cuts[0]], None
    for i, dims in enumerate(cuts):
        if i and pairs is None:
            score = score + mine[:, dims] @ columns[dims]
        elif i:
            score = score + (mine[np.ix_(pairs[0], dims)] * columns[np.ix_(dims, pairs[1])].T).sum(1)
        later = np.concatenate(cuts[i + 1:]) if cuts[i + 1:] else np.array([], int)
        left = np.sqrt(mass[:, later].sum(1)), np.sqrt(held[later].sum(0))
        about = score.astype(np.float64)
        if pairs is None:
            slack = left[0][:, None] * left[1] * (1 + 1e-9) + 1 + 1e-12 * np.abs(about)
            if len(ids) >= k:
                certain = np.partition(np.where(alive, about - slack, -np.inf), len(ids) - k, axis=1)
                floors = np.maximum(floors, certain[:, len(ids) - k])
            alive &= about + slack >= floors[:, None]
            if alive.sum() <= COMPACT * alive.size or i == len(cuts) - 1:
                pairs = np.nonzero(alive)
                score = score[pairs]
        else:
            slack = left[0][pairs[0]] * left[1][pairs[1]] * (1 + 1e-9) + 1 + 1e-12 * np.abs(about)
            keep = about + slack >= floors[pairs[0]]
            pairs, score = (pairs[0][keep], pairs[1][keep]), score[keep]
    asked, place = pairs
    if kind is object:
        turn = np.array(sorted(range(len(asked)), key=lambda j: (asked[j], -score[j], ids[place[j]])), int)
    else:
        turn = np.lexsort((ids[place], -score, asked))
    asked, place, score = asked[turn], place[turn], score[turn]
    ends = np.searchsorted(asked, np.arange(len(mine) + 1))
    for q in range(len(mine)):
        best = slice(ends[q], min(ends[q + 1], ends[q] + k))
        times = np.minimum(copies[place[best]] - (place[best] == own[q]), k)
        yield q, np.repeat(place[best], times)[:k], np.repeat(score[best], times)[:k]


def _cell(group: pd.DataFrame, k: int) -> pd.DataFrame:
    names = ["query_id", "query_key", "query_n", "vec_id", "score"]
    asked, given = group[group["asks"]], group[~group["asks"]]
    if asked.empty or given.empty:
        return pd.DataFrame({name: [] for name in names}).astype("int64")
    both = _matrix(pd.concat([asked["x"], given["x"]]))
    queries, candidates = both[: len(asked)], both[len(asked):]
    ids = given["vec_id"].to_numpy(np.int64)
    place = {key: i for i, key in enumerate(given["key"])}
    own = np.array([place.get(key, -1) for key in asked["key"]])
    columns = np.ascontiguousarray(candidates.T)
    found = list(search(
        queries, own, columns, ids, given["n"].to_numpy(np.int64), k, floors=asked["floor"].to_numpy(np.float64)
    ))
    rows = np.repeat([q for q, _, _ in found], [len(places) for _, places, _ in found]).astype(int)
    whole = [min(max(int(s), _LONG.min), _LONG.max) for _, _, scores in found for s in scores]
    made = [asked[name].to_numpy(np.int64)[rows] for name in ("vec_id", "key", "n")]
    made += [ids[np.concatenate([places for _, places, _ in found])], np.array(whole, np.int64)]
    return pd.DataFrame(dict(zip(names, made)))


def _floors(asked: DataFrame, seeds: list, k: int) -> DataFrame:
    """Queries with ``floor``, a score that ``k`` of the seed rows reach; minus infinity if there are fewer."""
    keys, vectors = np.array([row["key"] for row in seeds], np.int64), pd.Series([row["x"] for row in seeds])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            floor = np.full(len(batch), -np.inf)
            if len(batch) and len(keys) > k:
                both = _matrix(pd.concat([batch["x"], vectors]))
                kind = _exact_type(both, both)
                score = both[: len(batch)].astype(kind) @ both[len(batch):].astype(kind).T
                score = score.astype(np.float64)
                score[batch["key"].to_numpy()[:, None] == keys] = -np.inf
                best = np.partition(score, len(keys) - k, axis=1)[:, len(keys) - k]
                floor = best - 1 - 1e-12 * np.abs(best)
            yield batch.assign(floor=floor)

    return asked.mapInPandas(run, "vec_id long, x array<long>, n long, asks boolean, key long, floor double")


def top_k(
    vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
    scale: int = 256, candidates_per_cell: int = CANDIDATES_PER_CELL, queries_per_cell: int = QUERIES_PER_CELL,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for every query.

    ``is_query`` is a condition on ``vec_id``. The number of cells follows the counts of rows, so
    a cell stays as small for any input.
    """
    # Read for counts, seeds and both sides of the grid: written once.
    rows = stored(scaled(vectors, vec_id, vector, scale), "whole_numbers")
    asks = F.coalesce(F.col("vec_id").isNotNull() & is_query(F.col("vec_id")), F.lit(False))
    n, n_queries = rows.agg(F.count("*"), F.count_if(asks)).first()
    bands = max(1, -(-n // candidates_per_cell))
    stripes = max(1, -(-n_queries // queries_per_cell))
    key = F.xxhash64("vec_id", "x")
    rows = rows.select(F.coalesce("vec_id", F.lit(_NO_ID)).alias("vec_id"), "x", "n", asks.alias("asks"), key.alias("key"))
    band, stripe = (F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(count)) for turn, count in ((0, bands), (1, stripes)))

    def every(count):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    seeds = rows.select("key", "x").orderBy("key", "x").limit(SEEDS).collect()
    given = rows.withColumn("asks", F.lit(False)).withColumn("floor", F.lit(None).cast("double")).select("*", band.alias("band"), every(stripes).alias("stripe"))
    asked = _floors(rows.filter("asks"), seeds, k).select("*", every(bands).alias("band"), stripe.alias("stripe"))
    found = given.unionByName(asked).groupBy("band", "stripe").applyInPandas(
        lambda group: _cell(group, k),
        "query_id long, query_key long, query_n long, vec_id long, score long",
    )
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "query_n"))).select(
        "query_id", "rank", F.expr(f"nullif(vec_id, {_NO_ID}L)").alias("vec_id"), "score"
    )
