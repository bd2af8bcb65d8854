"""Cosine pairs of embedding vectors, exact, without comparing everything with everything.

Vectors are dealt to cells, each to its nearest pivot by angle. A partner within the angle
``acos(threshold)`` of some vector of a cell is, by the triangle inequality, within the cell's
radius plus that angle of the pivot; only such vectors are sent to the cell as visitors. Inside a
cell, residents and visitors are cut into blocks, and one task multiplies two blocks. Hot cells
become more tasks, not larger ones, and a task returns only the pairs that reach the threshold, a
bounded piece of its product at a time; visitors too are dealt out piece by piece.

There are as many cells as residents fill blocks, so that a cell does not grow with the data, up to
``MOST_PIVOTS``. Pivots and per-cell counts, one small row each, are all that passes through the
driver. How much the cells save depends on the vectors: without clusters, or with a low threshold,
nearly every cell visits every other.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.operators.copies import collapse, copy_pairs, counted_pairs
from refsieve.session import stored

PIVOTS, MOST_PIVOTS = 64, 4_096
BLOCK_ROWS = 16_384
# Angles, or scores of two blocks, that a Python worker holds at once.
CELLS = 1 << 20
# Slack on angles, so that rounding never loses a visitor.
SLACK = 1e-6


def _pivots(groups: DataFrame, count: int) -> np.ndarray:
    chosen = groups.orderBy(F.xxhash64("id"), "id").limit(count).select("value").collect()
    return np.array([row["value"] for row in chosen], dtype=np.float64)


def _angle_function():
    """Nested, like all functions here, so that it travels to the workers by value."""

    def angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        def unit(rows):
            return rows / np.linalg.norm(rows, axis=1, keepdims=True)

        return np.arccos(np.clip(unit(vectors) @ unit(pivots).T, -1.0, 1.0))

    return angles


def _piece_function():
    cells = CELLS

    def pieces(batches, width):
        """Batches cut so that ``width`` numbers per row stay bounded, however many pivots there are."""
        rows = max(1, cells // max(width, 1))
        for batch in batches:
            for start in range(0, len(batch), rows):
                yield batch.iloc[start: start + rows]

    return pieces


def _residents(groups: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Vectors with their cell and the angle to its pivot."""
    angles, pieces = _angle_function(), _piece_function()

    def assign(batches):
        for batch in pieces(batches, len(pivots)):
            away = angles(np.stack(batch["value"]).astype(np.float64), pivots)
            yield batch.assign(cell=away.argmin(axis=1), away=away.min(axis=1))

    schema = f"{_fields(groups)}, cell int, away double"
    return groups.mapInPandas(assign, schema)


def _fields(groups: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema.fields)


def _with_visits(
    residents: DataFrame, pivots: np.ndarray, radii: np.ndarray, reach: float
) -> DataFrame:
    """Each vector once as resident of its cell and once per lower cell it may have a partner in.

    Two vectors of different cells meet in the lower one only, so a pair is found once.
    """
    angles, pieces = _angle_function(), _piece_function()
    fields = _fields(residents)
    # A visitor takes a row with its vector in every cell, so pieces are smaller by its numbers.
    wide = 16 * len(pivots)

    def visit(batches):
        for batch in pieces(batches, wide):
            away = angles(np.stack(batch["value"]).astype(np.float64), pivots)
            home = batch["cell"].to_numpy()
            lower = np.arange(len(pivots))[None, :] < home[:, None]
            near = away <= np.minimum(
                radii[None, :] + reach, batch["away"].to_numpy()[:, None] + 2 * reach
            )
            rows, cells = np.nonzero(lower & near)
            yield batch.assign(visiting=False)
            if len(rows):
                yield batch.iloc[rows].assign(cell=cells.astype(np.int32), visiting=True)

    return residents.mapInPandas(visit, f"{fields}, visiting boolean")


def _in_blocks(placed: DataFrame, block_rows: int) -> DataFrame:
    """Copies of every vector for the tasks ``(cell, block, other, visitors)`` it takes part in.

    Residents are paired block by block among themselves (``block <= other``) and with each
    block of visitors.
    """
    sizes = placed.groupBy("cell").agg(
        F.count_if(~F.col("visiting")).alias("residents"),
        F.count_if("visiting").alias("visitors"),
    )
    # One small row per pivot: the bound on this broadcast is MOST_PIVOTS.
    sized = placed.join(F.broadcast(sizes), "cell")

    def blocks(column):
        return F.ceil(F.col(column) / block_rows).cast("int")

    sized = sized.select(
        "id", "value", "copies", "cell", "visiting",
        blocks("residents").alias("n_res"),
        blocks("visitors").alias("n_vis"),
        F.pmod(
            F.xxhash64("id"),
            F.when(F.col("visiting"), blocks("visitors")).otherwise(blocks("residents")),
        ).cast("int").alias("own"),
    )

    def task(block, other, visitors, first):
        return F.struct(
            block.alias("block"), other.alias("other"), F.lit(visitors).alias("visitors"),
            F.lit(first).alias("first"),
        )

    own = F.col("own")
    res = F.sequence(F.lit(0), F.col("n_res") - 1)
    as_resident = F.concat(
        F.transform(F.filter(res, lambda b: b >= own), lambda b: task(own, b, False, True)),
        F.transform(F.filter(res, lambda b: b <= own), lambda b: task(b, own, False, False)),
        F.when(
            F.col("n_vis") > 0,
            F.transform(
                F.sequence(F.lit(0), F.col("n_vis") - 1), lambda v: task(own, v, True, True)
            ),
        ).otherwise(F.array().cast("array<struct<block:int,other:int,visitors:boolean,first:boolean>>")),
    )
    as_visitor = F.when(
        F.col("n_res") > 0, F.transform(res, lambda b: task(b, own, True, False))
    )
    tasks = F.when(F.col("visiting"), as_visitor).otherwise(as_resident)
    return sized.select("id", "value", "copies", "cell", F.inline(tasks))


def _matches(threshold: float):
    cells = CELLS

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(batches), ignore_index=True)
        a, b = group[group["first"]], group[~group["first"]]
        if a.empty or b.empty:
            return
        own_block = group["block"].iloc[0] == group["other"].iloc[0] and not group["visitors"].iloc[0]

        def unit(side):
            rows = np.stack(side["value"]).astype(np.float64)
            return rows / np.linalg.norm(rows, axis=1, keepdims=True)

        ids, copies = ([side[c].to_numpy() for side in (a, b)] for c in ("id", "copies"))
        left, right = unit(a), unit(b).T
        del group, a, b
        step = max(1, cells // right.shape[1])
        for start in range(0, len(left), step):
            scores = left[start: start + step] @ right
            i, j = np.nonzero(scores >= threshold)
            score, i = scores[i, j], i + start
            id1, id2, copies1, copies2 = ids[0][i], ids[1][j], copies[0][i], copies[1][j]
            swap = id1 > id2
            kept = id1 < id2 if own_block else slice(None)
            yield pd.DataFrame({
                "id1": np.where(swap, id2, id1)[kept], "id2": np.where(swap, id1, id2)[kept],
                "copies1": np.where(swap, copies2, copies1)[kept],
                "copies2": np.where(swap, copies1, copies2)[kept], "score": score[kept],
            })

    return compare


def embedding_pairs(
    df: DataFrame,
    threshold: float = 0.8,
    id_column: str = "vec_id",
    column: str = "embedding",
    pivots: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Pairs of distinct vectors with a cosine of at least ``threshold``, and copies of a vector.

    Columns ``id1, id2, copies1, copies2, score, n_pairs``; the score is rounded to 3 places. A
    zero vector has no direction and no partner.
    """
    block_rows = block_rows or BLOCK_ROWS
    nonzero = df.filter(F.exists(column, lambda x: x != 0))
    # Read for pivots, residents and copies, and behind a shuffle of whole vectors: written once.
    groups = stored(collapse(nonzero, column, id_column), "vectors")
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(PIVOTS, groups.count() // block_rows))
    centres = _pivots(groups, pivots)
    if not len(centres):
        near = groups.select(
            F.col("id").alias("id1"), F.col("id").alias("id2"), F.col("copies").alias("copies1"),
            F.col("copies").alias("copies2"), F.lit(1.0).alias("score"),
        )
    else:
        # Read three times below, and behind a shuffle: written once instead.
        residents = stored(_residents(groups, centres), "residents")
        radii = np.full(len(centres), -math.inf)
        for row in residents.groupBy("cell").agg(F.max("away").alias("radius")).collect():
            radii[row["cell"]] = row["radius"]
        reach = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
        placed = _with_visits(residents, centres, radii, reach)
        id_type = groups.schema["id"].dataType.simpleString()
        schema = f"id1 {id_type}, id2 {id_type}, copies1 long, copies2 long, score double"
        near = (
            _in_blocks(placed, block_rows)
            .groupBy("cell", "block", "other", "visitors")
            .applyInPandas(_matches(threshold), schema)
        )
    pairs = counted_pairs(near).unionByName(copy_pairs(groups))
    return pairs.withColumn("score", F.round("score", 3))
