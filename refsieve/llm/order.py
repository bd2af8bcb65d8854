"""Places of rows in a total order, found without one task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refsieve.session import stored

# monotonically_increasing_id() has the partition above these bits, the row within it below.
PART_BITS = 33


def in_order(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``at``, numbers that ascend with ``keys``, written once.

    Ranges of ``keys`` are dealt over partitions and sorted there, so that a key with many rows is
    cut wherever a later key tells its rows apart.
    """
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(sorted_.withColumn("at", F.monotonically_increasing_id()), name)


def placed(rows: DataFrame, tree: str, keys: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``place``, from 0 by ``keys`` within each ``tree`` (never null), and ``n``, its rows.

    Rows of a tree lie together in a partition, so their places follow from one row per tree and
    partition.
    """
    ordered = in_order(rows, [tree, *keys], name)
    part = F.shiftrightunsigned("at", PART_BITS)
    runs = ordered.groupBy(tree, part.alias("part")).agg(F.min("at").alias("begin"), F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy(tree).orderBy("part")) - F.col("held")
    runs = runs.select(
        tree, "part", (before - F.col("begin")).alias("shift"),
        F.sum("held").over(Window.partitionBy(tree)).alias("n"),
    )
    return ordered.withColumn("part", part).join(runs, [tree, "part"]).withColumn(
        "place", F.col("at") + F.col("shift")
    ).drop("at", "part", "shift")
