"""Exact copies: many works with one title, many ids with one vector.

Similarity joins run on distinct values. A pair row stands for ``n1 * n2`` pairs of works, and a
value with ``n`` works gets one row with itself that stands for its ``n * (n - 1) / 2`` pairs.
The input has one row per work, as ``plans.titles.clean_titles`` leaves it.
``members`` says which works are behind an id, so nothing is lost and no group is ever paired
out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collapse(df: DataFrame, value: str, id_column: str = "DOI") -> DataFrame:
    """Distinct values as ``id, value, copies``; the smallest id speaks for the group."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.col(value).alias("value"))
        .agg(F.min(id_column).alias("id"), F.count("*").alias("copies"))
        .select("id", "value", "copies")
    )


def members(df: DataFrame, value: str, id_column: str = "DOI") -> DataFrame:
    """Every id with the id that speaks for its group: ``member, id``."""
    named = df.select(F.col(id_column).alias("member"), F.col(value).alias("_v"))
    return named.join(
        collapse(df, value, id_column), F.col("_v") == F.col("value"), "inner"
    ).select("member", "id")


def copy_pairs(groups: DataFrame, score: float = 1.0) -> DataFrame:
    """One row per value with copies: ``id1, id2, copies1, copies2, score, n_pairs``."""
    repeated = groups.filter(F.col("copies") > 1)
    return repeated.select(
        F.col("id").alias("id1"),
        F.col("id").alias("id2"),
        F.col("copies").alias("copies1"),
        F.col("copies").alias("copies2"),
        F.lit(score).alias("score"),
        F.expr("copies * (copies - 1) div 2").alias("n_pairs"),
    )


def counted_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of distinct values with the number of work pairs each stands for."""
    return pairs.select(
        "id1", "id2", "copies1", "copies2", "score",
        (F.col("copies1") * F.col("copies2")).alias("n_pairs"),
    )


def titled_pairs(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs with both values as ``title1`` and ``title2``."""
    for side in ("1", "2"):
        names = groups.select(F.col("id").alias(f"id{side}"), F.col("value").alias(f"title{side}"))
        pairs = pairs.join(names, f"id{side}")
    return pairs
