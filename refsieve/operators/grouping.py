"""Count-and-keep-rows, first-row and duplicate operators.

A count over a key is an aggregate joined back rather than a window: the aggregate combines
before its shuffle, and the join of the rows can be split where one key holds many of them. A
window would sort all rows of a key in one task. First-row-per-key keeps the window form, since
Spark limits ``row_number() = 1`` before its shuffle, to one row per key and task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_over(
    df: DataFrame, keys: Sequence[str], name: str, counted: str | Column = "DOI"
) -> DataFrame:
    """Add the number of non-null ``counted`` values per key group; null where a key is null."""
    keyed = df.dropna(subset=list(keys))
    counts = keyed.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.count(counted).alias(name)
    )
    matches = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys])
    return df.join(counts, matches, "left").drop(*[f"_{k}" for k in keys])


def sum_over(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` per key; null where the key is null."""
    sums = df.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias(name))
    return df.join(sums, F.col(key) == F.col("_key"), "left").drop("_key")


def keep_first(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order; nulls form one group."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


def keep_duplicated(df: DataFrame, key: str) -> DataFrame:
    """All rows whose key occurs more than once; nulls count as equal."""
    repeated = (
        df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1")
    )
    return df.join(repeated.select("_key"), F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def not_in(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose value is not listed; a null value is not listed either."""
    listed = F.col(column).isin(list(values))
    return df.filter(~F.coalesce(listed, F.lit(False)))


def differs(column: str, value: str) -> Column:
    """Inequality that holds for null."""
    return ~F.col(column).eqNullSafe(F.lit(value))


def descending(*columns: str) -> list[Column]:
    return [F.desc_nulls_last(c) for c in columns]


def ascending(*columns: str) -> list[Column]:
    return [F.asc_nulls_last(c) for c in columns]
