"""Joins of articles with pairs and set operations over keys."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_pairs(articles: DataFrame, pairs: DataFrame, key: str = "DOI") -> DataFrame:
    """Articles with the pairs they open."""
    return articles.join(pairs, key, "inner")


def join_partner(
    pairs: DataFrame, articles: DataFrame, names: Mapping[str, str], key: str = "DOI2"
) -> DataFrame:
    """Attributes of the second work of each pair, renamed by ``names``; ``DOI`` is the key."""
    partner = articles.select(
        F.col("DOI").alias(key), *[F.col(old).alias(new) for old, new in names.items()]
    )
    return pairs.join(partner, key, "inner")


def pair_attributes(
    pairs: DataFrame, articles: DataFrame, columns: Iterable[str] = ("title", "author")
) -> DataFrame:
    """Add the chosen columns of both works as ``doi1_*`` and ``doi2_*``."""
    columns = list(columns)
    for side, key in (("doi1", "DOI"), ("doi2", "DOI2")):
        pairs = join_partner(pairs, articles, {c: f"{side}_{c}" for c in columns}, key)
    return pairs


def with_ids(df: DataFrame, ids: DataFrame, key: str = "DOI") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str = "DOI") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def stack(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of all rows, by column name, on the columns both have."""
    shared = [c for c in first.columns if c in second.columns]
    return first.select(shared).unionByName(second.select(shared))


def key_difference(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys of the first table that the second lacks."""
    keys = first.select(key).dropna().distinct()
    return keys.join(second.select(key), key, "left_anti")


def key_intersection(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys that both tables hold."""
    keys = first.select(key).dropna().distinct()
    return keys.join(second.select(key), key, "left_semi")
