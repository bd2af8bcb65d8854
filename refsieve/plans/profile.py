"""Exploration of works and results: term counts, reference shapes, distributions, top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.fixed_values import BY_ISSN_AND_TITLE
from refsieve.functions import text
from refsieve.functions.text import separated
from refsieve.operators.grouping import ascending, descending, differs
from refsieve.plans.reports import JOURNAL_ARTICLE


def term_counts(
    df: DataFrame, column: str, stop: DataFrame | None = None, more_than: int = 0
) -> DataFrame:
    """Occurrences of each lower-case term without digits and stop words.

    Occurrences are added up before the stop words are taken out, so the anti join sees each
    term once.
    """
    found = df.select(F.explode(text.terms(text.strip_digits(F.col(column)))).alias("term"))
    counts = found.groupBy("term").agg(F.count("*").alias("n"))
    if stop is not None:
        words = stop.select(F.col("word").alias("term")).distinct()
        counts = counts.join(words, "term", "left_anti")
    return counts.filter(F.col("n") > more_than)


def vocabulary(df: DataFrame, column: str, stop: DataFrame | None = None) -> DataFrame:
    return term_counts(df, column, stop).select("term")


def reference_profile(df: DataFrame) -> DataFrame:
    """How many references of a work are free text, have an author, only a DOI, or neither."""

    def how_many(condition):
        return F.coalesce(F.array_size(F.filter("reference", condition)), F.lit(0))

    def bare(r):
        return r["unstructured"].isNull() & r["author"].isNull()

    return df.select(
        "DOI",
        how_many(lambda r: r["unstructured"].isNotNull()).alias("unstructured"),
        how_many(lambda r: r["unstructured"].isNull()).alias("structured"),
        how_many(lambda r: r["author"].isNotNull()).alias("authors"),
        how_many(lambda r: bare(r) & r["DOI"].isNotNull()).alias("only_doi"),
        how_many(lambda r: bare(r) & r["DOI"].isNull()).alias("other"),
    )


def share_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("percentage").agg(F.count("*").alias("freq")).orderBy("percentage")


def work_type_counts(
    df: DataFrame, types: Sequence[str] | None = None, columns: Sequence[str] = ("DOI",)
) -> DataFrame:
    """Non-null values of the chosen columns per work type, fewest first."""
    df = df.dropna(subset=["work_type"])
    if types is not None:
        df = df.filter(F.col("work_type").isin(list(types)))
    counted = df.groupBy("work_type").agg(*[F.count(c).alias(c) for c in columns])
    return counted.orderBy(columns[0], "work_type")


def work_types(df: DataFrame) -> DataFrame:
    return df.select("work_type").distinct()


def most_common_tokens(df: DataFrame, columns: Sequence[str] = tuple(BY_ISSN_AND_TITLE)) -> DataFrame:
    """Tokens that reach the maximum of any of the count columns."""
    per_token = df.groupBy("separated_tokens").agg(*[F.max(c).alias(c) for c in columns])
    reaches = F.lit(False)
    for column in columns:
        highest = per_token.agg(F.max(column)).scalar()
        reaches = reaches | F.coalesce(F.col(column) == highest, F.lit(False))
    return per_token.filter(reaches).select("separated_tokens")


def token_list(df: DataFrame, exclude: str) -> DataFrame:
    return df.filter(differs("separated_tokens", exclude)).select("separated_tokens").distinct()


def fraction_distribution(df: DataFrame, work_type: str, token: str) -> DataFrame:
    """How often each token share occurs for one token in one work type."""
    chosen = df.filter((F.col("work_type") == work_type) & (F.col("separated_tokens") == token))
    return (
        chosen.groupBy("token_frac_refs")
        .agg(F.count("*").alias("n"))
        .orderBy(*descending("token_frac_refs"))
    )


def token_authors(df: DataFrame, token: str, k: int = 3) -> DataFrame:
    """Author lists that write most journal articles dominated by one token."""
    chosen = df.filter(
        (F.col("work_type") == JOURNAL_ARTICLE)
        & (F.col("separated_tokens") == token)
        & F.col("author").isNotNull()
    )
    return (
        chosen.groupBy(separated(F.col("author")).alias("sep_author"))
        .agg(F.count("DOI").alias("n"))
        .orderBy(*descending("n"), *ascending("sep_author"))
        .limit(k)
    )


def top_repeated_titles(pairs: DataFrame, k: int = 50) -> DataFrame:
    """Titles that open the most pairs of score 1.

    ``pairs`` carries the number of work pairs behind each row, so copies are added up rather
    than listed.
    """
    exact = pairs.filter(F.round("score", 9) >= 1.0)
    return (
        exact.groupBy("title1")
        .agg(F.sum("n_pairs").alias("n"))
        .orderBy(*descending("n"), *ascending("title1"))
        .limit(k)
    )
