"""The report frame: result table plus flat ISSNs, joined tokens, shares and group counts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.functions import text, works
from refsieve.session import stored

COUNTS = {
    "token_counts_by_container_title": ["separated_tokens", "container_title"],
    "token_counts_by_print_issn": ["separated_tokens", "print_issn"],
    "token_counts_by_electronic_issn": ["separated_tokens", "electronic_issn"],
    "container_title_work_type_counts": ["container_title", "work_type"],
}


def flatten_results(results: DataFrame) -> DataFrame:
    """Result table with scalar ISSN, token and container columns and the processed share."""
    issn = F.col("issn")
    return (
        results.withColumn("print_issn", works.issn_of_type(issn, "print"))
        .withColumn("electronic_issn", works.issn_of_type(issn, "electronic"))
        .withColumn("separated_tokens", text.separated_tokens(F.col("token_vocabulary")))
        .withColumn("container_title", works.container_name(F.col("container_title")))
        .withColumn(
            "ref_pge",
            F.try_divide(F.col("cleaned_references_length"), F.col("total_reference_length")),
        )
        .drop("issn")
    )


def _group_counts(frame: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """``keys`` and the requested counts, a row per combination of all keys.

    One shuffle counts the combinations and all groups as grouping sets of the key columns. What it
    gives is read once per count, so it is written once.
    """
    sets = {tuple(keys)} | {tuple(COUNTS[name]) for name in counts}
    grouped = stored(
        frame.select("DOI", *keys).groupingSets([list(s) for s in sorted(sets)], *keys)
        .agg(F.grouping_id().alias("_set"), F.count("DOI").alias("_n")),
        "group_counts",
    )

    def members(own: Iterable[str]) -> DataFrame:
        left_out = int("".join("0" if key in own else "1" for key in keys), 2)
        return grouped.filter(F.col("_set") == left_out)

    counted = members(keys).select(*keys)
    for name in counts:
        own = COUNTS[name]
        counted = counted.join(members(own).dropna(subset=own).select(*own, F.col("_n").alias(name)), own, "left")
    return counted


def prepare(results: DataFrame, counts: Iterable[str] = tuple(COUNTS)) -> DataFrame:
    """Add the requested group counts; a report asks only for those it shows.

    The counts are joined to the slim table of key combinations, so that wide rows are shuffled
    once, however many counts there are. A row with a null key has no count.
    """
    frame, counts = flatten_results(results), list(counts)
    if not counts:
        return frame
    keys = sorted({key for name in counts for key in COUNTS[name]})
    counted = _group_counts(frame, keys, counts)
    counted = counted.select(*[F.col(key).alias(f"_{key}") for key in keys], *counts)
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys])
    return frame.join(counted, same, "left").select(*frame.columns, *counts)
