"""Journal roll-up: which journals hold the most dominated articles.

Rows are reduced to the leading journals first; everything after ``top_journals`` works on at
most ``2 * k`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refsieve.fixed_values import JOURNAL_HEADINGS
from refsieve.operators.grouping import count_over, descending, keep_first
from refsieve.plans.reports import JOURNAL_ARTICLE, fill_report_nulls, shape_report
from refsieve.session import stored

BY_ELECTRONIC = ["electronic_issn_counts", "print_issn_counts", "container_title_work_type_counts"]
BY_PRINT = ["print_issn_counts", "electronic_issn_counts", "container_title_work_type_counts"]
JOURNAL_ORDER = ["electronic_issn_counts", "container_title_work_type_counts", "print_issn"]


def _order(columns, tie: str):
    return [*descending(*columns), F.asc_nulls_last(tie)]


def journals_ranked(prepared: DataFrame) -> DataFrame:
    """One row per container title, the one with the highest ISSN counts."""
    articles = prepared.filter(F.col("work_type") == JOURNAL_ARTICLE).select(
        "DOI", "container_title", "print_issn", "electronic_issn",
        "container_title_work_type_counts", "member",
    )
    for issn in ("print_issn", "electronic_issn"):
        articles = count_over(articles, [issn], f"{issn}_counts")
    return keep_first(articles, "container_title", _order(BY_ELECTRONIC, "DOI")).drop("DOI")


def top_journals(ranked: DataFrame, k: int = 60) -> DataFrame:
    """Leading ``k`` journals by electronic and by print ISSN count, each title once."""
    leading = [
        ranked.orderBy(*_order(columns, "container_title")).limit(k)
        for columns in (BY_ELECTRONIC, BY_PRINT)
    ]
    return leading[0].unionByName(leading[1]).dropDuplicates(["container_title"])


def issn_evidence(journals: DataFrame) -> DataFrame:
    """Which ISSN speaks for a journal's count: equal counts and ISSNs that occur twice."""
    # At most a few score rows; null keys fail the test on the key.
    for short, issn in (("_e", "electronic_issn"), ("_p", "print_issn")):
        alike = F.count("*").over(Window.partitionBy(issn))
        journals = journals.withColumn(short, F.when(F.col(issn).isNotNull(), alike))
    titles = F.col("container_title_work_type_counts")

    def holds(condition):
        return F.coalesce(condition, F.lit(False))

    return journals.withColumns(
        {
            "eq_e": holds(titles == F.col("electronic_issn_counts")),
            "eq_p": holds(titles == F.col("print_issn_counts")),
            "dup_e": holds(F.col("_e") > 1),
            "dup_p": holds(F.col("_p") > 1),
        }
    ).drop("_e", "_p")


def actual_counts(evidence: DataFrame) -> DataFrame:
    """The count to report, by the strongest evidence; 0 without any."""
    count = (
        F.when(F.col("dup_p") & ~F.col("dup_e"), F.col("print_issn_counts"))
        .when(F.col("dup_e"), F.col("electronic_issn_counts"))
        .when(F.col("eq_e"), F.col("electronic_issn_counts"))
        .when(F.col("eq_p"), F.col("print_issn_counts"))
        .otherwise(F.lit(0))
    )
    return evidence.withColumn("actual_counts", count)


def unique_journals(journals: DataFrame) -> DataFrame:
    """First journal of each electronic ISSN, and the others that bear a print ISSN.

    Of those others, the first one per electronic ISSN is dropped; further ones stay.
    """
    order = _order(JOURNAL_ORDER, "container_title")
    has_e, has_p = F.col("electronic_issn").isNotNull(), F.col("print_issn").isNotNull()
    by_issn = Window.partitionBy("electronic_issn").orderBy(*order)
    journals = journals.withColumn("_first", has_e & (F.row_number().over(by_issn) == 1))
    others = Window.partitionBy("electronic_issn", "_first", has_p).orderBy(*order)
    journals = journals.withColumn("_other", F.row_number().over(others))
    kept = F.col("_first") | (has_p & (~has_e | (F.col("_other") > 1)))
    return journals.filter(kept).drop("_first", "_other")


def with_journal_info(journals: DataFrame, info: DataFrame) -> DataFrame:
    """Add title and total DOI count from the journals table by ISSN, electronic first.

    Of several rows of an ISSN the one with the most DOIs counts, then the greatest title.
    """
    issn = F.coalesce(F.nullif("electronic_issn", F.lit("")), F.nullif("print_issn", F.lit("")))
    best = F.max(F.struct("total_dois", "title")).alias("best")
    info = info.groupBy(F.col("issn").alias("_issn")).agg(best).select(
        "_issn", F.col("best.title").alias("journal_title"), F.col("best.total_dois").alias("total_dois")
    )
    return (
        journals.withColumn("_lookup", issn)
        .join(info, F.col("_lookup") == F.col("_issn"), "left")
        .drop("_lookup", "_issn")
    )


def journal_report(prepared: DataFrame, info: DataFrame, k: int = 60) -> DataFrame:
    """Leading journals with their share of dominated DOIs; one row per journal title."""
    # Sorted in two ways below: written once instead.
    ranked = stored(journals_ranked(prepared), "journals")
    counted = actual_counts(issn_evidence(top_journals(ranked, k)))
    described = with_journal_info(unique_journals(counted), info)
    share = F.round(F.try_divide(F.col("actual_counts"), F.col("total_dois")) * 100, 2)
    described = described.withColumn("doi_pge", share)
    order = [F.desc("actual_counts"), F.asc_nulls_last("container_title")]
    named = keep_first(described, "journal_title", order)
    filled = fill_report_nulls(named, ["journal_title", "total_dois", "doi_pge"])
    return shape_report(filled.orderBy(*order), list(JOURNAL_HEADINGS), JOURNAL_HEADINGS)
