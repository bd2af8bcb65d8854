"""Similar titles: clean-up, the enriched pair report, and the lookup of copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.fixed_values import PARTNER_NAMES, SIMILAR_TITLE_COLUMNS, STOP_TITLES
from refsieve.functions import text
from refsieve.operators.copies import members
from refsieve.operators.grouping import not_in, sum_over
from refsieve.operators.sets import join_partner
from refsieve.session import stored


def clean_titles(
    df: DataFrame, stop_titles: Sequence[str] = tuple(STOP_TITLES), order: str | None = None
) -> DataFrame:
    """``DOI, title`` with cleaned titles, without stop titles, one row per DOI.

    Of several rows of one DOI the last by ``order`` stays, or the greatest title without it.
    """
    cleaned = df.filter(F.col("title").isNotNull()).withColumn(
        "title", text.clean_title(F.col("title"))
    )
    kept = not_in(cleaned, "title", stop_titles)
    last = F.max_by("title", order) if order else F.max("title")
    return kept.groupBy("DOI").agg(last.alias("title"))


def similar_title_report(articles: DataFrame, pairs: DataFrame, titles: DataFrame) -> DataFrame:
    """For every work the titles like its own, with fields of both works and counts.

    ``pairs`` runs over distinct titles or vectors, with copies as rows of an id with itself;
    ``titles`` has one row per work, ``DOI, title``, where ``title`` is the value that ``pairs``
    compares. A row is a work and an id that stands for ``n_partners`` works with one title, for
    the work's own title all others; so rows grow with the works, never with pairs of copies.
    ``DOI_counts`` and ``container_title_counts`` add up partners, as a full listing would count
    its rows: pairs of different titles once, under the first, and copies under both.
    """
    groups = stored(members(titles, "title").withColumnRenamed("member", "DOI"), "members")
    same = F.col("id1") == F.col("id2")
    partners = F.when(same, F.col("copies1") - 1).otherwise(F.col("copies2"))
    keyed = pairs.select("id1", F.col("id2").alias("DOI2"), "score", "copies1", "copies2", partners.alias("n_partners"))
    named = titles.select(F.col("DOI").alias("DOI2"), F.col("title").alias("doi2_title"))
    partner = join_partner(named, articles, PARTNER_NAMES)
    # All works of a title have the same partners: they are summed before the works are looked up.
    found = sum_over(keyed, "id1", "n_partners", "DOI_counts").join(partner, "DOI2")
    works = articles.select(SIMILAR_TITLE_COLUMNS).join(groups, "DOI")
    sums = found.groupBy("id1").agg(F.sum("n_partners").alias("_n"))
    contained = works.select("container_title", "id").join(sums, F.col("id") == F.col("id1"))
    totals = contained.groupBy(F.col("container_title").alias("_key")).agg(F.sum("_n").alias("container_title_counts"))
    report = works.join(found, F.col("id") == F.col("id1")).drop("id", "id1")
    return report.join(totals, F.col("container_title") == F.col("_key"), "left").drop("_key")
