"""Work records, dimensions and word lists derived from the given tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refsieve.functions.gate import once
from refsieve.functions.text import TERM, WORD
from refsieve.schema import REFERENCE, WORK


SCAN_PARTITIONS = "spark.workload.scanPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table.

    The given documents lie in one row group, which Spark reads in one task, whatever the cores. A
    session may set ``SCAN_PARTITIONS`` to deal them out; tables of many row groups need no such
    setting, and no size is looked at.
    """
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    parts = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(parts)) if parts and name == "documents" else df


def _marked(part, i):
    """Markup, a DOI prefix or a URL on some references, a mere URL in place of others, so that
    cleaning has work to do."""
    return (
        F.when(i % 33 == 21, F.concat(F.lit("http://ref.example/"), i))
        .when(i % 11 == 4, F.concat(F.lit("doi:10.1000/182 "), part))
        .when(i % 11 == 7, F.concat(F.lit("<i>Vol. 12</i> &amp; "), part))
        .when(i % 11 == 9, F.concat(F.lit("http://ref.example/x "), part))
        .otherwise(part)
    )


def _first_part(text):
    """The first sentence with a term, without splitting the rest of the text."""
    found = F.trim(F.regexp_extract(text, r"(?:^|[.\n])([^.\n]*?" + WORD + r"{2}[^.\n]*)", 1))
    return F.when(found != "", found)


def works(spark: SparkSession, sf_dir: str, references: bool = True) -> DataFrame:
    """One work per document: its sentences become the references.

    Without ``references`` the fields that need all sentences, the references and their number, are
    null.
    """
    docs = table(spark, sf_dir, "documents")
    doc, lang = F.col("doc_id"), F.col("lang")
    # ``F.trim`` itself would take the position as its second argument.
    parts = F.filter(
        F.transform(F.split("text", r"[.\n]+"), lambda p: F.trim(p)),
        lambda p: p.rlike(TERM),
    )
    if not references:
        parts = F.array(_first_part("text"))
    docs = docs.select("*", once(parts.alias("parts")))

    def planted(part, i):
        return F.when(
            (doc % 4 == 0) & ((i % 10 < 7) | (doc % 36 == 0)),
            F.concat(F.lit("Autor"), lang, F.lit(" "), part),
        ).otherwise(part)

    def reference(part, i0):
        i = i0 + 1
        body = _marked(planted(part, i), i)
        is_doi, is_author = i % 10 == 0, (i % 10 != 0) & (i % 3 == 0)
        return F.struct(
            F.concat(F.lit("ref"), i).alias("key"),
            F.when(~is_doi & ~is_author, body).alias("unstructured"),
            F.when(is_author, body).alias("author"),
            F.when(is_doi, F.concat(F.lit("10.5555/r"), i)).alias("DOI"),
        ).cast(REFERENCE)

    first = F.get("parts", F.lit(0))
    title = (
        F.when(doc % 19 == 0, None)
        .when(doc % 17 == 0, F.lit(""))
        .when(doc % 12 == 0, planted(first, F.lit(1)))
        .otherwise(first)
    )
    family = F.when(doc % 8 == 0, F.concat(F.lit("Autor"), lang)).otherwise(
        F.regexp_extract("text", TERM, 0)
    )
    container = (
        F.when(doc % 16 == 0, F.concat(F.lit("Autor"), lang, F.lit(" Annals")))
        .when(doc % 5 < 2, F.concat(F.lit("Journal "), lang, F.lit(" "), "source"))
        .otherwise(F.concat(F.lit("Journal "), lang))
    )
    issns = F.filter(
        F.array(
            F.when(doc % 7 != 0, F.struct(
                F.concat(F.lit("P"), "source").alias("value"), F.lit("print").alias("type"))),
            F.when(doc % 9 != 0, F.struct(
                F.concat(F.lit("E"), "source").alias("value"), F.lit("electronic").alias("type"))),
        ),
        lambda i: i.isNotNull(),
    )
    kind = F.floor(doc / 8) % 10
    work_type = (
        F.when(kind <= 4, "journal-article")
        .when(kind == 5, "other")
        .when(kind == 6, "book")
        .when(kind == 7, "book-chapter")
        .when(kind == 8, "proceedings-article")
        .otherwise("posted-content")
    )
    size = F.array_size("parts")
    dated = F.struct(
        F.array(F.array((2000 + doc % 25).cast("int"), (1 + doc % 12).cast("int"))).alias(
            "date-parts"
        )
    )
    columns = {
        "DOI": F.concat(F.lit("10.5555/"), doc),
        "type": work_type,
        "title": F.when(title.isNotNull(), F.array(title)),
        "author": F.when(
            doc % 13 != 0,
            F.array(F.struct(family.alias("family"), F.substring("source", 1, 4).alias("given"))),
        ),
        "container-title": F.when(doc % 11 != 0, F.array(container)),
        "issn-type": F.when(F.array_size(issns) > 0, issns),
        "member": F.col("source"),
        "prefix": F.lit("10.5555"),
        "reference-count": (size + doc % 5).cast("int") if references else F.lit(None),
        "is-referenced-by-count": (F.col("n_chars") % 97).cast("int"),
        "deposited": dated,
        "published": dated,
        "reference": F.when(size > 0, F.transform("parts", reference)) if references else F.lit(None),
    }
    return docs.select([columns[f.name].cast(f.dataType).alias(f.name) for f in WORK.fields])


def ignore_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignore list: nation names as countries, first words of benchmark items as tokens."""
    countries = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("word"))
    tokens = table(spark, sf_dir, "benchmark").select(
        F.lower(F.regexp_extract("text", TERM, 0)).alias("word")
    )
    return countries.unionByName(tokens).filter(F.col("word") != "").distinct()


def journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals by ISSN with their total number of DOIs; one source in six is unknown."""
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    per_source = (
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .agg((F.count("*") * 10).alias("total_dois"))
        .filter(number % 6 != 5)
    )
    title = F.concat(F.lit("Quarterly "), (number % 15).cast("string"))
    return per_source.select(
        F.explode(F.array(F.concat(F.lit("P"), "source"), F.concat(F.lit("E"), "source"))).alias(
            "issn"
        ),
        title.alias("title"),
        "total_dois",
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens known to be persons."""
    return (
        table(spark, sf_dir, "documents")
        .filter(F.col("lang") != "en")
        .select(F.concat(F.lit("Autor"), "lang").alias("name"))
        .distinct()
    )


def toxic_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the works whose document is labelled toxic."""
    return (
        table(spark, sf_dir, "labels")
        .filter(F.col("toxic") == 1)
        .select(F.concat(F.lit("10.5555/"), "doc_id").alias("DOI"))
        .distinct()
    )
