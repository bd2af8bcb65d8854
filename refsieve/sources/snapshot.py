"""Scans: snapshot records, ignore lists, result tables, earlier reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refsieve.schema import IGNORE_COUNTRIES, IGNORE_TOKENS, RESULT, WORK

BAD_LINE = "_bad_line"


def read_works(spark: SparkSession, path: str | list[str], schema: T.StructType = WORK) -> DataFrame:
    """Snapshot of one JSON record per line; pass a narrower schema to parse fewer fields."""
    return spark.read.schema(schema).json(path)


def read_lines(
    spark: SparkSession, path: str | list[str], schema: T.StructType = WORK, tasks: int | None = None
) -> DataFrame:
    """The snapshot with the text of each line that is no such record in the column ``BAD_LINE``.

    A compressed file is read by one task, whatever its size; ``tasks`` deals its lines over that
    many before they are parsed. Blank lines are skipped.
    """
    lines = spark.read.text(path).filter(F.col("value").rlike(r"\S"))
    if tasks is not None:
        lines = lines.repartition(tasks)
    marked = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
    record = F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE})
    return lines.select(F.inline(F.array(record)))


def good_lines(lines: DataFrame) -> DataFrame:
    """Records of ``read_lines``, as ``read_works`` gives them."""
    return lines.filter(F.col(BAD_LINE).isNull()).drop(BAD_LINE)


def bad_lines(lines: DataFrame) -> DataFrame:
    """Lines of ``read_lines`` that are no record, as text in ``value``."""
    return lines.filter(F.col(BAD_LINE).isNotNull()).select(F.col(BAD_LINE).alias("value"))


def read_items(spark: SparkSession, path: str | list[str], schema: T.StructType = WORK) -> DataFrame:
    """Snapshot files that each hold one document with an ``items`` array."""
    document = T.StructType([T.StructField("items", T.ArrayType(schema))])
    return (
        spark.read.schema(document)
        .option("multiLine", True)
        .json(path)
        .select(F.inline("items"))
    )


def read_ignore_tokens(
    spark: SparkSession, tokens: str | None = None, countries: str | None = None
) -> DataFrame:
    """Ignore lists as one column ``word`` of distinct lower-case entries."""
    lists = [
        spark.read.schema(schema).json(path).select(F.explode(schema.fieldNames()[0]).alias("word"))
        for path, schema in ((tokens, IGNORE_TOKENS), (countries, IGNORE_COUNTRIES))
        if path is not None
    ]
    if not lists:
        return spark.createDataFrame([], "word string")
    words = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    return words.select(F.lower("word").alias("word")).distinct()


def read_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(RESULT).parquet(path)


def read_report(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """A report written earlier as CSV with a header."""
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .schema(schema)
        .csv(path)
    )
