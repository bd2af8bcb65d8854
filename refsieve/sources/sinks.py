"""Sinks: result parquet in a folder per run, reports as CSV with a header."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refsieve.functions.text import separated


def run_path(root: str, now: datetime | None = None) -> str:
    """A folder name that sorts by time and is never given twice."""
    stamp = (now or datetime.now(UTC)).strftime("%Y%m%d-%H%M%S")
    return f"{root.rstrip('/')}/run-{stamp}-{uuid.uuid4().hex[:8]}.parquet"


def write_results(df: DataFrame, root: str, now: datetime | None = None) -> str:
    """Write a result table below ``root`` and return the folder it went to."""
    path = run_path(root, now)
    df.write.parquet(path)
    return path


def flat(df: DataFrame) -> DataFrame:
    """Lists of strings as comma-separated text; CSV holds no arrays."""
    return df.select(
        [
            separated(F.col(f"`{field.name}`")).alias(field.name)
            if isinstance(field.dataType, T.ArrayType)
            else F.col(f"`{field.name}`")
            for field in df.schema.fields
        ]
    )


def write_report(df: DataFrame, path: str) -> str:
    """Write a report as a folder of CSV files, one per partition, each with the header."""
    flat(df).write.option("header", True).option("escape", '"').csv(path)
    return path
