"""Disk of finished stages, and rows of a batch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def freed_early(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go when the query that made them ends, not when memory is collected.

    Meant for chains of stages that each write their result to the shared folder: what a stage
    shuffled is not read again.
    """
    with _setting(spark, _CLEAN, "true"):
        yield


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, Python workers get at most ``rows`` rows at once; for rows that hold several texts."""
    with _setting(spark, _BATCH, str(rows)):
        yield


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
