"""The snapshot job as a program.

    spark-submit refsieve/job.py SNAPSHOT OUTPUT [--ignore-tokens FILE] [--countries FILE] [--tasks N]

Reads JSON-lines works, writes the works that one token dominates to a new folder below OUTPUT, and
prints that folder. Lines that are no record are counted in the same pass; where there are any, a
second one writes them as text beside the result. Every path may be of any store that Spark reads.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from refsieve.operators import tokens
from refsieve.operators.tokens import MIN_FRACTION
from refsieve.plans.dominant import dominant_token_works
from refsieve.session import SETTINGS
from refsieve.sources import sinks, snapshot


def run(
    spark: SparkSession,
    snapshot_path: str,
    output: str,
    ignore_tokens: str | None = None,
    countries: str | None = None,
    min_fraction: float = MIN_FRACTION,
    tasks: int | None = None,
) -> str:
    """The folder of the result table; that of bad lines, if any, ends in ``.bad`` instead."""
    ignore = snapshot.read_ignore_tokens(spark, ignore_tokens, countries)
    stop = tokens.stop_lists(tokens.stop_table(spark, ignore))
    lines = snapshot.read_lines(spark, snapshot_path, tasks=tasks)
    seen = Observation("snapshot lines")
    observed = lines.observe(seen, F.count(snapshot.BAD_LINE).alias("bad"))
    path = sinks.write_results(dominant_token_works(snapshot.good_lines(observed), stop, min_fraction), output)
    if seen.get["bad"]:
        snapshot.bad_lines(lines).write.text(bad_path(path))
    return path


def bad_path(result: str) -> str:
    """Where the bad lines of the run with this result lie."""
    return result.removesuffix(".parquet") + ".bad"


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Works whose references one token dominates.")
    parser.add_argument("snapshot", help="folder or file of works, one JSON object per line")
    parser.add_argument("output", help="folder below which a folder for this run is made")
    parser.add_argument("--ignore-tokens", help="JSON file with words to leave out")
    parser.add_argument("--countries", help="JSON file with country names to leave out")
    parser.add_argument("--min-fraction", type=float, default=MIN_FRACTION)
    parser.add_argument("--tasks", type=int, help="deal lines over so many tasks, for compressed files")
    given = parser.parse_args(arguments)
    builder = SparkSession.builder.appName("refsieve")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    print(run(
        spark, given.snapshot, given.output, given.ignore_tokens, given.countries, given.min_fraction, given.tasks
    ))


if __name__ == "__main__":
    main()
