"""Exact similarity self-join over token sets by prefix filtering.

Tokens of every record are put in one global order, rarest first. A similarity threshold then
fixes, per record, how many leading tokens suffice: two records that reach the threshold share a
token within their prefixes. Joining prefixes therefore finds every pair and never compares
records that share only common tokens.

The joined rows are slim, an id and a few numbers per prefix token, so that a long record costs
in proportion to its length; vectors and texts are joined to the candidates afterwards. The records
of a token are dealt over blocks, and every two blocks meet in a cell of their own: a record goes to
as many cells as its token has blocks, and no cell holds more than two blocks, however many records
a token leads. The join is a sort-merge join by hint, since Spark would judge the exploded rows by
the size of the table before it was exploded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 20_000

Side = Callable[[str], Column]


def prefix_cells(
    records: DataFrame, numbers: Sequence[str], details: Sequence[str] = (), rows_per_block: int | None = None
) -> DataFrame:
    """A row per record, prefix token and cell: ``token, low, high`` name the cell."""
    rows = records.select("id", *numbers, F.posexplode("prefix").alias("pos", "_p")).select(
        "id", *numbers, "pos", *[F.col(f"_p.{d}").alias(d) for d in details],
        F.col("_p.token").alias("token"),
        (F.floor(F.col("_p.freq") / (rows_per_block or ROWS_PER_BLOCK)) + 1).cast("int").alias("_blocks"),
    )
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    return dealt.select("*", other).select(
        "token", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"),
        "id", "pos", "block", *numbers, *details,
    )


def candidate_pairs(
    records: DataFrame,
    numbers: Sequence[str],
    possible: Callable[[Side, Side], Column],
    details: Sequence[str] = (),
    rows_per_block: int | None = None,
) -> DataFrame:
    """Distinct candidate pairs ``id1 < id2``.

    ``records`` has ``id``, ``prefix`` (``array<struct<freq, token, ...>>``, rarest first, ``freq``
    the number of records with the token) and the columns ``numbers``. ``possible`` states a cheap
    condition on a pair from those columns, the fields ``details`` of the prefix entries, and
    ``pos``, the place of the shared token. It must hold for the first token that a pair shares.
    """
    cell, carried = ["token", "low", "high"], ["id", "pos", "block", *numbers, *details]
    cells = prefix_cells(records, numbers, details, rows_per_block)
    left, right = (
        cells.select(*cell, *[F.col(c).alias(f"{c}{side}") for c in carried]) for side in "12"
    )

    def first(column: str) -> Column:
        return F.col(f"{column}1")

    def second(column: str) -> Column:
        return F.col(f"{column}2")

    # Pairs within one block belong to the cell of that block with itself.
    here = (F.col("low") == F.col("high")) | (F.col("block1") != F.col("block2"))
    met = (
        left.hint("merge")
        .join(right, cell)
        .filter((F.col("id1") < F.col("id2")) & here & possible(first, second))
    )
    return met.select("id1", "id2").distinct()


def with_both(pairs: DataFrame, records: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Candidate pairs with the payload of both records as ``*1`` and ``*2``."""
    for side in ("1", "2"):
        side_rows = records.select(
            F.col("id").alias(f"id{side}"), *[F.col(c).alias(f"{c}{side}") for c in payload]
        )
        pairs = pairs.join(side_rows, f"id{side}")
    return pairs
