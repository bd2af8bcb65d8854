"""Gates on computed columns.

A filter on a computed column is pushed below the projection together with a second copy of the
expression. Emitting the value as a list of one or no rows computes it once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def passing(value: Column, condition: Callable[[Column], Column]) -> Column:
    """A generator column: ``value`` where the condition holds, no row where it does not."""
    return F.explode(F.filter(F.array(value), condition))


def worked_out(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a column of its own projection, computed once.

    What stands inside a generator or a lambda is interpreted row by row; a projection is generated code.
    The generator on top keeps later projections and filters from copying the expression.
    """
    return df.select("*", value.alias("_value")).select(
        *[F.col(f"`{c}`") for c in df.columns], once(F.col("_value").alias(name))
    )


def once(*columns: Column) -> Column:
    """A generator of named columns that later expressions read without recomputing them."""
    return F.inline(F.array(F.struct(*columns)))
