"""Statistics of many columns through one short expression.

One aggregate per column generates methods too large for the JIT to compile. Here the
columns of a row become an array, exploded with its position, and one expression
serves all of them. Partial aggregation leaves one line per column and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = "_column"


def long_values(df: DataFrame, columns: Sequence[str | Column],
                keep: Sequence[str | Column] = ()) -> DataFrame:
    """Rows (keep..., position of the column, value as double)."""
    values = [F.col(c) if isinstance(c, str) else c for c in columns]
    return df.select(*keep, F.posexplode(F.array(*[v.cast("double") for v in values]))
                     .alias(PLACE, "value"))


def column_name(columns: Sequence[str]) -> Column:
    """Name behind a position."""
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(PLACE) + 1)


def with_feature(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(column_name(columns).alias("feature"),
                     *[F.col(c) for c in df.columns if c != PLACE])
