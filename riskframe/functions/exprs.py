"""Small column helpers that pin down how missing values behave.

Missing values are NULL inside a plan. The sentinel -999 is written only where a
feature definition asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = -999.0
UNEMPLOYED_DAYS = 365243


def has(df: DataFrame, *names: str) -> bool:
    """True when every column is present; features with absent inputs are skipped."""
    return set(names) <= set(df.columns)


def flag(condition: Column) -> Column:
    """1.0 when the condition holds, 0.0 when it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def fill(value: Column, default: float = MISSING) -> Column:
    return F.coalesce(value, F.lit(default))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value, leaving NULL as NULL (greatest and least skip NULLs)."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(value.isNotNull(), bounded)


def ratio(num: Column, den: Column, otherwise: float | None = 0.0,
          above: float = 0.0, missing: float | None = MISSING) -> Column:
    """num/den where den > ``above``; ``otherwise`` elsewhere, ``missing`` for a NULL numerator."""
    value = num.cast("double") / den
    inside = value if missing is None else F.coalesce(value, F.lit(missing))
    branch = F.when(den > above, inside)
    return branch if otherwise is None else branch.otherwise(F.lit(otherwise))


def mean_if(condition: Column, value: Column) -> Column:
    return F.avg(F.when(condition, value))


def sum0(value: Column) -> Column:
    """Sum that is 0 for a group whose values are all NULL."""
    return F.coalesce(F.sum(value), F.lit(0))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes NULL, so comparisons and aggregates skip it."""
    floating = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating})


def null_to_sentinel(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Sentinel fill of numeric columns; infinities count as missing."""
    numeric = [c for c, t in df.dtypes
               if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    chosen = [c for c in (columns or numeric) if c in numeric]
    inf = float("inf")
    floating = {c for c, t in df.dtypes if t in ("double", "float")}
    filled = {}
    for c in chosen:
        value = F.col(c).cast("double")
        if c in floating:
            value = F.when(~F.isnan(c) & (F.abs(c) < inf), value)
        filled[c] = fill(value)
    return df.withColumns(filled)


def sentinel_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(MISSING)) for c in columns})
