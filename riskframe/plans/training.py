"""The training frame: applications joined with one aggregate per child table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import MISSING, flag, nan_to_null
from riskframe.operators import history
from riskframe.operators.wide import PLACE, column_name, long_values
from riskframe.session import cut_lineage
from riskframe.sources.schema import CHILD_PREFIXES, COUNT_COLUMNS, KEY, TARGET

# Aggregates that are 0 for an applicant without rows in the table.
ZERO_WHEN_ABSENT = [
    "bureau_cnt", "bureau_active_cnt", "bureau_closed_cnt", "bureau_overdue_cnt",
    "bureau_amt_credit_mean", "bureau_overdue_sum", "bureau_prolong_sum",
    "bureau_recent_openings", "bureau_days_since_last_credit",
    "prev_cnt", "prev_approved_cnt", "prev_refused_cnt", "prev_cancelled_cnt",
    "prev_amt_annuity_mean", "prev_amt_down_payment_mean",
    "pos_cnt", "pos_overdue_cnt", "inst_cnt", "inst_late_cnt", "cc_cnt",
]


def joined_frame(tables: dict[str, DataFrame], sequences: bool = True,
                 histories: bool = False) -> DataFrame:
    """Left joins of the child aggregates.

    Every aggregate has one row per applicant, so no join can multiply rows, and all
    are partitioned by the applicant key already. ``histories`` also returns the
    windowed, status and habit features, which come from the same passes. With ``sequences`` the
    instalments are written once, because two passes read them.
    """
    bureau, prev = tables["bureau"], tables["previous_application"]
    inst, cc = tables["installments"], tables["credit_card"]
    balances = history.gathered_balances(tables["bureau_balance"]) if sequences else None
    if sequences:
        paid = history.instalment_history(cut_lineage(inst.select(
            KEY, history.DUE, history.ENTRY, "AMT_INSTALMENT", "AMT_PAYMENT"), drop_shuffles=True), histories)
    else:
        paid = history.instalment_features(inst) if histories else history.instalment_summary(inst)
    if histories:
        parts = [
            history.bureau_features(bureau, tables["bureau_balance"], balances).drop(
                *history.TIME_COLUMNS),
            history.previous_features(prev), history.pos_summary(tables["pos_cash"]),
            paid, history.card_features(cc)]
    else:
        parts = [history.bureau_summary(bureau, tables["bureau_balance"], balances),
                 history.previous_summary(prev), history.pos_summary(tables["pos_cash"]),
                 paid, history.card_summary(cc)]
    frame = tables["application"]
    for part in parts:
        frame = frame.join(part, KEY, "left")
    if sequences:
        # order-dependent features stand last
        frame = frame.select(*[c for c in frame.columns if c not in history.ORDERED_COLUMNS], *history.ORDERED_COLUMNS)
    frame = frame.fillna(0, [c for c in ZERO_WHEN_ABSENT if c in frame.columns])
    if histories:
        frame = frame.fillna({c: v for c, v in history.ABSENT.items() if c in frame.columns})
    return frame


def presence_flags(df: DataFrame) -> DataFrame:
    balances = (flag(F.col("bureau_bbal_cnt_mean") > 0) if "bureau_bbal_cnt_mean" in df.columns
                else F.lit(0.0))
    return df.withColumns({"cc_has_records": flag(F.col("cc_cnt") > 0).cast("int"),
                           "bureau_has_bbal": balances.cast("int")})


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = (KEY, TARGET)) -> list[str]:
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes if t in kinds and c not in exclude]


def sentinel_child_columns(df: DataFrame) -> DataFrame:
    """Sentinel for missing child aggregates; counts are exempt."""
    chosen = [c for c in numeric_columns(df)
              if c.startswith(CHILD_PREFIXES) and c not in COUNT_COLUMNS]
    return df.fillna(MISSING, chosen)


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_null, missing_rate) for every column, in one pass."""
    absent = [F.col(c).isNull() for c in df.columns]
    counts = long_values(df, absent).groupBy(PLACE).agg(
        F.count("*").alias("n_rows"), F.sum("value").cast("long").alias("n_null"))
    return counts.select(column_name(df.columns).alias("column"), "n_rows", "n_null",
                         (F.col("n_null") / F.col("n_rows")).alias("missing_rate"))


def drop_sparse_columns(df: DataFrame, most_missing: float = 0.60) -> DataFrame:
    """Drop columns with more than the given share of NULLs."""
    rows = missing_counts(df).collect()
    needed = math.ceil((1.0 - most_missing) * rows[0]["n_rows"]) if rows else 0
    return df.drop(*[r["column"] for r in rows if r["n_rows"] - r["n_null"] < needed])


def training_frame(tables: dict[str, DataFrame], drop_sparse: bool = True,
                   sequences: bool = True) -> DataFrame:
    """One row per applicant, TARGET kept as a column, numeric columns without NULLs."""
    if TARGET not in tables["application"].columns:
        raise KeyError(f"{TARGET} is required")
    frame = sentinel_child_columns(presence_flags(nan_to_null(joined_frame(tables, sequences))))
    if drop_sparse:
        # counting NULLs reads every column; the child aggregates must not run twice
        frame = drop_sparse_columns(cut_lineage(frame, drop_shuffles=True))
    return frame.fillna(MISSING, numeric_columns(frame))
