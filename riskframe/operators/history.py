"""Per-applicant aggregates of the child tables.

A ``..._features`` function computes all features of a table in one ``groupBy().agg``.
The smaller functions select from it, and Catalyst prunes aggregates nobody reads. All of them combine partially before the
shuffle, so one applicant with very many rows costs no more than its partial rows.
Order-dependent features use running totals in day chunks, see :mod:`prefix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.exprs import MISSING, clip, fill, flag, mean_if, sum0
from riskframe.sources.schema import KEY

DELINQUENT = ["1", "2", "3", "4", "5"]
CLOSED = ["C", "X"]


def _severity(closed: int) -> Column:
    """Status text to number; ``closed`` is the code of C and X."""
    status = F.col("STATUS")
    return F.when(status.isin(CLOSED), closed).when(
        status.isin(["0", *DELINQUENT]), status.try_cast("int"))


def _mean3(name: str) -> Column:
    """Mean rounded half-even to 3 digits; the inner rounding removes summation noise."""
    return F.bround(F.round(F.avg(name), 9), 3)


#: Rows of keys that share a hash, up to which they are gathered in one task.
GATHERED_ROWS = 1_000_000
_HASHES = 1 << 16


def _gathered(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows dealt by key, and the rows of keys with too many rows for that, if there are any.

    Where a key has few rows, they take less room in a shuffle than partial aggregates of many columns, and one
    shuffle serves every aggregate and window of the key. Rows without a key are left out.
    """
    rows, hashed = rows.where(F.col(key).isNotNull()), F.pmod(F.xxhash64(key), F.lit(_HASHES))
    sizes = rows.groupBy(hashed.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    hot = [r["h"] for r in sizes.where(F.col("n") > GATHERED_ROWS).collect()]
    if not hot:
        return rows.repartition(key), None
    return rows.where(~hashed.isin(hot)).repartition(key), rows.where(hashed.isin(hot))


def gathered_balances(bbal: DataFrame) -> DataFrame:
    """:func:`loan_balances` of rows dealt by loan; loans with very many rows combine partially as there."""
    few, many = _gathered(bbal.select("SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS"), "SK_ID_BUREAU")
    loans = loan_balances(few)
    return loans if many is None else loans.unionByName(loan_balances(many))


def loan_balances(bbal: DataFrame, key: str = "SK_ID_BUREAU") -> DataFrame:
    """Monthly balances to one row per loan.

    The one pass over the largest table. It yields the windowed delinquency rates and,
    as sums and extremes that can be combined later, all that the applicant-level
    status features need. So only loan rows, never months, travel to the applicant.
    """
    month, status = F.col("MONTHS_BALANCE"), F.col("STATUS")
    dpd = flag(status.isin(DELINQUENT))
    severity, code = _severity(0), _severity(-1)
    recent6, prior6 = mean_if(month >= -6, dpd), mean_if(month < -6, dpd)
    late12 = mean_if(month.between(-12, -7), dpd)
    at = F.struct(month.alias("m"), code.alias("s"))
    return bbal.groupBy(key).agg(
        F.count(month).alias("bbal_cnt"),
        F.avg(dpd).alias("bbal_dpd_rate"),
        F.stddev_samp(dpd).alias("bbal_dpd_rate_std"),
        F.max(severity).alias("bbal_max_severity"),
        F.count_if(~status.isin(CLOSED)).alias("bbal_active_months"),
        mean_if(month >= -3, dpd).alias("bbal_dpd_rate_3m"),
        recent6.alias("bbal_dpd_rate_6m"),
        late12.alias("bbal_dpd_rate_12m"),
        mean_if(month.between(-12, -3), dpd).alias("bbal_dpd_rate_3m_to_12m"),
        F.max(F.when(month >= -6, severity)).alias("bbal_recent_max_severity"),
        (recent6 - late12).alias("bbal_dpd_trend"),
        (-F.max(F.when(dpd > 0, month))).alias("months_since_dpd"),
        F.bround(recent6 - prior6, 3).alias("recent_vs_prior"),
        mean_if(month < 0, dpd).alias("past_dpd_mean"),
        F.max(F.when(month < 0, dpd)).alias("past_dpd_max"),
        F.count("*").alias("n_months"),
        *[F.max(flag(status == s)).alias(f"ever_{s}") for s in ("0", "1", "2")],
        F.count_if(status == "C").alias("n_current"),
        F.count(code).alias("n_codes"), F.sum(code).alias("sum_code"),
        F.sum(code * code).alias("sum_code2"), F.max(code).alias("max_code"),
        F.max(at).alias("latest"), F.min(at).alias("earliest"),
        F.max(F.struct(code.alias("s"), month.alias("m"))).alias("worst"),
        F.sum(F.when(month >= -3, dpd)).alias("late_3m"),
        F.count_if(month >= -3).alias("n_3m"),
        F.min(F.when(dpd > 0, month)).alias("oldest_dpd"),
    )


BALANCE_COLUMNS = ["bbal_cnt", "bbal_dpd_rate", "bbal_dpd_rate_std", "bbal_max_severity",
                   "bbal_active_months", "bbal_dpd_rate_3m", "bbal_dpd_rate_6m",
                   "bbal_dpd_rate_12m", "bbal_dpd_rate_3m_to_12m", "bbal_recent_max_severity",
                   "bbal_dpd_trend"]
LOAN_MEANS = ["bbal_cnt", "bbal_dpd_rate", "bbal_dpd_rate_std", "bbal_dpd_rate_3m",
              "bbal_dpd_rate_6m", "bbal_dpd_rate_12m", "bbal_dpd_rate_3m_to_12m",
              "bbal_dpd_trend", "bbal_max_severity", "bbal_recent_max_severity",
              "bbal_active_months"]
RECENCY_COLUMNS = ["bbal_months_since_last_dpd", "bbal_dpd_last_3m_rate",
                   "bbal_dpd_last_6m_vs_prior_rate"]
STATUS_COLUMNS = ["bbal_ever_30dpd", "bbal_ever_60dpd", "bbal_ever_90dpd",
                  "bbal_max_status_code", "bbal_pct_current", "bbal_status_volatility",
                  "bbal_dpd_escalation", "bbal_max_dpd_months_ago"]


TIME_COLUMNS = ["bbal_dpd_rate_3m", "newest_dpd_months", "oldest_dpd_months",
                "bureau_credit_age_mean"]
SEQUENCE_COLUMNS = ["inst_longest_dpd_streak", "inst_months_since_last_dpd",
                    "inst_payment_amt_slope", "inst_payment_ratio_trend",
                    "inst_recent_vs_historical_dpd"]
LATE_COLUMNS = ["inst_late_rate_12m", "inst_late_rate_recent_vs_historical",
                "inst_rolling_30dpd_ratio_3m", "inst_delinquency_escalation_flag",
                "inst_days_since_last_30dpd", "inst_late_payment_acceleration"]
HABIT_COLUMNS = ["inst_payment_consistency_score", "inst_recency_weighted_dpd",
                 "inst_early_payment_pct", "inst_large_payment_freq"]
CARD_TREND_COLUMNS = ["cc_balance_velocity_3m", "cc_utilization_trend", "cc_balance_volatility",
                      "cc_atm_drawing_frequency"]
REJECTION_COLUMNS = ["prev_reject_fraud_flag", "prev_reject_high_risk_pct",
                     "prev_goods_secured_pct", "prev_interest_rate_mean"]

# What an applicant without rows in the child table gets.
ABSENT = {
    **{c: MISSING for c in LATE_COLUMNS},
    **{c: 0.0 for c in [*STATUS_COLUMNS, *HABIT_COLUMNS, *CARD_TREND_COLUMNS,
                        *REJECTION_COLUMNS, *SEQUENCE_COLUMNS]},
    "inst_late_payment_acceleration": 0.0,
    "bbal_max_status_code": -1.0,
    "inst_months_since_last_dpd": 999.0,
}


def _bureau_aggregates() -> dict[str, Column]:
    opened, owed = F.col("DAYS_CREDIT"), F.col("AMT_CREDIT_SUM_DEBT")
    granted, overdue = F.col("AMT_CREDIT_SUM"), F.col("AMT_CREDIT_SUM_OVERDUE")
    aggregates = {
        "cnt": F.count("SK_ID_BUREAU"),
        "active_cnt": F.count_if(F.col("CREDIT_ACTIVE") == "Active"),
        "closed_cnt": F.count_if(F.col("CREDIT_ACTIVE") == "Closed"),
        "overdue_cnt": F.count_if(F.col("CREDIT_DAY_OVERDUE") > 0),
        "days_credit_mean": F.avg(opened), "days_credit_min": F.min(opened),
        "days_credit_max": F.max(opened), "days_credit_std": F.stddev_samp(opened),
        "credit_sum": sum0(granted), "amt_credit_mean": F.avg(granted),
        "credit_debt_sum": sum0(owed), "credit_debt_std": F.stddev_samp(owed),
        "credit_debt_max": F.max(owed),
        "credit_overdue_sum": sum0(overdue), "overdue_sum": sum0(overdue),
        "max_overdue_amt": F.max("AMT_CREDIT_MAX_OVERDUE"),
        "annuity_mean": F.avg("AMT_ANNUITY"),
        "overdue_max": F.max("CREDIT_DAY_OVERDUE"),
        "prolong_sum": sum0(F.col("CNT_CREDIT_PROLONG")),
        "recent_openings": F.count_if(opened >= -365),
        "days_since_last_credit": F.max(opened),
        **{f"{c}_mean": F.avg(c) for c in LOAN_MEANS},
    }
    return {f"bureau_{n}": v for n, v in aggregates.items()} | {
        "bbal_months_since_last_dpd": _mean3("months_since_dpd"),
        "bbal_dpd_last_3m_rate": _mean3("bbal_dpd_rate_3m"),
        "bbal_dpd_last_6m_vs_prior_rate": _mean3("recent_vs_prior"),
    }


def _status_aggregates() -> dict[str, Column]:
    """Status features from loan rows; all NULL for an applicant without balance rows.

    Among several loans in the latest month the highest status counts, in the earliest
    month the lowest. Of several months with the worst status the most recent counts.
    """
    n, total, squares = F.sum("n_codes"), F.sum("sum_code"), F.sum("sum_code2")
    mean = total / F.when(n > 0, n)
    spread = F.sqrt(F.greatest(squares - total * mean, F.lit(0.0)) / F.when(n > 1, n - 1))
    months, worst = F.sum("n_months"), F.max("worst")
    rises = (months >= 2) & (F.max("latest")["s"] > F.min("earliest")["s"])
    known = {
        "bbal_ever_30dpd": F.max("ever_0"), "bbal_ever_60dpd": F.max("ever_1"),
        "bbal_ever_90dpd": F.max("ever_2"),
        "bbal_max_status_code": fill(F.max("max_code").cast("double"), -1.0),
        "bbal_pct_current": F.sum("n_current") / F.when(months > 0, months),
        "bbal_status_volatility": fill(F.when(mean + 0.01 != 0, spread / (mean + 0.01)), 0.0),
        "bbal_dpd_escalation": flag(rises),
        "bbal_max_dpd_months_ago": F.when(worst["s"] > -1, F.abs(worst["m"]).cast("double"))
        .otherwise(MISSING),
    }
    return {name: F.when(months > 0, value) for name, value in known.items()}


def _time_aggregates() -> dict[str, Column]:
    recent = F.sum("n_3m")
    return {
        "bbal_dpd_rate_3m": F.sum("late_3m") / F.when(recent > 0, recent),
        "newest_dpd_months": F.min("months_since_dpd").cast("double"),
        "oldest_dpd_months": (-F.min("oldest_dpd")).cast("double"),
        "bureau_credit_age_mean": F.avg(F.abs("DAYS_CREDIT") / 365.25),
    }


def bureau_features(bureau: DataFrame, bbal: DataFrame, balances: DataFrame | None = None) -> DataFrame:
    """Every bureau and balance feature per applicant from one pass over each table.

    ``balances`` are the rows of :func:`loan_balances` where they are made already.
    """
    loans = bureau.join(loan_balances(bbal) if balances is None else balances, "SK_ID_BUREAU", "left")
    wanted = {**_bureau_aggregates(), **_status_aggregates(), **_time_aggregates()}
    return loans.groupBy(KEY).agg(*[v.alias(n) for n, v in wanted.items()])


def bureau_summary(bureau: DataFrame, bbal: DataFrame, balances: DataFrame | None = None) -> DataFrame:
    """Loans with their balance rows summarised, to one row per applicant."""
    return bureau_features(bureau, bbal, balances).select(KEY, *_bureau_aggregates())


def status_profile(bureau: DataFrame, bbal: DataFrame) -> DataFrame:
    """Status history per applicant with balance rows."""
    return bureau_features(bureau, bbal).where(
        F.col("bbal_ever_30dpd").isNotNull()).select(KEY, *STATUS_COLUMNS)


def time_features(applicants: DataFrame, bureau: DataFrame, bbal: DataFrame) -> DataFrame:
    """Three-month delinquency rate, months since delinquency, mean credit age.

    Every applicant is kept. "Months since last" is the newest delinquent month; the
    oldest one is returned beside it as ``bbal_months_since_first_dpd``.
    """
    found = bureau_features(bureau, bbal).select(
        KEY, "bbal_dpd_rate_3m",
        F.col("newest_dpd_months").alias("bbal_months_since_last_dpd"),
        F.col("oldest_dpd_months").alias("bbal_months_since_first_dpd"),
        "bureau_credit_age_mean")
    return applicants.select(KEY).join(found, KEY, "left").fillna(
        MISSING, [c for c in found.columns if c != KEY])


def _previous_aggregates() -> dict[str, Column]:
    status, credit = F.col("NAME_CONTRACT_STATUS"), F.col("AMT_CREDIT")
    asked, decided = F.col("AMT_APPLICATION"), F.col("DAYS_DECISION")
    aggregates = {
        "cnt": F.count("SK_ID_PREV"),
        "approved_cnt": F.count_if(status == "Approved"),
        "refused_cnt": F.count_if(status == "Refused"),
        "cancelled_cnt": F.count_if(status == "Canceled"),
        "amt_credit_mean": F.avg(credit), "amt_credit_sum": sum0(credit),
        "amt_credit_std": F.stddev_samp(credit), "amt_credit_max": F.max(credit),
        "amt_application_mean": F.avg(asked),
        "annuity_mean": F.avg("AMT_ANNUITY"), "amt_annuity_mean": F.avg("AMT_ANNUITY"),
        "amt_down_payment_mean": F.avg("AMT_DOWN_PAYMENT"),
        "credit_to_app_ratio_mean": F.avg(F.when(asked > 0, credit / asked)),
        "days_decision_min": F.min(decided), "days_decision_mean": F.avg(decided),
        "days_decision_max": F.max(decided),
        "cnt_payment_mean": F.avg("CNT_PAYMENT"),
        "rate_down_payment_mean": F.avg("RATE_DOWN_PAYMENT"),
    }
    return {f"prev_{n}": v for n, v in aggregates.items()}


def previous_features(prev: DataFrame) -> DataFrame:
    """Every prior-application feature per applicant from one pass."""
    wanted = {**_previous_aggregates(), **_rejection_aggregates()}
    return prev.groupBy(KEY).agg(*[v.alias(n) for n, v in wanted.items()])


def previous_summary(prev: DataFrame) -> DataFrame:
    """Prior applications: counts by outcome, amounts, decision days."""
    return prev.groupBy(KEY).agg(*[v.alias(n) for n, v in _previous_aggregates().items()])


def pos_summary(pos: DataFrame) -> DataFrame:
    dpd, status = F.col("SK_DPD"), F.col("NAME_CONTRACT_STATUS")
    aggregates = {
        "cnt": F.count("MONTHS_BALANCE"), "months_balance_mean": F.avg("MONTHS_BALANCE"),
        "cnt_instalment_mean": F.avg("CNT_INSTALMENT"),
        "cnt_instalment_std": F.stddev_samp("CNT_INSTALMENT"),
        "sk_dpd_max": F.max(dpd), "sk_dpd_std": F.stddev_samp(dpd), "sk_dpd_mean": F.avg(dpd),
        "sk_dpd_def_max": F.max("SK_DPD_DEF"),
        "overdue_cnt": F.count_if(dpd > 0), "overdue_rate": F.avg(flag(dpd > 0)),
        "active_cnt": F.count_if(status == "Active"),
        "completed_cnt": F.count_if(status == "Completed"),
    }
    return pos.groupBy(KEY).agg(*[v.alias(f"pos_{n}") for n, v in aggregates.items()])


def _instalment_aggregates() -> dict[str, Column]:
    due, paid_on = F.col("DAYS_INSTALMENT"), F.col("DAYS_ENTRY_PAYMENT")
    owed, paid = F.col("AMT_INSTALMENT"), F.col("AMT_PAYMENT")
    share = F.when(owed != 0, paid / owed)
    aggregates = {
        "cnt": F.count(due), "late_cnt": F.count_if(paid_on > due),
        "amt_payment_sum": sum0(paid), "amt_instalment_mean": F.avg(owed),
        "payment_ratio_mean": F.avg(share), "payment_ratio_std": F.stddev_samp(share),
        "payment_ratio_min": F.min(share), "payment_ratio_max": F.max(share),
        "payment_diff_mean": F.avg(owed - paid), "payment_diff_std": F.stddev_samp(owed - paid),
        "days_past_due_mean": F.avg(paid_on - due), "days_past_due_max": F.max(paid_on - due),
        "days_past_due_std": F.stddev_samp(paid_on - due),
    }
    return {f"inst_{n}": v for n, v in aggregates.items()}


def instalment_features(inst: DataFrame, legacy: bool = False) -> DataFrame:
    """Every order-free instalment feature per applicant from one pass."""
    wanted = {**_instalment_aggregates(), **_late_aggregates(), **_habit_aggregates(legacy)}
    return inst.groupBy(KEY).agg(*[v.alias(n) for n, v in wanted.items()])


def instalment_summary(inst: DataFrame) -> DataFrame:
    return instalment_features(inst).select(KEY, *_instalment_aggregates())


def _card_aggregates() -> dict[str, Column]:
    balance, limit = F.col("AMT_BALANCE"), F.col("AMT_CREDIT_LIMIT_ACTUAL")
    minimum, dpd = F.col("AMT_INST_MIN_REGULARITY"), F.col("SK_DPD")
    used = F.when(limit > 0, balance / limit)
    aggregates = {
        "cnt": F.count("MONTHS_BALANCE"),
        "bal_mean": F.avg(balance), "bal_max": F.max(balance), "bal_min": F.min(balance),
        "bal_std": F.stddev_samp(balance),
        "drawing_mean": F.avg("AMT_DRAWINGS_CURRENT"),
        "drawing_std": F.stddev_samp("AMT_DRAWINGS_CURRENT"),
        "atm_drawing_mean": F.avg("AMT_DRAWINGS_ATM_CURRENT"),
        "utilization_mean": F.avg(used), "utilization_max": F.max(used),
        "utilization_std": F.stddev_samp(used),
        "limit_mean": F.avg(limit), "sk_dpd_max": F.max(dpd), "sk_dpd_mean": F.avg(dpd),
        "dpd_rate": F.avg(flag(dpd > 0)),
        "min_payment_ratio_mean": F.avg(
            F.when(minimum > 0, F.col("AMT_PAYMENT_CURRENT") / minimum)),
    }
    return {f"cc_{n}": v for n, v in aggregates.items()}


def card_features(cc: DataFrame) -> DataFrame:
    """Every card feature per applicant from one pass."""
    wanted = {**_card_aggregates(), **_card_trend_aggregates()}
    return cc.groupBy(KEY).agg(*[v.alias(n) for n, v in wanted.items()])


def card_summary(cc: DataFrame) -> DataFrame:
    return cc.groupBy(KEY).agg(*[v.alias(n) for n, v in _card_aggregates().items()])


def days_late() -> Column:
    """Days past due floored at 0; NULL while unpaid."""
    return clip(F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT"), low=0.0)


def _late_aggregates() -> dict[str, Column]:
    due = F.col("DAYS_INSTALMENT")
    late = flag(days_late() > 30)
    year, all_time = mean_if(due >= -365, late), F.avg(late)
    quarter = mean_if(due >= -90, late)
    before = mean_if((due >= -180) & (due < -90), late)
    worse = (F.when(quarter.isNotNull() & before.isNotNull(), (quarter > before).cast("double"))
             .when(quarter.isNotNull(), 1.0).when(before.isNotNull(), 0.0).otherwise(MISSING))
    last_late = F.max(F.when(days_late() > 30, due))
    return {
        "inst_late_rate_12m": fill(year),
        "inst_late_rate_recent_vs_historical": fill(year - all_time),
        "inst_rolling_30dpd_ratio_3m": fill(quarter),
        "inst_delinquency_escalation_flag": worse,
        "inst_days_since_last_30dpd": fill((F.max(due) - last_late).cast("double"), -1.0),
        "inst_late_payment_acceleration": fill(quarter - before, 0.0),
    }


def late_rates(inst: DataFrame) -> DataFrame:
    """Shares of payments over 30 days late, by window of the due day.

    An applicant with instalments but none in a window gets the sentinel.
    """
    return instalment_features(inst).select(KEY, *_late_aggregates())


def _habit_aggregates(legacy: bool = False) -> dict[str, Column]:
    due, paid_on = F.col("DAYS_INSTALMENT"), F.col("DAYS_ENTRY_PAYMENT")
    owed, paid = F.col("AMT_INSTALMENT"), F.col("AMT_PAYMENT")
    share = paid / (owed + 1e-6)
    mean, spread = F.avg(share), F.stddev_samp(share)
    on_time = F.avg(flag(paid_on - due <= 0))
    steady = (spread == 0) | (mean == 0)
    penalty = F.when(steady, 0.0).otherwise(F.least(spread / (mean + 0.01), F.lit(1.0)))
    # a single payment has no spread: the penalty is then 1
    penalty = F.when(spread.isNull(), 1.0).otherwise(penalty)
    weight = F.lit(1.0) if legacy else 1.0 / (1.0 + F.abs(due) / 30.0)
    late = F.coalesce(paid_on - due, F.lit(0.0))
    return {
        "inst_payment_consistency_score": F.greatest(on_time - penalty, F.lit(0.0)),
        "inst_recency_weighted_dpd": F.sum(weight * late) / F.sum(weight),
        "inst_early_payment_pct": F.avg(flag(paid_on < due)),
        "inst_large_payment_freq": F.avg(flag(paid > owed * 1.2)),
    }


def payment_habits(inst: DataFrame, legacy: bool = False) -> DataFrame:
    """Consistency, recency-weighted lateness, early and large payments.

    The weight of a payment is 1/(1 + months of age). ``legacy`` gives every payment
    the same weight.
    """
    return instalment_features(inst, legacy).select(KEY, *_habit_aggregates())


def _card_trend_aggregates(limit: str = "AMT_CREDIT_LIMIT_ACTUAL") -> dict[str, Column]:
    month, balance = F.col("MONTHS_BALANCE"), F.col("AMT_BALANCE")
    used = clip(balance / (F.col(limit) + 1e-6), 0.0, 1.0)
    recent, prior = mean_if(month.between(-1, 0), balance), mean_if(month.between(-3, -2), balance)
    steady = F.coalesce(balance, F.lit(0.0))
    mean = F.avg(steady)
    return {
        "cc_balance_velocity_3m":
            fill(F.when(prior + 1.0 != 0, (recent - prior) / (prior + 1.0)), 0.0),
        # month -3 belongs to both windows
        "cc_utilization_trend":
            fill(mean_if(month.between(-3, 0), used) - mean_if(month.between(-6, -3), used), 0.0),
        "cc_balance_volatility": fill(F.when(mean != 0, F.stddev_samp(steady) / mean), 0.0),
        "cc_atm_drawing_frequency": F.avg(flag(F.col("AMT_DRAWINGS_ATM_CURRENT") > 0)),
    }


def card_trends(cc: DataFrame, limit: str = "AMT_CREDIT_LIMIT") -> DataFrame:
    """Balance velocity, utilisation trend, balance volatility, share of cash months."""
    return cc.groupBy(KEY).agg(*[v.alias(n) for n, v in _card_trend_aggregates(limit).items()])


def _rejection_aggregates() -> dict[str, Column]:
    # Reject codes and secured goods.
    reason, goods = F.col("CODE_REJECT_REASON"), F.col("NAME_GOODS_CATEGORY")
    return {
        "prev_reject_fraud_flag": F.max(flag(reason == "FRAUD")),
        "prev_reject_high_risk_pct": F.avg(flag(reason.isin("HC", "LIMIT", "SCOFR"))),
        "prev_goods_secured_pct": F.avg(flag(goods.isin("Auto", "Real estate"))),
        "prev_interest_rate_mean":
            fill(F.avg(F.nullif(F.col("RATE_INTEREST_PRIMARY"), F.lit(MISSING))), 0.0),
    }


def rejection_profile(prev: DataFrame) -> DataFrame:
    return prev.groupBy(KEY).agg(*[v.alias(n) for n, v in _rejection_aggregates().items()])


DUE, ENTRY = "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT"


def _segments(inst: DataFrame) -> DataFrame:
    """One summary per (applicant, due day, entry day), the smallest stretch of both payment orders.

    All its rows are late or none is. Inside, rows go by owed, then paid amount, so rows of equal place
    are interchangeable. ``at_<v>`` is the sum of place times value, places from 1.
    """
    owed, paid = F.col("AMT_INSTALMENT"), F.col("AMT_PAYMENT")
    inside = Window.partitionBy(KEY, DUE, ENTRY)
    place = F.row_number().over(inside.orderBy("AMT_INSTALMENT", "AMT_PAYMENT"))
    rows = inst.select(KEY, DUE, ENTRY, "AMT_INSTALMENT", "AMT_PAYMENT", (paid / (owed + 1e-6)).alias("_ratio"),
                       place.alias("_place"))
    values = {"owed": owed, "paid": paid, "ratio": F.col("_ratio")}
    return rows.groupBy(KEY, DUE, ENTRY).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(n) for n, v in values.items()],
        *[F.sum(F.col("_place") * v).alias(f"at_{n}") for n, v in values.items()])


def _tails(inst: DataFrame, keep: int) -> DataFrame:
    """Per applicant the last ``keep`` rows in payment order, with their distance from the end.

    Spark takes the last rows of each partition before the shuffle, so an applicant with very many rows
    sends ``keep`` rows a task.
    """
    latest = Window.partitionBy(KEY).orderBy(*[F.col(c).desc() for c in (DUE, ENTRY, "AMT_INSTALMENT", "AMT_PAYMENT")])
    rows = inst.select(KEY, DUE, ENTRY, "AMT_INSTALMENT", "AMT_PAYMENT", F.row_number().over(latest).alias("_rank"))
    return rows.where(F.col("_rank") <= keep).groupBy(KEY).agg(F.collect_list(F.struct(
        (F.col("_rank") - 1).alias("left"), days_late().alias("late"),
        (F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT")).alias("gap"))).alias("_tail"))


def _folded(parts: DataFrame, by: str, first: str, values: list[str]) -> DataFrame:
    """Summaries per (applicant, ``first``) from summaries per (applicant, ``first``, ``by``), in that order.

    Each level is a window over the lines below it, never over an applicant's rows.
    """
    whole = Window.partitionBy(KEY, first)
    before = F.coalesce(F.sum("n").over(whole.orderBy(F.col(by)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    late = F.coalesce(F.col(ENTRY) > F.col(DUE), F.lit(False))
    placed = parts.select(KEY, first, by, "n", *values, *[f"at_{v}" for v in values],
                          late.alias("_late"), before.alias("_before"))
    return placed.groupBy(KEY, first).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("_late"), F.col("n")).otherwise(0)).alias("n_late"),
        *[F.sum(v).alias(v) for v in values],
        *[F.sum(F.col(f"at_{v}") + F.col("_before") * F.col(v)).alias(f"at_{v}") for v in values])


def _in_order(days: DataFrame, first: str) -> DataFrame:
    """Day summaries with the rows before them and of the whole applicant, and the run they belong to."""
    whole = Window.partitionBy(KEY)
    ordered = whole.orderBy(F.col(first))
    before = F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # within a due day, late payments come after the others: a day with others begins a new run
    run = F.sum(F.col("n") - F.col("n_late")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumns({"before": before, "all": F.sum("n").over(whole), "run": run})


def _slope(value: str) -> Column:
    """Least-squares slope of a value over the places 1 to ``all``, from day summaries."""
    middle, n = (F.col("all") + 1) / 2, F.max("all").cast("double")
    across = F.sum(F.col(f"at_{value}") + (F.col("before") - middle) * F.col(value))
    return F.when(n > 1, across / (n * (n * n - 1) / 12))


def instalment_sequences(inst: DataFrame, window: int = 12) -> DataFrame:
    """All order-dependent instalment features, from summaries that are folded in payment order.

    A payment is late when it comes after its due day; an unpaid one is not. Rows are summed up per
    (applicant, due day, entry day), those per day, and days per applicant, so that no task orders
    all rows of an applicant. NULL is an applicant of its own.
    """
    due, owed, paid = F.col(DUE), F.col("AMT_INSTALMENT"), F.col("AMT_PAYMENT")
    late = F.col(ENTRY) > due
    last_late = F.max(F.when(late, due))
    mean_late, n_late = F.avg(days_late()), F.count(days_late())
    # an unpaid instalment leaves a slope, mean or skewness unknown
    varied = (n_late > 1) & (F.count("*") == n_late) & (F.stddev_pop(days_late()) > 0)
    plain = inst.groupBy(KEY).agg(
        F.bround(-last_late / 30.0, 2).alias("inst_months_since_last_late"),
        fill(F.abs(F.max(due) - last_late) / 30.0, 999.0).alias("inst_months_since_last_dpd"),
        fill(F.max(owed - paid), 0.0).alias("inst_payment_diff_max"),
        fill(F.when(varied, F.skewness(days_late())), 0.0).alias("inst_late_skew"),
        mean_late.alias("_mean_late"), (F.count("*") == F.count(owed)).alias("_all_owed"),
        (F.count("*") == F.count(paid)).alias("_all_paid"), (F.count("*") == n_late).alias("_all_days"))
    keep = max(window, 6)
    days = _in_order(_folded(_segments(inst), ENTRY, DUE, ["owed", "ratio"]), DUE)
    # runs of late payments: the longest sum of late rows over days that begin no new run
    runs = days.groupBy(KEY, "run").agg(F.sum("n_late").alias("_len")).groupBy(KEY).agg(
        F.max("_len").cast("long").alias("inst_max_consec_late_streak"))
    folded = days.groupBy(KEY).agg(_slope("owed").alias("_owed_slope"), _slope("ratio").alias("_ratio_slope"))

    def mean_of(field: str, rows: int) -> Column:
        known = F.filter("_tail", lambda x: (x["left"] < rows) & x[field].isNotNull())
        total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x[field])
        return F.when(F.size(known) > 0, total / F.size(known))

    out = plain
    for i, part in enumerate((folded, runs, _tails(inst, keep))):
        part = part.withColumnRenamed(KEY, f"_k{i}")
        out = out.join(part, out[KEY].eqNullSafe(F.col(f"_k{i}")), "left").drop(f"_k{i}")
    recent = mean_of("late", window)
    return out.withColumns({
        "inst_payment_amt_slope": fill(F.when(F.col("_all_owed"), F.col("_owed_slope")), 0.0),
        "inst_payment_ratio_trend": fill(F.when(F.col("_all_paid"), F.col("_ratio_slope")), 0.0),
        "inst_recent_vs_historical_dpd": fill(F.when(
            F.col("_all_days"), mean_of("late", 6) / (F.col("_mean_late") + 1e-6)), 0.0),
        "inst_recent_late_mean": fill(recent, 0.0),
        "inst_recent_underpay": fill(mean_of("gap", window), 0.0),
        "inst_late_trend": fill(recent - F.col("_mean_late"), 0.0),
        "inst_longest_dpd_streak": F.col("inst_max_consec_late_streak").cast("double"),
    }).drop("_mean_late", "_all_owed", "_all_paid", "_all_days", "_owed_slope", "_ratio_slope", "_tail")


ORDERED_COLUMNS = ["inst_max_consec_late_streak", "inst_months_since_last_late", *SEQUENCE_COLUMNS,
                   "inst_payment_trend_slope"]


def _in_place(rows: DataFrame) -> DataFrame:
    """Rows dealt by applicant with their places in both payment orders and the run of late ones they end."""
    whole = Window.partitionBy(KEY)
    order = whole.orderBy(DUE, ENTRY, "AMT_INSTALMENT", "AMT_PAYMENT")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    late = F.coalesce(F.col(ENTRY) > F.col(DUE), F.lit(False))
    rows = rows.withColumns({"_late": late, "_place": F.row_number().over(order)})
    run = F.col("_place") - F.coalesce(F.max(F.when(~F.col("_late"), F.col("_place"))).over(upto), F.lit(0))
    unpaid_last = whole.orderBy(F.coalesce(F.col(ENTRY), F.lit(1e9)), DUE, "AMT_INSTALMENT", "AMT_PAYMENT")
    return rows.withColumns({"_run": F.when(F.col("_late"), run).otherwise(0), "_all": F.count(F.lit(1)).over(whole)}) \
        .withColumn("_paid_place", F.row_number().over(unpaid_last))


def _ordered_aggregates() -> dict[str, Column]:
    """The features of :func:`instalment_sequences` that a frame holds, and the slope of :func:`payment_slope`."""
    due, owed, paid = F.col(DUE), F.col("AMT_INSTALMENT"), F.col("AMT_PAYMENT")
    n, last_late = F.count(F.lit(1)), F.max(F.when(F.col(ENTRY) > F.col(DUE), F.col(DUE)))
    recent = F.avg(F.when(F.col("_all") - F.col("_place") < 6, days_late()))

    def slope(value: Column, place: str) -> Column:
        size = n.cast("double")
        across = F.sum((F.col(place) - (F.col("_all") + 1) / 2) * value)
        return F.when(n > 1, across / (size * (size * size - 1) / 12))

    found = {
        "inst_max_consec_late_streak": F.max("_run").cast("long"),
        "inst_months_since_last_late": F.bround(-last_late / 30.0, 2),
        "inst_longest_dpd_streak": F.max("_run").cast("double"),
        "inst_months_since_last_dpd": fill(F.abs(F.max(due) - last_late) / 30.0, 999.0),
        "inst_payment_amt_slope": fill(F.when(n == F.count(owed), slope(owed, "_place")), 0.0),
        "inst_payment_ratio_trend": fill(F.when(n == F.count(paid), slope(paid / (owed + 1e-6), "_place")), 0.0),
        "inst_recent_vs_historical_dpd": fill(F.when(
            n == F.count(days_late()), recent / (F.avg(days_late()) + 1e-6)), 0.0),
        "inst_payment_trend_slope": F.when(n < 3, 0.0).when(n == F.count(paid), slope(paid, "_paid_place")),
    }
    return {c: found[c] for c in ORDERED_COLUMNS}


def instalment_history(inst: DataFrame, habits: bool = True) -> DataFrame:
    """Summary, with ``habits`` also late rates and habits, and the order-dependent features per applicant.

    One shuffle of the rows serves all of them. Applicants with very many rows are folded from summaries instead, by
    :func:`instalment_sequences` and :func:`payment_slope`. The rows are read several times: write them first.
    """
    plain = {**_instalment_aggregates(), **(_late_aggregates() | _habit_aggregates() if habits else {})}
    few, many = _gathered(inst.select(KEY, DUE, ENTRY, "AMT_INSTALMENT", "AMT_PAYMENT"), KEY)
    out = _in_place(few).groupBy(KEY).agg(*[v.alias(c) for c, v in {**plain, **_ordered_aggregates()}.items()])
    if many is None:
        return out
    folded = instalment_features(many).select(KEY, *plain).join(instalment_sequences(many).select(
        KEY, *ORDERED_COLUMNS[:-1]), KEY).join(payment_slope(many), KEY)
    return out.unionByName(folded)


def late_streak(inst: DataFrame) -> DataFrame:
    """Longest run of late payments and months since the last late one."""
    return instalment_sequences(inst).select(
        KEY, "inst_max_consec_late_streak", "inst_months_since_last_late")


def payment_sequence(inst: DataFrame) -> DataFrame:
    """Longest overdue run, recency, slopes over the sequence, recent against overall lateness."""
    return instalment_sequences(inst).select(
        KEY, "inst_longest_dpd_streak", "inst_months_since_last_dpd", "inst_payment_amt_slope",
        "inst_payment_ratio_trend", "inst_recent_vs_historical_dpd")


def recent_payments(inst: DataFrame, window: int = 12) -> DataFrame:
    """Newest ``window`` instalments against all: lateness, underpayment, gap, skewness."""
    return instalment_sequences(inst, window).select(
        KEY, "inst_recent_late_mean", "inst_recent_underpay", "inst_late_trend",
        "inst_payment_diff_max", "inst_late_skew")


def payment_slope(inst: DataFrame) -> DataFrame:
    """Slope of the paid amount over payments in entry order.

    0 below three payments, NULL when an amount is missing. Unpaid rows come last.
    """
    unpaid_last = F.coalesce(F.col(ENTRY), F.lit(1e9))
    parts = _segments(inst).withColumn("_entry", unpaid_last)
    days = _in_order(_folded(parts, DUE, "_entry", ["paid"]), "_entry")
    slopes = days.groupBy(KEY).agg(_slope("paid").alias("_slope")).withColumnRenamed(KEY, "_k")
    plain = inst.groupBy(KEY).agg(F.count("*").alias("_n"), F.count("AMT_PAYMENT").alias("_paid"))
    return plain.join(slopes, plain[KEY].eqNullSafe(F.col("_k")), "left").select(
        KEY, F.when(F.col("_n") < 3, 0.0).when(F.col("_n") == F.col("_paid"), F.col("_slope"))
        .alias("inst_payment_trend_slope"))


def past_loan_delinquency(bbal: DataFrame) -> DataFrame:
    """Mean and maximum delinquency of each loan over strictly past months, NULL as 0."""
    return loan_balances(bbal).select(
        "SK_ID_BUREAU", fill(F.col("past_dpd_mean"), 0.0).alias("bb_dpd_mean"),
        fill(F.col("past_dpd_max"), 0.0).alias("bb_dpd_max"))
