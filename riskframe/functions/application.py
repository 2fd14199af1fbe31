"""Row-wise applicant features. Every block adds its columns in one projection.

A block is skipped when its inputs are absent, so the same functions serve training
frames, request rows and partial test frames.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import (MISSING, UNEMPLOYED_DAYS, clip, fill, flag, has, ratio)
from riskframe.sources.schema import KEY, REGULATED, REGULATED_STRICT

DAYS_PER_YEAR = 365.25


def _col(name: str) -> Column:
    return F.col(name).cast("double")


def amount_ratios(df: DataFrame) -> DataFrame:
    """Loan size against income, annuity and goods price."""
    income, credit = _col("AMT_INCOME_TOTAL"), _col("AMT_CREDIT")
    annuity, goods = _col("AMT_ANNUITY"), _col("AMT_GOODS_PRICE")
    return df.withColumns({
        "CREDIT_INCOME_RATIO": ratio(credit, income),
        "ANNUITY_INCOME_RATIO": ratio(annuity, income),
        "CREDIT_TERM": ratio(credit, annuity),
        "GOODS_CREDIT_RATIO": ratio(goods, credit),
        "payment_rate": ratio(annuity, credit),
    })


def age_and_tenure(df: DataFrame) -> DataFrame:
    age = -_col("DAYS_BIRTH") / DAYS_PER_YEAR
    worked = F.when(_col("DAYS_EMPLOYED") == UNEMPLOYED_DAYS, 0.0).otherwise(_col("DAYS_EMPLOYED"))
    tenure = clip(-worked / DAYS_PER_YEAR, low=0.0)
    return df.withColumns({
        "AGE_YEARS": fill(age),
        "YEARS_EMPLOYED": fill(tenure),
        "EMPLOYED_TO_AGE_RATIO": ratio(tenure, age),
    })


def document_counts(df: DataFrame, prefix: str = "FLAG_DOCUMENT_") -> DataFrame:
    flags = [F.coalesce(F.col(c), F.lit(0)) for c in df.columns if c.startswith(prefix)]
    return df.withColumns({
        "DOCUMENTS_SUBMITTED": reduce(add, flags).cast("long"),
        "HIGH_RISK_DOC_MISSING": flag(F.col(f"{prefix}3") == 0).cast("int"),
    })


def score_statistics(df: DataFrame, scores: tuple[str, str, str] =
                     ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")) -> DataFrame:
    """Summary, products and missing flags of the three external scores.

    Sums over present scores are plain arithmetic, so everything stays in generated
    code. Any product with a missing factor is NULL and becomes the sentinel.
    """
    e1, e2, e3 = (_col(s) for s in scores)
    parts = (e1, e2, e3)
    available = reduce(add, [e.isNotNull().cast("double") for e in parts])
    total = reduce(add, [F.coalesce(e, F.lit(0.0)) for e in parts])
    low, high = F.least(*parts), F.greatest(*parts)
    mean = F.when(available > 0, total / available)
    # three present: the middle one; two or one: midpoint of the extremes
    middle = F.greatest(F.least(e1, e2), F.least(F.greatest(e1, e2), e3))
    median = F.when(available == 3, middle).otherwise((low + high) / 2)
    squares = reduce(add, [F.coalesce((e - mean) * (e - mean), F.lit(0.0)) for e in parts])
    spread = F.when(available > 0, F.sqrt(squares / available))

    def safe(num: Column, den: Column) -> Column:
        present = num.isNotNull() & den.isNotNull()
        return F.when(present, F.when(F.abs(den) > 1e-4, num / den).otherwise(0.0))

    features = {
        "EXT_SOURCE_MEAN": mean, "EXT_SOURCE_MIN": low, "EXT_SOURCE_MAX": high,
        "EXT_SOURCE_MEDIAN": median, "EXT_SOURCE_STD": spread, "EXT_SOURCE_RANGE": high - low,
        "EXT_SOURCE_NUM_AVAILABLE": available,
        "EXT_SOURCE_PROD_12": e1 * e2, "EXT_SOURCE_PROD_13": e1 * e3,
        "EXT_SOURCE_PROD_23": e2 * e3,
        "EXT_SOURCE_1_SQ": e1 * e1, "EXT_SOURCE_2_SQ": e2 * e2,
        "EXT_SOURCE_RATIO_12": safe(e1, e2), "EXT_SOURCE_RATIO_23": safe(e2, e3),
        "EXT_SCORE_FLOOR": low * mean,
        "EXT_SOURCE_1_missing": e1.isNull().cast("double"),
        "EXT_SOURCE_2_missing": e2.isNull().cast("double"),
        "EXT_SOURCE_3_missing": e3.isNull().cast("double"),
        "ext_source_missing_count": 3.0 - available,
        "ext_source_prod": e1 * e2 * e3,
    }
    return df.withColumns({name: fill(value) for name, value in features.items()})


def application_features(df: DataFrame) -> DataFrame:
    """All application-level blocks; the raw birth day is dropped afterwards."""
    out = amount_ratios(df) if has(df, "AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_ANNUITY",
                                   "AMT_GOODS_PRICE") else df
    if has(df, "DAYS_BIRTH", "DAYS_EMPLOYED"):
        out = age_and_tenure(out)
    if has(df, "FLAG_DOCUMENT_3"):
        out = document_counts(out)
    if has(df, "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"):
        out = score_statistics(out)
    return out.drop("DAYS_BIRTH")


# name -> (count column, total column): share of a total, 0 when the total is 0
_SHARES = {
    "prev_approval_rate": ("prev_approved_cnt", "prev_cnt"),
    "prev_refusal_rate": ("prev_refused_cnt", "prev_cnt"),
    "inst_pct_late": ("inst_late_cnt", "inst_cnt"),
    "bureau_overdue_rate": ("bureau_overdue_cnt", "bureau_cnt"),
    "bureau_active_ratio": ("bureau_active_cnt", "bureau_cnt"),
}

# name -> (numerator, denominator): sentinel when the denominator is not positive
_RELATIVE = {
    "new_credit_to_bureau_ratio": ("AMT_CREDIT", "bureau_credit_sum"),
    "annuity_to_prev_annuity_ratio": ("AMT_ANNUITY", "prev_amt_annuity_mean"),
    "bureau_overdue_to_income": ("bureau_overdue_sum", "AMT_INCOME_TOTAL"),
    "bureau_active_to_prev_apps": ("bureau_active_cnt", "prev_cnt"),
    "bureau_close_rate": ("bureau_closed_cnt", "bureau_cnt"),
}


def aggregate_rates(df: DataFrame) -> DataFrame:
    """Rates and capped ratios over the child-table aggregates."""
    new = {name: ratio(_col(num), _col(den))
           for name, (num, den) in _SHARES.items() if has(df, num, den)}
    new.update({name: ratio(_col(num), _col(den), otherwise=MISSING)
                for name, (num, den) in _RELATIVE.items() if has(df, num, den)})
    if has(df, "bureau_credit_sum", "bureau_credit_debt_sum"):
        new["bureau_debt_ratio"] = ratio(_col("bureau_credit_debt_sum"),
                                         _col("bureau_credit_sum"), above=1e-6)
    for table in ("cc", "pos"):
        if has(df, f"{table}_sk_dpd_max"):
            new[f"{table}_overdue_flag"] = flag(fill(_col(f"{table}_sk_dpd_max")) > 0)
    if has(df, "AMT_INCOME_TOTAL"):
        income = _col("AMT_INCOME_TOTAL")
        if has(df, "prev_amt_credit_mean"):
            share = F.when(income > 0, _col("prev_amt_credit_mean") / income).otherwise(0.0)
            new["prev_credit_income_ratio"] = fill(clip(share, 0.0, 100.0))
        if has(df, "bureau_credit_debt_sum"):
            debt = clip(_col("bureau_credit_debt_sum"), low=0.0)
            new["bureau_debt_to_income"] = fill(clip(debt / clip(income, low=1.0), high=50.0))
        if has(df, "AMT_ANNUITY"):
            monthly = clip(income, low=1.0) / 12.0
            new["debt_service_ratio"] = fill(clip(_col("AMT_ANNUITY") / monthly, high=10.0))
        # the loader's spelling of the utilisation column
        if has(df, "cc_utilization_mean", "cc_bal_max"):
            new["cc_utilisation_to_income"] = ratio(
                _col("cc_utilization_mean") * _col("cc_bal_max"), income, otherwise=MISSING)
    if has(df, "inst_days_past_due_max", "inst_days_past_due_mean"):
        typical = F.abs(_col("inst_days_past_due_mean")) + 1.0
        new["inst_late_dpd_ratio"] = fill(_col("inst_days_past_due_max") / typical)
    return df.withColumns(new)


def interactions(df: DataFrame) -> DataFrame:
    """Products and differences across tables. Expects :func:`aggregate_rates` columns."""
    def pos(name: str) -> Column:
        return clip(_col(name), low=0.0)

    def product(a: str, b: str) -> Column:
        return fill(pos(a) * pos(b))

    new: dict[str, Column] = {}
    pairs = {
        "ext_credit_risk": ("EXT_SOURCE_MEAN", "CREDIT_INCOME_RATIO"),
        "ext_annuity_risk": ("EXT_SOURCE_MIN", "ANNUITY_INCOME_RATIO"),
        "bureau_inst_dpd": ("bureau_overdue_rate", "inst_days_past_due_mean"),
        "leverage_vs_bureau": ("bureau_debt_to_income", "CREDIT_INCOME_RATIO"),
    }
    new.update({n: product(*pair) for n, pair in pairs.items() if has(df, *pair)})

    if has(df, "inst_pct_late", "cc_dpd_rate"):
        new["multi_dpd_flag"] = flag((_col("inst_pct_late") > 0.1) & (_col("cc_dpd_rate") > 0.1))
    elif has(df, "bureau_overdue_rate", "inst_days_past_due_mean"):
        new["multi_dpd_flag"] = flag((_col("bureau_overdue_rate") > 0.1)
                                     & (_col("inst_days_past_due_mean") > 0))

    if has(df, "bureau_credit_debt_sum", "cc_bal_max", "AMT_INCOME_TOTAL"):
        owed = pos("bureau_credit_debt_sum") + pos("cc_bal_max")
        exposure = owed / clip(_col("AMT_INCOME_TOTAL"), low=1.0)
        new["total_debt_exposure"] = fill(clip(exposure, 0.0, 100.0))

    if has(df, "bureau_bbal_dpd_rate_6m_mean", "bureau_bbal_dpd_rate_12m_mean"):
        change = (fill(_col("bureau_bbal_dpd_rate_6m_mean"), 0.0)
                  - fill(_col("bureau_bbal_dpd_rate_12m_mean"), 0.0))
        new["dpd_trajectory"] = change
        if has(df, "inst_days_past_due_max"):
            new["dpd_escalation"] = fill(clip(change, low=0.0) * pos("inst_days_past_due_max"))

    if has(df, "AMT_INCOME_TOTAL", "AMT_ANNUITY"):
        service = pos("AMT_ANNUITY") + 1.0
        if has(df, "bureau_annuity_mean"):
            service = service + pos("bureau_annuity_mean")
        new["debt_service_coverage"] = fill(pos("AMT_INCOME_TOTAL") / service)
    return df.withColumns(new)


def policy_flags(df: DataFrame) -> DataFrame:
    tests = {
        "no_bureau_history": ("bureau_cnt", lambda c: c == 0),
        "no_prev_applications": ("prev_cnt", lambda c: c == 0),
        "ever_dpd_bureau": ("bureau_overdue_cnt", lambda c: c > 0),
        "bureau_prolong_any": ("bureau_prolong_sum", lambda c: c > 0),
        "high_credit_income": ("CREDIT_INCOME_RATIO", lambda c: c > 5),
        "low_payment_rate": ("payment_rate", lambda c: c < 0.03),
        "thin_file": ("bureau_cnt", lambda c: c == 0),
    }
    return df.withColumns({name: flag(test(F.col(source))).cast("int")
                           for name, (source, test) in tests.items() if has(df, source)})


def secondary_features(df: DataFrame) -> DataFrame:
    return policy_flags(interactions(aggregate_rates(df)))


def bureau_trend_features(df: DataFrame) -> DataFrame:
    """Delinquency trend, debt against the new loan, improvement and acceleration."""
    def first_present(*names: str) -> Column | None:
        return next((_col(n) for n in names if n in df.columns), None)

    # Accepted names, in order of preference.
    recent = first_present("bureau_bbal_dpd_rate_3m_mean", "bbal_dpd_last_3m_rate")
    history = first_present("bureau_bbal_dpd_rate_3m_to_12m_mean",
                            "bureau_bbal_dpd_rate_12m_mean", "bureau_bbal_dpd_rate_6m_mean")
    usable = recent is not None and history is not None
    new = {"bureau_dpd_trend_3m_vs_12m":
           fill(clip(recent - history, -1.0, 1.0)) if usable else F.lit(MISSING)}

    if has(df, "bureau_credit_debt_sum", "AMT_CREDIT"):
        debt, credit = _col("bureau_credit_debt_sum"), _col("AMT_CREDIT")
        new["bureau_debt_to_new_credit"] = fill(clip(debt, low=0.0) / clip(credit, low=1.0))
        cover = F.when(debt > 0, F.least(credit / (debt + 1.0), F.lit(100.0)))
        new["current_to_bureau_debt_ratio"] = fill(F.when(credit.isNotNull(), cover))
    else:
        new["bureau_debt_to_new_credit"] = F.lit(MISSING)

    r3, r6, r12 = (fill(_col(c), 0.0) if has(df, c) else F.lit(0.0)
                   for c in (f"bureau_bbal_dpd_rate_{m}m_mean" for m in (3, 6, 12)))
    new["bbal_improving_flag"] = flag(r3 < r6)
    new["bbal_dpd_acceleration_3m"] = (r3 - r6) - (r6 - r12)
    return df.withColumns(new)


def pair_products(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Interaction columns for a stored list of column pairs."""
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs if has(df, a, b)})


def drop_regulated(df: DataFrame, strict: bool = False) -> DataFrame:
    """Drop columns a model must not use; ``strict`` also drops age and family columns."""
    return df.drop(*REGULATED, *(REGULATED_STRICT if strict else []))


def drop_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One audit row: dropped columns, row counts and lost keys."""
    dropped = [c for c in before.columns if c not in after.columns]
    lost = before.join(after.select(KEY), KEY, "left_anti").count()
    return before.sparkSession.createDataFrame(
        [(before.count(), after.count(), lost, dropped)],
        "rows_before long, rows_after long, lost_keys long, dropped_columns array<string>")


def drop_columns(df: DataFrame, denied: list[str], prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Deny-list and prefix drop, checked on the resulting schema."""
    doomed = [c for c in df.columns
              if c in denied or (prefixes and c.startswith(prefixes))]
    out = df.drop(*doomed)
    left = set(doomed) & set(out.columns)
    if left:
        raise ValueError(f"columns survived the drop: {sorted(left)}")
    return out


def repair_suffixes(df: DataFrame) -> DataFrame:
    """Merge left-overs: keep ``name_x`` as ``name`` and drop ``name_y`` where both exist."""
    names = set(df.columns)
    bases = [c[:-2] for c in df.columns if c.endswith("_x") and c[:-2] + "_y" in names]
    out = df.drop(*[f"{b}_y" for b in bases])
    return out.withColumnsRenamed({f"{b}_x": b for b in bases})


def attach_categoricals(store: DataFrame, source: DataFrame, columns: list[str],
                        key: str = KEY) -> DataFrame:
    """Text columns from the source table, NULL as 'Unknown'."""
    present = [c for c in columns if c in source.columns]
    side = source.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c)
                                for c in present])
    return store.drop(*present).join(side, key, "left").fillna("Unknown", present)


def column_label(name: Column) -> Column:
    """Readable label of a column name; a table prefix becomes 'Table: '."""
    # Table prefixes.
    pattern = "^(bureau|prev|pos|inst|cc)_(.+)$"
    words = F.initcap(F.regexp_replace(name, "_", " "))
    prefixed = F.concat(F.initcap(F.regexp_extract(name, pattern, 1)), F.lit(": "),
                        F.initcap(F.regexp_replace(F.regexp_extract(name, pattern, 2), "_", " ")))
    return F.when(name.rlike(pattern), prefixed).otherwise(words)


def risk_band(pd_score: Column) -> Column:
    """Five tiers, lower bound inclusive."""
    # Tier bounds and names.
    return (F.when(pd_score < 0.05, "VERY_LOW").when(pd_score < 0.15, "LOW")
            .when(pd_score < 0.30, "MEDIUM").when(pd_score < 0.50, "HIGH")
            .otherwise("VERY_HIGH"))
