"""Driver queries: row-wise features and child-table histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import Tables, nudge_of, rounded, sql_rounded, with_views
from riskframe.functions import application as app
from riskframe.operators import history as hist
from riskframe.sources import tables as src

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def register(fn):
        QUERIES[name] = lambda spark, folder: rounded(fn(Tables(spark, folder)), nudge_of(sql))
        SQL[name] = sql
        return fn
    return register


def ratio_sql(num: str, den: str, other: str = "0") -> str:
    return f"CASE WHEN {den} > 0 THEN coalesce({num}::DOUBLE / {den}, -999) ELSE {other} END"


def clip_sql(x: str, low=None, high=None) -> str:
    inner = x
    if low is not None:
        inner = f"greatest({inner}, {low})"
    if high is not None:
        inner = f"least({inner}, {high})"
    return f"CASE WHEN ({x}) IS NOT NULL THEN {inner} END"


# ---- integrity ------------------------------------------------------------------------

@query("pk_guard", """SELECT sum(n)::BIGINT AS n_rows,
    coalesce(sum(CASE WHEN l_orderkey IS NULL THEN n END), 0)::BIGINT AS null_keys,
    coalesce(sum(CASE WHEN l_orderkey IS NOT NULL THEN n - 1 END), 0)::BIGINT AS surplus_rows
    FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def _(t):
    return src.key_report(t.raw("lineitem"), "l_orderkey")


@query("semi_filter", with_views("cc app prev", """
    SELECT SK_ID_CURR, count(*) AS n FROM cc
    WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM app WHERE TARGET = 0) GROUP BY 1"""))
def _(t):
    good = t.applicants().where("TARGET = 0")
    return src.keep_keys(t.cc(), good, "SK_ID_CURR").groupBy("SK_ID_CURR").agg(
        F.count("*").alias("n"))


# ---- row-wise -------------------------------------------------------------------------

_RATIOS = {
    "CREDIT_INCOME_RATIO": ratio_sql("AMT_CREDIT", "AMT_INCOME_TOTAL"),
    "ANNUITY_INCOME_RATIO": ratio_sql("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "CREDIT_TERM": ratio_sql("AMT_CREDIT", "AMT_ANNUITY"),
    "GOODS_CREDIT_RATIO": ratio_sql("AMT_GOODS_PRICE", "AMT_CREDIT"),
    "payment_rate": ratio_sql("AMT_ANNUITY", "AMT_CREDIT"),
}


def _named(items: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in items.items())


@query("ratios", with_views("app", sql_rounded(
    f"SELECT SK_ID_CURR, {_named(_RATIOS)} FROM app", " ".join(_RATIOS), "SK_ID_CURR")))
def _(t):
    return app.amount_ratios(t.applicants()).select("SK_ID_CURR", *_RATIOS)


_WORKED = "greatest(-(CASE WHEN DAYS_EMPLOYED = 365243 THEN 0 ELSE DAYS_EMPLOYED END) / 365.25::DOUBLE, 0)"
_AGE = "(-DAYS_BIRTH / 365.25::DOUBLE)"


@query("tenure", with_views("app", sql_rounded(
    f"""SELECT SK_ID_CURR, {_AGE} AS AGE_YEARS, {_WORKED} AS YEARS_EMPLOYED,
    CASE WHEN {_AGE} > 0 THEN {_WORKED} / {_AGE} ELSE 0 END AS EMPLOYED_TO_AGE_RATIO,
    FLAG_DOCUMENT_2 + FLAG_DOCUMENT_3 + FLAG_DOCUMENT_5 AS DOCUMENTS_SUBMITTED,
    CAST(FLAG_DOCUMENT_3 = 0 AS INT) AS HIGH_RISK_DOC_MISSING FROM app""",
    "AGE_YEARS YEARS_EMPLOYED EMPLOYED_TO_AGE_RATIO",
    "SK_ID_CURR DOCUMENTS_SUBMITTED HIGH_RISK_DOC_MISSING")))
def _(t):
    return app.document_counts(app.age_and_tenure(t.applicants())).select(
        "SK_ID_CURR", "AGE_YEARS", "YEARS_EMPLOYED", "EMPLOYED_TO_AGE_RATIO",
        "DOCUMENTS_SUBMITTED", "HIGH_RISK_DOC_MISSING")


_SCORE_STATS = {
    "EXT_SOURCE_MEAN": "list_avg(v)", "EXT_SOURCE_MIN": "list_min(v)",
    "EXT_SOURCE_MAX": "list_max(v)", "EXT_SOURCE_MEDIAN": "list_median(v)",
    "EXT_SOURCE_STD": "list_stddev_pop(v)", "EXT_SOURCE_RANGE": "list_max(v) - list_min(v)",
    "EXT_SOURCE_NUM_AVAILABLE": "len(v)", "ext_source_missing_count": "3 - len(v)",
    "EXT_SOURCE_1_missing": "CAST(e1 IS NULL AS INT)",
    "EXT_SOURCE_2_missing": "CAST(e2 IS NULL AS INT)",
    "EXT_SOURCE_3_missing": "CAST(e3 IS NULL AS INT)",
}
_SCORE_PRODUCTS = {
    "EXT_SOURCE_PROD_12": "e1 * e2", "EXT_SOURCE_PROD_13": "e1 * e3",
    "EXT_SOURCE_PROD_23": "e2 * e3", "EXT_SOURCE_1_SQ": "e1 * e1", "EXT_SOURCE_2_SQ": "e2 * e2",
    "EXT_SOURCE_RATIO_12": "CASE WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN CASE WHEN abs(e2) > 0.0001 THEN e1 / e2 ELSE 0 END END",
    "EXT_SOURCE_RATIO_23": "CASE WHEN e2 IS NOT NULL AND e3 IS NOT NULL THEN CASE WHEN abs(e3) > 0.0001 THEN e2 / e3 ELSE 0 END END",
    "EXT_SCORE_FLOOR": "list_min(v) * list_avg(v)", "ext_source_prod": "e1 * e2 * e3",
}
_SCORES_CTE = """SELECT SK_ID_CURR, EXT_SOURCE_1 AS e1, EXT_SOURCE_2 AS e2, EXT_SOURCE_3 AS e3,
    list_filter([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3], lambda x: x IS NOT NULL) AS v FROM app"""


def _score_sql(items):
    body = ", ".join(f"coalesce({v}, -999) AS {k}" for k, v in items.items())
    return with_views("app", sql_rounded(f"SELECT SK_ID_CURR, {body} FROM s",
                                         " ".join(items), "SK_ID_CURR"), s=_SCORES_CTE)


@query("row_stats", _score_sql(_SCORE_STATS))
def _(t):
    return app.score_statistics(t.applicants()).select("SK_ID_CURR", *_SCORE_STATS)


@query("products_ratios", _score_sql(_SCORE_PRODUCTS))
def _(t):
    return app.score_statistics(t.applicants()).select("SK_ID_CURR", *_SCORE_PRODUCTS)


@query("risk_band", with_views("scored", """SELECT CASE WHEN score_b < 0.05 THEN 'VERY_LOW'
    WHEN score_b < 0.15 THEN 'LOW' WHEN score_b < 0.3 THEN 'MEDIUM' WHEN score_b < 0.5 THEN 'HIGH'
    ELSE 'VERY_HIGH' END AS band, count(*) AS n, sum(label)::BIGINT AS events FROM scored GROUP BY 1"""))
def _(t):
    return t.scored().groupBy(app.risk_band(F.col("score_b")).alias("band")).agg(
        F.count("*").alias("n"), F.sum("label").alias("events"))


@query("label_format", """SELECT DISTINCT event_type, CASE event_type
    WHEN 'click' THEN 'Bureau: Click Flag' WHEN 'view' THEN 'Bureau: View Flag'
    WHEN 'signup' THEN 'Bureau: Signup Flag' WHEN 'purchase' THEN 'Bureau: Purchase Flag'
    WHEN 'error' THEN 'Bureau: Error Flag' END AS prefixed,
    upper(event_type[1]) || event_type[2:] || ' Source 1' AS plain FROM events""")
def _(t):
    names = t.raw("events").select("event_type").distinct()
    return names.select(
        "event_type",
        app.column_label(F.concat(F.lit("bureau_"), "event_type", F.lit("_flag"))).alias("prefixed"),
        app.column_label(F.concat("event_type", F.lit("_source_1"))).alias("plain"))


# ---- child tables ---------------------------------------------------------------------

_DPD = "CAST(STATUS IN ('1','2','3','4','5') AS INT)"
_SEV = "CASE WHEN STATUS IN ('C','X') THEN 0 ELSE CAST(STATUS AS INT) END"


def avg_if(cond: str, x: str) -> str:
    return f"avg(CASE WHEN {cond} THEN {x} END)"


LOANS = f"""SELECT SK_ID_BUREAU, count(MONTHS_BALANCE) AS bbal_cnt, avg({_DPD}) AS bbal_dpd_rate,
    stddev_samp({_DPD}) AS bbal_dpd_rate_std, max({_SEV}) AS bbal_max_severity,
    count(*) FILTER (STATUS NOT IN ('C','X')) AS bbal_active_months,
    {avg_if('MONTHS_BALANCE >= -3', _DPD)} AS bbal_dpd_rate_3m,
    {avg_if('MONTHS_BALANCE >= -6', _DPD)} AS bbal_dpd_rate_6m,
    {avg_if('MONTHS_BALANCE BETWEEN -12 AND -7', _DPD)} AS bbal_dpd_rate_12m,
    {avg_if('MONTHS_BALANCE BETWEEN -12 AND -3', _DPD)} AS bbal_dpd_rate_3m_to_12m,
    max(CASE WHEN MONTHS_BALANCE >= -6 THEN {_SEV} END) AS bbal_recent_max_severity,
    {avg_if('MONTHS_BALANCE >= -6', _DPD)} - {avg_if('MONTHS_BALANCE BETWEEN -12 AND -7', _DPD)} AS bbal_dpd_trend,
    -max(CASE WHEN {_DPD} = 1 THEN MONTHS_BALANCE END) AS months_since_dpd,
    round_even({avg_if('MONTHS_BALANCE >= -6', _DPD)} - {avg_if('MONTHS_BALANCE < -6', _DPD)}, 3) AS recent_vs_prior
    FROM bbal GROUP BY SK_ID_BUREAU"""


@query("bbal_loan_agg", with_views("bbal", sql_rounded(LOANS,
    "bbal_dpd_rate bbal_dpd_rate_std bbal_dpd_rate_3m bbal_dpd_rate_6m bbal_dpd_rate_12m "
    "bbal_dpd_rate_3m_to_12m bbal_dpd_trend",
    "SK_ID_BUREAU bbal_cnt bbal_max_severity bbal_active_months bbal_recent_max_severity")))
def _(t):
    return hist.loan_balances(t.bbal()).select("SK_ID_BUREAU", *hist.BALANCE_COLUMNS)


_MEANS = ", ".join(f"avg({c}) AS bureau_{c}_mean" for c in hist.LOAN_MEANS)
BUREAU = f"""SELECT SK_ID_CURR, count(SK_ID_BUREAU) AS bureau_cnt,
    count(*) FILTER (CREDIT_ACTIVE = 'Active') AS bureau_active_cnt,
    count(*) FILTER (CREDIT_ACTIVE = 'Closed') AS bureau_closed_cnt,
    count(*) FILTER (CREDIT_DAY_OVERDUE > 0) AS bureau_overdue_cnt,
    avg(DAYS_CREDIT) AS bureau_days_credit_mean, min(DAYS_CREDIT) AS bureau_days_credit_min,
    max(DAYS_CREDIT) AS bureau_days_credit_max, stddev_samp(DAYS_CREDIT) AS bureau_days_credit_std,
    sum(AMT_CREDIT_SUM) AS bureau_credit_sum, avg(AMT_CREDIT_SUM) AS bureau_amt_credit_mean,
    coalesce(sum(AMT_CREDIT_SUM_DEBT), 0) AS bureau_credit_debt_sum,
    stddev_samp(AMT_CREDIT_SUM_DEBT) AS bureau_credit_debt_std,
    max(AMT_CREDIT_SUM_DEBT) AS bureau_credit_debt_max,
    sum(AMT_CREDIT_SUM_OVERDUE) AS bureau_credit_overdue_sum,
    sum(AMT_CREDIT_SUM_OVERDUE) AS bureau_overdue_sum,
    max(AMT_CREDIT_MAX_OVERDUE) AS bureau_max_overdue_amt, avg(AMT_ANNUITY) AS bureau_annuity_mean,
    max(CREDIT_DAY_OVERDUE) AS bureau_overdue_max, sum(CNT_CREDIT_PROLONG) AS bureau_prolong_sum,
    count(*) FILTER (DAYS_CREDIT >= -365) AS bureau_recent_openings,
    max(DAYS_CREDIT) AS bureau_days_since_last_credit, {_MEANS},
    round_even(round(avg(months_since_dpd), 9), 3) AS bbal_months_since_last_dpd,
    round_even(round(avg(bbal_dpd_rate_3m), 9), 3) AS bbal_dpd_last_3m_rate,
    round_even(round(avg(recent_vs_prior), 9), 3) AS bbal_dpd_last_6m_vs_prior_rate
    FROM bureau LEFT JOIN loans USING (SK_ID_BUREAU) GROUP BY SK_ID_CURR"""
_BUREAU_INT = ("SK_ID_CURR bureau_cnt bureau_active_cnt bureau_closed_cnt bureau_overdue_cnt "
               "bureau_days_credit_min bureau_days_credit_max bureau_overdue_max "
               "bureau_prolong_sum bureau_recent_openings bureau_days_since_last_credit")
_BUREAU_DBL = ("bureau_days_credit_mean bureau_days_credit_std bureau_credit_sum "
               "bureau_amt_credit_mean bureau_credit_debt_sum bureau_credit_debt_std "
               "bureau_credit_debt_max bureau_credit_overdue_sum bureau_overdue_sum "
               "bureau_max_overdue_amt bureau_annuity_mean "
               + " ".join(f"bureau_{c}_mean" for c in hist.LOAN_MEANS))
_RECENCY = ["bbal_months_since_last_dpd", "bbal_dpd_last_3m_rate",
            "bbal_dpd_last_6m_vs_prior_rate"]


def _sum4(df):
    """Sums of amounts rounded to 4 digits: addition order moves the last bits."""
    big = {"bureau_credit_sum", "bureau_credit_debt_sum", "prev_amt_credit_sum",
           "inst_amt_payment_sum", "bureau_credit_debt_std", "prev_amt_credit_std"}
    return df.withColumns({c: F.round(c, 4) for c in df.columns if c in big})


@query("bureau_agg", with_views("bureau bbal", sql_rounded(
    BUREAU, _BUREAU_DBL, _BUREAU_INT), loans=LOANS))
def _(t):
    return hist.bureau_summary(t.bureau(), t.bbal()).drop(*_RECENCY)


@query("dpd_recency", with_views("bureau bbal", sql_rounded(
    BUREAU, " ".join(_RECENCY), "SK_ID_CURR"), loans=LOANS))
def _(t):
    return hist.bureau_summary(t.bureau(), t.bbal()).select("SK_ID_CURR", *_RECENCY)


PREV = """SELECT SK_ID_CURR, count(SK_ID_PREV) AS prev_cnt,
    count(*) FILTER (NAME_CONTRACT_STATUS = 'Approved') AS prev_approved_cnt,
    count(*) FILTER (NAME_CONTRACT_STATUS = 'Refused') AS prev_refused_cnt,
    count(*) FILTER (NAME_CONTRACT_STATUS = 'Canceled') AS prev_cancelled_cnt,
    avg(AMT_CREDIT) AS prev_amt_credit_mean, sum(AMT_CREDIT) AS prev_amt_credit_sum,
    stddev_samp(AMT_CREDIT) AS prev_amt_credit_std, max(AMT_CREDIT) AS prev_amt_credit_max,
    avg(AMT_APPLICATION) AS prev_amt_application_mean, avg(AMT_ANNUITY) AS prev_annuity_mean,
    avg(AMT_ANNUITY) AS prev_amt_annuity_mean, avg(AMT_DOWN_PAYMENT) AS prev_amt_down_payment_mean,
    avg(CASE WHEN AMT_APPLICATION > 0 THEN AMT_CREDIT / AMT_APPLICATION END) AS prev_credit_to_app_ratio_mean,
    min(DAYS_DECISION) AS prev_days_decision_min, avg(DAYS_DECISION) AS prev_days_decision_mean,
    max(DAYS_DECISION) AS prev_days_decision_max, avg(CNT_PAYMENT) AS prev_cnt_payment_mean,
    avg(RATE_DOWN_PAYMENT) AS prev_rate_down_payment_mean FROM prev GROUP BY 1"""


@query("prev_agg", with_views("prev", sql_rounded(
    PREV, "prev_amt_credit_mean prev_amt_credit_sum prev_amt_credit_std prev_amt_credit_max "
    "prev_amt_application_mean prev_annuity_mean prev_amt_annuity_mean "
    "prev_amt_down_payment_mean prev_credit_to_app_ratio_mean prev_days_decision_mean "
    "prev_cnt_payment_mean prev_rate_down_payment_mean",
    "SK_ID_CURR prev_cnt prev_approved_cnt prev_refused_cnt prev_cancelled_cnt "
    "prev_days_decision_min prev_days_decision_max")))
def _(t):
    return hist.previous_summary(t.prev())


POS = """SELECT SK_ID_CURR, count(MONTHS_BALANCE) AS pos_cnt, avg(MONTHS_BALANCE) AS pos_months_balance_mean,
    avg(CNT_INSTALMENT) AS pos_cnt_instalment_mean, stddev_samp(CNT_INSTALMENT) AS pos_cnt_instalment_std,
    max(SK_DPD) AS pos_sk_dpd_max, stddev_samp(SK_DPD) AS pos_sk_dpd_std, avg(SK_DPD) AS pos_sk_dpd_mean,
    max(SK_DPD_DEF) AS pos_sk_dpd_def_max, count(*) FILTER (SK_DPD > 0) AS pos_overdue_cnt,
    avg(CAST(SK_DPD > 0 AS INT)) AS pos_overdue_rate,
    count(*) FILTER (NAME_CONTRACT_STATUS = 'Active') AS pos_active_cnt,
    count(*) FILTER (NAME_CONTRACT_STATUS = 'Completed') AS pos_completed_cnt FROM pos GROUP BY 1"""


@query("pos_agg", with_views("pos", sql_rounded(
    POS, "pos_months_balance_mean pos_cnt_instalment_mean pos_cnt_instalment_std pos_sk_dpd_std "
    "pos_sk_dpd_mean pos_overdue_rate",
    "SK_ID_CURR pos_cnt pos_sk_dpd_max pos_sk_dpd_def_max pos_overdue_cnt pos_active_cnt "
    "pos_completed_cnt")))
def _(t):
    return hist.pos_summary(t.pos())


_SHARE = "CASE WHEN AMT_INSTALMENT <> 0 THEN AMT_PAYMENT / AMT_INSTALMENT END"
INST = f"""SELECT SK_ID_CURR, count(DAYS_INSTALMENT) AS inst_cnt,
    count(*) FILTER (DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT) AS inst_late_cnt,
    coalesce(sum(AMT_PAYMENT), 0) AS inst_amt_payment_sum, avg(AMT_INSTALMENT) AS inst_amt_instalment_mean,
    avg({_SHARE}) AS inst_payment_ratio_mean, stddev_samp({_SHARE}) AS inst_payment_ratio_std,
    min({_SHARE}) AS inst_payment_ratio_min, max({_SHARE}) AS inst_payment_ratio_max,
    avg(AMT_INSTALMENT - AMT_PAYMENT) AS inst_payment_diff_mean,
    stddev_samp(AMT_INSTALMENT - AMT_PAYMENT) AS inst_payment_diff_std,
    avg(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT) AS inst_days_past_due_mean,
    max(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT) AS inst_days_past_due_max,
    stddev_samp(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT) AS inst_days_past_due_std FROM inst GROUP BY 1"""
_INST_DBL = ("inst_amt_payment_sum inst_amt_instalment_mean inst_payment_ratio_mean "
             "inst_payment_ratio_std inst_payment_ratio_min inst_payment_ratio_max "
             "inst_payment_diff_mean inst_payment_diff_std inst_days_past_due_mean "
             "inst_days_past_due_max inst_days_past_due_std")


@query("inst_agg", with_views("inst", sql_rounded(
    INST, _INST_DBL, "SK_ID_CURR inst_cnt inst_late_cnt")))
def _(t):
    return hist.instalment_summary(t.inst())


_USED = "CASE WHEN AMT_CREDIT_LIMIT_ACTUAL > 0 THEN AMT_BALANCE / AMT_CREDIT_LIMIT_ACTUAL END"
CC = f"""SELECT SK_ID_CURR, count(MONTHS_BALANCE) AS cc_cnt, avg(AMT_BALANCE) AS cc_bal_mean,
    max(AMT_BALANCE) AS cc_bal_max, min(AMT_BALANCE) AS cc_bal_min, stddev_samp(AMT_BALANCE) AS cc_bal_std,
    avg(AMT_DRAWINGS_CURRENT) AS cc_drawing_mean, stddev_samp(AMT_DRAWINGS_CURRENT) AS cc_drawing_std,
    avg(AMT_DRAWINGS_ATM_CURRENT) AS cc_atm_drawing_mean, avg({_USED}) AS cc_utilization_mean,
    max({_USED}) AS cc_utilization_max, stddev_samp({_USED}) AS cc_utilization_std,
    avg(AMT_CREDIT_LIMIT_ACTUAL) AS cc_limit_mean, max(SK_DPD) AS cc_sk_dpd_max,
    avg(SK_DPD) AS cc_sk_dpd_mean, avg(CAST(SK_DPD > 0 AS INT)) AS cc_dpd_rate,
    avg(CASE WHEN AMT_INST_MIN_REGULARITY > 0 THEN AMT_PAYMENT_CURRENT / AMT_INST_MIN_REGULARITY END) AS cc_min_payment_ratio_mean
    FROM cc GROUP BY 1"""


@query("cc_agg", with_views("cc", sql_rounded(
    CC, "cc_bal_mean cc_bal_max cc_bal_min cc_bal_std cc_drawing_mean cc_drawing_std "
    "cc_atm_drawing_mean cc_utilization_mean cc_utilization_max cc_utilization_std cc_limit_mean "
    "cc_sk_dpd_mean cc_dpd_rate cc_min_payment_ratio_mean", "SK_ID_CURR cc_cnt cc_sk_dpd_max")))
def _(t):
    return hist.card_summary(t.cc())


_L30 = "CAST(coalesce(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT > 30, false) AS INT)"
_Q1 = avg_if("DAYS_INSTALMENT >= -90", _L30)
_Q2 = avg_if("DAYS_INSTALMENT >= -180 AND DAYS_INSTALMENT < -90", _L30)
_Y1 = avg_if("DAYS_INSTALMENT >= -365", _L30)


@query("late_rates", with_views("inst", sql_rounded(f"""SELECT SK_ID_CURR,
    coalesce({_Y1}, -999) AS inst_late_rate_12m,
    coalesce({_Y1} - avg({_L30}), -999) AS inst_late_rate_recent_vs_historical,
    coalesce({_Q1}, -999) AS inst_rolling_30dpd_ratio_3m FROM inst GROUP BY 1""",
    "inst_late_rate_12m inst_late_rate_recent_vs_historical inst_rolling_30dpd_ratio_3m",
    "SK_ID_CURR")))
def _(t):
    return hist.late_rates(t.inst()).select(
        "SK_ID_CURR", "inst_late_rate_12m", "inst_late_rate_recent_vs_historical",
        "inst_rolling_30dpd_ratio_3m")


@query("escalation", with_views("inst", sql_rounded(f"""SELECT SK_ID_CURR,
    CASE WHEN {_Q1} IS NOT NULL AND {_Q2} IS NOT NULL THEN CAST({_Q1} > {_Q2} AS INT)
         WHEN {_Q1} IS NOT NULL THEN 1 WHEN {_Q2} IS NOT NULL THEN 0 ELSE -999 END AS inst_delinquency_escalation_flag,
    coalesce({_Q1} - {_Q2}, 0) AS inst_late_payment_acceleration FROM inst GROUP BY 1""",
    "inst_delinquency_escalation_flag inst_late_payment_acceleration", "SK_ID_CURR")))
def _(t):
    return hist.late_rates(t.inst()).select(
        "SK_ID_CURR", "inst_delinquency_escalation_flag", "inst_late_payment_acceleration")


@query("days_since_30dpd", with_views("inst", sql_rounded(f"""SELECT SK_ID_CURR,
    coalesce(max(DAYS_INSTALMENT) - max(CASE WHEN {_L30} = 1 THEN DAYS_INSTALMENT END), -1) AS inst_days_since_last_30dpd
    FROM inst GROUP BY 1""", "inst_days_since_last_30dpd", "SK_ID_CURR")))
def _(t):
    return hist.late_rates(t.inst()).select("SK_ID_CURR", "inst_days_since_last_30dpd")


_CODE = "CASE WHEN STATUS IN ('C','X') THEN -1 ELSE CAST(STATUS AS INT) END"


@query("status_profile", with_views("obal", sql_rounded(f"""SELECT SK_ID_CURR,
    max(CAST(STATUS = '0' AS INT)) AS bbal_ever_30dpd, max(CAST(STATUS = '1' AS INT)) AS bbal_ever_60dpd,
    max(CAST(STATUS = '2' AS INT)) AS bbal_ever_90dpd, max({_CODE}) AS bbal_max_status_code,
    avg(CAST(STATUS = 'C' AS INT)) AS bbal_pct_current,
    coalesce(CASE WHEN avg({_CODE}) + 0.01::DOUBLE <> 0 THEN stddev_samp({_CODE}) / (avg({_CODE}) + 0.01::DOUBLE) END, 0) AS bbal_status_volatility
    FROM obal GROUP BY 1""",
    "bbal_ever_30dpd bbal_ever_60dpd bbal_ever_90dpd bbal_max_status_code bbal_pct_current "
    "bbal_status_volatility", "SK_ID_CURR")))
def _(t):
    return hist.status_profile(t.bureau(), t.bbal()).drop("bbal_dpd_escalation",
                                                    "bbal_max_dpd_months_ago")


@query("status_escalation", with_views("obal", sql_rounded(f"""SELECT o.SK_ID_CURR,
    CAST(any_value(n) >= 2 AND max(CASE WHEN MONTHS_BALANCE = hi THEN {_CODE} END)
         > min(CASE WHEN MONTHS_BALANCE = lo THEN {_CODE} END) AS INT) AS bbal_dpd_escalation
    FROM obal o JOIN (SELECT SK_ID_CURR AS k, count(*) AS n, max(MONTHS_BALANCE) AS hi,
      min(MONTHS_BALANCE) AS lo FROM obal GROUP BY 1) ON k = o.SK_ID_CURR GROUP BY 1""",
    "bbal_dpd_escalation", "SK_ID_CURR")))
def _(t):
    return hist.status_profile(t.bureau(), t.bbal()).select("SK_ID_CURR", "bbal_dpd_escalation")


@query("worst_month", with_views("obal", sql_rounded(f"""SELECT SK_ID_CURR,
    CASE WHEN any_value(w) > -1 THEN min(abs(MONTHS_BALANCE)) ELSE -999 END AS bbal_max_dpd_months_ago
    FROM obal JOIN (SELECT SK_ID_CURR AS k, max({_CODE}) AS w FROM obal GROUP BY 1) ON k = SK_ID_CURR
    WHERE {_CODE} = w GROUP BY 1""", "bbal_max_dpd_months_ago", "SK_ID_CURR")))
def _(t):
    return hist.status_profile(t.bureau(), t.bbal()).select("SK_ID_CURR", "bbal_max_dpd_months_ago")


_PS = "AMT_PAYMENT / (AMT_INSTALMENT + 1e-6)"


@query("consistency", with_views("inst", sql_rounded(f"""SELECT SK_ID_CURR,
    greatest(avg(CAST(coalesce(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT <= 0, false) AS INT))
      - CASE WHEN stddev_samp({_PS}) IS NULL THEN 1 WHEN stddev_samp({_PS}) = 0 OR avg({_PS}) = 0 THEN 0
        ELSE least(stddev_samp({_PS}) / (avg({_PS}) + 0.01::DOUBLE), 1) END, 0) AS inst_payment_consistency_score,
    sum(coalesce(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT, 0) / (1 + abs(DAYS_INSTALMENT) / 30))
      / sum(1 / (1 + abs(DAYS_INSTALMENT) / 30)) AS inst_recency_weighted_dpd,
    avg(CAST(coalesce(DAYS_ENTRY_PAYMENT < DAYS_INSTALMENT, false) AS INT)) AS inst_early_payment_pct,
    avg(CAST(coalesce(AMT_PAYMENT > AMT_INSTALMENT * 1.2::DOUBLE, false) AS INT)) AS inst_large_payment_freq
    FROM inst GROUP BY 1""",
    "inst_payment_consistency_score inst_recency_weighted_dpd inst_early_payment_pct "
    "inst_large_payment_freq", "SK_ID_CURR")))
def _(t):
    return hist.payment_habits(t.inst())


_U = "least(greatest(AMT_BALANCE / (AMT_CREDIT_LIMIT_ACTUAL + 1e-6), 0), 1)"
_UT = f"CASE WHEN AMT_BALANCE IS NOT NULL THEN {_U} END"
_R = avg_if("MONTHS_BALANCE IN (0, -1)", "AMT_BALANCE")
_P = avg_if("MONTHS_BALANCE IN (-2, -3)", "AMT_BALANCE")


@query("cc_trends", with_views("cc", sql_rounded(f"""SELECT SK_ID_CURR,
    coalesce(CASE WHEN {_P} + 1 <> 0 THEN ({_R} - {_P}) / ({_P} + 1) END, 0) AS cc_balance_velocity_3m,
    coalesce({avg_if('MONTHS_BALANCE IN (0,-1,-2,-3)', _UT)} - {avg_if('MONTHS_BALANCE IN (-3,-4,-5,-6)', _UT)}, 0) AS cc_utilization_trend,
    coalesce(CASE WHEN avg(coalesce(AMT_BALANCE, 0)) <> 0 THEN stddev_samp(coalesce(AMT_BALANCE, 0)) / avg(coalesce(AMT_BALANCE, 0)) END, 0) AS cc_balance_volatility,
    avg(CAST(AMT_DRAWINGS_ATM_CURRENT > 0 AS INT)) AS cc_atm_drawing_frequency FROM cc GROUP BY 1""",
    "cc_balance_velocity_3m cc_utilization_trend cc_balance_volatility cc_atm_drawing_frequency",
    "SK_ID_CURR")))
def _(t):
    return hist.card_trends(t.cc().withColumnRenamed("AMT_CREDIT_LIMIT_ACTUAL",
                                                     "AMT_CREDIT_LIMIT"))


@query("reject_profile", with_views("prev", sql_rounded("""SELECT SK_ID_CURR,
    max(CAST(CODE_REJECT_REASON = 'FRAUD' AS INT)) AS prev_reject_fraud_flag,
    avg(CAST(CODE_REJECT_REASON IN ('HC', 'LIMIT', 'SCOFR') AS INT)) AS prev_reject_high_risk_pct,
    avg(CAST(NAME_GOODS_CATEGORY IN ('Auto', 'Real estate') AS INT)) AS prev_goods_secured_pct,
    coalesce(avg(nullif(RATE_INTEREST_PRIMARY, -999)), 0) AS prev_interest_rate_mean FROM prev GROUP BY 1""",
    "prev_reject_fraud_flag prev_reject_high_risk_pct prev_goods_secured_pct "
    "prev_interest_rate_mean", "SK_ID_CURR")))
def _(t):
    return hist.rejection_profile(t.prev())


@query("time_features", with_views("app bureau bbal obal", sql_rounded(f"""SELECT a.SK_ID_CURR,
    coalesce(r, -999) AS bbal_dpd_rate_3m, coalesce(newest, -999) AS bbal_months_since_last_dpd,
    coalesce(oldest, -999) AS bbal_months_since_first_dpd, coalesce(age, -999) AS bureau_credit_age_mean
    FROM app a LEFT JOIN (SELECT SK_ID_CURR, {avg_if('MONTHS_BALANCE >= -3', _DPD)} AS r,
      -max(CASE WHEN {_DPD} = 1 THEN MONTHS_BALANCE END) AS newest,
      -min(CASE WHEN {_DPD} = 1 THEN MONTHS_BALANCE END) AS oldest FROM obal GROUP BY 1) USING (SK_ID_CURR)
    LEFT JOIN (SELECT SK_ID_CURR, avg(abs(DAYS_CREDIT) / 365.25::DOUBLE) AS age FROM bureau GROUP BY 1) USING (SK_ID_CURR)""",
    "bbal_dpd_rate_3m bbal_months_since_last_dpd bbal_months_since_first_dpd "
    "bureau_credit_age_mean", "SK_ID_CURR")))
def _(t):
    return hist.time_features(t.applicants(), t.bureau(), t.bbal())


# ---- ordered histories ----------------------------------------------------------------

_DPD0 = "CASE WHEN DAYS_ENTRY_PAYMENT IS NOT NULL THEN greatest(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT, 0) END"
_ORDER = "DAYS_INSTALMENT NULLS FIRST, DAYS_ENTRY_PAYMENT NULLS FIRST, AMT_INSTALMENT NULLS FIRST, AMT_PAYMENT NULLS FIRST"
_SEQ = f"""SELECT *, {_DPD0} AS dpd, row_number() OVER w AS seq, count(*) OVER (PARTITION BY SK_ID_CURR) AS n,
    coalesce(DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT, false) AS late
    FROM inst WINDOW w AS (PARTITION BY SK_ID_CURR ORDER BY {_ORDER})"""
_RUNS = """SELECT SK_ID_CURR, max(len) AS run FROM (SELECT SK_ID_CURR, count(*) AS len FROM
    (SELECT SK_ID_CURR, seq - row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY seq) AS g FROM seqs WHERE late)
    GROUP BY SK_ID_CURR, g) GROUP BY 1"""


@query("late_streak", with_views("inst", sql_rounded("""SELECT SK_ID_CURR,
    coalesce(max(run), 0) AS inst_max_consec_late_streak,
    round_even(-max(CASE WHEN late THEN DAYS_INSTALMENT END) / 30, 2) AS inst_months_since_last_late
    FROM seqs LEFT JOIN runs USING (SK_ID_CURR) GROUP BY 1""", "inst_months_since_last_late",
    "SK_ID_CURR inst_max_consec_late_streak"), seqs=_SEQ, runs=_RUNS))
def _(t):
    return hist.late_streak(t.inst())


@query("dpd_run", with_views("inst", sql_rounded("""SELECT SK_ID_CURR,
    coalesce(max(run), 0) AS inst_longest_dpd_streak,
    coalesce(abs(max(DAYS_INSTALMENT) - max(CASE WHEN dpd > 0 THEN DAYS_INSTALMENT END)) / 30, 999) AS inst_months_since_last_dpd
    FROM seqs LEFT JOIN runs USING (SK_ID_CURR) GROUP BY 1""",
    "inst_longest_dpd_streak inst_months_since_last_dpd", "SK_ID_CURR"), seqs=_SEQ, runs=_RUNS))
def _(t):
    return hist.payment_sequence(t.inst()).select(
        "SK_ID_CURR", "inst_longest_dpd_streak", "inst_months_since_last_dpd")


@query("slopes", with_views("inst", sql_rounded(f"""SELECT SK_ID_CURR,
    CASE WHEN count(*) > 1 THEN coalesce(regr_slope(AMT_INSTALMENT, seq), 0) ELSE 0 END AS inst_payment_amt_slope,
    coalesce(CASE WHEN count(*) > 1 AND count(*) = count(AMT_PAYMENT) THEN regr_slope({_PS}, seq) END, 0) AS inst_payment_ratio_trend
    FROM seqs GROUP BY 1""", "inst_payment_amt_slope inst_payment_ratio_trend", "SK_ID_CURR"),
    seqs=_SEQ))
def _(t):
    return hist.payment_sequence(t.inst()).select(
        "SK_ID_CURR", "inst_payment_amt_slope", "inst_payment_ratio_trend")


@query("payment_slope", with_views("inst", sql_rounded("""SELECT SK_ID_CURR,
    CASE WHEN count(*) < 3 THEN 0 WHEN count(*) = count(AMT_PAYMENT) THEN regr_slope(AMT_PAYMENT, seq) END AS inst_payment_trend_slope
    FROM (SELECT *, row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY DAYS_ENTRY_PAYMENT NULLS LAST,
      DAYS_INSTALMENT, AMT_INSTALMENT, AMT_PAYMENT) AS seq FROM inst) GROUP BY 1""",
    "inst_payment_trend_slope", "SK_ID_CURR")))
def _(t):
    return hist.payment_slope(t.inst())


@query("recent6", with_views("inst", sql_rounded("""SELECT SK_ID_CURR,
    coalesce(CASE WHEN count(*) = count(dpd) THEN avg(CASE WHEN seq > n - 6 THEN dpd END) / (avg(dpd) + 1e-6) END, 0) AS inst_recent_vs_historical_dpd
    FROM seqs GROUP BY 1""", "inst_recent_vs_historical_dpd", "SK_ID_CURR"), seqs=_SEQ))
def _(t):
    return hist.payment_sequence(t.inst()).select("SK_ID_CURR", "inst_recent_vs_historical_dpd")


@query("recent12", with_views("inst", sql_rounded("""SELECT SK_ID_CURR,
    coalesce(avg(CASE WHEN seq > n - 12 THEN dpd END), 0) AS inst_recent_late_mean,
    coalesce(avg(CASE WHEN seq > n - 12 THEN AMT_INSTALMENT - AMT_PAYMENT END), 0) AS inst_recent_underpay,
    coalesce(avg(CASE WHEN seq > n - 12 THEN dpd END) - avg(dpd), 0) AS inst_late_trend,
    coalesce(max(AMT_INSTALMENT - AMT_PAYMENT), 0) AS inst_payment_diff_max
    FROM seqs GROUP BY 1""",
    "inst_recent_late_mean inst_recent_underpay inst_late_trend inst_payment_diff_max",
    "SK_ID_CURR"), seqs=_SEQ))
def _(t):
    return hist.recent_payments(t.inst()).drop("inst_late_skew")


@query("late_skew", with_views("inst", sql_rounded(f"""SELECT SK_ID_CURR,
    coalesce(CASE WHEN any_value(c) = any_value(r) AND any_value(c) > 1 AND any_value(s) > 0
      THEN avg((dpd - m) ** 3) / any_value(s) ** 3 END, 0) AS inst_late_skew
    FROM seqs JOIN (SELECT SK_ID_CURR AS k, avg(dpd) AS m, stddev_pop(dpd) AS s, count(dpd) AS c,
      count(*) AS r FROM seqs GROUP BY 1) ON k = SK_ID_CURR GROUP BY 1""", "inst_late_skew",
    "SK_ID_CURR"), seqs=_SEQ))
def _(t):
    return hist.recent_payments(t.inst()).select("SK_ID_CURR", "inst_late_skew")
