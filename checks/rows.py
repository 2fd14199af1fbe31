"""Driver queries: features over the joined frame, and profiling of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.features import BUREAU, CC, INST, LOANS, POS, PREV, clip_sql, ratio_sql
from checks.views import Tables, nudge_of, rounded, sql_rounded, with_views
from riskframe.functions import application as app
from riskframe.operators import profile
from riskframe.plans import training

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: rounded(fn(Tables(spark, folder)), nudge_of(sql))
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def frame(t: Tables):
    """Applicants with all child aggregates, NULL where a child table has no rows."""
    return training.joined_frame(t.tables(), sequences=False)


_ZERO = ", ".join(f"coalesce({c}, 0) AS {c}" for c in training.ZERO_WHEN_ABSENT)
_PARTS = {"loans": LOANS, "b": BUREAU, "p": PREV, "ps": POS, "i": INST, "c": CC}
_FRAME = f"""SELECT * REPLACE ({_ZERO}) FROM app LEFT JOIN b USING (SK_ID_CURR)
    LEFT JOIN p USING (SK_ID_CURR) LEFT JOIN ps USING (SK_ID_CURR)
    LEFT JOIN i USING (SK_ID_CURR) LEFT JOIN c USING (SK_ID_CURR)"""


def on_frame(select: str, doubles: str = "", longs: str = "", others: str = "", **ctes: str) -> str:
    return with_views("app bureau bbal prev inst pos cc",
                      sql_rounded(select, doubles, longs, others),
                      **_PARTS, f=_FRAME, **ctes)


def _cols(items: dict[str, str], wrap: bool = False) -> str:
    return ", ".join(f"{'coalesce(' + v + ', -999)' if wrap else v} AS {k}"
                     for k, v in items.items())


_SHARES = {
    "prev_approval_rate": ("prev_approved_cnt", "prev_cnt"),
    "prev_refusal_rate": ("prev_refused_cnt", "prev_cnt"),
    "inst_pct_late": ("inst_late_cnt", "inst_cnt"),
    "bureau_overdue_rate": ("bureau_overdue_cnt", "bureau_cnt"),
    "bureau_active_ratio": ("bureau_active_cnt", "bureau_cnt"),
    "bureau_debt_ratio": ("bureau_credit_debt_sum", "bureau_credit_sum"),
}
_RATES = {k: ratio_sql(*v) for k, v in _SHARES.items()}
_RATES["cc_overdue_flag"] = "CAST(coalesce(cc_sk_dpd_max, -999) > 0 AS INT)"
_RATES["pos_overdue_flag"] = "CAST(coalesce(pos_sk_dpd_max, -999) > 0 AS INT)"


@query("secondary_rates", on_frame(f"SELECT SK_ID_CURR, {_cols(_RATES)} FROM f",
                                   " ".join(_RATES), "SK_ID_CURR"))
def _(t):
    return app.aggregate_rates(frame(t)).select("SK_ID_CURR", *_RATES)


_INCOME1 = clip_sql("AMT_INCOME_TOTAL", 1)
_PCI = "CASE WHEN AMT_INCOME_TOTAL > 0 THEN prev_amt_credit_mean / AMT_INCOME_TOTAL ELSE 0 END"
_BDI = f"({clip_sql('bureau_credit_debt_sum', 0)}) / ({_INCOME1})"
_DSR = f"AMT_ANNUITY / (({_INCOME1}) / 12)"
_CLIPPED = {
    "prev_credit_income_ratio": f"coalesce({clip_sql(_PCI, 0, 100)}, -999)",
    "bureau_debt_to_income": f"coalesce({clip_sql(_BDI, None, 50)}, -999)",
    "debt_service_ratio": f"coalesce({clip_sql(_DSR, None, 10)}, -999)",
    "inst_late_dpd_ratio": "coalesce(inst_days_past_due_max / (abs(inst_days_past_due_mean) + 1), -999)",
    "new_credit_to_bureau_ratio": ratio_sql("AMT_CREDIT", "bureau_credit_sum", "-999"),
    "annuity_to_prev_annuity_ratio": ratio_sql("AMT_ANNUITY", "prev_amt_annuity_mean", "-999"),
    "bureau_overdue_to_income": ratio_sql("bureau_overdue_sum", "AMT_INCOME_TOTAL", "-999"),
    "bureau_active_to_prev_apps": ratio_sql("bureau_active_cnt", "prev_cnt", "-999"),
    "bureau_close_rate": ratio_sql("bureau_closed_cnt", "bureau_cnt", "-999"),
    "cc_utilisation_to_income": ratio_sql("(cc_utilization_mean * cc_bal_max)", "AMT_INCOME_TOTAL", "-999"),
}


@query("clipped_ratios", on_frame(f"SELECT SK_ID_CURR, {_cols(_CLIPPED)} FROM f",
                                  " ".join(_CLIPPED), "SK_ID_CURR"))
def _(t):
    return app.aggregate_rates(frame(t)).select("SK_ID_CURR", *_CLIPPED)


def _pos(x: str) -> str:
    return f"({clip_sql(x, 0)})"


_G = f"""SELECT *, {_RATES['bureau_overdue_rate']} AS borate, {_RATES['inst_pct_late']} AS ilate,
    {_CLIPPED['bureau_debt_to_income']} AS bdi, {ratio_sql('AMT_CREDIT', 'AMT_INCOME_TOTAL')} AS cir,
    {ratio_sql('AMT_ANNUITY', 'AMT_INCOME_TOTAL')} AS air,
    coalesce(list_avg([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3]), -999) AS emean,
    coalesce(list_min([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3]), -999) AS emin,
    coalesce(bureau_bbal_dpd_rate_6m_mean, 0) - coalesce(bureau_bbal_dpd_rate_12m_mean, 0) AS traj FROM f"""
_INTER = {
    "ext_credit_risk": f"coalesce({_pos('emean')} * {_pos('cir')}, -999)",
    "ext_annuity_risk": f"coalesce({_pos('emin')} * {_pos('air')}, -999)",
    "multi_dpd_flag": "CAST(coalesce(ilate > 0.1 AND cc_dpd_rate > 0.1, false) AS INT)",
    "bureau_inst_dpd": f"coalesce({_pos('borate')} * {_pos('inst_days_past_due_mean')}, -999)",
    "total_debt_exposure": "coalesce(" + clip_sql(
        f"(({_pos('bureau_credit_debt_sum')} + {_pos('cc_bal_max')}) / ({_INCOME1}))", 0, 100) + ", -999)",
    "leverage_vs_bureau": f"coalesce({_pos('bdi')} * {_pos('cir')}, -999)",
    "dpd_trajectory": "traj",
    "dpd_escalation": f"coalesce({_pos('traj')} * {_pos('inst_days_past_due_max')}, -999)",
    "debt_service_coverage": f"coalesce({_pos('AMT_INCOME_TOTAL')} / ({_pos('AMT_ANNUITY')} + {_pos('bureau_annuity_mean')} + 1), -999)",
}


def _featured(t):
    return app.secondary_features(app.application_features(frame(t)))


@query("interactions", on_frame(f"SELECT SK_ID_CURR, {_cols(_INTER)} FROM g",
                                " ".join(_INTER), "SK_ID_CURR", g=_G))
def _(t):
    return _featured(t).select("SK_ID_CURR", *_INTER)


_POLICY = {
    "no_bureau_history": "bureau_cnt = 0", "no_prev_applications": "prev_cnt = 0",
    "ever_dpd_bureau": "bureau_overdue_cnt > 0", "bureau_prolong_any": "bureau_prolong_sum > 0",
    "high_credit_income": "cir > 5", "low_payment_rate": f"{ratio_sql('AMT_ANNUITY', 'AMT_CREDIT')} < 0.03",
    "thin_file": "bureau_cnt = 0",
}


@query("policy_flags", on_frame(
    f"SELECT SK_ID_CURR, {_cols({k: f'CAST({v} AS INT)' for k, v in _POLICY.items()})} FROM g",
    "", "SK_ID_CURR " + " ".join(_POLICY), g=_G))
def _(t):
    return _featured(t).select("SK_ID_CURR", *_POLICY)


_R3, _R6, _R12 = (f"coalesce(bureau_bbal_dpd_rate_{m}m_mean, 0)" for m in (3, 6, 12))
_TREND = {
    "bureau_dpd_trend_3m_vs_12m": "coalesce(" + clip_sql(
        "(bureau_bbal_dpd_rate_3m_mean - bureau_bbal_dpd_rate_3m_to_12m_mean)", -1, 1) + ", -999)",
    "bureau_debt_to_new_credit": f"coalesce({_pos('bureau_credit_debt_sum')} / ({clip_sql('AMT_CREDIT', 1)}), -999)",
    "current_to_bureau_debt_ratio": "coalesce(CASE WHEN bureau_credit_debt_sum > 0 THEN least(AMT_CREDIT / (bureau_credit_debt_sum + 1), 100) END, -999)",
    "bbal_improving_flag": f"CAST({_R3} < {_R6} AS INT)",
    "bbal_dpd_acceleration_3m": f"({_R3} - {_R6}) - ({_R6} - {_R12})",
}


@query("bureau_trends", on_frame(f"SELECT SK_ID_CURR, {_cols(_TREND)} FROM f",
                                 " ".join(_TREND), "SK_ID_CURR"))
def _(t):
    return app.bureau_trend_features(frame(t)).select("SK_ID_CURR", *_TREND)


# ---- missing values -------------------------------------------------------------------

_APP = ["AMT_INCOME_TOTAL", "AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_2",
        "EXT_SOURCE_3", "bureau_annuity_mean", "prev_amt_credit_std", "pos_cnt_instalment_mean",
        "cc_utilization_mean", "inst_payment_diff_std"]
_MISS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, "
    f"1 - count({c}) / count(*) AS missing_rate FROM f" for c in _APP)


@query("missing_top", on_frame(f"SELECT * FROM ({_MISS}) WHERE n_null > 0",
                               "missing_rate", "n_rows n_null", '"column"'))
def _(t):
    return profile.missing_top(frame(t).select(_APP), 40)


@query("missing_drop", on_frame(
    "SELECT SK_ID_CURR, TARGET, coalesce(AMT_ANNUITY, -999) AS AMT_ANNUITY, "
    "coalesce(EXT_SOURCE_1, -999) AS EXT_SOURCE_1, coalesce(cc_bal_mean, -999) AS cc_bal_mean, "
    "coalesce(pos_sk_dpd_mean, -999) AS pos_sk_dpd_mean, cc_cnt, "
    "CAST(cc_cnt > 0 AS INT) AS cc_has_records, CAST(coalesce(bureau_bbal_cnt_mean, 0) > 0 AS INT) AS bureau_has_bbal FROM f",
    "AMT_ANNUITY EXT_SOURCE_1 cc_bal_mean pos_sk_dpd_mean",
    "SK_ID_CURR TARGET cc_cnt cc_has_records bureau_has_bbal"))
def _(t):
    return training.training_frame(t.tables(), sequences=False).select(
        "SK_ID_CURR", "TARGET", "AMT_ANNUITY", "EXT_SOURCE_1", "cc_bal_mean", "pos_sk_dpd_mean",
        "cc_cnt", "cc_has_records", "bureau_has_bbal")


# ---- profiling ------------------------------------------------------------------------

_COUNTS = {"bureau": "bureau_cnt", "previous_application": "prev_cnt", "pos_cash": "pos_cnt",
           "installments": "inst_cnt", "credit_card": "cc_cnt"}
_COVER = " UNION ALL ".join(
    [f"SELECT '{k}' AS source, count(*) FILTER ({c} > 0) AS applicants, count(*) FILTER ({c} > 0) * 100.0::DOUBLE / count(*) AS share, sum({c}) AS n_records FROM f"
     for k, c in _COUNTS.items()]
    + ["SELECT 'application', count(*), 100, count(*) FROM f"])


@query("source_coverage", on_frame(_COVER, "share", "applicants n_records", "source"))
def _(t):
    return profile.source_coverage(frame(t), _COUNTS)


@query("target_balance", with_views("app", """SELECT TARGET::BIGINT AS TARGET, count(*) AS n,
    round(count(*) / (SELECT count(*) FROM app), 6) AS share FROM app GROUP BY 1"""))
def _(t):
    return profile.target_balance(t.applicants(), "TARGET")


@query("sentinel_rates", with_views("app", sql_rounded("""SELECT count(*) AS n_rows,
    count(*) FILTER (DAYS_EMPLOYED = 365243) AS n_sentinel, avg(CAST(DAYS_EMPLOYED = 365243 AS INT)) AS share,
    avg(CASE WHEN DAYS_EMPLOYED = 365243 THEN TARGET END) AS rate_sentinel,
    avg(CASE WHEN DAYS_EMPLOYED <> 365243 THEN TARGET END) AS rate_other FROM app""",
    "share rate_sentinel rate_other", "n_rows n_sentinel")))
def _(t):
    return profile.sentinel_rates(t.applicants(), "DAYS_EMPLOYED", 365243, "TARGET")


_YEARS = "-DAYS_EMPLOYED / 365.25::DOUBLE"


@query("bin_rates", with_views("app", f"""SELECT CASE WHEN y <= 1 THEN '<1yr' WHEN y <= 2 THEN '1-2yr'
    WHEN y <= 5 THEN '2-5yr' WHEN y <= 10 THEN '5-10yr' WHEN y <= 20 THEN '10-20yr' ELSE '>20yr' END AS band,
    count(*) AS n, round(avg(TARGET), 6) AS rate FROM (SELECT TARGET, {_YEARS} AS y FROM app
    WHERE DAYS_EMPLOYED < 0) WHERE y > 0 AND y <= 50 GROUP BY 1"""))
def _(t):
    years = t.applicants().where("DAYS_EMPLOYED < 0").withColumn(
        "y", -F.col("DAYS_EMPLOYED") / 365.25)
    return profile.band_rates(years, "y", [0, 1, 2, 5, 10, 20, 50],
                              ["<1yr", "1-2yr", "2-5yr", "5-10yr", "10-20yr", ">20yr"], "TARGET")


@query("histogram", """WITH v AS (SELECT l_returnflag AS cls, least(l_extendedprice,
      (SELECT quantile_cont(l_extendedprice, 0.99) FROM lineitem)) AS x FROM lineitem),
    r AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
    SELECT cls, CAST(least(floor((x - lo) / (hi - lo) * 40), 39) AS BIGINT) AS bin, count(*) AS n
    FROM v, r GROUP BY 1, 2""")
def _(t):
    return profile.class_histogram(t.raw("lineitem").select(
        F.col("l_returnflag").alias("cls"), "l_extendedprice"), "cls", "l_extendedprice")


_CM = {"ltv": "CASE WHEN AMT_GOODS_PRICE > 0 THEN AMT_CREDIT / AMT_GOODS_PRICE END",
       "service": "CASE WHEN AMT_INCOME_TOTAL > 0 THEN AMT_ANNUITY / AMT_INCOME_TOTAL END",
       "income_to_credit": "CASE WHEN AMT_CREDIT > 0 THEN AMT_INCOME_TOTAL / AMT_CREDIT END"}


@query("class_medians", with_views("app", " UNION ALL ".join(
    f"SELECT TARGET::BIGINT AS TARGET, '{k}' AS feature, round(quantile_cont({v}, 0.5), 6) AS median FROM app GROUP BY 1"
    for k, v in _CM.items())))
def _(t):
    return profile.class_medians(profile.affordability(t.applicants()), "TARGET",
                                 ["ltv", "service", "income_to_credit"])


_PRES = {"has_bureau": "bureau_cnt", "has_prev": "prev_cnt", "has_inst": "inst_cnt", "has_cc": "cc_cnt"}
_H = "SELECT TARGET, " + ", ".join(f"CAST({c} > 0 AS INT) AS {k}" for k, c in _PRES.items()) + " FROM f"
_PAIRS = [(a, b) for i, a in enumerate(_PRES) for b in list(_PRES)[i + 1:]]
_PIV = " UNION ALL ".join(
    f"SELECT '{a}' AS first_flag, '{b}' AS second_flag, {a} AS first_value, {b} AS second_value, count(*) AS n, avg(TARGET) AS rate FROM h GROUP BY {a}, {b}"
    for a, b in _PAIRS)


@query("presence_pivot", on_frame(_PIV, "rate", "first_value second_value n",
                                  "first_flag second_flag", h=_H))
def _(t):
    return profile.presence_pairs(frame(t), _PRES, "TARGET")


@query("presence_rates", on_frame(" UNION ALL ".join(
    [f"SELECT '{k}' AS flag, {k} AS value, count(*) AS n, avg(TARGET) AS rate FROM h GROUP BY 2" for k in _PRES]
    + ["SELECT 'thin_credit', CAST(has_bureau = 0 AND has_prev = 0 AS INT), count(*), avg(TARGET) FROM h GROUP BY 2"]),
    "rate", "value n", "flag", h=_H))
def _(t):
    return profile.presence_rates(frame(t), _PRES, "TARGET")


_PB = ["bureau_cnt", "bureau_credit_sum", "bureau_overdue_max", "prev_amt_credit_mean",
       "prev_refused_cnt", "pos_sk_dpd_mean", "inst_payment_ratio_mean", "inst_days_past_due_mean",
       "cc_utilization_mean", "cc_limit_mean"]


@query("point_biserial", on_frame(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, n, r FROM (SELECT count(*) AS n, CASE WHEN stddev_pop({c}) > 0 AND stddev_pop(TARGET) > 0 "
    f"THEN corr({c}, TARGET) END AS r FROM f WHERE {c} IS NOT NULL) WHERE n > 100" for c in _PB),
    "r", "n", "feature"))
def _(t):
    return profile.target_correlations(frame(t), _PB, "TARGET")


@query("underpayment", on_frame("""SELECT CAST(coalesce(inst_payment_ratio_mean, 1) < 0.95 AND inst_late_cnt > 0 AS INT) AS underpaid,
    count(*) AS n, avg(TARGET) AS rate FROM f GROUP BY 1""", "rate", "underpaid n"))
def _(t):
    return profile.underpayment_rates(frame(t), "TARGET")


_Q = "quantile_cont(AMT_INCOME_TOTAL, {})"


@query("age_income_pivot", with_views("app", f"""SELECT age_band,
      1 + CAST(x > q1 AS INT) + CAST(x > q2 AS INT) + CAST(x > q3 AS INT) + CAST(x > q4 AS INT) AS income_quintile,
      count(*) AS n, round(avg(TARGET), 6) AS rate
    FROM (SELECT TARGET, AMT_INCOME_TOTAL AS x, CASE WHEN a <= 18 THEN NULL WHEN a <= 25 THEN '18-25' WHEN a <= 30 THEN '25-30'
      WHEN a <= 35 THEN '30-35' WHEN a <= 40 THEN '35-40' WHEN a <= 50 THEN '40-50' WHEN a <= 65 THEN '50-65'
      ELSE '65-80' END AS age_band FROM (SELECT *, least(greatest(-DAYS_BIRTH / 365.25::DOUBLE, 18), 80) AS a FROM capped)),
      (SELECT {_Q.format(0.2)} AS q1, {_Q.format(0.4)} AS q2, {_Q.format(0.6)} AS q3, {_Q.format(0.8)} AS q4 FROM capped)
    WHERE age_band IS NOT NULL GROUP BY 1, 2""",
    capped=f"SELECT * FROM app WHERE AMT_INCOME_TOTAL <= (SELECT {_Q.format(0.99)} FROM app)"))
def _(t):
    return profile.age_income_rates(t.applicants(), "TARGET")
