"""Driver queries: binning, selection, automatic aggregation, store audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.rows import _G, _INTER, _RATES, frame, on_frame
from checks.views import Tables, nudge_of, rounded, sql_rounded, with_views
from riskframe.operators import audit, autoagg, binning, profile, selection
from riskframe.plans import stores
from riskframe.functions.exprs import null_to_sentinel

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: rounded(fn(Tables(spark, folder)), nudge_of(sql))
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


# Lines as a labelled table: quantity and price are related to the label, tax is noise,
# ship delay is missing for small quantities, line status is constant text.
_COLS = ["qty", "price", "tax", "delay", "one"]


def labelled(t: Tables):
    return t.raw("lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("tax"),
        F.when(F.col("l_quantity") < 5, -999.0).otherwise(
            F.datediff("l_shipdate", F.to_date(F.lit("1994-01-01"))).cast("double")).alias("delay"),
        F.when(F.col("l_quantity") > 3, 7.0).alias("one"))


_LAB = """SELECT CAST(l_returnflag = 'R' AS INT) AS y, l_returnflag AS flag, l_linestatus AS line, l_quantity AS qty,
    l_extendedprice AS price, l_tax AS tax, CASE WHEN l_quantity < 5 THEN -999.0
      ELSE CAST(date_diff('day', DATE '1994-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) END AS delay,
    CASE WHEN l_quantity > 3 THEN 7.0::DOUBLE END AS one FROM lineitem"""
_VALS = " UNION ALL ".join(
    f"SELECT y, '{c}' AS feature, nullif({c}, -999) AS v FROM lab" for c in _COLS)
_EDGE = "SELECT feature, " + ", ".join(
    f"quantile_cont(v, {i / 10}) AS e{i}" for i in range(11)) + " FROM vals GROUP BY 1"
# bins are numbered over distinct edges: count distinct inner edges below the value
_INNER = ", ".join(f"e{i}" for i in range(1, 10))
_BIN = f"""CASE WHEN v IS NULL THEN -1 ELSE len(list_filter(list_distinct([{_INNER}]),
    lambda e: e > e0 AND e < e10 AND v > e)) END"""
_CNT = f"""SELECT vals.feature, {_BIN} AS bin, sum(y) AS ev, sum(1 - y) AS ne FROM vals JOIN edge USING (feature) GROUP BY 1, 2"""
_WOE = """SELECT feature, bin, ev, ne, CASE WHEN ev = 0 THEN 5 WHEN ne = 0 THEN -5
    ELSE greatest(least(ln((ne / sn) / (ev / se)), 5), -5) END AS w, ne / sn - ev / se AS d
    FROM (SELECT *, sum(ev::DOUBLE) OVER (PARTITION BY feature) AS se, sum(ne::DOUBLE) OVER (PARTITION BY feature) AS sn FROM cnt)"""
_CTES = {"lab": _LAB, "vals": _VALS, "edge": _EDGE, "cnt": _CNT, "woe": _WOE}


@query("woe_table", with_views("", """SELECT feature, bin::BIGINT AS bin, ev::BIGINT AS event_count, ne::BIGINT AS non_event_count,
    round(w, 6) AS woe, round(d * w, 6) + 0.0 AS iv_contrib FROM woe""", **_CTES))
def _(t):
    return binning.woe_table(labelled(t), "y", _COLS)


@query("iv_rank", with_views("", """SELECT feature, round(iv, 6) AS iv, CASE WHEN iv >= 0.5 THEN 'very strong'
    WHEN iv >= 0.3 THEN 'strong' WHEN iv >= 0.1 THEN 'medium' WHEN iv >= 0.02 THEN 'weak' ELSE 'useless' END AS strength
    FROM (SELECT feature, sum(d * w) AS iv FROM woe GROUP BY 1)""", **_CTES))
def _(t):
    return binning.iv_ranking(binning.woe_table(labelled(t), "y", _COLS))


@query("iv_filter", with_views("", """SELECT feature, round(iv, 6) AS iv, feature IN ('qty', 'price', 'tax', 'delay', 'one') AS present
    FROM (SELECT feature, sum(d * w) AS iv FROM woe GROUP BY 1) WHERE iv >= 0.0005""", **_CTES))
def _(t):
    out, kept = binning.filter_by_iv(labelled(t), "y", _COLS, 0.0005)
    rows = [(f, float(v), f in out.columns) for f, v in kept.items()]
    return t.spark.createDataFrame(rows, "feature string, iv double, present boolean")


@query("woe_apply", with_views("", """SELECT flag, feature, count(*) AS n, round(avg(w), 6) + 0.0 AS mean_woe FROM
    (SELECT flag, v.feature, CASE WHEN v IS NOT NULL AND e0 = e10 THEN -999 ELSE w END AS w FROM (""" + " UNION ALL ".join(
        f"SELECT flag, '{c}' AS feature, nullif({c}, -999) AS v FROM lab" for c in _COLS)
    + f""") v JOIN edge USING (feature) JOIN woe ON woe.feature = v.feature AND woe.bin = {_BIN}) GROUP BY 1, 2""",
    **_CTES))
def _(t):
    model = binning.fit_woe(labelled(t), "y", _COLS)
    encoded = binning.apply_woe(labelled(t), model, ["flag"])
    return encoded.unpivot(["flag"], list(model.iv), "feature", "woe").groupBy(
        "flag", "feature").agg(F.count("*").alias("n"), F.avg("woe").alias("mean_woe"))


@query("cat_woe", with_views("", """SELECT feature, category, ev::BIGINT AS event_count, ne::BIGINT AS non_event_count,
    round(ln(pn / pe), 6) + 0.0 AS woe, round((pn - pe) * ln(pn / pe), 6) + 0.0 AS iv_contrib FROM
    (SELECT *, (ev + 0.5::DOUBLE) / (te + 0.5 * k) AS pe, (ne + 0.5::DOUBLE) / (tn + 0.5 * k) AS pn FROM
      (SELECT *, count(*) OVER (PARTITION BY feature) AS k FROM
        (SELECT 'line' AS feature, line AS category, sum(late) AS ev, sum(1 - late) AS ne FROM c GROUP BY 2
         UNION ALL SELECT 'flag', flag, sum(late), sum(1 - late) FROM c GROUP BY 2)),
      (SELECT sum(late) AS te, sum(1 - late) AS tn FROM c))""",
    lab=_LAB, c="SELECT *, CAST(price > 60000 AS INT) AS late FROM lab"))
def _(t):
    rows = labelled(t).withColumn("late", (F.col("price") > 60000).cast("int"))
    return binning.categorical_woe(rows, "late", ["line", "flag"])


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "double_qty", "flat"]
_NUMSQL = "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_quantity * 2 + l_tax AS double_qty, 1.0::DOUBLE AS flat FROM lineitem"


def numbers(t: Tables):
    return t.raw("lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("double_qty"), F.lit(1.0).alias("flat"))


@query("variance_filter", with_views("", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_pop({c}), 4) AS variance, var_pop({c}) > 0.01 AS kept FROM n" for c in _NUM),
    n=_NUMSQL))
def _(t):
    rows = numbers(t)
    kept = selection.keep_varied(rows, _NUM)
    return selection.column_variances(rows, _NUM).select(
        "feature", F.round("variance", 4).alias("variance"),
        F.col("feature").isin(kept).alias("kept"))


_PAIRSQL = " UNION ALL ".join(
    f"SELECT '{a}' AS first, '{b}' AS second, abs(CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) ELSE 0 END) AS abs_r FROM n"
    for i, a in enumerate(_NUM) for b in _NUM[i + 1:])


@query("corr_pairs", with_views("", f"SELECT first, second, round(abs_r, 6) AS abs_r FROM ({_PAIRSQL}) WHERE abs_r > 0.5",
                                n=_NUMSQL))
def _(t):
    pairs = selection.correlated_pairs(numbers(t), _NUM, 0.5)
    return t.spark.createDataFrame(pairs, "first string, second string, abs_r double")


@query("corr_prune", with_views("", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, "
    + (f"NOT ({' OR '.join(f'coalesce(abs(CASE WHEN stddev_pop({e}) > 0 AND stddev_pop({c}) > 0 THEN corr({e}, {c}) END) > 0.85, false)' for e in _NUM[:i])})" if i else "bool_and(true)")
    + " AS kept FROM n" for i, c in enumerate(_NUM)), n=_NUMSQL))
def _(t):
    kept = selection.prune_later(numbers(t), _NUM, 0.85)
    return selection.column_variances(numbers(t), _NUM).select(
        "feature", F.col("feature").isin(kept).alias("kept"))


@query("top_variance", with_views("", f"SELECT first, second, round(abs_r, 6) AS abs_r FROM ({_PAIRSQL})", n=_NUMSQL))
def _(t):
    return profile.top_variance_correlations(numbers(t), _NUM, 6).select(
        F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b"), "abs_r"
    ).select(_in_schema_order("a", "b"), _in_schema_order("b", "a", last=True), "abs_r")


def _in_schema_order(x: str, y: str, last: bool = False):
    place = F.create_map(*[p for i, c in enumerate(_NUM) for p in (F.lit(c), F.lit(i))])
    a, b = F.col("a"), F.col("b")
    early = place[a] < place[b]
    return (F.when(early, b).otherwise(a).alias("second") if last
            else F.when(early, a).otherwise(b).alias("first"))


_QSTORE = ["AMT_CREDIT", "AMT_GOODS_PRICE", "bureau_cnt", "prev_cnt", "cc_cnt", "cc_bal_mean"]


@query("store_consistency", on_frame(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n_rows, count(*) - count({c}) AS n_null, min({c}) AS lo, max({c}) AS hi, count(DISTINCT {c}) <= 2 AS two_values FROM f"
    for c in [*_QSTORE, "TARGET"]), "lo hi", "n_rows n_null", "feature two_values"))
def _(t):
    return audit.store_consistency(frame(t), [*_QSTORE, "TARGET"])


@query("store_quality", on_frame("""SELECT 'zero_variance' AS "check", 0::BIGINT AS actual, true AS passed
    UNION ALL SELECT 'infinite_values', 0, true UNION ALL SELECT 'column_count', 6, false
    UNION ALL SELECT 'mostly_sentinel', CAST(avg(CAST(cc_bal_mean IS NULL AS INT)) > 0.95 AS INT) + CAST(avg(CAST(AMT_GOODS_PRICE IS NULL AS INT)) > 0.95 AS INT), avg(CAST(cc_bal_mean IS NULL AS INT)) <= 0.95 FROM f
    UNION ALL SELECT 'correlated_pairs', n, n = 0 FROM (SELECT """ + " + ".join(
        f"CAST(abs(corr(coalesce({a}, -999), coalesce({b}, -999))) > 0.9 AS BIGINT)" for i, a in enumerate(_QSTORE) for b in _QSTORE[i + 1:])
    + " AS n FROM f)", "", "actual", '"check" passed'))
def _(t):
    return audit.store_quality(null_to_sentinel(frame(t), _QSTORE), _QSTORE)


# ---- automatic aggregation ------------------------------------------------------------

_AUTO = [
    ("bureau", "bureau e LEFT JOIN bb USING (SK_ID_BUREAU)",
     ["DAYS_CREDIT", "CREDIT_DAY_OVERDUE", "CNT_CREDIT_PROLONG", "AMT_CREDIT_MAX_OVERDUE",
      "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE", "AMT_ANNUITY",
      "bb_dpd_mean", "bb_dpd_max"], ["CREDIT_ACTIVE"]),
    ("credit_card", "(SELECT * FROM cc WHERE MONTHS_BALANCE < 0)",
     ["MONTHS_BALANCE", "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "AMT_DRAWINGS_ATM_CURRENT",
      "AMT_DRAWINGS_CURRENT", "AMT_INST_MIN_REGULARITY", "AMT_PAYMENT_CURRENT", "SK_DPD"], []),
]
_BB = """SELECT SK_ID_BUREAU, coalesce(avg(d), 0) AS bb_dpd_mean, coalesce(max(d), 0) AS bb_dpd_max FROM
    (SELECT SK_ID_BUREAU, CASE WHEN MONTHS_BALANCE < 0 THEN CAST(STATUS IN ('1','2','3','4','5') AS INT) END AS d FROM bbal) GROUP BY 1"""


def _auto_cols(child, nums, cats):
    yield f"count__{child}", "count(*)"
    for fn, sql in (("mean", "avg"), ("sum", "sum"), ("std", "stddev_samp")):
        for c in nums:
            x = f"coalesce({c}, 0)" if c.startswith("bb_") else c
            yield f"{fn}__{child}__{c}", f"{sql}({x})"
    for c in cats:
        yield f"num_unique__{child}__{c}", f"count(DISTINCT {c})"


_AUTO_NAMES = [n for child, _, nums, cats in _AUTO for n, _ in _auto_cols(child, nums, cats)]
_AUTO_PARTS = {f"a{i}": f"SELECT SK_ID_CURR, {', '.join(f'{e} AS {n}' for n, e in _auto_cols(child, nums, cats))} FROM {src} GROUP BY 1"
               for i, (child, src, nums, cats) in enumerate(_AUTO)}


@query("auto_agg", with_views("app bureau bbal cc", sql_rounded(
    f"SELECT SK_ID_CURR, {', '.join(f'round(coalesce({n}, -999) + 0.0000123, 3) AS {n}' for n in _AUTO_NAMES)} FROM app LEFT JOIN a0 USING (SK_ID_CURR) LEFT JOIN a1 USING (SK_ID_CURR)",
    " ".join(_AUTO_NAMES), "SK_ID_CURR"), bb=_BB, **_AUTO_PARTS))
def _(t):
    matrix, _ = autoagg.auto_features(t.tables())
    return matrix.select("SK_ID_CURR", *[F.round(F.col(n) + 0.0000123, 3).alias(n) for n in _AUTO_NAMES])


# ---- stores (rows-only: their columns depend on fitted choices) ------------------------

@query("scorecard_store", None)
def _(t):
    return stores.fit_scorecard(frame(t).drop("ORGANIZATION_TYPE")).frame


@query("tree_store", None)
def _(t):
    return stores.tree_store_from_tables(t.tables()).frame


@query("auto_store", None)
def _(t):
    return stores.fit_auto_store(t.tables()).frame


_WORTH = {"AMT_CREDIT": 4.0, "EXT_SOURCE_2": 3.0, "EXT_SOURCE_3": 2.0, "DAYS_EMPLOYED": 1.0}
_CROSS = [(a, b) for i, a in enumerate(_WORTH) for b in list(_WORTH)[i + 1:]]


@query("interaction_iv", with_views("app", """SELECT feature, round(iv, 6) AS iv, CASE WHEN iv >= 0.5 THEN 'very strong'
    WHEN iv >= 0.3 THEN 'strong' WHEN iv >= 0.1 THEN 'medium' WHEN iv >= 0.02 THEN 'weak' ELSE 'useless' END AS strength
    FROM (SELECT feature, sum(d * w) AS iv FROM woe GROUP BY 1) WHERE iv >= 0.02""",
    vals=" UNION ALL ".join(f"SELECT TARGET AS y, '{a}_x_{b}' AS feature, {a} * {b} AS v FROM app" for a, b in _CROSS),
    edge=_EDGE, cnt=_CNT, woe=_WOE))
def _(t):
    return stores.interaction_candidates(t.applicants(), _WORTH, 4)
