"""Driver queries: store assembly, table guards, alignment, samples, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.learned import BAND_SQL, FIXED_CTES, fixed_bundle
from checks.rows import _cols, frame, on_frame
from checks.views import Tables, nudge_of, rounded, sql_rounded, with_views
from riskframe.functions import application as app
from riskframe.functions import exprs
from riskframe.operators import history, selection, splits
from riskframe.plans import stores, training
from riskframe.session import shared_folder
from riskframe.sources import tables as src
from riskframe.streaming import scoring as stream

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: rounded(fn(Tables(spark, folder)), nudge_of(sql))
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


_FULL = ["AMT_INCOME_TOTAL", "AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "EXT_SOURCE_3",
         "bureau_days_credit_std", "bureau_credit_debt_std", "bureau_bbal_dpd_rate_mean",
         "bureau_bbal_dpd_trend_mean", "prev_amt_credit_std", "prev_credit_to_app_ratio_mean",
         "prev_amt_down_payment_mean", "pos_cnt_instalment_std", "pos_sk_dpd_mean",
         "inst_payment_ratio_std", "inst_days_past_due_mean", "cc_utilization_mean", "cc_bal_std"]
_KEPT = ["bureau_cnt", "bureau_active_cnt", "prev_cnt", "pos_cnt", "pos_overdue_cnt", "inst_cnt",
         "inst_late_cnt", "cc_cnt"]


@query("training_frame", on_frame(
    f"SELECT SK_ID_CURR, TARGET, {_cols({c: f'coalesce({c}, -999)' for c in _FULL})}, {', '.join(_KEPT)} FROM f",
    " ".join(_FULL), "SK_ID_CURR TARGET " + " ".join(_KEPT)))
def _(t):
    return training.training_frame(t.tables()).select("SK_ID_CURR", "TARGET", *_FULL, *_KEPT)


@query("history_store", None)
def _(t):
    wide = stores.history_features(t.applicants().select("SK_ID_CURR"), t.tables())
    return wide.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c, k in wide.dtypes
                                               if k == "double"])


@query("pair_products", with_views("app", sql_rounded(
    "SELECT SK_ID_CURR, AMT_CREDIT * EXT_SOURCE_2 AS AMT_CREDIT_x_EXT_SOURCE_2, EXT_SOURCE_1 * EXT_SOURCE_3 AS EXT_SOURCE_1_x_EXT_SOURCE_3 FROM app",
    "AMT_CREDIT_x_EXT_SOURCE_2 EXT_SOURCE_1_x_EXT_SOURCE_3", "SK_ID_CURR")))
def _(t):
    pairs = [("AMT_CREDIT", "EXT_SOURCE_2"), ("EXT_SOURCE_1", "EXT_SOURCE_3"), ("AMT_CREDIT", "absent")]
    return app.pair_products(t.applicants(), pairs).select(
        "SK_ID_CURR", "AMT_CREDIT_x_EXT_SOURCE_2", "EXT_SOURCE_1_x_EXT_SOURCE_3")


@query("attach_categoricals", with_views("app cc", """SELECT k AS SK_ID_CURR, n, coalesce(NAME_EDUCATION_TYPE, 'Unknown') AS NAME_EDUCATION_TYPE,
    coalesce(nullif(CODE_GENDER, 'XNA'), 'Unknown') AS CODE_GENDER FROM (SELECT SK_ID_CURR AS k, count(*) AS n FROM cc GROUP BY 1)
    LEFT JOIN app ON SK_ID_CURR = k"""))
def _(t):
    store = t.cc().groupBy("SK_ID_CURR").agg(F.count("*").alias("n"))
    people = t.applicants().withColumn("CODE_GENDER", F.nullif(F.col("CODE_GENDER"), F.lit("XNA")))
    return app.attach_categoricals(store, people, ["NAME_EDUCATION_TYPE", "CODE_GENDER"])


@query("side_by_side", with_views("app cc", sql_rounded(
    "SELECT app.SK_ID_CURR, TARGET, AMT_CREDIT, n FROM app JOIN (SELECT SK_ID_CURR, count(*) AS n FROM cc GROUP BY 1) USING (SK_ID_CURR)",
    "AMT_CREDIT", "SK_ID_CURR TARGET n")))
def _(t):
    counts = t.cc().groupBy("SK_ID_CURR").agg(F.count("*").alias("n"),
                                              F.lit(0.0).alias("AMT_CREDIT"))
    return stores.side_by_side(t.applicants().select("SK_ID_CURR", "TARGET", "AMT_CREDIT"), counts)


@query("key_intersection", with_views("app cc", """SELECT SK_ID_CURR FROM app
    INTERSECT SELECT SK_ID_CURR FROM cc"""))
def _(t):
    return stores.shared_keys(t.applicants(), t.cc())


@query("orphan_drop", with_views("bbal prev", """SELECT SK_ID_CURR, count(*) AS n, min(MONTHS_BALANCE)::BIGINT AS oldest FROM bbal
    JOIN (SELECT DISTINCT SK_ID_PREV AS SK_ID_BUREAU, SK_ID_CURR FROM prev WHERE NAME_CONTRACT_STATUS = 'Approved') USING (SK_ID_BUREAU) GROUP BY 1"""))
def _(t):
    tables = t.tables()
    tables["bureau"] = tables["bureau"].where("CREDIT_ACTIVE = 'Closed'")
    return src.history_frames(tables)["bbal"].groupBy("SK_ID_CURR").agg(
        F.count("*").alias("n"), F.min("MONTHS_BALANCE").alias("oldest"))


@query("align_columns", with_views("app", sql_rounded(
    "SELECT SK_ID_CURR, EXT_SOURCE_2, -999 AS absent_column, AMT_CREDIT FROM app",
    "EXT_SOURCE_2 absent_column AMT_CREDIT", "SK_ID_CURR")))
def _(t):
    return src.align_columns(t.applicants(), ["SK_ID_CURR", "EXT_SOURCE_2", "absent_column",
                                              "AMT_CREDIT"])


@query("sentinel_cycle", with_views("app", sql_rounded(
    "SELECT SK_ID_CURR, coalesce(EXT_SOURCE_1, -999) AS EXT_SOURCE_1, EXT_SOURCE_3 FROM app",
    "EXT_SOURCE_1 EXT_SOURCE_3", "SK_ID_CURR")))
def _(t):
    rows = t.applicants().select("SK_ID_CURR", "EXT_SOURCE_1", "EXT_SOURCE_3")
    filled = exprs.null_to_sentinel(rows, ["EXT_SOURCE_1", "EXT_SOURCE_3"])
    return exprs.sentinel_to_null(filled, ["EXT_SOURCE_3"])


@query("regulated_drop", with_views("app", """SELECT count(*) AS rows_before, count(*) AS rows_after, 0::BIGINT AS lost_keys,
    'CODE_GENDER,AGE_YEARS,EMPLOYED_TO_AGE_RATIO' AS dropped FROM app"""))
def _(t):
    people = app.age_and_tenure(t.applicants())
    report = app.drop_report(people, app.drop_regulated(people, strict=True))
    return report.select("rows_before", "rows_after", "lost_keys",
                         F.concat_ws(",", "dropped_columns").alias("dropped"))


@query("novel_columns", """SELECT f AS feature, r <= 0.9 AS kept FROM (
    SELECT 'twice' AS f, greatest(abs(corr(l_quantity * 2 + l_tax, l_quantity)), abs(corr(l_quantity * 2 + l_tax, l_discount))) AS r FROM lineitem
    UNION ALL SELECT 'l_tax', greatest(abs(corr(l_tax, l_quantity)), abs(corr(l_tax, l_discount))) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', greatest(abs(corr(l_extendedprice, l_quantity)), abs(corr(l_extendedprice, l_discount))) FROM lineitem)""")
def _(t):
    rows = t.raw("lineitem").withColumn("twice", F.col("l_quantity") * 2 + F.col("l_tax"))
    new = ["twice", "l_tax", "l_extendedprice"]
    kept = selection.novel_columns(rows, ["l_quantity", "l_discount"], new)
    return selection.column_variances(rows, new).select(
        "feature", F.col("feature").isin(kept).alias("kept"))


_ORD = ["o_orderkey", "o_custkey"]


@query("seeded_sample", "SELECT least(1000, count(*)) AS n, least(1000, count(*)) AS n_keys FROM orders")
def _(t):
    picked = selection.seeded_sample(t.raw("orders").select(*_ORD), ["o_orderkey"], 1000)
    return picked.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


@query("first_share", """SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r,
    count(*) OVER () AS n FROM orders) WHERE r <= floor(n * 0.75)""")
def _(t):
    rows = t.raw("orders").select(*_ORD, "o_orderdate")
    return splits.first_share(rows, 0.75, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("commit_decision", with_views("scored", """SELECT round(b, 6) AS baseline_gini, round(c, 6) AS candidate_gini,
    round(c - b, 6) AS gain, CASE WHEN c - b >= 0.01 THEN 'commit' ELSE 'defer' END AS decision FROM (
    SELECT 2 * (SELECT sum(p * (cn - g / 2.0::DOUBLE)) FROM la) / t - 1 AS b, 2 * (SELECT sum(p * (cn - g / 2.0::DOUBLE)) FROM lb) / t - 1 AS c
    FROM (SELECT sum(label)::DOUBLE * sum(1 - label) AS t FROM scored))""",
    la="SELECT p, g, sum(g) OVER (ORDER BY score_c) AS cn FROM (SELECT score_c, sum(label) AS p, sum(1 - label) AS g FROM scored GROUP BY 1)",
    lb="SELECT p, g, sum(g) OVER (ORDER BY score_a) AS cn FROM (SELECT score_a, sum(label) AS p, sum(1 - label) AS g FROM scored GROUP BY 1)"))
def _(t):
    out = stores.commit_decision(t.scored(), "label", "score_c", "score_a")
    return t.spark.createDataFrame([out]).select("baseline_gini", "candidate_gini", "gain",
                                                 "decision")


@query("row_guard", with_views("app cc", """SELECT count(*) AS n, count(DISTINCT SK_ID_CURR) AS n_keys FROM app"""))
def _(t):
    people = t.applicants()
    joined = people.join(t.cc().groupBy("SK_ID_CURR").agg(F.count("*").alias("k")), "SK_ID_CURR", "left")
    src.assert_same_rows(people, joined, "cards")
    return joined.agg(F.count("*").alias("n"), F.count_distinct("SK_ID_CURR").alias("n_keys"))


@query("extended_store", None)
def _(t):
    people = t.applicants().select("SK_ID_CURR", "TARGET", "AMT_CREDIT").fillna(-999.0)
    auto = exprs.null_to_sentinel(history.previous_summary(t.prev()))
    times = history.time_features(t.applicants(), t.bureau(), t.bbal())
    return stores.extended_store(people, auto.withColumn("SK_ID_CURR", F.col("SK_ID_CURR").cast("long")), times)


@query("score_stream", with_views("app", f"""SELECT {BAND_SQL} AS risk_band, count(*) AS n, round(avg(p), 6) AS mean_probability
    FROM probs GROUP BY 1""", **FIXED_CTES))
def _(t):
    """Customers arrive as files and are scored by the function that scores batches."""
    people, folder = t.applicants().drop("TARGET"), f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"
    people.write.parquet(f"{folder}/in")
    arriving = stream.application_stream(t.spark, f"{folder}/in", people.schema)
    stream.score_stream(arriving, fixed_bundle(t), f"{folder}/out",
                        f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").groupBy("risk_band").agg(
        F.count("*").alias("n"), F.avg("probability").alias("mean_probability"))
