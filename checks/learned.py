"""Driver queries: model jobs and scoring. Fitted values have no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import Tables, nudge_of, rounded, sql_rounded, with_views
from riskframe.operators import models
from riskframe.plans import scoring

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: rounded(fn(Tables(spark, folder)), nudge_of(sql))
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


_X = ["qty", "price", "disc", "tax"]
_KEY = ["id", "line", "qty", "price"]


def rows(t: Tables):
    """Every line item as a training row; the label depends on price and discount."""
    return t.raw("lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        F.col("l_shipdate").alias("shipped"),
        ((F.col("l_extendedprice") * (1 - F.col("l_discount")) > 55000)
         != (F.col("l_tax") > 0.075)).cast("int").alias("label"))


def scores(t: Tables):
    return t.scored().select("id", "fold", "label", "score_a", "score_b", "score_c",
                             F.col("shipped"))


@query("scorecard_fit", None)
def _(t):
    return models.scorecard_report(rows(t), _X, "label", _KEY, folds=3)


@query("boosted_oof", None)
def _(t):
    scored = models.out_of_fold(rows(t), models.boosted_fitter(_X, "label", trees=5, depth=4),
                                "label", _KEY, "shipped", folds=2)
    return models.metrics.metric_suite(scored, "label", "score", ["fold"])


@query("calibrate", None)
def _(t):
    s = scores(t).withColumnRenamed("score_b", "score")
    return models.calibration_report(s.where("fold <= 4"), s.where("fold > 4"), "label",
                                     ["id", "fold", "score_a"])


@query("impute", """WITH d AS (SELECT l_quantity AS qty, CASE WHEN l_tax >= 0.02 THEN l_extendedprice / 100000 END AS target FROM lineitem),
    m AS (SELECT regr_slope(target, qty) AS a, regr_intercept(target, qty) AS b FROM d)
    SELECT CAST(target IS NULL AS BIGINT) AS "target_MISSING_FLAG", count(*) AS n, round(avg(coalesce(target, a * qty + b)), 6) AS mean
    FROM d, m GROUP BY 1""")
def _(t):
    data = rows(t).withColumn("target", F.when(F.col("tax") < 0.02, None).otherwise(
        F.col("price") / 100000))
    fitted = models.fit_imputer(data, "target", ["qty"], linear=True)
    return models.apply_imputer(data, "target", fitted).groupBy("target_MISSING_FLAG").agg(
        F.count("*").alias("n"), F.avg("target").alias("mean"))


@query("blend", with_views("scored", sql_rounded("""SELECT fold, count(*) AS n,
    avg((score_a + score_b + score_c) / 3) AS mean, avg((score_a + score_b) / 2) AS mean2 FROM scored GROUP BY 1""",
    "mean mean2", "n fold")))
def _(t):
    both = models.blend_mean(models.blend_mean(scores(t), ["score_a", "score_b", "score_c"]),
                             ["score_a", "score_b"], "blend2")
    return both.groupBy("fold").agg(F.count("*").alias("n"), F.avg("blend").alias("mean"),
                                    F.avg("blend2").alias("mean2"))


@query("stack", None)
def _(t):
    s = scores(t)
    stacked = models.fit_logistic_stack(s, ["score_a", "score_b", "score_c"], "label").score(s)
    return models.metrics.metric_suite(stacked, "label", "score", ["fold"])


@query("ridge_stack", None)
def _(t):
    s = scores(t)
    fitted = models.fit_ridge_stack(s, ["score_a", "score_b", "score_c"], "label", folds=2)
    return models.metrics.metric_suite(fitted(s), "label", "score", ["fold"])


@query("calibrated_stack", None)
def _(t):
    stacked = models.calibrated_stack(scores(t).drop("fold"), ["score_a", "score_b"], "label",
                                      ["id", "score_a", "score_b"], "shipped", 2)
    return models.metrics.metric_suite(stacked, "label", "score", ["fold"])


@query("subset_ablation", None)
def _(t):
    return models.subset_ablation(scores(t), ["score_a", "score_b", "score_c"], "label", 2)


@query("imbalance", None)
def _(t):
    data = rows(t).where("shipped IS NOT NULL")
    cut = F.col("shipped") < F.lit("2000-01-01").cast("timestamp")
    return models.imbalance_report(data.where(cut), data.where(~cut), _X, "label", _KEY, folds=2,
                                   trees=3, depth=3)


@query("shift_report", None)
def _(t):
    data = rows(t).drop("label")
    cut = F.col("shipped") < F.lit("2000-01-01").cast("timestamp")
    return models.shift_report(data.where(cut), data.where(~cut), _X, _KEY, folds=2, trees=3)


@query("learning_curve", None)
def _(t):
    return models.learning_curve(rows(t), models.linear_fitter(_X, "label"), "label", _KEY,
                                 "shipped", folds=2)


_RAW = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1",
        "EXT_SOURCE_2", "EXT_SOURCE_3", "DAYS_BIRTH", "DAYS_EMPLOYED"]


@query("median_fill", with_views("app", sql_rounded("SELECT SK_ID_CURR, " + ", ".join(
    f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM app)) AS {c}" for c in _RAW) + " FROM app",
    " ".join(_RAW), "SK_ID_CURR")))
def _(t):
    defaults = scoring.fit_defaults(t.applicants(), _RAW)
    return scoring.fill_defaults(t.applicants(), defaults).select("SK_ID_CURR", *_RAW)


@query("score_batch", None)
def _(t):
    people = t.applicants()
    columns = ["CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO", "EXT_SOURCE_MEAN", "AGE_YEARS",
               "YEARS_EMPLOYED", "payment_rate"]
    bundle = scoring.fit_bundle(people, _RAW, columns, "TARGET")
    return scoring.score(people, bundle).select(
        "SK_ID_CURR", "probability", "risk_band", "model_version",
        F.col("factors")[0]["feature"].alias("first_factor"))


# A scorecard with given coefficients, so that batch and stream can be checked by SQL.
_MODEL = models.LinearScore(["CREDIT_INCOME_RATIO", "EXT_SOURCE_MEAN", "AGE_YEARS"],
                            [0.02, -2.5, -0.03], [10.0, 0.5, 40.0], -2.0)


def fixed_bundle(t: Tables) -> scoring.ScoreBundle:
    return scoring.ScoreBundle(scoring.fit_defaults(t.applicants(), _RAW), _MODEL, (0.9, -0.1))


FIXED_CTES = {
    "filled": "SELECT SK_ID_CURR, " + ", ".join(
        f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM app)) AS {c}" for c in _RAW) + " FROM app",
    "parts": """SELECT SK_ID_CURR, 0.02::DOUBLE * (CASE WHEN AMT_INCOME_TOTAL > 0 THEN AMT_CREDIT / AMT_INCOME_TOTAL ELSE 0 END - 10) AS c1,
        -2.5::DOUBLE * ((EXT_SOURCE_1 + EXT_SOURCE_2 + EXT_SOURCE_3) / 3 - 0.5) AS c2,
        -0.03::DOUBLE * (-DAYS_BIRTH / 365.25::DOUBLE - 40) AS c3 FROM filled""",
    "probs": """SELECT *, 1 / (1 + exp(-(0.9::DOUBLE * (1 / (1 + exp(-(-2 + c1 + c2 + c3)))) - 0.1))) AS p FROM parts""",
}
BAND_SQL = """CASE WHEN p < 0.05 THEN 'VERY_LOW' WHEN p < 0.15 THEN 'LOW' WHEN p < 0.3 THEN 'MEDIUM'
    WHEN p < 0.5 THEN 'HIGH' ELSE 'VERY_HIGH' END"""


@query("score_given_model", with_views("app", sql_rounded(f"""SELECT SK_ID_CURR, p AS probability, {BAND_SQL} AS risk_band,
    CASE WHEN abs(c1) >= abs(c2) AND abs(c1) >= abs(c3) THEN 'CREDIT_INCOME_RATIO'
      WHEN abs(c2) >= abs(c3) THEN 'EXT_SOURCE_MEAN' ELSE 'AGE_YEARS' END AS first_factor,
    greatest(abs(c1), abs(c2), abs(c3)) AS size FROM probs""", "probability size", "SK_ID_CURR",
    "risk_band first_factor"), **FIXED_CTES))
def _(t):
    return scoring.score(t.applicants(), fixed_bundle(t)).select(
        "SK_ID_CURR", "probability", "risk_band", F.col("factors")[0]["feature"].alias("first_factor"),
        F.abs(F.col("factors")[0]["contribution"]).alias("size"))


@query("contributions", with_views("app", sql_rounded(
    "SELECT SK_ID_CURR, c1 AS CREDIT_INCOME_RATIO, c2 AS EXT_SOURCE_MEAN, c3 AS AGE_YEARS FROM parts",
    "CREDIT_INCOME_RATIO EXT_SOURCE_MEAN AGE_YEARS", "SK_ID_CURR"), **FIXED_CTES))
def _(t):
    bundle = fixed_bundle(t)
    return _MODEL.contributions(scoring.request_features(t.applicants(), bundle.defaults),
                                ["SK_ID_CURR"])
