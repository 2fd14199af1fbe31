"""Driver queries for sinks, loaders, folds and fitted models.

Fitted values have no SQL counterpart, but laws that they obey have: a gradient is zero, a calibrated
mean is the base rate, every row is scored once. SQL counts the rows and states the law.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.learned import _KEY, _X, rows, scores
from checks.views import Tables, nudge_of, rounded, sql_rounded, with_views
from riskframe.functions import application as app
from riskframe.operators import metrics, models, selection, splits
from riskframe.session import shared_folder
from riskframe.sources import tables as src
from riskframe.sources.schema import APPLICATION_FILES, CHILD_FILES, leaky_columns

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def register(fn):
        QUERIES[name] = lambda spark, folder: rounded(fn(Tables(spark, folder)), nudge_of(sql))
        SQL[name] = sql
        return fn
    return register


def fresh(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"


@query("sink_round_trip", " UNION ALL ".join(
    f"SELECT '{f}' AS sink, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, round(sum(c_acctbal), 2) AS total FROM customer"
    for f in ("parquet", "json", "csv")))
def _(t):
    rows_, folder = t.raw("customer").select("c_custkey", "c_acctbal"), fresh(t)
    src.write_store(rows_, f"{folder}/store", {"origin": "customer"})
    src.write_report(rows_, f"{folder}/json")
    src.write_report(rows_, f"{folder}/csv", "csv")
    store, meta = src.read_store(t.spark, f"{folder}/store")
    kind = "c_custkey long, c_acctbal double"
    back = {"parquet": store.select(*meta["columns"]), "json": t.spark.read.schema(kind).json(f"{folder}/json"),
            "csv": t.spark.read.schema(kind).csv(f"{folder}/csv", header=True)}
    out = [df.agg(F.lit(name).alias("sink"), F.count("*").alias("n"), F.sum("c_custkey").alias("keys"),
                  F.round(F.sum("c_acctbal"), 2).alias("total")) for name, df in back.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("reuse_store", "SELECT c_nationkey::BIGINT AS c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    """The second builder would return nothing; the finished first write is read instead."""
    path, built = fresh(t), t.raw("customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    src.reuse_or_build(t.spark, path, lambda: built)
    return src.reuse_or_build(t.spark, path, lambda: built.limit(0))


@query("text_columns", "SELECT CAST(l_linenumber AS VARCHAR) AS line, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    frame = t.raw("lineitem").select(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))
    return src.as_text(frame, ["line", "flag", "absent"]).groupBy("line", "flag").agg(F.count("*").alias("n"))


_LOADED = {"bureau": "bureau", "bureau_balance": "bbal", "previous_application": "prev", "pos_cash": "pos",
           "installments": "inst", "credit_card": "cc", "application": "app"}


@query("load_tables", with_views(" ".join(_LOADED.values()), " UNION ALL ".join(
    f"SELECT '{name}' AS source, count(*) AS n FROM {view}" for name, view in _LOADED.items())))
def _(t):
    folder = fresh(t)
    for table, df in t.tables().items():
        name = APPLICATION_FILES["train"] if table == "application" else CHILD_FILES[table]
        df.write.parquet(f"{folder}/{name}.parquet")
    loaded = src.load_tables(t.spark, folder, extension="parquet")
    out = [df.agg(F.lit(name).alias("source"), F.count("*").alias("n")) for name, df in loaded.items()]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


@query("leakage_drop", "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders")
def _(t):
    denied = leaky_columns()
    wide = t.raw("orders").select("o_orderkey", F.round("o_totalprice", 2).alias("price"),
                                  *[F.lit(1.0).alias(c) for c in denied], F.lit(2.0).alias("cc_balance_x"))
    return app.drop_columns(wide, denied, ("cc_",))


@query("suffix_repair", "SELECT o_orderkey, round(o_totalprice, 2) AS amount, o_orderstatus AS only_x FROM orders")
def _(t):
    both = t.raw("orders").select("o_orderkey", F.round("o_totalprice", 2).alias("amount_x"),
                                  (-F.col("o_totalprice")).alias("amount_y"), F.col("o_orderstatus").alias("only_x"))
    return app.repair_suffixes(both)


@query("fold_roles", """SELECT f.fold, count(*) AS n, max(positives) AS positives FROM lineitem, range(4) f(fold),
    (SELECT count(*) FILTER (WHERE l_extendedprice * (1 - l_discount) > 60000) AS positives FROM lineitem) GROUP BY 1""")
def _(t):
    """Every row has a role in every fold; validation shares differ by a row a class at most."""
    placed = splits.choose_folds(scores(t).drop("fold"), "label", ["id", "score_a", "score_b", "score_c"], folds=4)
    by_fold = placed.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("positives"),
                                         F.sum((F.col("role") == "valid").cast("int")).alias("valid"))
    held = F.abs(F.col("valid") - F.col("n") / 4) <= 2
    return by_fold.where(held).select(F.col("fold").cast("long").alias("fold"), "n", "positives")


_SHAPE = """SELECT corr(l_quantity, price) AS qp, abs(corr(l_quantity, l_tax)) AS qt, abs(corr(price, l_tax)) AS pt
    FROM (SELECT *, l_quantity * 2 + l_discount AS price FROM lineitem)"""


@query("prune_flags", f"""WITH c AS ({_SHAPE}) SELECT r.rule, r.name, CASE WHEN qp > 0.8 AND qt < 0.8 AND pt < 0.8 THEN r.stays END AS kept
    FROM c, (VALUES ('value', 'price', true), ('value', 'qty', false), ('value', 'tax', true),
      ('protected', 'price', true), ('protected', 'qty', true), ('protected', 'tax', true),
      ('scan', 'price', false), ('scan', 'qty', true), ('scan', 'tax', true),
      ('important', 'price', true), ('important', 'qty', false), ('important', 'tax', true)) r(rule, name, stays)""")
def _(t):
    """Which of two correlated columns goes under each pruning rule."""
    data, names = rows(t).withColumn("price", F.col("qty") * 2 + F.col("disc")), ["qty", "price", "tax"]
    kept = {"value": selection.prune_by_value(data, names, {"price": 2.0, "qty": 1.0}, 0.8),
            "protected": selection.prune_later(data, names, 0.8, ["price"]),
            "scan": selection.prune_left_to_right(data, names, 0.8),
            "important": selection.prune_left_to_right(data, names, 0.8, {"price": 2.0, "qty": 1.0})}
    return t.spark.createDataFrame([(rule, c, c in found) for rule, found in kept.items() for c in names],
                                   "rule string, name string, kept boolean")


_LABEL = "CAST((l_extendedprice * (1 - l_discount) > 55000) <> (l_tax > 0.075) AS INT)"


@query("boosted_laws", "SELECT count(*) AS n, true AS in_range, true AS beats_chance, true AS kept_model_equal FROM lineitem")
def _(t):
    """Every row scored out of fold, within 0 and 1, better than chance; a model read back scores the same."""
    data = rows(t)
    scored = models.out_of_fold(data, models.boosted_fitter(_X, "label", trees=5, depth=4), "label", _KEY, folds=2)
    model, folder = models.fit_boosted(data, _X, "label", trees=3, depth=3), fresh(t)
    model.save(folder)
    back = models.BoostedScore.load(t.spark, folder)
    apart = back(model(data, "first"), "second").agg(F.max(F.abs(F.col("first") - F.col("second")))).first()[0]
    return scored.agg(F.count("*").alias("n"), F.min(F.col("score").between(0, 1)).alias("in_range")).select(
        "n", "in_range", F.lit(metrics.gini(scored, "label") > 0.2).alias("beats_chance"),
        F.lit(apart < 1e-12).alias("kept_model_equal"))


@query("scorecard_walk", """SELECT part, true AS in_range FROM lineitem, (VALUES ('fold_0'), ('fold_1'), ('fold_2'), ('holdout')) p(part)
    GROUP BY part""")
def _(t):
    """Folds that walk forward in time, and the latest fifth held out."""
    found = models.scorecard_report(rows(t), _X, "label", _KEY, folds=3, time="shipped")
    return found.select("part", (F.col("auc").between(0, 1) & F.col("ks").between(0, 1)).alias("in_range"))


@query("calibration_laws", with_views("scored", """SELECT count(*) AS n, round(avg(label), 4) AS mean_isotonic,
    round(avg(label), 4) AS mean_platt, true AS order_kept FROM scored"""))
def _(t):
    """Both calibrations have the base rate as their mean on the rows they were fitted on, and keep the order."""
    s = scores(t).withColumnRenamed("score_b", "score")
    platt, isotonic = models.fit_platt(s, "label"), models.fit_isotonic(s, "label")
    out = models.apply_isotonic(s.withColumn("platt", models.apply_platt(F.col("score"), platt)), isotonic)
    steps = sorted((r["score"], r["calibrated"]) for r in out.groupBy("score").agg(
        F.max("calibrated").alias("calibrated")).collect())  # at most a thousand rounded scores
    order = platt[0] > 0 and all(a[1] <= b[1] + 1e-12 for a, b in zip(steps, steps[1:]))
    return out.agg(F.count("*").alias("n"), F.round(F.avg("calibrated"), 4).alias("mean_isotonic"),
                   F.round(F.avg("platt"), 4).alias("mean_platt"), F.lit(order).alias("order_kept"))


@query("logistic_gradient", with_views("scored", """SELECT count(*) AS n, 0.0::DOUBLE AS base, 0.0::DOUBLE AS score_a,
    0.0::DOUBLE AS score_b, 0.0::DOUBLE AS score_c FROM scored"""))
def _(t):
    """The penalised log-loss of the stack has no slope left, in standardised columns."""
    s, names = scores(t), ["score_a", "score_b", "score_c"]
    fitted = models.fit_logistic_stack(s, names, "label")
    stats = s.agg(F.count("*").alias("n"), *[F.stddev_pop(c).alias(c) for c in names]).first()
    wrong = fitted.probability() - F.col("label")
    slopes = [(F.avg(wrong * (F.col(c) - F.lit(m)) / F.lit(stats[c])) + F.lit(w * stats[c] / stats["n"])).alias(c)
              for c, w, m in zip(names, fitted.coefficients, fitted.means)]
    found = s.agg(F.count("*").alias("n"), F.avg(wrong).alias("base"), *slopes)
    return found.select("n", *[(F.round(c, 4) + 0.0).alias(c) for c in ("base", *names)])


@query("ridge_normal", with_views("scored", """SELECT count(*) AS n, 0.0::DOUBLE AS base, 0.0::DOUBLE AS score_a,
    0.0::DOUBLE AS score_b, 0.0::DOUBLE AS score_c FROM scored"""))
def _(t):
    """Normal equations of the ridge stack at its chosen penalty."""
    s, names = scores(t), ["score_a", "score_b", "score_c"]
    fitted = models.fit_ridge_stack(s, names, "label", folds=3)
    wrong = fitted.raw() - F.col("label")
    found = s.agg(F.count("*").alias("n"), F.avg(wrong).alias("base"), *[
        (F.avg(wrong * F.col(c)) + F.lit(w * fitted.penalty)).alias(c) for c, w in zip(names, fitted.weights)])
    return found.select("n", *[(F.round(c, 8) + 0.0).alias(c) for c in ("base", *names)])


@query("ablation_laws", with_views("scored", """SELECT kind || ':' || names AS variant, n, true AS in_range FROM
    (SELECT count(*) AS n FROM scored), (VALUES ('average'), ('logistic')) k(kind),
    (VALUES ('score_a+score_b'), ('score_a+score_c'), ('score_b+score_c'), ('score_a+score_b+score_c')) v(names)"""))
def _(t):
    """Every subset of two scores and more, both ways, over all rows."""
    s = scores(t)
    found = models.subset_ablation(s, ["score_a", "score_b", "score_c"], "label", 2)
    return found.select(
        "variant", F.lit(s.count()).alias("n"), (F.col("auc").between(0, 1) & F.col("gini").between(-1, 1)).alias("in_range"))


_CUT = "TIMESTAMP '2000-01-01'"


@query("imbalance_laws", """SELECT strategy, n, true AS in_range FROM (SELECT count(*) AS n FROM lineitem WHERE l_shipdate IS NOT NULL),
    (VALUES ('tuned_threshold'), ('class_weight')) s(strategy)""")
def _(t):
    data = rows(t).where("shipped IS NOT NULL")
    cut = F.col("shipped") < F.lit("2000-01-01").cast("timestamp")
    found = models.imbalance_report(data.where(cut), data.where(~cut), _X, "label", _KEY, folds=2, trees=2, depth=2)
    names = ["auc", "macro_f1", "precision", "recall"]
    good = F.col("ks").between(0, 1)
    for c in names:
        good = good & F.col(c).between(0, 1)
    return found.select("strategy", F.lit(data.count()).alias("n"), good.alias("in_range"))


@query("shift_laws", f"""SELECT count(*) FILTER (WHERE l_shipdate < {_CUT}) AS n_train,
    count(*) FILTER (WHERE NOT l_shipdate < {_CUT}) AS n_test, true AS verdict_fits, 4::BIGINT AS n_features FROM lineitem""")
def _(t):
    data = rows(t).drop("label")
    cut = F.col("shipped") < F.lit("2000-01-01").cast("timestamp")
    found = models.shift_report(data.where(cut), data.where(~cut), _X, _KEY, folds=2, trees=2)
    auc = F.col("auc")
    fits = F.col("verdict") == F.when(auc < 0.55, "safe").when(auc < 0.65, "investigate").otherwise("problematic")
    return found.select("n_train", "n_test", fits.alias("verdict_fits"),
                        F.size("shifted_features").cast("long").alias("n_features"))


@query("curve_laws", sql_rounded("""SELECT share, CAST(floor(n * share + 1e-9) AS BIGINT) AS n, true AS in_range, share > 0.5 AS has_gain
    FROM (SELECT count(*) AS n FROM lineitem), (VALUES (0.5), (0.75), (1.0)) s(share)""", "share", "n", "in_range has_gain"))
def _(t):
    found = models.learning_curve(rows(t), models.linear_fitter(_X, "label"), "label", _KEY, "shipped", folds=2)
    return found.select("share", "n", F.col("gini").between(-1, 1).alias("in_range"),
                        F.col("gain").isNotNull().alias("has_gain"))
