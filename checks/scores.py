"""Driver queries: metrics, audits, splits, encodings over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import Tables, nudge_of, rounded, sql_rounded, with_views
from riskframe.operators import audit, encoding, metrics, neighbours, prefix, splits

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: rounded(fn(Tables(spark, folder)), nudge_of(sql))
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


_LINES = """SELECT model, score, sum(label) AS pos, sum(1 - label) AS neg FROM slong GROUP BY 1, 2"""
_CURVE = """SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY model) AS np,
    sum(neg) OVER (PARTITION BY model) AS nn FROM lines WINDOW w AS (PARTITION BY model ORDER BY score)"""


def curve_sql(body: str, **ctes: str) -> str:
    return with_views("slong", body, lines=_LINES, cv=_CURVE, **ctes)


def curve(t: Tables):
    return metrics.score_curve(t.scored_long(), group=["model"])


@query("gini", curve_sql("""SELECT model, round(2 * sum(pos * (cn - neg / 2.0::DOUBLE)) / (any_value(np)::DOUBLE * any_value(nn)) - 1, 6) AS gini
    FROM cv GROUP BY 1"""))
def _(t):
    return metrics.curve_metrics(curve(t), ["model"]).select("model", "gini")


@query("ks", curve_sql("""SELECT model, round(max(g), 6) AS ks, round(arg_min(score, (-round(g, 12), score)), 6) AS ks_threshold
    FROM (SELECT *, abs(cp / np::DOUBLE - cn / nn::DOUBLE) AS g FROM cv) GROUP BY 1"""))
def _(t):
    return metrics.curve_metrics(curve(t), ["model"]).select("model", "ks", "ks_threshold")


@query("metric_suite", curve_sql("""SELECT model, CAST(np AS BIGINT) AS n_pos, CAST(nn AS BIGINT) AS n_neg,
    round((g + 1) / 2, 6) AS auc, round(b, 6) AS brier, round(r * (1 - r), 6) AS brier_baseline,
    round(1 - b / (r * (1 - r)), 6) AS brier_skill, round(ap, 6) AS avg_precision
    FROM (SELECT model, any_value(np) AS np, any_value(nn) AS nn, any_value(np)::DOUBLE / (any_value(np) + any_value(nn)) AS r,
      2 * sum(pos * (cn - neg / 2.0::DOUBLE)) / (any_value(np)::DOUBLE * any_value(nn)) - 1 AS g,
      sum(pos / np::DOUBLE * (np - cp + pos) / ((np - cp + pos) + (nn - cn + neg))::DOUBLE) AS ap FROM cv GROUP BY 1)
    JOIN (SELECT model, avg((score - label) ** 2) AS b FROM slong GROUP BY 1) USING (model)"""))
def _(t):
    return metrics.curve_metrics(curve(t), ["model"]).select(
        "model", "n_pos", "n_neg", "auc", "brier", "brier_baseline", "brier_skill",
        "avg_precision")


@query("roc_points", curve_sql("""SELECT model, round(score, 6) AS threshold, CAST(np - cp + pos AS BIGINT) AS tp,
    CAST(nn - cn + neg AS BIGINT) AS fp, round((np - cp + pos) / np::DOUBLE, 6) AS tpr,
    round((nn - cn + neg) / nn::DOUBLE, 6) AS fpr,
    round((np - cp + pos) / ((np - cp + pos) + (nn - cn + neg))::DOUBLE, 6) AS precision FROM cv"""))
def _(t):
    return metrics.roc_points(curve(t), ["model"])


@query("reliability", with_views("slong", """SELECT model, CAST(least(floor(score * 20), 19) AS BIGINT) AS bin,
    count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS event_rate FROM slong GROUP BY 1, 2"""))
def _(t):
    return metrics.reliability(t.scored_long(), group=["model"])


_F1 = """CASE WHEN 2 * tp + w > 0 THEN 2 * tp / (2 * tp + w)::DOUBLE ELSE 0 END / 2
    + CASE WHEN 2 * tn + w > 0 THEN 2 * tn / (2 * tn + w)::DOUBLE ELSE 0 END / 2"""


@query("best_threshold", curve_sql(f"""SELECT model, round(max(f1), 6) AS macro_f1,
    round(arg_min(score, (-round(f1, 12), score)), 6) AS threshold
    FROM (SELECT model, score, {_F1} AS f1 FROM (SELECT model, score, np - cp + pos AS tp,
      np - (np - cp + pos) + (nn - cn + neg) AS w, cn - neg AS tn FROM cv WHERE score BETWEEN 0.1 AND 0.9)) GROUP BY 1"""))
def _(t):
    return metrics.best_threshold(curve(t), ["model"])


@query("threshold_metrics", with_views("slong", f"""SELECT model, tp, fp, fn, tn,
    round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision,
    round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall, round({_F1}, 6) AS macro_f1
    FROM (SELECT *, fp + fn AS w FROM (SELECT model, count(*) FILTER (score >= 0.4 AND label = 1) AS tp,
      count(*) FILTER (score >= 0.4 AND label = 0) AS fp, count(*) FILTER (score < 0.4 AND label = 1) AS fn,
      count(*) FILTER (score < 0.4 AND label = 0) AS tn FROM slong GROUP BY 1))"""))
def _(t):
    return metrics.threshold_metrics(t.scored_long(), 0.4, group=["model"])


@query("class_balance", with_views("slong", """SELECT model, count(*) AS n, sum(label)::BIGINT AS n_pos,
    sum(1 - label)::BIGINT AS n_neg, round(avg(label), 6) AS prevalence,
    round(sum(1 - label) / sum(label)::DOUBLE, 6) AS scale_weight FROM slong GROUP BY 1"""))
def _(t):
    return metrics.class_balance(t.scored_long(), group=["model"])


_GINIS = """SELECT model, 2 * sum(pos * (cn - neg / 2.0::DOUBLE)) / (any_value(np)::DOUBLE * any_value(nn)) - 1 AS gini FROM cv GROUP BY 1"""


@query("model_comparison", curve_sql("""SELECT model, round(gini, 6) AS gini, best_single,
    round(best_single_gini, 6) AS best_single_gini, round(gini - best_single_gini, 6) AS lift,
    CASE WHEN gini >= 0.65 THEN 'full_pass' WHEN gini >= 0.58 AND gini - best_single_gini >= 0.005
      THEN 'accept_best_available' ELSE 'investigate' END AS gate
    FROM g, (SELECT arg_max(model, gini) AS best_single, max(gini) AS best_single_gini FROM g WHERE model <> 'score_b')""",
    g=_GINIS))
def _(t):
    table = metrics.curve_metrics(curve(t), ["model"]).select("model", "gini")
    return metrics.compare_models(table, ["score_b"])


# ---- ranks ----------------------------------------------------------------------------

def _pct(col: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"((rank() OVER ({part} ORDER BY {col}) + (count(*) OVER (PARTITION BY {by + ',' if by else ''} {col}) - 1) / 2.0::DOUBLE) / count(*) OVER ({part}))"


@query("fold_rank_avg", with_views("scored", f"""SELECT fold, count(*) AS n, round(sum(r * label) / sum(label), 6) AS pos_mean,
    round(max(r), 6) AS top, round(min(r), 6) AS bottom, round(avg(r * r), 6) AS second_moment
    FROM (SELECT fold, label, ({_pct('score_a', 'fold')} + {_pct('score_b', 'fold')} + {_pct('score_c', 'fold')}) / 3 AS r FROM scored)
    GROUP BY 1"""))
def _(t):
    ranked = encoding.rank_average(t.scored(), ["score_a", "score_b", "score_c"], ["id"], ["fold"])
    return _rank_summary(ranked, ["fold"])


def _rank_summary(ranked, by):
    r = F.col("rank_score")
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"), (F.sum(r * F.col("label")) / F.sum("label")).alias("pos_mean"),
        F.max(r).alias("top"), F.min(r).alias("bottom"), F.avg(r * r).alias("second_moment"))


@query("rank_avg", with_views("scored", f"""SELECT flag, count(*) AS n, round(sum(r * label) / sum(label), 6) AS pos_mean,
    round(max(r), 6) AS top, round(min(r), 6) AS bottom, round(avg(r * r), 6) AS second_moment
    FROM (SELECT flag, label, ({_pct('score_a')} + {_pct('score_b')} + {_pct('score_c')}) / 3 AS r FROM scored) GROUP BY 1"""))
def _(t):
    ranked = encoding.rank_average(t.scored(), ["score_a", "score_b", "score_c"], ["id"])
    return _rank_summary(ranked, ["flag"])


@query("percentiles", " UNION ALL ".join(
    f"SELECT l_returnflag AS grp, {p}::DOUBLE AS prob, round(quantile_cont(l_extendedprice, {p}), 6) AS quantile FROM lineitem GROUP BY 1"
    for p in (0.0, 0.05, 0.25, 0.5, 0.9, 0.99, 1.0)))
def _(t):
    rows = t.raw("lineitem").select(F.col("l_returnflag").alias("grp"), "l_extendedprice")
    return prefix.exact_quantiles(rows, "l_extendedprice",
                                  [0.0, 0.05, 0.25, 0.5, 0.9, 0.99, 1.0], ["grp"])


# ---- audits ---------------------------------------------------------------------------

_PEOPLE = """SELECT CODE_GENDER, -DAYS_BIRTH / 365.25::DOUBLE AS age, TARGET AS label,
    round(least(coalesce(EXT_SOURCE_3, 0.5), 1.0), 3) AS score FROM app"""
_GROUPS = """SELECT 'gender' AS attribute, CODE_GENDER AS group_name, label, score FROM people WHERE CODE_GENDER <> 'XNA'
    UNION ALL SELECT 'age', CASE WHEN age < 25 THEN 'Young' WHEN age < 45 THEN 'Mid' ELSE 'Senior' END, label, score FROM people WHERE age >= 0"""
_RATES = """SELECT attribute, group_name, count(*) AS n, avg(score) AS mean_score,
    coalesce(count(*) FILTER (score >= cut AND label = 1) / nullif(sum(label), 0)::DOUBLE, 0) AS tpr,
    coalesce(count(*) FILTER (score >= cut AND label = 0) / nullif(sum(1 - label), 0)::DOUBLE, 0) AS fpr
    FROM groups, (SELECT quantile_cont(score, 0.92) AS cut FROM people) GROUP BY 1, 2"""
_FAIR = "SELECT *, " + ", ".join(
    f"CASE WHEN max({m}) OVER w > 0 THEN min({m}) OVER w / max({m}) OVER w ELSE 0 END AS {m}_ratio"
    for m in ("mean_score", "tpr", "fpr")) + " FROM rates WINDOW w AS (PARTITION BY attribute)"


def people(t: Tables):
    return t.applicants().select(
        "CODE_GENDER", (-F.col("DAYS_BIRTH") / 365.25).alias("age"),
        F.col("TARGET").alias("label"),
        F.round(F.least(F.coalesce("EXT_SOURCE_3", F.lit(0.5)), F.lit(1.0)), 3).alias("score"))


def _fairness(t: Tables):
    return audit.fairness(people(t), {"gender": F.col("CODE_GENDER"),
                                      "age": audit.age_band(F.col("age"))})


@query("fairness", with_views("app", sql_rounded(
    _FAIR, "mean_score tpr fpr mean_score_ratio tpr_ratio fpr_ratio", "n", "attribute group_name"),
    people=_PEOPLE, groups=_GROUPS, rates=_RATES))
def _(t):
    return _fairness(t)


@query("fairness_joined", with_views("app", sql_rounded(
    _FAIR, "mean_score tpr fpr mean_score_ratio tpr_ratio fpr_ratio", "n", "attribute group_name"),
    people=_PEOPLE, groups=_GROUPS, rates=_RATES))
def _(t):
    rows = t.applicants()
    scored = rows.select("SK_ID_CURR", F.col("TARGET").alias("label"), F.round(F.least(
        F.coalesce("EXT_SOURCE_3", F.lit(0.5)), F.lit(1.0)), 3).alias("score"))
    return audit.fairness_with_demographics(scored, rows, "SK_ID_CURR", {
        "gender": F.col("CODE_GENDER"),
        "age": audit.age_band(-F.col("DAYS_BIRTH") / 365.25)})


@query("fairness_gate", with_views("app", """SELECT attribute, round(min(least(mean_score_ratio, tpr_ratio, fpr_ratio)), 6) AS worst_ratio,
    min(least(mean_score_ratio, tpr_ratio, fpr_ratio)) >= 0.8 AS passed FROM fair GROUP BY 1""",
    people=_PEOPLE, groups=_GROUPS, rates=_RATES, fair=_FAIR))
def _(t):
    return audit.fairness_gate(_fairness(t))


_CONTRIB = ["qty", "price", "disc", "tax"]


def contributions(t: Tables):
    return t.raw("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.col("l_returnflag").alias("flag"),
        ((F.col("l_quantity") - 25.5) / 25).alias("qty"),
        ((F.col("l_extendedprice") - 50000) / 50000).alias("price"),
        ((F.col("l_discount") - 0.05) * 20).alias("disc"),
        ((F.col("l_tax") - 0.04) * 25).alias("tax"))


_CSQL = """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id, l_returnflag AS flag,
    (l_quantity - 25.5::DOUBLE) / 25 AS qty, (l_extendedprice - 50000) / 50000 AS price,
    (l_discount - 0.05::DOUBLE) * 20 AS disc, (l_tax - 0.04::DOUBLE) * 25 AS tax FROM lineitem"""
_CLIST = ", ".join(f"{{'s': -abs({c}), 'p': {i}, 'f': '{c}', 'v': {c}}}" for i, c in enumerate(_CONTRIB))


@query("top_factors", f"""WITH c AS ({_CSQL}), s AS (SELECT row_id, list_sort([{_CLIST}]) AS l FROM c)
    SELECT row_id, l[r].f AS feature, upper(l[r].f[1]) || l[r].f[2:] AS label, round(l[r].v, 6) + 0.0 AS contribution,
    CASE WHEN l[r].v > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction, r::BIGINT AS rank
    FROM s, (VALUES (1), (2), (3)) t(r)""")
def _(t):
    return audit.top_factors(contributions(t), "row_id", _CONTRIB, 3)


@query("attr_stability", f"""WITH c AS ({_CSQL}), m AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS feature, avg(CASE WHEN flag <> 'R' THEN abs({c}) END) AS a, avg(CASE WHEN flag = 'R' THEN abs({c}) END) AS b FROM c" for c in _CONTRIB)})
    SELECT round(corr(ra, rb), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY b) AS rb FROM m)""")
def _(t):
    rows = contributions(t)
    rho = audit.attribution_stability(rows.where("flag <> 'R'"), rows.where("flag = 'R'"), _CONTRIB)
    return t.spark.createDataFrame([(rho,)], "spearman double")


# ---- splits ---------------------------------------------------------------------------

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_LINEKEY = ", ".join(_KEYS)


@query("oot_split", f"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey,
    round(l_extendedprice, 6) AS l_extendedprice,
    row_number() OVER (ORDER BY l_shipdate, {_LINEKEY}) - 1 >= floor(count(*) OVER () * 0.8 + 1e-9) AS is_oot FROM lineitem""")
def _(t):
    rows = t.raw("lineitem").select(*_KEYS, "l_shipdate")
    return splits.out_of_time(rows, "l_shipdate", _KEYS).drop("l_shipdate")


@query("walk_forward", """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos,
      count(*) OVER () AS n, CAST(o_orderstatus = 'F' AS INT) AS label FROM orders),
    f AS (SELECT i AS fold, (i + 1) * (n // 6) AS s, CASE WHEN i = 4 THEN n ELSE (i + 2) * (n // 6) END AS e
      FROM (SELECT count(*) AS n FROM orders), range(5) t(i))
    SELECT fold::BIGINT AS fold, role, count(*) AS n, sum(label)::BIGINT AS n_pos, round(avg(label), 6) AS positive_rate FROM
    (SELECT fold, label, CASE WHEN pos < s - CAST(floor(s * 0.02::DOUBLE) AS BIGINT) THEN 'train' WHEN pos >= s AND pos < e THEN 'valid' END AS role
     FROM p, f) WHERE role IS NOT NULL GROUP BY 1, 2""")
def _(t):
    rows = t.raw("orders").select("o_orderkey", "o_orderdate",
                                  (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    ordered = prefix.position(rows, ["o_orderdate", "o_orderkey"])
    return splits.fold_audit(splits.walk_forward(ordered), group=["role"])


@query("fold_audit", with_views("scored", """SELECT fold, count(*) AS n, sum(label)::BIGINT AS n_pos,
    round(avg(label), 6) AS positive_rate FROM scored GROUP BY 1"""))
def _(t):
    return splits.fold_audit(t.scored())


@query("prefix_share", f"""WITH p AS (SELECT label, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n
      FROM (SELECT o_orderdate, o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS label FROM orders))
    SELECT s::DOUBLE AS share, count(*) AS n, sum(label)::BIGINT AS events FROM p, (VALUES (0.5), (0.75), (1.0)) v(s)
    WHERE r <= floor(n * s) GROUP BY 1""")
def _(t):
    rows = t.raw("orders").select("o_orderkey", "o_orderdate",
                                  (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    return splits.prefix_event_rates(rows, ["o_orderdate", "o_orderkey"], "label", [0.5, 0.75, 1.0])


@query("stratified_folds", """SELECT fold, sum((c + 4 - fold) // 5)::BIGINT AS n,
    sum(CASE WHEN label = 1 THEN (c + 4 - fold) // 5 ELSE 0 END)::BIGINT AS n_pos,
    round(sum(CASE WHEN label = 1 THEN (c + 4 - fold) // 5 ELSE 0 END) / sum((c + 4 - fold) // 5)::DOUBLE, 6) AS positive_rate
    FROM (SELECT CAST(o_orderstatus = 'F' AS INT) AS label, count(*) AS c FROM orders GROUP BY 1), range(5) r(fold) GROUP BY 1""")
def _(t):
    rows = t.raw("orders").select("o_orderkey",
                                  (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    return splits.fold_audit(splits.stratified_folds(rows, "label", ["o_orderkey"]))


@query("downsample", """SELECT count(*) FILTER (o_orderstatus = 'F') AS n_pos,
    least(CAST(floor(count(*) FILTER (o_orderstatus = 'F') * (1 - 0.4::DOUBLE) / 0.4::DOUBLE) AS BIGINT),
      count(*) FILTER (o_orderstatus <> 'F')) AS n_neg FROM orders""")
def _(t):
    rows = t.raw("orders").select("o_orderkey",
                                  (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    kept = splits.downsample_to_rate(rows, "label", ["o_orderkey"], 0.4)
    return kept.agg(F.count_if(F.col("label") == 1).alias("n_pos"),
                    F.count_if(F.col("label") == 0).alias("n_neg"))


@query("pseudo_labels", with_views("scored", """SELECT label AS truth, CAST(score_b > 0.5 AS BIGINT) AS TARGET, count(*) AS n
    FROM scored WHERE score_b < 0.05 OR score_b >= 0.95 GROUP BY 1, 2"""))
def _(t):
    rows = t.scored().withColumnRenamed("label", "truth")
    return splits.confident_rows(rows, "score_b", ["id"]).groupBy("truth", "TARGET").agg(
        F.count("*").alias("n"))


@query("minmax", """WITH b AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_extendedprice) AS p0,
      max(l_extendedprice) AS p1 FROM lineitem WHERE l_returnflag <> 'R')
    SELECT l_returnflag, round(avg(least(greatest((l_quantity - q0) / (q1 - q0), 0), 1)), 6) AS l_quantity,
    round(avg(least(greatest((l_extendedprice - p0) / (p1 - p0), 0), 1)), 6) AS l_extendedprice
    FROM lineitem, b GROUP BY 1""")
def _(t):
    rows = t.raw("lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    bounds = encoding.fit_minmax(rows.where("l_returnflag <> 'R'"), ["l_quantity", "l_extendedprice"])
    return encoding.scale_minmax(rows, bounds).groupBy("l_returnflag").agg(
        *[F.avg(c).alias(c) for c in bounds])


@query("target_encode", with_views("scored", """SELECT flag, fold, count(*) AS n, round(any_value(enc), 6) AS enc FROM
    (SELECT s.flag, s.fold, (yc - y + 20 * (ya - yf)::DOUBLE / (na - nf)) / (nc - n + 20)::DOUBLE AS enc FROM scored s
     JOIN (SELECT flag, fold, count(*) AS n, sum(label) AS y FROM scored GROUP BY 1, 2) USING (flag, fold)
     JOIN (SELECT flag, count(*) AS nc, sum(label) AS yc FROM scored GROUP BY 1) USING (flag)
     JOIN (SELECT fold, count(*) AS nf, sum(label) AS yf FROM scored GROUP BY 1) USING (fold),
     (SELECT count(*) AS na, sum(label) AS ya FROM scored)) GROUP BY 1, 2"""))
def _(t):
    encoded = encoding.encode_out_of_fold(t.scored(), "flag", "label", "fold", name="enc")
    return encoded.groupBy("flag", "fold").agg(F.count("*").alias("n"), F.max("enc").alias("enc"))


@query("target_encode_test", with_views("scored", """SELECT flag, count(*) AS n, round(any_value((coalesce(y, 0) + 20 * m) / (coalesce(k, 0) + 20)), 6) AS enc
    FROM scored LEFT JOIN (SELECT flag, count(*) AS k, sum(label) AS y FROM scored WHERE flag <> 'N' GROUP BY 1) USING (flag),
    (SELECT avg(label) AS m FROM scored WHERE flag <> 'N') GROUP BY 1"""))
def _(t):
    rows = t.scored()
    encoded = encoding.encode_test(rows.where("flag <> 'N'"), rows, "flag", "label", name="enc")
    return encoded.groupBy("flag").agg(F.count("*").alias("n"), F.max("enc").alias("enc"))


@query("neighbour_encode", with_views("scored", """SELECT fold, count(*) AS n, round(avg(e), 6) AS mean_enc, round(max(e), 6) AS top
    FROM r JOIN best USING (a, b, fold) GROUP BY 1""",
    r="SELECT score_a AS a, round(score_c * 10 + 1e-9) AS b, fold, label FROM scored",
    st="SELECT stddev_pop(a) AS s_a, stddev_pop(b) AS s_b FROM r",
    pts="SELECT a, b, fold, count(*) AS n, sum(label) AS y FROM r GROUP BY ALL",
    d="""SELECT q.a, q.b, q.fold, p.n, p.y, ((q.a - p.a) / s_a) ** 2 + ((q.b - p.b) / s_b) ** 2 AS away
      FROM pts q JOIN pts p ON q.fold <> p.fold, st""",
    c="SELECT *, sum(n) OVER (PARTITION BY a, b, fold ORDER BY away ROWS UNBOUNDED PRECEDING) AS cum FROM d",
    k="SELECT a, b, fold, coalesce(min(away) FILTER (WHERE cum >= 500), max(away)) AS reach FROM c GROUP BY ALL",
    best="""SELECT a, b, fold, sum(y) / sum(n) AS e FROM d JOIN k USING (a, b, fold)
      WHERE away <= reach * (1 + 1e-9) GROUP BY ALL"""))
def _(t):
    rows = t.scored().withColumn("tenths", F.round(F.col("score_c") * 10 + 1e-9))
    encoded = neighbours.encode_neighbours(rows, ["score_a", "tenths"], "label", "fold")
    e = F.col("neighbour_enc")
    return encoded.groupBy("fold").agg(F.count("*").alias("n"), F.avg(e).alias("mean_enc"),
                                       F.max(e).alias("top"))
