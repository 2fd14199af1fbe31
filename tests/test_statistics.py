"""Binning, selection, metrics, splits and encodings against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import audit, binning, encoding, metrics, neighbours, selection, splits


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"id": np.arange(500), "strong": rng.random(500),
                          "noise": rng.random(500), "few": rng.choice([0.0, 0.0, 0.0, 1.0], 500),
                          "flat": 5.0})
    frame["TARGET"] = (frame.strong < 0.25).astype(int)
    frame.loc[rng.random(500) < 0.1, "noise"] = -999.0
    return frame, spark.createDataFrame(frame)


def brute_woe(values, target):
    s, y = pd.Series(values), pd.Series(target)
    gone = s == -999.0
    bins = pd.qcut(s[~gone], 10, duplicates="drop").cat.codes if s[~gone].nunique() > 1 else \
        pd.Series(0, index=s[~gone].index)
    code = pd.Series(-1, index=s.index)
    code[~gone] = bins
    table = pd.DataFrame({"bin": code, "e": y, "n": 1 - y}).groupby("bin").sum()
    out = {}
    for b, r in table.iterrows():
        de, dn = r.e / table.e.sum(), r.n / table.n.sum()
        w = 5.0 if de == 0 else -5.0 if dn == 0 else float(np.clip(math.log(dn / de), -5, 5))
        out[int(b)] = (int(r.e), int(r.n), w, (dn - de) * w)
    return out


def test_woe_table_matches_brute_force(labelled):
    frame, df = labelled
    got = {}
    for r in binning.woe_table(df, "TARGET", ["strong", "noise", "few", "flat"]).collect():
        got.setdefault(r["feature"], {})[r["bin"]] = (
            r["event_count"], r["non_event_count"], r["woe"], r["iv_contrib"])
    assert "flat" not in got
    for name in ("strong", "noise", "few"):
        want = brute_woe(frame[name], frame["TARGET"])
        assert got[name].keys() == want.keys(), name
        for b in want:
            assert got[name][b] == pytest.approx(want[b]), (name, b)


def test_iv_and_transform(labelled):
    frame, df = labelled
    ranking = binning.iv_ranking(binning.woe_table(df, "TARGET", ["strong", "noise"])).collect()
    assert ranking[0]["feature"] == "strong" and ranking[0]["strength"] == "very strong"
    model = binning.fit_woe(df, "TARGET", ["strong", "noise"])
    want = brute_woe(frame["noise"], frame["TARGET"])
    out = binning.apply_woe(df, model, ["id"]).toPandas().set_index("id")
    gone = frame["noise"] == -999.0
    assert np.allclose(out["noise"][gone.values], want[-1][2])
    outside = df.limit(1).withColumn("strong", F.lit(7.0)).withColumn("noise", F.lit(None).cast("double"))
    r = binning.apply_woe(outside, model).first()
    assert r["strong"] == -999.0 and r["noise"] == pytest.approx(want[-1][2])
    assert model.to_frame(df.sparkSession).where("feature = 'strong'").count() == 10
    no_missing = binning.fit_woe(df, "TARGET", ["strong"])
    assert binning.apply_woe(outside.withColumn("strong", F.lit(-999.0)), no_missing).first()[0] == -999.0


def test_single_class_has_no_woe(spark, labelled):
    _, df = labelled
    assert binning.woe_table(df.withColumn("TARGET", F.lit(0)), "TARGET", ["strong"]).count() == 0


# ---- selection ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def correlated(spark):
    rng = np.random.default_rng(5)
    a, c = rng.random(400), rng.random(400)
    frame = pd.DataFrame({"id": np.arange(400), "a": a, "b": a * 2 + rng.random(400) * 0.01, "c": c,
                          "d": -c + rng.random(400) * 0.01, "k": 1.0, "tiny": a * 0.001})
    return spark.createDataFrame(frame)


def test_pruning(correlated):
    names = ["a", "b", "c", "d", "k", "tiny"]
    assert selection.prune_later(correlated, names) == ["a", "c", "k"]
    assert selection.prune_later(correlated, names, protected=["d"]) == ["a", "c", "d", "k"]
    assert selection.prune_left_to_right(correlated, names) == ["a", "c", "k"]
    assert selection.prune_left_to_right(correlated, names, importance={"b": 2.0, "d": 1.0}) == ["b", "d", "k"]
    worth = {"b": 1.0, "tiny": 2.0, "d": 1.0}
    assert selection.prune_by_value(correlated, names, worth) == ["d", "k", "tiny"]


def test_variance_filters(correlated):
    assert selection.keep_varied(correlated, ["a", "k", "tiny"]) == ["a"]
    assert selection.keep_varied(correlated, ["a", "k", "tiny"], protected=["tiny"]) == ["a", "tiny"]
    assert selection.keep_above_floor(correlated, ["a", "b", "k", "tiny"]) == ["a", "b"]


def test_novel_columns_and_sample(correlated):
    assert selection.novel_columns(correlated, ["a", "c"], ["b", "k"]) == ["k"]
    one = selection.seeded_sample(correlated, ["id"], 50).select("id").collect()
    two = selection.seeded_sample(correlated.repartition(7), ["id"], 50).select("id").collect()
    assert sorted(r[0] for r in one) == sorted(r[0] for r in two) and len(set(one)) == 50


# ---- metrics --------------------------------------------------------------------------

def scored(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, map(float, scores))), "label int, score double")


def test_gini_by_definition(spark):
    assert metrics.gini(scored(spark, [0, 0, 0, 1, 1, 1], [.1, .2, .3, .7, .8, .9])) == 1.0
    assert metrics.gini(scored(spark, [0, 1] * 5, [0.5] * 10)) == 0.0
    assert metrics.gini(scored(spark, [1, 1, 0, 0], [.1, .2, .8, .9])) == -1.0
    with pytest.raises(ValueError):
        metrics.gini(scored(spark, [0, 0], [.1, .2]))


def test_ks_takes_first_widest_gap(spark):
    assert metrics.ks_statistic(scored(spark, [0, 0, 1, 1], [.1, .2, .8, .9])) == (1.0, 0.2)
    with pytest.raises(ValueError):
        metrics.ks_statistic(scored(spark, [1, 1], [.1, .2]))


def test_suite_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < p).astype(int)
    r = metrics.metric_suite(scored(spark, y.tolist(), p)).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > neg).mean() + (a == neg).mean() / 2 for a in pos])
    assert r["auc"] == pytest.approx(auc)
    gaps = {t: abs((pos <= t).mean() - (neg <= t).mean()) for t in np.unique(p)}
    assert r["ks"] == pytest.approx(max(gaps.values()))
    assert r["brier"] == pytest.approx(np.mean((p - y) ** 2))
    ap, seen = 0.0, 0.0
    for t in np.unique(p)[::-1]:
        recall = (pos >= t).mean()
        ap += (recall - seen) * (y[p >= t].mean())
        seen = recall
    assert r["avg_precision"] == pytest.approx(ap)


def test_best_threshold(spark):
    df = scored(spark, [0, 0, 1, 1], [.2, .3, .6, .8])
    r = metrics.best_threshold(metrics.score_curve(df)).first()
    assert (r["threshold"], r["macro_f1"]) == (0.6, 1.0)
    none = metrics.best_threshold(metrics.score_curve(scored(spark, [0, 1], [.01, .99]))).first()
    assert none["threshold"] == 0.5


def test_model_gate(spark):
    table = spark.createDataFrame([("a", 0.57), ("b", 0.56), ("mix", 0.59)], "model string, gini double")
    got = {r["model"]: r for r in metrics.compare_models(table, ["mix"]).collect()}
    assert got["mix"]["gate"] == "accept_best_available" and got["mix"]["best_single"] == "a"
    assert got["a"]["gate"] == "investigate"


def test_fairness(spark):
    rows = [("F", 20.0, 1, 0.9), ("F", 30.0, 0, 0.1), ("M", 50.0, 1, 0.2), ("M", 50.0, 0, 0.1), ("XNA", 30.0, 0, 0.5)]
    df = spark.createDataFrame(rows, "sex string, age double, label int, score double")
    out = audit.fairness(df, {"sex": F.col("sex"), "age": audit.age_band(F.col("age"))}, cutoff=0.5)
    got = {(r["attribute"], r["group_name"]): r for r in out.collect()}
    assert ("sex", "XNA") not in got and got[("sex", "F")]["tpr"] == 1.0
    assert got[("sex", "M")]["tpr_ratio"] == 0.0 and got[("sex", "F")]["mean_score_ratio"] == pytest.approx(0.3)
    assert {g for a, g in got if a == "age"} == {"Young", "Mid", "Senior"}
    gate = {r["attribute"]: r["passed"] for r in audit.fairness_gate(out).collect()}
    assert gate["sex"] is False


def test_factors_and_stability(spark):
    df = spark.createDataFrame([(1, -3.0, 1.0, 2.0), (2, 0.5, None, 0.1)], "id int, a double, b double, c double")
    got = [(r["id"], r["feature"], r["rank"], r["direction"]) for r in
           audit.top_factors(df, "id", ["a", "b", "c"], 2).collect()]
    assert got == [(1, "a", 1, "decreases_risk"), (1, "c", 2, "increases_risk"),
                   (2, "a", 1, "increases_risk"), (2, "c", 2, "increases_risk")]
    assert audit.attribution_stability(df, df, ["a", "b"]) == 0.0
    assert audit.attribution_stability(df, df, ["a", "b", "c"]) == pytest.approx(1.0)


def test_store_audits(spark):
    df = spark.createDataFrame([(1.0, -999.0, 2.0), (2.0, -999.0, 2.0), (3.0, -999.0, 2.0)], "a double, b double, c double")
    got = {r["check"]: (r["actual"], r["passed"]) for r in
           audit.store_quality(df, ["a", "b", "c"], expected=(1, 5)).collect()}
    assert got["zero_variance"] == (2, False) and got["mostly_sentinel"] == (1, False)
    assert got["infinite_values"] == (0, True) and got["column_count"] == (3, True)
    two = {r["feature"]: r["two_values"] for r in audit.store_consistency(df, ["a", "b", "c"]).collect()}
    assert two == {"a": False, "b": True, "c": True}


# ---- splits ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, None if i % 5 == 0 else i * 10, int(i % 4 == 0), "xyz"[i % 3]) for i in range(100)]
    return spark.createDataFrame(rows, "id long, t int, label int, c string")


def test_out_of_time(people):
    out = splits.out_of_time(people, "t", ["id"]).toPandas()
    known = out[out.t.notna()]
    assert known[known.is_oot].id.min() > known[~known.is_oot].id.max()
    assert known.is_oot.sum() == 16 and out[out.t.isna()].is_oot.sum() == 4
    again = splits.out_of_time(people.repartition(5), "t", ["id"]).toPandas()
    assert set(out[out.is_oot].id) == set(again[again.is_oot].id)


def test_walk_forward_bounds():
    b = splits.walk_forward_bounds(100, 4, 0.1)
    assert b[0] == {"fold": 0, "train_end": 18, "valid_start": 20, "valid_end": 40}
    assert b[-1]["valid_end"] == 100
    assert splits.walk_forward_bounds(1, 5) == []
    assert [x["fold"] for x in splits.walk_forward_bounds(3, 5)] == [0, 1]


def test_stratified(people):
    sizes = splits.fold_audit(splits.stratified_folds(people, "label", ["id"])).toPandas()
    assert (sizes.n == 20).all() and (sizes.n_pos == 5).all()
    held = splits.stratified_holdout(people, "label", ["id"]).where("is_test").toPandas()
    assert len(held) == 20 and held.label.sum() == 5
    roles = splits.choose_folds(people, "label", ["id"], folds=5).groupBy("fold", "role").count().toPandas()
    assert len(roles) == 10 and roles[roles.role == "train"]["count"].eq(80).all()
    timed = splits.choose_folds(people.where("t IS NOT NULL"), "label", ["id"], "t", 3)
    assert set(timed.select("role").distinct().toPandas().role) == {"train", "valid"}


def test_samples(people):
    kept = splits.downsample_to_rate(people, "label", ["id"], 0.5).toPandas()
    assert kept.label.sum() == 25 and (kept.label == 0).sum() == 25
    sure = splits.confident_rows(people.withColumn("p", F.col("id") / 100), "p", ["id"], 0.1, 0.9)
    assert sure.count() == 20 and sure.where("TARGET = 1").count() == 10
    assert splits.confident_rows(people.withColumn("p", F.col("id") / 100), "p", ["id"], 0.1, 0.9, 7).count() == 7
    more = splits.with_pseudo_rows(people.withColumnRenamed("label", "TARGET").drop("c"), sure, "p")
    assert more.count() == 120 and more.columns == ["id", "t", "TARGET"]
    assert splits.first_share(people, 0.25, ["id"]).count() == 25


# ---- encodings ------------------------------------------------------------------------

def test_minmax(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 1.0)], "a double, b double")
    bounds = encoding.fit_minmax(df, ["a", "b"])
    out = encoding.scale_minmax(spark.createDataFrame([(20.0, 9.0), (5.0, 1.0)], "a double, b double"), bounds)
    assert [tuple(r) for r in out.collect()] == [(1.0, 0.5), (0.5, 0.5)]


def test_target_encoding_leaves_own_fold_out(spark, people):
    df = people.withColumn("fold", (F.col("id") % 3).cast("int"))
    out = encoding.encode_out_of_fold(df, "c", "label", "fold", 2.0).toPandas()
    base = out[["id", "c", "label", "fold"]]
    for r in out.head(20).itertuples():
        other = base[base.fold != r.fold]
        same = other[other.c == r.c]
        want = (same.label.sum() + 2.0 * other.label.mean()) / (len(same) + 2.0)
        assert r.c_enc == pytest.approx(want)
    unseen = encoding.encode_test(df, spark.createDataFrame([("q",)], "c string"), "c", "label").first()
    assert unseen["c_enc"] == pytest.approx(0.25)


def plain_neighbours(points, fold, labels, rows, k):
    """Mean label of the k nearest rows of other folds, with all rows at the last distance."""
    out = []
    for i in rows:
        away = np.where(fold != fold[i], ((points - points[i]) ** 2).sum(1), np.inf)
        out.append(labels[away <= np.sort(away)[k - 1] * (1 + 1e-12)].mean())
    return np.array(out)


def test_neighbours_are_the_nearest(spark):
    rng = np.random.default_rng(2)
    for wide, n in ((2, 3000), (10, 1500)):
        names = [f"x{i}" for i in range(wide)]
        frame = pd.DataFrame({"id": np.arange(n), **{c: rng.normal(size=n) for c in names}})
        frame.loc[: n // 3, names] = 0.5  # a third of the rows share a place
        frame["label"] = (rng.random(n) < 1 / (1 + np.exp(-2 * frame.x0))).astype(int)
        frame["fold"] = frame.id % 5
        df = spark.createDataFrame(frame)
        points = frame[names].values
        z = (points - points.mean(0)) / points.std(0)
        rows = np.arange(0, n, 20)
        want = plain_neighbours(z, frame.fold.values, frame.label.values, rows, 60)
        out = neighbours.encode_neighbours(df, names, "label", "fold", k=60).toPandas().sort_values("id")
        assert len(out) == n and np.abs(out.neighbour_enc.values[rows] - want).max() < 1e-9
        # several cells: only spheres that cross a border differ
        out = neighbours.encode_neighbours(df, names, "label", "fold", k=60, cell_lines=800).toPandas().sort_values("id")
        # (mean absolute difference 0.01 in two columns, 0.03 in ten, with cells of 800 lines)
        assert len(out) == n and np.abs(out.neighbour_enc.values[rows] - want).mean() < (0.02 if wide == 2 else 0.05)


def test_neighbours_of_test_rows_and_odd_folds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), None if i % 9 == 0 else float(i % 2), int(i % 3 == 0), None if i % 4 == 0 else i % 4)
            for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label int, fold int")
    out = neighbours.encode_neighbours(df, ["a", "b"], "label", "fold", k=20)
    assert out.count() == 400 and out.where("neighbour_enc is null").count() == 0 and out.columns[-1] == "neighbour_enc"
    asked = spark.createDataFrame([(9, 2.0, 0.0), (10, -2.0, None)], "id int, a double, b double")
    got = neighbours.encode_neighbours(df, ["a", "b"], "label", "fold", asked, k=400).collect()
    assert [r["neighbour_enc"] for r in got] == pytest.approx([134 / 400] * 2)
    assert neighbours.encode_neighbours(df.limit(0), ["a", "b"], "label", "fold").count() == 0
    one = neighbours.encode_neighbours(df.where("fold = 1"), ["a", "b"], "label", "fold", k=5)
    assert {round(r["neighbour_enc"], 9) for r in one.collect()} == {round(rows_mean([r for r in rows if r[4] == 1]), 9)}


def test_neighbours_beyond_the_cell(spark):
    """The nearest rows count, and all that tie with the last one, whichever cell they lie in."""
    rng = np.random.default_rng(5)
    grid = pd.DataFrame([(i % 20, i // 20 % 20) for i in range(1200)], columns=["a", "b"]).astype(float)
    heap = pd.DataFrame(np.where(np.arange(600)[:, None] < 400, 0.0, rng.normal(size=(600, 2)) ** 2), columns=["a", "b"])
    # (rows, folds, k, lines of a cell): ties everywhere; a place of many folds at an edge, cells with fewer than k rows
    for frame, folds, k, most in ((grid, 4, 30, 500), (heap, 300, 120, 64)):
        n = len(frame)
        frame = frame.assign(id=np.arange(n), label=(rng.random(n) < 0.3).astype(int), fold=np.arange(n) * 7 % folds)
        names = ["a", "b"]
        z = (frame[names].values - frame[names].values.mean(0)) / frame[names].values.std(0)
        df = spark.createDataFrame(frame)
        got = neighbours.encode_neighbours(df, names, "label", "fold", k=k, cell_lines=most).toPandas().sort_values("id")
        want = []
        for i in range(n):
            away = np.where(frame.fold != frame.fold[i], ((z - z[i]) ** 2).sum(1), np.inf)
            want.append(frame.label[away <= np.sort(away)[k - 1] * (1 + 1e-9)].mean())
        assert np.abs(got.neighbour_enc.values - want).max() < 1e-9
    asked = spark.createDataFrame(frame[["id", *names]])
    got = neighbours.encode_neighbours(df, names, "label", "fold", asked, k=k, cell_lines=most).toPandas().sort_values("id")
    away = ((z[:, None] - z) ** 2).sum(2)
    reach = np.sort(away, axis=1)[:, k - 1:k] * (1 + 1e-9)
    assert np.abs(got.neighbour_enc.values - ((away <= reach) @ frame.label / (away <= reach).sum(1))).max() < 1e-9


def rows_mean(rows):
    return sum(r[3] for r in rows) / len(rows)
