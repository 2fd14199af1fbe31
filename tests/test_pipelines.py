"""Sources, stores, automatic aggregation, model jobs, scoring and streaming."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.rows import frame
from checks.views import Tables
from riskframe.operators import autoagg, metrics, models
from riskframe.plans import scoring, stores, training
from riskframe.session import drop_intermediates, shared_folder
from riskframe.sources import schema
from riskframe.sources import tables as src
from riskframe.streaming import scoring as stream


@pytest.fixture(scope="module")
def loans(spark, sf_dir):
    return Tables(spark, sf_dir)


# ---- sources --------------------------------------------------------------------------

def test_load_from_csv(spark, loans, tmp_path):
    names = {"application": "application_train", **schema.CHILD_FILES}
    tables = loans.tables()
    with pytest.raises(ValueError):
        src.load_tables(spark, str(tmp_path), "predict")
    with pytest.raises(FileNotFoundError, match="bureau"):
        src.load_tables(spark, str(tmp_path))
    for table, name in names.items():
        tables[table].write.csv(f"{tmp_path}/{name}.csv", header=True)
    loaded = src.load_tables(spark, str(tmp_path))
    assert loaded["application"].count() == tables["application"].count()
    assert dict(loaded["installments"].dtypes)["DAYS_INSTALMENT"] == "double"
    assert dict(loaded["application"].dtypes)["CODE_GENDER"] == "string"
    ours = training.training_frame(loaded, sequences=False)
    assert ours.agg(F.sum("inst_cnt")).first()[0] == tables["installments"].count()


def test_primary_key_guard(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    with pytest.raises(ValueError, match="NULL"):
        src.assert_primary_key(df, "k")
    with pytest.raises(ValueError, match="duplicate"):
        src.assert_primary_key(df.dropna(), "k")
    src.assert_primary_key(df.dropna().distinct(), "k")
    with pytest.raises(ValueError):
        src.assert_same_rows(df, df.dropna(), "join")


def test_store_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "SK_ID_CURR long, x double")
    src.write_store(df, f"{tmp_path}/store", {"medians": {"x": 0.5}}, compact=True)
    back, meta = src.read_store(spark, f"{tmp_path}/store")
    assert meta["columns"] == ["SK_ID_CURR", "x"] and meta["medians"] == {"x": 0.5}
    assert dict(back.dtypes)["x"] == "float"
    src.write_report(df, f"{tmp_path}/csv", "csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == ["SK_ID_CURR", "x"]
    calls = []
    for _ in range(2):
        out = src.reuse_or_build(spark, f"{tmp_path}/mid", lambda: calls.append(1) or df)
    assert len(calls) == 1 and out.count() == 1


# ---- stores ---------------------------------------------------------------------------

def test_scorecard_store(loans):
    data = frame(loans).drop("ORGANIZATION_TYPE", "NAME_EDUCATION_TYPE", "CODE_GENDER")
    store = stores.fit_scorecard(data)
    assert store.columns and store.frame.count() == data.count()
    assert set(store.woe.iv) == set(store.columns) and min(store.woe.iv.values()) >= 0.02
    again = stores.apply_scorecard(data, store)
    a = store.frame.orderBy("SK_ID_CURR").toPandas()
    b = again.orderBy("SK_ID_CURR").toPandas()[a.columns]
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_tree_store(loans):
    store = stores.fit_tree_store(frame(loans), loans.tables())
    data = store.frame.toPandas()
    assert len(data) == loans.applicants().count() and "CODE_GENDER" not in data
    assert not data.isna().any().any() and not np.isinf(data.to_numpy(dtype=float)).any()
    protected = set(schema.PROTECTED)
    assert {"inst_late_rate_12m", "bbal_dpd_escalation"} <= set(store.columns)
    loose = [c for c in store.columns if c not in protected]
    assert (data[loose].var(ddof=0) > 0.01).all()
    matrix = data[loose].corr().abs().fillna(0).values
    assert np.triu(matrix, 1).max() <= 0.95 + 1e-9
    aligned = stores.apply_tree_store(frame(loans).drop("TARGET", "AMT_ANNUITY", "AMT_CREDIT"), store.columns)
    assert aligned.columns == ["SK_ID_CURR", *store.columns]


def test_combinations(spark, loans):
    base = loans.applicants().select("SK_ID_CURR", "TARGET", "AMT_CREDIT")
    guess = base.select("SK_ID_CURR", F.lit(0.5).alias("AMT_CREDIT"), F.lit(1.0).alias("extra"))
    out = stores.combined_store(base, guess)
    assert out.columns == ["SK_ID_CURR", "TARGET", "AMT_CREDIT", "extra"]
    assert out.first()["AMT_CREDIT"] == 0.5
    with pytest.raises(ValueError):
        stores.combined_store(base, guess, min_columns=50)
    with pytest.raises(ValueError, match="NULL"):
        stores.combined_store(base, guess.withColumn("extra", F.lit(None).cast("double")))
    variants = stores.store_variants(base.withColumn("AGE_YEARS", F.lit(30.0)), loans.applicants(), ["ORGANIZATION_TYPE"])
    assert "AGE_YEARS" not in variants["base_strict"].columns
    assert "ORGANIZATION_TYPE" in variants["categorical_strict"].columns
    scored = spark.createDataFrame([(0, .1, .5), (1, .9, .5), (0, .2, .6), (1, .8, .4)], "label int, good double, bad double")
    assert stores.commit_decision(scored, "label", "bad", "good")["decision"] == "commit"
    assert stores.commit_decision(scored, "label", "good", "bad")["decision"] == "defer"


# ---- automatic aggregation ------------------------------------------------------------

def test_auto_features_and_replay(loans):
    tables = loans.tables()
    matrix, features = autoagg.auto_features(tables)
    assert matrix.count() == tables["application"].count()
    shown = autoagg.display_names(features)
    assert shown["mean__bureau__DAYS_CREDIT"] == "MEAN(bureau.DAYS_CREDIT)"
    assert shown["count__bureau"] == "COUNT(bureau)"
    assert not [c for c in matrix.columns if "SK_ID" in c and c != "SK_ID_CURR"]
    again = autoagg.replay(tables, autoagg.from_json(autoagg.to_json(features)), columns=["count__bureau"])
    want = {r["SK_ID_CURR"]: r["count__bureau"] for r in matrix.select("SK_ID_CURR", "count__bureau").collect()}
    assert {r["SK_ID_CURR"]: r["count__bureau"] for r in again.collect()} == want
    zero_months = loans.cc().where("MONTHS_BALANCE = 0").count()
    total = matrix.where("count__credit_card > 0").agg(F.sum("count__credit_card")).first()[0]
    assert total == loans.cc().count() - zero_months


def test_auto_store_guards_and_depth(loans):
    tables = loans.tables()
    store = stores.fit_auto_store(tables, loans.applicants(), min_iv=0.02)
    assert store.columns and not [c for c in store.columns if c.endswith("SK_DPD")]
    deep, features = autoagg.auto_features(tables, depth=2, primitives=("count", "mean"))
    assert "mean__bureau__count__bureau_balance" in deep.columns
    assert deep.count() == tables["application"].count()


# ---- models ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 2))
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))
    frame = pd.DataFrame({"id": np.arange(1200), "x1": x[:, 0], "x2": x[:, 1], "t": np.arange(1200),
                          "label": (rng.random(1200) < p).astype(int),
                          "s1": np.clip(p + rng.normal(0, .2, 1200), 0, 1),
                          "s2": np.clip(p + rng.normal(0, .3, 1200), 0, 1)})
    return spark.createDataFrame(frame)


def test_scorecard_model(sample):
    model = models.fit_scorecard_model(sample, ["x1", "x2"], "label")
    assert model.coefficients[0] == pytest.approx(1.5, abs=0.25)
    assert model.coefficients[1] == pytest.approx(-1.0, abs=0.25)
    assert metrics.gini(model.score(sample)) > 0.6
    parts = model.contributions(sample, ["id"]).agg(F.avg("x1"), F.avg("x2")).first()
    assert max(map(abs, parts)) < 1e-9
    report = models.scorecard_report(sample, ["x1", "x2"], "label", ["id"], folds=3).toPandas()
    assert len(report) == 4 and (report.gini > 0.5).all()


def test_boosted_out_of_fold(sample):
    fit = models.boosted_fitter(["x1", "x2"], "label", trees=5, depth=3)
    flat = models.out_of_fold(sample, fit, "label", ["id"], folds=3)
    assert flat.count() == 1200 and metrics.gini(flat) > 0.5
    timed = models.out_of_fold(sample, fit, "label", ["id"], "t", 3)
    assert timed.agg(F.min("t")).first()[0] == 300 and timed.count() == 900


def test_calibration(sample):
    out = {r["method"]: r["brier"] for r in models.calibration_report(
        sample.where("t < 800"), sample.where("t >= 800"), "label", ["id"], "s1").collect()}
    assert set(out) == {"raw", "platt", "isotonic"} and all(0 < v < 0.3 for v in out.values())


def test_imputer(sample):
    data = sample.withColumn("EXT_SOURCE_3", F.when(F.col("id") % 4 == 0, -999.0).otherwise(2 * F.col("x1")))
    fitted = models.fit_imputer(data, "EXT_SOURCE_3", ["x1", "x2"], linear=True)
    out = models.apply_imputer(data, "EXT_SOURCE_3", fitted).toPandas()
    assert np.allclose(out.EXT_SOURCE_3, 2 * out.x1, atol=1e-6)
    assert out.EXT_SOURCE_3_MISSING_FLAG.sum() == 300
    assert models.imputer_correlation(data, "EXT_SOURCE_3", ["x1", "x2"], "label", ["id"], linear=True) > 0.999


def test_blends(sample):
    scores = ["s1", "s2"]
    single = metrics.gini(sample, score="s1")
    stack = models.fit_logistic_stack(sample, scores, "label").score(sample)
    ridge = models.fit_ridge_stack(sample, scores, "label", folds=2)(sample)
    assert metrics.gini(stack) > single and metrics.gini(ridge) > single
    low, high = ridge.agg(F.min("score"), F.max("score")).first()
    assert low >= 0 and high <= 1
    per_fold = models.calibrated_stack(sample, scores, "label", ["id"], folds=2)
    assert per_fold.count() == 1200
    names = [r["variant"] for r in models.subset_ablation(sample, scores, "label").collect()]
    assert sorted(names) == ["average:s1+s2", "logistic:s1+s2"]


def test_reports(sample):
    early, late = sample.where("t < 800"), sample.where("t >= 800")
    both = models.imbalance_report(early, late, ["x1", "x2"], "label", ["id"], folds=2, trees=3).toPandas()
    assert sorted(both.strategy) == ["class_weight", "tuned_threshold"] and (both.gini > 0.4).all()
    columns = ["x1", "x2", "id"]
    shift = models.shift_report(early.select("id", "x1", "x2"), late.select("id", "x1", "x2"),
                                ["x1", "x2"], ["id"], folds=2, trees=3).first()
    assert shift["verdict"] in ("safe", "investigate") and shift["n_train"] == 800
    moved = late.select("id", (F.col("x1") + 5).alias("x1"), "x2")
    assert models.shift_report(early.select("id", "x1", "x2"), moved, ["x1", "x2"], ["id"],
                               folds=2, trees=3).first()["verdict"] == "problematic"
    curve = models.learning_curve(sample, models.linear_fitter(["x1", "x2"], "label"), "label",
                                  ["id"], "t", folds=2).collect()
    assert [r["n"] for r in curve] == [600, 900, 1200] and curve[0]["gain"] is None


# ---- scoring --------------------------------------------------------------------------

RAW = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1",
       "EXT_SOURCE_2", "EXT_SOURCE_3", "DAYS_BIRTH", "DAYS_EMPLOYED"]


def test_learning_curve_places_rows_once(spark, monkeypatch):
    """Each share takes the first rows of one order, with the folds that an order of its own would give."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({
        "id": np.arange(400), "t": rng.integers(0, 90, 400), "x": x, "y": (x + rng.normal(size=400) > 0).astype(int)}))
    fit, calls, real = models.linear_fitter(["x"], "y"), [], models.position
    monkeypatch.setattr(models, "position", lambda *a, **k: calls.append(1) or real(*a, **k))
    got = {r["share"]: r["gini"] for r in models.learning_curve(df, fit, "y", ["id"], "t", (0.5, 1.0), 2).collect()}
    assert len(calls) == 1
    half = df.orderBy("t", "id").limit(200)
    want = [metrics.gini(models.out_of_fold(part, fit, "y", ["id"], "t", 2), "y") for part in (half, df)]
    assert [got[0.5], got[1.0]] == pytest.approx(want, abs=1e-9)


def test_boosting_spreads_rows(spark, monkeypatch):
    """Rows in one partition are dealt evenly, so that no task holds them all."""
    df = spark.range(1000).coalesce(1).select(
        (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    monkeypatch.setattr(models, "ROWS_PER_TASK", 100)
    assert models.spread(df, 90) is df
    sizes = models.spread(df, 1000).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) <= 110
    seen, real = [], models.assembled
    monkeypatch.setattr(models, "assembled", lambda d, c, *a: seen.append(d.rdd.getNumPartitions()) or real(d, c, *a))
    models.fit_boosted(df, ["x"], "y", trees=1, depth=1)
    assert seen == [10]


def test_boosting_by_cells_equals_rows(spark, monkeypatch, tmp_path):
    """Weighted cells of binned rows train the trees of the rows, and passes of the trees do not see the rows."""
    rng = np.random.default_rng(5)
    x, y, z = rng.integers(0, 9, 6000) / 7, rng.integers(-3, 5, 6000) * 1e6, rng.integers(0, 3, 6000) * 1.0
    label = ((x > 0.5) & (y < 2e6) ^ (rng.random(6000) < 0.2)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": z, "label": label}))
    for balanced in (False, True):
        rows = models.fit_boosted(df, ["x", "y", "z"], "label", trees=4, depth=4, balanced=balanced)
        seen, real = [], models.assembled
        with monkeypatch.context() as patch:
            patch.setattr(models, "BINNED_ROWS", 1000)
            patch.setattr(models, "assembled", lambda d, c, *a: seen.append(d.count()) or real(d, c, *a))
            cells = models.fit_boosted(df, ["x", "y", "z"], "label", trees=4, depth=4, balanced=balanced)
        assert rows.edges is None and cells.edges and seen[0] <= 9 * 8 * 3 * 2
        cells.save(f"{tmp_path}/kept")
        kept = models.BoostedScore.load(spark, f"{tmp_path}/kept")
        both = kept(cells(rows(df, "a"), "b"), "c")
        assert both.columns == [*df.columns, "a", "b", "c"]
        found = both.agg(F.max(F.abs(F.col("a") - F.col("b"))), F.max(F.abs(F.col("b") - F.col("c")))).first()
        assert found[0] < 1e-9 and found[1] == 0
    many = spark.range(4000).select(F.col("id").alias("v"), F.lit(1.0).alias("one"), F.lit(float("inf")).alias("far"))
    edges = models.bin_edges(many, ["v", "one", "far"])
    assert len(edges[0]) == 31 and edges[1:] == [[], []]
    sizes = models.binned(many, ["v", "one", "far"], edges).groupBy("v", "one", "far").count().collect()
    assert len(sizes) == 32 and max(r["count"] for r in sizes) <= 200
    with pytest.raises(Exception):
        models.binned(many.withColumn("v", F.lit(float("nan"))), ["v"], edges[:1]).collect()


def test_ablation_weights_equal_rows(spark, sample, monkeypatch):
    """Lines of equal rows give the fits and metrics of the rows; the fits see the lines only."""
    rounded = sample.select("label", F.round("s1", 1).alias("s1"), F.round("s2", 1).alias("s2"))
    sizes, real = [], models.fit_scorecard_model
    monkeypatch.setattr(models, "fit_scorecard_model", lambda d, *a, **k: sizes.append(d.count()) or real(d, *a, **k))
    got = {r["variant"]: r for r in models.subset_ablation(rounded, ["s1", "s2"], "label").collect()}
    assert max(sizes) < 400 < rounded.count()
    plain = real(rounded, ["s1", "s2"], "label").score(rounded)
    want = metrics.metric_suite(plain, "label", "score").first()
    line = got["logistic:s1+s2"]
    assert (line["n_pos"], line["n_neg"]) == (want["n_pos"], want["n_neg"])
    assert [line["auc"], line["brier"]] == pytest.approx([want["auc"], want["brier"]], abs=1e-6)


def test_score_curve_works_out_scores_once(spark):
    """Rows without score or label are left out after counting, not by a filter that repeats the score's expression."""
    df = spark.createDataFrame([(0.1, 0), (None, 1), (0.3, None), (0.3, 1), (0.5, None)], "s double, label int")
    curve = metrics.score_curve(df.withColumn("score", F.exp("s")), "label", "score")
    assert sorted((r["pos"], r["neg"], r["n_pos"], r["n_neg"]) for r in curve.collect()) == [(0, 1, 1, 1), (1, 0, 1, 1)]
    lines = df.withColumn("score", F.exp("s")).groupBy("score", "label").agg(F.count("*").alias("n"))
    again = metrics.score_curve(lines, "label", "score", counts="n")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, curve.collect()))


def test_batch_and_stream_agree(spark, loans, tmp_path):
    people = loans.applicants()
    bundle = scoring.fit_bundle(people, RAW, ["CREDIT_INCOME_RATIO", "EXT_SOURCE_MEAN", "AGE_YEARS"], "TARGET")
    bundle = scoring.ScoreBundle.from_json(bundle.to_json())
    batch = scoring.score(people, bundle).toPandas().sort_values("SK_ID_CURR").reset_index(drop=True)
    assert batch.probability.between(0, 1).all() and len(batch) == people.count()
    first = batch.factors[0]
    assert [f["rank"] for f in first] == [1, 2, 3]
    assert abs(first[0]["contribution"]) >= abs(first[1]["contribution"])
    rows = people.drop("TARGET")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    query = stream.score_stream(stream.application_stream(spark, f"{tmp_path}/in", rows.schema, 1),
                                bundle, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    live = spark.read.parquet(f"{tmp_path}/out").toPandas().sort_values("SK_ID_CURR").reset_index(drop=True)
    pd.testing.assert_series_equal(batch.probability, live.probability)
    assert (batch.risk_band == live.risk_band).all()


def test_partial_requests_use_defaults(spark, loans):
    bundle = scoring.fit_bundle(loans.applicants(), RAW, ["CREDIT_INCOME_RATIO", "EXT_SOURCE_MEAN"], "TARGET")
    ask = spark.createDataFrame([(1, 0.9), (2, None)], "SK_ID_CURR long, EXT_SOURCE_2 double")
    got = scoring.score(ask, bundle).collect()
    assert len(got) == 2 and got[0]["probability"] != got[1]["probability"]
    filled = scoring.fill_defaults(ask, bundle.defaults).collect()
    assert filled[0]["EXT_SOURCE_2"] == 0.9 and filled[1]["EXT_SOURCE_2"] == bundle.defaults["EXT_SOURCE_2"]


def test_intermediates_can_be_dropped(spark):
    folder = shared_folder(spark)
    assert src.path_exists(spark, folder)
    drop_intermediates(spark)
    assert not src.path_exists(spark, folder)
