"""NULL groups, types by name, leakage at depth and other rules that hold across operators."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskframe.operators import autoagg, encoding, metrics, selection, splits
from riskframe.sources import tables as src


def test_undeclared_child_columns_get_a_type_by_name(spark, tmp_path):
    path = str(tmp_path / "previous_application.csv")
    (tmp_path / "previous_application.csv").write_text(
        "SK_ID_PREV,SK_ID_CURR,DAYS_FIRST_DUE,SELLERPLACE_AREA,NAME_TYPE_SUITE,AMT_GOODS_PRICE\n1,2,-5,7,Family,1.5\n")
    types = dict(src.read_table(spark, path, "previous_application").dtypes)
    assert [types[c] for c in ("DAYS_FIRST_DUE", "SELLERPLACE_AREA", "NAME_TYPE_SUITE", "AMT_GOODS_PRICE")] == [
        "double", "double", "string", "double"]


def test_leakage_is_denied_at_any_depth():
    deep = autoagg.Feature("previous_application", "SK_ID_CURR", "mean", "mean__credit_card__SK_DPD")
    assert autoagg.is_leaky(deep) and autoagg.is_leaky(autoagg.Feature("pos_cash", "SK_ID_CURR", "sum", "SK_DPD_DEF"))
    assert not autoagg.is_leaky(autoagg.Feature("previous_application", "SK_ID_CURR", "mean", "mean__credit_card__AMT_BALANCE"))


def test_null_is_a_group_and_a_category(spark):
    rows = [(i, None if i % 2 else "a", i % 3, i % 4 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, c string, fold int, y boolean").withColumn("y", F.col("y").cast("int"))
    encoded = encoding.encode_out_of_fold(df, "c", "y", "fold", smoothing=0.0)
    assert encoded.count() == 40 and encoded.where("c_enc is null").count() == 0
    assert encoded.where("c is null").agg(F.max("c_enc")).first()[0] == 0.0
    one = encoding.encode_out_of_fold(df.withColumn("fold", F.lit(0)), "c", "y", "fold")
    assert one.where("c_enc is null").count() == 0
    test = encoding.encode_test(df, df.limit(5), "c", "y", smoothing=0.0)
    assert test.where("c is null").agg(F.max("c_enc")).first()[0] == 0.0
    folds = splits.stratified_folds(df.withColumn("y", F.when(F.col("id") > 3, F.col("y"))), "y", ["id"], 2)
    assert folds.where("fold is null").count() == 0 and folds.count() == 40


def test_correlation_uses_rows_where_both_are_present(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.normal(size=(500, 4)), columns=list("abcd"))
    frame["b"] = -frame.a + 0.3 * frame.b
    frame.loc[rng.random(500) < 0.3, "a"] = None
    frame.loc[rng.random(500) < 0.2, "c"] = None
    frame["k"] = 7.0
    df = spark.createDataFrame(frame).replace(float("nan"), None)
    want = frame.corr().fillna(0.0).values
    assert np.allclose(selection.pearson_matrix(df, list("abcdk"))[:4, :4], want[:4, :4], atol=1e-6)
    assert (selection.pearson_matrix(df, list("abcdk"))[4] == 0).sum() >= 4


def test_models_that_are_all_blends_have_no_lift(spark):
    df = spark.createDataFrame([("x", 0.7), ("y", 0.5)], "model string, gini double")
    got = {r["model"]: r for r in metrics.compare_models(df, ["x", "y"]).collect()}
    assert got["x"]["gate"] == "full_pass" and got["y"]["gate"] == "investigate" and got["x"]["lift"] is None


def test_pearson_moments_in_long_form(spark, monkeypatch):
    """Counts, means and deviations of all columns come from one short aggregate, with NULLs and without rows too."""
    calls, real = [], selection.long_values
    monkeypatch.setattr(selection, "long_values", lambda d, c, *a: calls.append(len(c)) or real(d, c, *a))
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (-F.col("id")).alias("b"),
                                F.when(F.col("id") > 3, F.col("id") * 2).alias("c"))
    assert np.allclose(selection.pearson_matrix(df, ["a", "b"]), [[1, -1], [-1, 1]])
    assert np.allclose(selection.pearson_matrix(df, ["a", "c"]), 1)
    assert (selection.pearson_matrix(df.limit(0), ["a", "b"]) == 0).all()
    assert calls == [2, 2, 2]
