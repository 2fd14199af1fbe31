"""Running totals, positions and quantiles against brute force, on several layouts."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskframe.operators import prefix


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    # group "hot" holds half of the rows
    groups = np.where(rng.random(2000) < 0.5, "hot", rng.choice(list("abcdef"), 2000))
    frame = pd.DataFrame({"g": groups, "day": rng.integers(-40, 0, 2000),
                          "v": rng.integers(0, 50, 2000), "id": np.arange(2000)})
    return frame, spark.createDataFrame(frame)


def expected(frame):
    out = frame.sort_values(["g", "day", "id"]).copy()
    out["n"] = out.groupby("g").cumcount() + 1
    out["s"] = out.groupby("g")["v"].cumsum()
    out["n_total"] = out.groupby("g")["n"].transform("max")
    return out.sort_values("id")[["id", "n", "s", "n_total"]].values.tolist()


def collect(df):
    return [list(r) for r in df.orderBy("id").select("id", "n", "s", "n_total").collect()]


@pytest.mark.parametrize("partitions", ["1", "2", "8"])
@pytest.mark.parametrize("way", ["range", "chunk"])
def test_running_sums(spark, rows, way, partitions):
    frame, df = rows
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        args = (df, ["g"], ["day", "id"], {"n": F.lit(1), "s": F.col("v")})
        got = {"range": lambda: prefix.prefix_sums(*args, totals=["n"]),
               "chunk": lambda: prefix.prefix_sums(*args, F.col("day"), ["n"])}[way]()
        assert collect(got) == expected(frame)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_null_chunk_keeps_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (1, -5.0, 2), (1, -1.0, 3)], "g int, d double, id int")
    got = prefix.prefix_sums(df, ["g"], ["d"], {"n": F.lit(1)}, F.floor("d"))
    assert {r["id"]: r["n"] for r in got.collect()} == {1: 1, 2: 2, 3: 3}


def test_position_over_whole_table(spark, rows):
    frame, df = rows
    got = prefix.position(df, ["day", "id"]).orderBy("position").select("id", "position").collect()
    want = frame.sort_values(["day", "id"])["id"].tolist()
    assert [r["id"] for r in got] == want
    assert [r["position"] for r in got] == list(range(len(want)))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.92, 1.0]
    got = {r["prob"]: r["quantile"] for r in prefix.exact_quantiles(df, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_wide_quantiles_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 4.0), (None, 8.0)], "a double, b double")
    got = {r["feature"]: r["quantile"] for r in prefix.wide_quantiles(df, ["a", "b"], [0.5]).collect()}
    assert got == {"a": 2.0, "b": 6.0}
    near = prefix.wide_quantiles(df, ["a", "b"], [0.5], approximate=True).count()
    assert near == 2


def test_average_rank(spark, rows):
    frame, df = rows
    got = prefix.average_rank(df, "v", ["g"], "r", share=True).orderBy("id").toPandas()["r"]
    want = frame.groupby("g")["v"].rank(pct=True)
    assert np.allclose(got, want)


def test_position_sorts_rows_once(spark, rows):
    frame, df = rows
    got = prefix.position(df, ["day", "id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(_chunk" not in plan and "SortMergeJoin" not in plan
    assert {r[0] for r in got.select("position_total").collect()} == {len(frame)}
    assert prefix.position(df.where("id < 0"), ["day", "id"]).collect() == []


def test_few_groups_meet_their_brackets_by_broadcast(spark, rows, monkeypatch):
    """No task takes all rows of a group, whatever the size of the tables."""
    frame, df = rows
    seen, join = [], type(df).join
    monkeypatch.setattr(type(df), "join", lambda a, b, *rest: seen.append(join(a, b, *rest)) or seen[-1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["g"]: r["quantile"] for r in prefix.exact_quantiles(df, "v", [0.25], ["g"]).collect()}
        assert "BroadcastHashJoin" in seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == pytest.approx(frame.groupby("g")["v"].quantile(0.25).to_dict())
