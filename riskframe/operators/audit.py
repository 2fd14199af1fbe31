"""Fairness, factor and store audits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.application import column_label
from riskframe.functions.exprs import MISSING
from riskframe.operators.prefix import exact_quantiles
from riskframe.operators.selection import correlated_pairs
from riskframe.operators.wide import PLACE, long_values, with_feature


def age_band(age: Column) -> Column:
    # Band bounds and names.
    return (F.when((age >= 0) & (age < 25), "Young").when((age >= 25) & (age < 45), "Mid")
            .when(age >= 45, "Senior"))


def score_cutoff(df: DataFrame, score: str = "score", share: float = 0.92) -> float:
    """Percentile of the score over all rows."""
    return exact_quantiles(df.select(score), score, [share]).first()["quantile"]


def fairness(df: DataFrame, attributes: dict[str, Column], label: str = "label",
             score: str = "score", cutoff: float | None = None,
             skip: Sequence[str] = ("XNA",)) -> DataFrame:
    """Mean score, true and false positive rate per group, and the min/max ratio per attribute."""
    limit = score_cutoff(df, score) if cutoff is None else cutoff
    groups = F.array(*[F.struct(F.lit(name).alias("attribute"), value.alias("group_name"))
                       for name, value in attributes.items()])
    long = df.select(F.col(label).alias("y"), F.col(score).alias("p"), F.explode(groups).alias("g")
                     ).select("y", "p", "g.attribute", "g.group_name")
    chosen, event = F.col("p") >= limit, F.col("y") == 1

    def rate(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    rates = (long.where(F.col("group_name").isNotNull() & ~F.col("group_name").isin(list(skip)))
             .groupBy("attribute", "group_name").agg(
                 F.count("*").alias("n"), F.avg("p").alias("mean_score"),
                 rate(F.count_if(chosen & event), F.count_if(event)).alias("tpr"),
                 rate(F.count_if(chosen & ~event), F.count_if(~event)).alias("fpr")))
    # one row per group of an attribute
    within = Window.partitionBy("attribute")
    return rates.withColumns({
        f"{m}_ratio": rate(F.min(m).over(within), F.max(m).over(within))
        for m in ("mean_score", "tpr", "fpr")})


def fairness_with_demographics(scored: DataFrame, people: DataFrame, key: str,
                               attributes: dict[str, Column], label: str = "label",
                               score: str = "score") -> DataFrame:
    """Audit scores of a model that never saw the attributes: they join by key for this only.

    The cutoff is the percentile over all scored rows, with or without known attributes.
    """
    needed = people.select(key, *[v.alias(n) for n, v in attributes.items()])
    joined = scored.select(key, label, score).join(needed, key)
    return fairness(joined, {n: F.col(n) for n in attributes}, label, score, score_cutoff(scored, score))


def fairness_gate(audit: DataFrame, bound: float = 0.80) -> DataFrame:
    """Pass or fail per attribute: every min/max ratio at or above the bound."""
    worst = F.least(*[F.min(f"{m}_ratio") for m in ("mean_score", "tpr", "fpr")])
    return audit.groupBy("attribute").agg(worst.alias("worst_ratio"),
                                          (worst >= bound).alias("passed"))


def top_factors(df: DataFrame, key: str, columns: list[str], n: int = 5) -> DataFrame:
    """The n largest contributions of each row by absolute value.

    Contributions stand side by side in a row, so the choice needs no shuffle.
    """
    # a missing contribution sorts behind every real one and is dropped afterwards
    entries = F.array(*[F.struct(F.coalesce(-F.abs(F.col(c)), F.lit(1.0)).alias("size"),
                                 F.lit(i).alias("place"), F.lit(c).alias("feature"),
                                 F.col(c).alias("contribution"))
                        for i, c in enumerate(columns)])
    best = F.slice(F.array_sort(entries), 1, n)
    name, value = F.col("_e.feature"), F.col("_e.contribution")
    return df.select(key, F.posexplode(best).alias("_i", "_e")).where(value.isNotNull()).select(
        key, name.alias("feature"), column_label(name).alias("label"),
        value.alias("contribution"),
        F.when(value > 0, "increases_risk").otherwise("decreases_risk").alias("direction"),
        (F.col("_i") + 1).alias("rank"))


def mean_absolute(df: DataFrame, columns: list[str]) -> dict[str, float]:
    means = with_feature(long_values(df, columns).groupBy(PLACE).agg(
        F.avg(F.abs("value")).alias("mean")), columns)
    return {r["feature"]: r["mean"] for r in means.collect()}


def _ranks(values: list[float]) -> np.ndarray:
    v = np.asarray(values)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def attribution_stability(train: DataFrame, later: DataFrame, columns: list[str]) -> float:
    """Spearman correlation of mean absolute contributions; 0 when undefined.

    One mean per feature reaches the driver.
    """
    if len(columns) < 3:
        return 0.0
    a, b = mean_absolute(train, columns), mean_absolute(later, columns)
    ranks = _ranks([a[c] for c in columns]), _ranks([b[c] for c in columns])
    if min(r.std() for r in ranks) == 0:
        return 0.0
    return float(np.corrcoef(*ranks)[0, 1])


def store_quality(df: DataFrame, columns: list[str], correlation: float = 0.90,
                  sentinel_share: float = 0.95, expected: tuple[int, int] = (30, 300)) -> DataFrame:
    """Checks of a feature store as rows (check, actual, passed)."""
    value = F.col("value")
    found = long_values(df, columns).groupBy(PLACE).agg(
        F.count_if(F.abs(value) == float("inf")).alias("infinite"),
        F.avg((value == MISSING).cast("double")).alias("share"),
        F.var_samp(value).alias("variance")).collect()
    infinite = sum(r["infinite"] for r in found)
    constant = sum(r["variance"] == 0 for r in found)
    sparse = sum((r["share"] or 0.0) > sentinel_share for r in found)
    pairs = len(correlated_pairs(df, columns, correlation))
    rows = [("zero_variance", constant, constant == 0),
            ("correlated_pairs", pairs, pairs == 0),
            ("infinite_values", infinite, infinite == 0),
            ("mostly_sentinel", sparse, sparse == 0),
            ("column_count", len(columns), expected[0] <= len(columns) <= expected[1])]
    return df.sparkSession.createDataFrame(rows, "check string, actual long, passed boolean")


def store_consistency(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, NULLs, minimum, maximum, and whether at most two values occur.

    Two values at most means every value is the minimum or the maximum. The extremes
    are one line per column and join back by broadcast.
    """
    value = F.col("value")
    long = long_values(df, columns)
    extremes = long.groupBy(F.col(PLACE).alias("_p")).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"))
    inner = (value > F.col("lo")) & (value < F.col("hi"))
    return with_feature(
        long.join(F.broadcast(extremes), F.col(PLACE) == F.col("_p")).groupBy(PLACE).agg(
            F.count("*").alias("n_rows"), F.count_if(value.isNull()).alias("n_null"),
            F.max("lo").alias("lo"), F.max("hi").alias("hi"),
            (F.count_if(inner) == 0).alias("two_values")), columns)
