"""Discrimination, calibration and threshold metrics over scored rows.

Rows first collapse to one line per (group, distinct score). Running totals over those
lines then give every curve-based metric, see :mod:`prefix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.prefix import prefix_sums


def score_curve(df: DataFrame, label: str = "label", score: str = "score",
                group: Sequence[str] = (), counts: str | None = None) -> DataFrame:
    """Per distinct score: events and non-events, running counts up to it, and totals.

    ``counts`` tells how many equal rows a line of ``df`` stands for.
    """
    def rows(chosen: Column) -> Column:
        if counts is None:
            return F.count_if(chosen)
        return F.coalesce(F.sum(F.when(chosen, F.col(counts))), F.lit(0)).cast("long")

    # filtered after they are counted: a filter on the rows would work out every score twice
    lines = df.groupBy(*group, F.col(score).cast("double").alias("score")).agg(
        rows(F.col(label) == 1).alias("pos"), rows(F.col(label) == 0).alias("neg"),
        F.count(label).alias("_known")).where(
        F.when(F.col("score").isNotNull(), F.col("_known")) > 0).drop("_known")
    return prefix_sums(lines, group, ["score"],
                       {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")},
                       totals=["cum_pos", "cum_neg"]).withColumnsRenamed(
        {"cum_pos_total": "n_pos", "cum_neg_total": "n_neg"})


def _at_or_above(which: str) -> Column:
    """Rows of a class with a score at or above this line's score."""
    return F.col(f"n_{which}") - F.col(f"cum_{which}") + F.col(which)


def curve_metrics(curve: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """AUC, Gini, KS with its threshold, Brier, skill and average precision per group.

    A group with one class has no AUC, Gini or KS: NULL.
    """
    pos, neg, score = F.col("pos"), F.col("neg"), F.col("score")
    n_pos, n_neg = F.col("n_pos"), F.col("n_neg")
    both = (n_pos > 0) & (n_neg > 0)
    # a positive beats all negatives below it and half of those at its own score
    beaten = pos * (F.col("cum_neg") - neg / 2.0)
    gap = F.abs(F.col("cum_pos") / n_pos - F.col("cum_neg") / n_neg)
    # the smallest score wins among equal gaps
    widest = F.max(F.when(both, F.struct(F.round(gap, 12).alias("gap"), (-score).alias("s"))))
    hits = _at_or_above("pos")
    precision = hits / (hits + _at_or_above("neg"))
    out = curve.groupBy(*group).agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
        (F.sum(beaten) / F.max(F.when(both, n_pos * n_neg.cast("double")))).alias("auc"),
        widest.alias("_ks"),
        (F.sum(pos * (1 - score) * (1 - score) + neg * score * score)
         / F.sum(pos + neg)).alias("brier"),
        F.sum(F.when(n_pos > 0, pos / n_pos * precision)).alias("avg_precision"))
    rate = F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))
    baseline = rate * (1 - rate)
    return out.select(
        *group, "n_pos", "n_neg", "auc", (2 * F.col("auc") - 1).alias("gini"),
        F.col("_ks.gap").alias("ks"), (-F.col("_ks.s")).alias("ks_threshold"), "brier",
        baseline.alias("brier_baseline"),
        F.when(baseline > 0, 1 - F.col("brier") / baseline).alias("brier_skill"),
        "avg_precision")


def metric_suite(df: DataFrame, label: str = "label", score: str = "score",
                 group: Sequence[str] = (), counts: str | None = None) -> DataFrame:
    return curve_metrics(score_curve(df, label, score, group, counts), group)


def _scalar(df: DataFrame, label: str, score: str, names: list[str]) -> tuple:
    row = metric_suite(df, label, score).select("n_pos", "n_neg", *names).first()
    if row is None or not row["n_pos"] or not row["n_neg"]:
        raise ValueError("both classes are required")
    return tuple(row[n] for n in names)


def gini(df: DataFrame, label: str = "label", score: str = "score") -> float:
    return _scalar(df, label, score, ["gini"])[0]


def ks_statistic(df: DataFrame, label: str = "label",
                 score: str = "score") -> tuple[float, float]:
    return _scalar(df, label, score, ["ks", "ks_threshold"])


def roc_points(curve: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall point of every threshold (predicted when score >= threshold)."""
    tp, fp = _at_or_above("pos"), _at_or_above("neg")
    return curve.select(
        *group, F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        F.when(F.col("n_pos") > 0, tp / F.col("n_pos")).alias("tpr"),
        F.when(F.col("n_neg") > 0, fp / F.col("n_neg")).alias("fpr"),
        (tp / (tp + fp)).alias("precision"))


def reliability(df: DataFrame, label: str = "label", score: str = "score",
                bins: int = 20, group: Sequence[str] = ()) -> DataFrame:
    """Mean score and event rate in uniform score bins; empty bins do not appear."""
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    return df.groupBy(*group, place.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_score"),
        F.avg(F.col(label).cast("double")).alias("event_rate"))


def _f1(hit: Column, wrong: Column) -> Column:
    return F.when(2 * hit + wrong > 0, 2 * hit / (2 * hit + wrong)).otherwise(0.0)


def macro_f1(tp: Column, fp: Column, n_pos: Column, n_neg: Column) -> Column:
    """Mean of the F1 scores of both classes."""
    wrong = n_pos - tp + fp
    return (_f1(tp, wrong) + _f1(n_neg - fp, wrong)) / 2


def best_threshold(curve: DataFrame, group: Sequence[str] = (), low: float = 0.1,
                   high: float = 0.9, default: float = 0.5) -> DataFrame:
    """Observed score in [low, high] with the best macro F1; the smallest on ties."""
    value = macro_f1(_at_or_above("pos"), _at_or_above("neg"), F.col("n_pos"), F.col("n_neg"))
    inside = F.col("score").between(low, high)
    best = F.max(F.when(inside, F.struct(F.round(value, 12).alias("f1"),
                                         (-F.col("score")).alias("s"))))
    return curve.groupBy(*group).agg(best.alias("_b")).select(
        *group, F.coalesce(-F.col("_b.s"), F.lit(default)).alias("threshold"),
        F.col("_b.f1").alias("macro_f1"))


def threshold_metrics(df: DataFrame, threshold: float | Column, label: str = "label",
                      score: str = "score", group: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and macro F1 at a threshold; undefined rates are 0."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    chosen, event = F.col(score) >= limit, F.col(label) == 1
    tp, fp = F.col("tp"), F.col("fp")
    n_pos, n_neg = F.col("n_pos"), F.col("n_neg")
    counts = df.groupBy(*group).agg(
        F.count_if(chosen & event).alias("tp"), F.count_if(chosen & ~event).alias("fp"),
        F.count_if(event).alias("n_pos"), F.count_if(~event).alias("n_neg"))
    return counts.select(
        *group, "tp", "fp", (n_pos - tp).alias("fn"), (n_neg - fp).alias("tn"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
        F.when(n_pos > 0, tp / n_pos).otherwise(0.0).alias("recall"),
        macro_f1(tp, fp, n_pos, n_neg).alias("macro_f1"))


def class_balance(df: DataFrame, label: str = "label", group: Sequence[str] = ()) -> DataFrame:
    """Class counts, prevalence and the weight that balances the positive class."""
    events, others = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.groupBy(*group).agg(
        F.count("*").alias("n"), events.alias("n_pos"), others.alias("n_neg"),
        (events / F.count(label)).alias("prevalence"),
        F.when(events > 0, others / events).alias("scale_weight"))


def compare_models(metrics: DataFrame, blends: list[str], model: str = "model") -> DataFrame:
    """Model table with the best single model, the lift over it and the acceptance gate."""
    single = metrics.where(~F.col(model).isin(blends)).orderBy(
        F.desc("gini"), model).select(model, "gini").first()
    # without a single model there is no lift, and only the absolute gate can pass
    best, best_gini = (single[model], single["gini"]) if single else (None, None)
    lift = F.col("gini") - F.lit(best_gini).cast("double")
    # Gate bounds and labels.
    gate = (F.when(F.col("gini") >= 0.65, "full_pass")
            .when((F.col("gini") >= 0.58) & (lift >= 0.005), "accept_best_available")
            .otherwise("investigate"))
    return metrics.withColumns({
        "best_single": F.lit(best).cast("string"), "best_single_gini": F.lit(best_gini).cast("double"),
        "lift": lift, "gate": gate})
