"""Scaling, target encoding and rank averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.prefix import average_rank


def fit_minmax(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    row = train.agg(*[F.min(F.col(c).cast("double")).alias(f"{c}__lo") for c in columns],
                    *[F.max(F.col(c).cast("double")).alias(f"{c}__hi") for c in columns]).first()
    return {c: (row[f"{c}__lo"], row[f"{c}__hi"]) for c in columns}


def scale_minmax(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Scale to [0, 1] by the fitted range, clipped; a constant column becomes 0.5."""
    def scaled(name: str) -> Column:
        low, high = bounds[name]
        if low is None or high == low:
            return F.lit(0.5)
        value = (F.col(name) - low) / F.lit(high - low)
        return F.when(F.col(name).isNotNull(), F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)))
    return df.withColumns({c: scaled(c) for c in bounds})


def encode_test(train: DataFrame, test: DataFrame, category: str, target: str,
                smoothing: float = 20.0, name: str | None = None) -> DataFrame:
    """Smoothed category mean of the whole training table, global mean for unseen categories."""
    name = name or f"{category}_enc"
    counts = train.groupBy(category).agg(F.count("*").alias("_n"), F.sum(target).alias("_y"))
    mean = train.agg(F.avg(F.col(target).cast("double"))).first()[0]
    table = counts.select(category, ((F.col("_y") + smoothing * mean)
                                     / (F.col("_n") + smoothing)).alias(name))
    table = table.withColumnRenamed(category, "_category")
    return test.join(table, test[category].eqNullSafe(F.col("_category")), "left").drop("_category").withColumn(
        name, F.coalesce(F.col(name), F.lit(mean)))


def encode_out_of_fold(train: DataFrame, category: str, target: str, fold: str,
                       smoothing: float = 20.0, name: str | None = None) -> DataFrame:
    """Each row encoded from the other folds: category totals minus the row's own fold.

    One aggregate per (category, fold) serves all folds. Only that small table is
    summed up again, the rows are scanned once and joined once.
    """
    name = name or f"{category}_enc"
    cells = train.groupBy(category, fold).agg(F.count("*").alias("n"), F.sum(target).alias("y"))
    by_category = cells.groupBy(category).agg(F.sum("n").alias("n_c"), F.sum("y").alias("y_c"))
    by_fold = cells.groupBy(fold).agg(F.sum("n").alias("n_f"), F.sum("y").alias("y_f"))
    n_all, y_all = train.agg(F.count("*"), F.sum(target)).first()
    # with a single fold there are no other rows to learn from
    others = F.lit(n_all) - F.col("n_f")
    mean = F.when(others > 0, (F.lit(y_all) - F.col("y_f")) / F.nullif(others, F.lit(0))).otherwise(
        F.lit(y_all) / F.lit(n_all)) if n_all else F.lit(None).cast("double")
    n, y = F.col("n_c") - F.col("n"), F.col("y_c") - F.col("y")
    # NULL is a category, and a fold, of its own
    by_category, by_fold = (by_category.withColumnRenamed(category, "_category"),
                            by_fold.withColumnRenamed(fold, "_fold"))
    table = (cells.join(by_category, cells[category].eqNullSafe(F.col("_category")))
             .join(by_fold, cells[fold].eqNullSafe(F.col("_fold")))
             .select("_category", "_fold", ((y + smoothing * mean) / (n + smoothing)).alias(name)))
    return train.join(table, train[category].eqNullSafe(F.col("_category"))
                      & train[fold].eqNullSafe(F.col("_fold")), "left").drop("_category", "_fold")


def rank_average(df: DataFrame, scores: list[str], key: Sequence[str], group: Sequence[str] = (),
                 name: str = "rank_score") -> DataFrame:
    """Mean percentile rank of several scores, ranked within each group (or globally)."""
    out = df
    for i, score in enumerate(scores):
        out = average_rank(out, score, group, f"_rank{i}", share=True)
    total = sum((F.col(f"_rank{i}") for i in range(1, len(scores))), F.col("_rank0"))
    return out.withColumn(name, total / len(scores)).drop(
        *[f"_rank{i}" for i in range(len(scores))])
