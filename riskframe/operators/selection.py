"""Feature filters: variance, correlation pruning and protected columns.

The statistics are Spark jobs over all rows. What reaches the driver is one number per
column, or a matrix of columns by columns, never rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.prefix import hash_key
from riskframe.operators.wide import PLACE, long_values, with_feature


def column_variances(df: DataFrame, columns: list[str], sample: bool = False) -> DataFrame:
    """(feature, variance) of every column in one pass; NULLs are skipped."""
    fn = F.var_samp if sample else F.var_pop
    return with_feature(long_values(df, columns).groupBy(PLACE).agg(
        fn("value").alias("variance")), columns)


def keep_varied(df: DataFrame, columns: list[str], threshold: float = 0.01,
                protected: list[str] = ()) -> list[str]:
    """Columns whose population variance is above the threshold, plus protected ones at the end."""
    found = {r["feature"]: r["variance"] or 0.0
             for r in column_variances(df, columns).collect()}
    kept = [c for c in columns if found[c] > threshold]
    return kept + [c for c in protected if c in columns and c not in kept]


def keep_above_floor(df: DataFrame, columns: list[str], share: float = 0.05) -> list[str]:
    """Columns at or above a percentile of the positive sample variances."""
    found = {r["feature"]: r["variance"] or 0.0
             for r in column_variances(df, columns, sample=True).collect()}
    positive = [v for v in found.values() if v > 0]
    if not positive:
        return []
    floor = float(np.quantile(positive, share))
    return [c for c in columns if found[c] > 0 and found[c] >= floor]


def pearson_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Signed Pearson matrix over the rows where both columns are present.

    A constant column correlates with nothing. Without NULLs one pass over the columns is enough.
    With NULLs the sums over shared rows are products of three column sets: standardised values with
    0 for NULL, their squares, and presence flags; their moments come from one wider pass.
    """
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    names = values.columns
    # one aggregate per column would not be compiled where there are many
    lines = {r[PLACE]: r for r in long_values(values, names).groupBy(PLACE).agg(
        F.count("*").alias("n"), F.count("value").alias("present"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std")).collect()}
    rows = lines[0]["n"] if lines else 0
    stats = {k: [lines[i][k] for i in range(len(names)) if lines] for k in ("present", "mean", "std")}
    if rows and min(stats["present"], default=rows) == rows:
        vectors = VectorAssembler(inputCols=names, outputCol="_v").transform(values).select("_v")
        return np.nan_to_num(Correlation.corr(vectors, "_v").head()[0].toArray(), nan=0.0)
    if not rows:
        return np.zeros((len(columns), len(columns)))
    scaled = [(F.col(c) - (m or 0.0)) / (s or 1.0)
              for c, m, s in zip(names, stats["mean"], stats["std"])]
    wide = values.select(*[F.coalesce(z, F.lit(0.0)).alias(f"z{i}") for i, z in enumerate(scaled)],
                         *[F.coalesce(z * z, F.lit(0.0)).alias(f"q{i}") for i, z in enumerate(scaled)],
                         *[F.col(c).isNotNull().cast("double").alias(f"p{i}") for i, c in enumerate(names)])
    vectors = VectorAssembler(inputCols=wide.columns, outputCol="_v").transform(wide).select("_v").cache()
    corr = np.nan_to_num(Correlation.corr(vectors, "_v").head()[0].toArray(), nan=0.0)
    first = vectors.select(Summarizer.metrics("mean", "variance").summary(F.col("_v")).alias("s")).first()["s"]
    vectors.unpersist()
    mean, std = first["mean"].toArray(), np.sqrt(first["variance"].toArray() * (rows - 1) / rows)
    np.fill_diagonal(corr, 1.0)
    shared = corr * np.outer(std, std) + np.outer(mean, mean)  # mean products over all rows
    d = len(columns)
    n, x, xx, xy = shared[2 * d:, 2 * d:], shared[:d, 2 * d:], shared[d:2 * d, 2 * d:], shared[:d, :d]
    with np.errstate(divide="ignore", invalid="ignore"):
        cov, var = xy / n - (x / n) * (x / n).T, xx / n - (x / n) ** 2
        out = cov / np.sqrt(var * var.T)
    usable = (n * rows > 1.5) & (var > 1e-12) & (var.T > 1e-12)
    return np.clip(np.where(usable, out, 0.0), -1.0, 1.0)


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Absolute pairwise-complete Pearson matrix."""
    return np.abs(pearson_matrix(df, columns))


def correlated_pairs(df: DataFrame, columns: list[str],
                     threshold: float) -> list[tuple[str, str, float]]:
    """Pairs above the threshold in schema order, strongest first, names break ties."""
    matrix = correlation_matrix(df, columns)
    pairs = [(columns[i], columns[j], float(matrix[i, j]))
             for i, j in zip(*np.triu_indices(len(columns), 1)) if matrix[i, j] > threshold]
    return sorted(pairs, key=lambda p: (-p[2], p[0], p[1]))


def prune_by_value(df: DataFrame, columns: list[str], worth: dict[str, float],
                   threshold: float = 0.90) -> list[str]:
    """Strongest pairs first; of each pair still intact the less valuable column goes."""
    gone: set[str] = set()
    for a, b, _ in correlated_pairs(df, columns, threshold):
        if not {a, b} & gone:
            gone.add(b if worth.get(a, 0.0) >= worth.get(b, 0.0) else a)
    return [c for c in columns if c not in gone]


def prune_later(df: DataFrame, columns: list[str], threshold: float = 0.95,
                protected: list[str] = ()) -> list[str]:
    """The later column of every correlated pair goes unless protected."""
    gone = {b for _, b, _ in correlated_pairs(df, columns, threshold)} - set(protected)
    return [c for c in columns if c not in gone]


def prune_left_to_right(df: DataFrame, columns: list[str], threshold: float = 0.95,
                        importance: dict[str, float] | None = None) -> list[str]:
    """Greedy scan: a kept column removes its later correlates.

    With an importance table the more important columns are scanned first; the result
    stays in schema order.
    """
    matrix = correlation_matrix(df, columns)
    scan = list(range(len(columns)))
    if importance:
        scan.sort(key=lambda i: -importance.get(columns[i], 0.0))
    gone: set[int] = set()
    for place, i in enumerate(scan):
        if i not in gone:
            gone.update(j for j in scan[place + 1:] if matrix[i, j] > threshold)
    return [c for i, c in enumerate(columns) if i not in gone]


def seeded_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement; the same rows for the same seed on any layout.

    The rows are those of the smallest hashes. A bound on the hash that passes slightly more than n
    rows comes first, so that the final trim gathers about n rows and not n of every partition.
    """
    total, hashed = df.count(), hash_key(key, seed)
    share = (n + 6 * n ** 0.5 + 50) / max(total, 1)
    if share < 1:
        near = df.where(hashed < int(-(2 ** 63) + share * 2 ** 64))
        if near.count() >= n:
            return near.orderBy(hashed, *key).limit(n)
    return df.orderBy(hashed, *key).limit(n)


def novel_columns(df: DataFrame, base: list[str], new: list[str],
                  threshold: float = 0.90) -> list[str]:
    """New columns whose correlation with every base column stays below the threshold, over all rows."""
    matrix = correlation_matrix(df, base + new)
    block = matrix[:len(base), len(base):]
    return [c for i, c in enumerate(new) if block[:, i].max(initial=0.0) <= threshold]
