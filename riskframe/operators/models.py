"""Model jobs on Spark ML: scorecard, boosted trees, calibration, imputation, blending.

Folds and variants are a short Python loop over distributed fits. Only coefficients,
metrics and other fitted values of fixed size come back to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.exprs import MISSING
from riskframe.operators import metrics, splits
from riskframe.operators.prefix import position
from riskframe.session import cut_lineage

Scorer = Callable[[DataFrame], DataFrame]

#: Rows of a partition that boosting keeps in memory and reads in every pass.
ROWS_PER_TASK = 500_000
#: Rows from which boosting trains on weighted cells of binned rows.
BINNED_ROWS = 1_000_000
#: Bins of a column, as Spark ML has them by default.
BINS = 32


def assembled(df: DataFrame, columns: Sequence[str], out: str = "_x") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


@dataclass
class LinearScore:
    """Logistic scorecard as plain numbers, so scoring is one column expression."""

    columns: list[str]
    coefficients: list[float]
    means: list[float]
    intercept: float

    def contribution(self, i: int) -> Column:
        """Coefficient times distance from the mean: what column i adds to the log odds."""
        return self.coefficients[i] * (F.col(self.columns[i]).cast("double") - self.means[i])

    def log_odds(self) -> Column:
        parts = [self.contribution(i) for i in range(len(self.columns))]
        return reduce(lambda a, b: a + b, parts, F.lit(self.intercept))

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.log_odds()))

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        return df.withColumn(name, self.probability())

    def contributions(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return df.select(*keep, *[self.contribution(i).alias(c)
                                  for i, c in enumerate(self.columns)])


def fit_scorecard_model(train: DataFrame, columns: Sequence[str], label: str,
                        c: float = 1.0, weight: str | None = None, counts: str | None = None) -> LinearScore:
    """Standardised L2 logistic regression with inverse penalty ``c``.

    ``counts`` tells how many equal rows a line stands for; the fit is that of the rows.
    """
    columns = list(columns)
    if counts is None:
        stats = train.agg(F.count("*").alias("n"),
                          F.array(*[F.avg(F.col(x)) for x in columns]).alias("mean"),
                          F.array(*[F.stddev_pop(F.col(x)) for x in columns]).alias("std")).first()
        means, deviations = stats["mean"], stats["std"]
    else:
        weight = counts

        def mean(value: Column) -> Column:
            return F.sum(value * F.col(counts)) / F.sum(F.when(value.isNotNull(), F.col(counts)))

        stats = train.agg(F.sum(counts).alias("n"), F.array(*[mean(F.col(x)) for x in columns]).alias("mean")).first()
        means = stats["mean"]
        squares = train.agg(*[mean((F.col(x) - (m or 0.0)) * (F.col(x) - (m or 0.0))).alias(f"_{i}")
                              for i, (x, m) in enumerate(zip(columns, means))]).first()
        stats, deviations = {"n": stats["n"] or 0}, [v and v ** 0.5 for v in squares]
    means = [float(m or 0.0) for m in means]
    spread = [float(s or 0.0) or 1.0 for s in deviations]
    scaled = train.select(label, *([weight] if weight else []), *[
        ((F.col(x) - m) / s).alias(x) for x, m, s in zip(columns, means, spread)])
    model = LogisticRegression(
        featuresCol="_x", labelCol=label, regParam=1.0 / (c * max(stats["n"], 1)),
        standardization=False, maxIter=100, **({"weightCol": weight} if weight else {})
    ).fit(assembled(scaled, columns).select(
        label, "_x", *([weight] if weight else [])))
    raw = [float(b / s) for b, s in zip(model.coefficients.toArray(), spread)]
    return LinearScore(columns, raw, means, float(model.intercept))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with more than ``ROWS_PER_TASK`` rows in even partitions of at most about so many.

    A scan puts any number of rows in one partition where they compress well, and the first rows of an ordered
    table lie in few partitions.
    """
    if rows <= ROWS_PER_TASK:
        return df
    return df.repartition(max(-(-rows // ROWS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism))


def bin_edges(df: DataFrame, columns: Sequence[str]) -> list[list[float]]:
    """Per column the bounds of at most ``BINS`` bins, from all rows: a value lies right of the bounds below it.

    Up to ``BINS`` values have a bin each, bounded halfway between neighbours; more are cut at quantiles.
    """
    values = {c: F.col(c).cast("double") for c in columns}
    grid = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = df.agg(F.array(*[F.approx_count_distinct(v) for v in values.values()]).alias("n"),
                   *[F.percentile_approx(v, grid, F.lit(1000)).alias(f"q{i}") for i, v in enumerate(values.values())]
                   ).first()
    # the number of values is an estimate, so some are listed in vain
    few = [c for i, c in enumerate(columns) if found["n"][i] <= BINS * 5 // 4]
    listed = df.agg(*[F.collect_set(values[c]).alias(f"s{i}") for i, c in enumerate(few)]).first() if few else ()
    known = {c: sorted(x) for c, x in zip(few, listed)}
    out = []
    for i, c in enumerate(columns):
        if len(known.get(c, [0.0] * (BINS + 1))) <= BINS:
            most = [min(max(x, -1e308), 1e308) for x in known[c]]
            out.append(sorted({a / 2 + b / 2 for a, b in zip(most, most[1:])}))
        else:
            out.append(sorted({float(x) for x in found[f"q{i}"] if np.isfinite(x)}))
    return out


def binned(df: DataFrame, columns: Sequence[str], edges: Sequence[Sequence[float]]) -> DataFrame:
    """``df`` with the bin number of each column in its place. NULL and NaN raise, as they do in an assembler."""
    # a bucket holds its lower bound, a bin its upper one; a column of one value has one bin
    splits_ = [[-np.inf, *[float(np.nextafter(e, np.inf)) for e in own or [0.0]], np.inf] for own in edges]
    out = Bucketizer(splitsArray=splits_, inputCols=list(columns), outputCols=[f"_b{i}" for i in range(len(columns))],
                     handleInvalid="error").transform(df.withColumns({c: F.col(c).cast("double") for c in columns}))
    # as plain numbers: a bucket is marked as a category, whose order trees would not keep
    return out.withColumns({c: F.col(f"_b{i}") + 0.0 for i, c in enumerate(columns)}).drop(
        *[f"_b{i}" for i in range(len(columns))])


class BoostedScore:
    """Fitted trees over named columns: scores batches and streams alike, and can be kept and read again.

    Trees over bins come with the bounds of the bins of each column.
    """

    def __init__(self, columns: list[str], model: GBTClassificationModel, edges: list[list[float]] | None = None):
        self.columns, self.model, self.edges = columns, model, edges

    @property
    def importances(self) -> dict[str, float]:
        return dict(zip(self.columns, self.model.featureImportances.toArray().tolist()))

    def __call__(self, df: DataFrame, name: str = "score") -> DataFrame:
        if self.edges is None:
            inputs = assembled(df, self.columns)
        else:
            own = {c: f"_v{i}" for i, c in enumerate(self.columns)}
            inputs = assembled(binned(df.withColumns({v: F.col(c) for c, v in own.items()}), list(own.values()), self.edges),
                               list(own.values())).drop(*own.values())
        # without the other outputs the trees are walked once a row
        model = self.model.copy().setRawPredictionCol("").setPredictionCol("")
        value = vector_to_array(F.col("probability")).getItem(1)
        return model.transform(inputs).withColumn("_p", value).drop("_x", "probability").withColumnRenamed("_p", name)

    def save(self, folder: str) -> None:
        """Trees, columns and bins below ``folder``, in the format of Spark ML, replacing what is there."""
        self.model.write().overwrite().save(f"{folder}/trees")
        spark = SparkSession.active()
        lines = [(i, c, self.edges[i] if self.edges is not None else None) for i, c in enumerate(self.columns)]
        (spark.createDataFrame(lines, "place int, name string, edges array<double>").coalesce(1)
         .write.mode("overwrite").json(f"{folder}/columns"))

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> BoostedScore:
        rows = spark.read.schema("place int, name string, edges array<double>").json(
            f"{folder}/columns").orderBy("place").collect()
        edges = [r["edges"] for r in rows]
        return cls([r["name"] for r in rows], GBTClassificationModel.load(f"{folder}/trees"),
                   None if None in edges else edges)


def _cells(data: DataFrame, columns: Sequence[str], label: str, rows: int
           ) -> tuple[DataFrame, int, list[list[float]]] | None:
    """Lines (label, bins of the columns, ``_n`` rows) of equally binned rows, their number and the bounds of the bins.

    Boosting sees only the bins of a row, so the lines train the same trees. None where binning
    does not reduce the rows, as over many columns.
    """
    edges = bin_edges(data, columns)
    lines = cut_lineage(binned(data, columns, edges).groupBy(label, *columns).agg(F.count("*").alias("_n")))
    size = lines.count()
    return (lines, size, edges) if size * 4 <= rows else None


def fit_boosted(train: DataFrame, columns: Sequence[str], label: str, trees: int = 50,
                depth: int = 5, step: float = 0.1, balanced: bool = True,
                seed: int = 42) -> BoostedScore:
    """Gradient-boosted trees; ``balanced`` weights positives by negatives / positives.

    More than ``BINNED_ROWS`` rows are binned and counted first, so that the passes of all trees go over
    the cells that occur and not over the rows.
    """
    columns = list(columns)
    counts = metrics.class_balance(train, label).first()
    scale = F.when(F.col(label) == 1, counts["scale_weight"] or 1.0).otherwise(1.0)
    data, rows = train.select(label, *dict.fromkeys(c for c in columns if c != label)), counts["n"]
    options = {"maxIter": trees, "maxDepth": depth, "stepSize": step, "seed": seed}
    found = _cells(data, columns, label, rows) if rows > BINNED_ROWS and label not in columns else None
    if found:
        lines, size, edges = found
        weight = F.col("_n") * scale if balanced else F.col("_n").cast("double")
        data = lines.withColumn("_w", weight).drop("_n").repartition(train.sparkSession.sparkContext.defaultParallelism)
        # so many bins that Spark draws no sample of the cells: every bound is a candidate
        options |= {"weightCol": "_w", "maxBins": max(BINS, int(size ** 0.5) + 1)}
    else:
        edges = None
        if balanced:
            data, options = data.withColumn("_w", scale), options | {"weightCol": "_w"}
        data = spread(data, rows)
    model = GBTClassifier(featuresCol="_x", labelCol=label, **options).fit(assembled(data, columns))
    return BoostedScore(columns, model, edges)


def fold_pairs(df: DataFrame, label: str, key: Sequence[str], time: str | None = None,
               folds: int = 5, seed: int = 42) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(fold, training rows, validation rows): walk-forward with a time column, else stratified.

    Rows are placed once and stored; every fold is a filter on the stored table.
    """
    if time and time in df.columns:
        placed = position(df, [time, *key])
        yield from _walk_pairs(placed, _placed_rows(placed), folds)
    else:
        placed = cut_lineage(splits.stratified_folds(df, label, key, folds, seed, "_fold"))
        for fold in range(folds):
            own = F.col("_fold") == fold
            yield fold, placed.where(~own).drop("_fold"), placed.where(own).drop("_fold")


def _placed_rows(placed: DataFrame) -> int:
    return int(placed.agg(F.max("position_total")).first()[0] or 0)


def _walk_pairs(placed: DataFrame, n: int, folds: int) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """Walk-forward pairs of the first ``n`` rows of a table with positions."""
    rows, place = placed.drop("position_total"), F.col("position")
    for b in splits.walk_forward_bounds(n, folds):
        yield (b["fold"], rows.where(place < b["train_end"]).drop("position"),
               rows.where((place >= b["valid_start"]) & (place < b["valid_end"])).drop("position"))


def _scored_pairs(pairs: Iterator[tuple[int, DataFrame, DataFrame]], fit: Callable[[DataFrame], Scorer]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        fit(train)(valid).withColumn("fold", F.lit(fold)) for fold, train, valid in pairs])


def out_of_fold(df: DataFrame, fit: Callable[[DataFrame], Scorer], label: str,
                key: Sequence[str], time: str | None = None, folds: int = 5,
                seed: int = 42) -> DataFrame:
    """Scores from models that did not see the row, with the fold. Rows that no fold
    validates have no score and are not returned."""
    return _scored_pairs(fold_pairs(df, label, key, time, folds, seed), fit)


def linear_fitter(columns: Sequence[str], label: str, c: float = 1.0
                  ) -> Callable[[DataFrame], Scorer]:
    return lambda train: fit_scorecard_model(train, columns, label, c).score


def boosted_fitter(columns: Sequence[str], label: str, **options) -> Callable[[DataFrame], Scorer]:
    return lambda train: fit_boosted(train, columns, label, **options)


def scorecard_report(df: DataFrame, columns: Sequence[str], label: str, key: Sequence[str],
                     folds: int = 10, share: float = 0.2, time: str | None = None) -> DataFrame:
    """Metrics per CV fold and for a holdout, one row each.

    With a ``time`` column the folds walk forward and the holdout is the latest ``share`` of the rows; without
    one, both are stratified.
    """
    if time and time in df.columns:
        placed = position(df, [time, *key])
        last = F.col("position") >= F.col("position_total") * (1 - share)
        parts = placed.withColumn("is_test", last).drop("position", "position_total")
    else:
        parts = cut_lineage(splits.stratified_holdout(df, label, key, share))
    train, test = parts.where(~F.col("is_test")).drop("is_test"), parts.where("is_test").drop("is_test")
    cv = out_of_fold(train, linear_fitter(columns, label), label, key, time, folds)
    scored = fit_scorecard_model(train, columns, label).score(test)
    per_fold = cv.select(F.concat(F.lit("fold_"), F.col("fold")).alias("part"), label, "score")
    held = scored.select(F.lit("holdout").alias("part"), label, "score")
    return metrics.metric_suite(per_fold.unionByName(held), label, "score", ["part"])


# ---- calibration ----------------------------------------------------------------------

def fit_platt(df: DataFrame, label: str, score: str = "score") -> tuple[float, float]:
    """Slope and intercept of a one-feature logistic regression on the score."""
    model = LogisticRegression(featuresCol="_x", labelCol=label).fit(assembled(df, [score]))
    return float(model.coefficients[0]), float(model.intercept)


def apply_platt(score: Column, fitted: tuple[float, float]) -> Column:
    return 1.0 / (1.0 + F.exp(-(fitted[0] * score + fitted[1])))


def fit_isotonic(df: DataFrame, label: str, score: str = "score"):
    """Isotonic regression on event rates per score, weighted by the rows that have it.

    The fit pools violating blocks inside range partitions before the blocks of all partitions meet.
    """
    lines = df.groupBy(F.col(score).cast("double").alias("_s")).agg(
        F.avg(F.col(label).cast("double")).alias("_y"), F.count("*").cast("double").alias("_n"))
    return IsotonicRegression(featuresCol="_s", labelCol="_y", weightCol="_n").fit(lines)


def apply_isotonic(df: DataFrame, model, score: str = "score", name: str = "calibrated") -> DataFrame:
    return model.setFeaturesCol(score).setPredictionCol(name).transform(df)


def calibration_report(train: DataFrame, test: DataFrame, label: str, key: Sequence[str],
                       score: str = "score", share: float = 0.3) -> DataFrame:
    """Metrics of raw, Platt and isotonic scores on the test rows, fitted on a slice of train."""
    part = splits.stratified_holdout(train, label, key, share, name="_calib").where("_calib")
    platt, isotonic = fit_platt(part, label, score), fit_isotonic(part, label, score)
    wide = apply_isotonic(test.withColumn("platt", apply_platt(F.col(score), platt)),
                          isotonic, score, "isotonic")
    long = wide.select(label, F.col(score).alias("raw"), "platt", "isotonic").unpivot(
        [label], ["raw", "platt", "isotonic"], "method", "score")
    return metrics.metric_suite(long, label, "score", ["method"])


# ---- imputation -----------------------------------------------------------------------

# Scores never used to predict another score.
_SCORES = ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")


def fit_imputer(df: DataFrame, target: str, columns: Sequence[str], linear: bool = False,
                trees: int = 50, seed: int = 42):
    """Regressor for a score, fitted on rows where it is observed."""
    inputs = [c for c in columns if c != target and c not in _SCORES]
    known = df.where(F.col(target).isNotNull() & (F.col(target) != MISSING))
    kind = (LinearRegression(featuresCol="_x", labelCol=target) if linear else
            GBTRegressor(featuresCol="_x", labelCol=target, maxIter=trees, seed=seed))
    return kind.fit(assembled(known, inputs)), inputs


def apply_imputer(df: DataFrame, target: str, fitted) -> DataFrame:
    """Missing values replaced by predictions; ``<target>_MISSING_FLAG`` tells which."""
    model, inputs = fitted
    absent = F.col(target).isNull() | (F.col(target) == MISSING)
    return (model.setPredictionCol("_guess").transform(assembled(df, inputs))
            .withColumn(f"{target}_MISSING_FLAG", absent.cast("int"))
            .withColumn(target, F.when(absent, F.col("_guess")).otherwise(F.col(target)))
            .drop("_x", "_guess"))


def imputer_correlation(df: DataFrame, target: str, columns: Sequence[str], label: str,
                        key: Sequence[str], linear: bool = False, trees: int = 50) -> float:
    """Correlation of predicted and observed values on a held-out fifth."""
    known = df.where(F.col(target).isNotNull() & (F.col(target) != MISSING))
    parts = cut_lineage(splits.stratified_holdout(known, label, key))
    model, inputs = fit_imputer(parts.where(~F.col("is_test")), target, columns, linear, trees)
    guess = model.setPredictionCol("_guess").transform(
        assembled(parts.where("is_test"), inputs))
    a, b = F.col("_guess"), F.col(target)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return guess.agg(F.when(spread > 0, F.covar_pop(a, b) / spread)).first()[0] or 0.0


# ---- blending -------------------------------------------------------------------------

def blend_mean(df: DataFrame, scores: Sequence[str], name: str = "blend") -> DataFrame:
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.col(s) for s in scores])
                         / len(scores))


def fit_logistic_stack(df: DataFrame, scores: Sequence[str], label: str, counts: str | None = None) -> LinearScore:
    """Logistic regression on out-of-fold scores; rows without a full set are left out."""
    return fit_scorecard_model(df.dropna(subset=list(scores)), scores, label, counts=counts)


class RidgeScore:
    """Linear score clipped to [0, 1], with the penalty it was fitted with."""

    def __init__(self, columns: list[str], weights: list[float], base: float, penalty: float):
        self.columns, self.weights, self.base, self.penalty = columns, weights, base, penalty

    def raw(self) -> Column:
        return reduce(lambda a, b: a + b, [w * F.col(c) for w, c in zip(self.weights, self.columns)], F.lit(self.base))

    def __call__(self, frame: DataFrame, name: str = "score") -> DataFrame:
        return frame.withColumn(name, F.greatest(F.least(self.raw(), F.lit(1.0)), F.lit(0.0)))


def _gram(df: DataFrame, columns: Sequence[str], label: str, folds: int, seed: int) -> np.ndarray:
    """Sums of products of (1, columns, label) per fold, from one pass; folds go by a hash of the values."""
    values = [F.lit(1.0), *[F.col(c).cast("double") for c in columns], F.col(label).cast("double")]
    fold = F.pmod(F.xxhash64(*values, F.lit(seed)), F.lit(folds))
    size = len(values)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = df.select(fold.alias("_f"), *[v.alias(f"_v{i}") for i, v in enumerate(values)]).groupBy("_f").agg(
        *[F.sum(F.col(f"_v{i}") * F.col(f"_v{j}")).alias(f"_s{i}_{j}") for i, j in pairs])
    out = np.zeros((folds, size, size))
    for row in sums.collect():
        for i, j in pairs:
            out[row["_f"], i, j] = out[row["_f"], j, i] = row[f"_s{i}_{j}"]
    return out


def _ridge(gram: np.ndarray, penalty: float) -> np.ndarray:
    """Base and weights that minimise half the mean squared error plus half the penalty times the squared weights."""
    left = gram[:-1, :-1] / max(gram[0, 0], 1.0)
    left = left + penalty * np.diag([0.0] + [1.0] * (len(left) - 1))
    return np.linalg.lstsq(left, gram[:-1, -1] / max(gram[0, 0], 1.0), rcond=None)[0]


def fit_ridge_stack(df: DataFrame, scores: Sequence[str], label: str,
                    penalties: Sequence[float] = (0.01, 0.1, 1.0, 10.0), folds: int = 5,
                    seed: int = 42) -> RidgeScore:
    """Ridge on the scores with the penalty chosen by cross-validation; output clipped to [0, 1].

    One pass sums the products per fold; each fit without a fold is the total minus that fold's sums.
    """
    grams = _gram(df.dropna(subset=list(scores)), scores, label, folds, seed)
    total = grams.sum(axis=0)
    rows = max(total[0, 0], 1.0)

    def loss(penalty: float) -> float:
        out = 0.0
        for gram in grams:
            wrong = np.append(_ridge(total - gram, penalty / rows), -1.0)
            out += wrong @ gram @ wrong
        return out

    best = min(penalties, key=loss)
    fitted = _ridge(total, best / rows)
    return RidgeScore(list(scores), [float(w) for w in fitted[1:]], float(fitted[0]), best / rows)


def calibrated_stack(df: DataFrame, scores: Sequence[str], label: str, key: Sequence[str],
                     time: str | None = None, folds: int = 5) -> DataFrame:
    """Scores calibrated fold by fold on the other folds, then ridge-stacked."""
    parts = []
    for fold, train, valid in fold_pairs(df, label, key, time, folds):
        fitted = {s: fit_platt(train, label, s) for s in scores}
        parts.append(valid.withColumns({s: apply_platt(F.col(s), fitted[s]) for s in scores})
                     .withColumn("fold", F.lit(fold)))
    calibrated = cut_lineage(reduce(DataFrame.unionByName, parts))
    return fit_ridge_stack(calibrated, scores, label)(calibrated)


def subset_ablation(df: DataFrame, scores: Sequence[str], label: str,
                    smallest: int = 2) -> DataFrame:
    """Metrics of every subset of scores, averaged and logistically stacked.

    Rows of equal scores and label meet in one line, written once; fits and metrics weight it by their number.
    """
    lines = cut_lineage(df.groupBy(label, *scores).agg(F.count("*").alias("_n")))
    columns: dict[str, Column] = {}
    for size in range(smallest, len(scores) + 1):
        for subset in combinations(scores, size):
            tag = "+".join(subset)
            columns[f"average:{tag}"] = reduce(lambda a, b: a + b, map(F.col, subset)) / size
            columns[f"logistic:{tag}"] = fit_logistic_stack(lines, subset, label, "_n").probability()
    wide = lines.select(label, "_n", *[v.alias(n) for n, v in columns.items()])
    return metrics.metric_suite(wide.unpivot([label, "_n"], list(columns), "variant", "score"),
                                label, "score", ["variant"], "_n")


def imbalance_report(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str,
                     key: Sequence[str], folds: int = 3, time: str | None = None, **options) -> DataFrame:
    """Unweighted model with a tuned threshold against a class-weighted one at 0.5.

    The threshold is the mean of the best thresholds over validation folds, which walk forward if there is a
    ``time`` column and are stratified otherwise.
    """
    plain = boosted_fitter(columns, label, balanced=False, **options)
    cv = out_of_fold(train, plain, label, key, time, folds)
    tuned = metrics.best_threshold(
        metrics.score_curve(cv, label, "score", ["fold"]), ["fold"]).agg(
        F.avg("threshold")).first()[0]
    weighted = fit_boosted(train, columns, label, balanced=True, **options)
    rows = plain(train)(test).select(
        F.lit("tuned_threshold").alias("strategy"), F.lit(float(tuned)).alias("threshold"),
        label, "score").unionByName(weighted(test).select(
            F.lit("class_weight").alias("strategy"), F.lit(0.5).alias("threshold"),
            label, "score"))
    rows = cut_lineage(rows)
    group = ["strategy"]
    at = metrics.threshold_metrics(rows, F.col("threshold"), label, "score", group)
    suite = metrics.metric_suite(rows, label, "score", group)
    return suite.select("strategy", "auc", "gini", "ks").join(
        at.select("strategy", "macro_f1", "precision", "recall"), "strategy")


# ---- reports --------------------------------------------------------------------------

def shift_report(train: DataFrame, test: DataFrame, columns: Sequence[str], key: Sequence[str],
                 folds: int = 5, top: int = 10, trees: int = 20) -> DataFrame:
    """How well a classifier tells test rows from training rows, with the most telling columns."""
    if set(train.columns) != set(test.columns):
        raise ValueError("train and test must have the same columns")
    both = cut_lineage(train.withColumn("origin", F.lit(0)).unionByName(
        test.withColumn("origin", F.lit(1))))
    fitter = boosted_fitter(columns, "origin", trees=trees, balanced=False)
    cv = out_of_fold(both, fitter, "origin", [*key, "origin"], folds=folds)
    auc = metrics.metric_suite(cv, "origin", "score", ["fold"]).agg(F.avg("auc")).first()[0]
    # Verdict bounds.
    verdict = "safe" if auc < 0.55 else "investigate" if auc < 0.65 else "problematic"
    weights = fitter(both).importances
    shifted = sorted(weights, key=lambda c: (-weights[c], c))[:top]
    sizes = both.groupBy("origin").count().collect()
    n = {r["origin"]: r["count"] for r in sizes}
    return both.sparkSession.createDataFrame(
        [(float(auc), verdict, n.get(0, 0), n.get(1, 0), shifted)],
        "auc double, verdict string, n_train long, n_test long, shifted_features array<string>")


def learning_curve(df: DataFrame, fit: Callable[[DataFrame], Scorer], label: str,
                   key: Sequence[str], time: str, shares: Sequence[float] = (0.5, 0.75, 1.0),
                   folds: int = 5, saturation: float = 0.005) -> DataFrame:
    """Out-of-fold Gini on growing leading shares of the time-ordered rows, which are placed once."""
    placed = position(df, [time, *key])
    n = _placed_rows(placed)
    rows, before = [], None
    for share in shares:
        size = int(n * share + 1e-9)
        # the first rows of the order keep their positions
        value = metrics.gini(_scored_pairs(_walk_pairs(placed, size, folds), fit), label)
        rows.append((float(share), size, value, None if before is None else value - before,
                     None if before is None else value - before < saturation))
        before = value
    return df.sparkSession.createDataFrame(
        rows, "share double, n long, gini double, gain double, saturated boolean")
