"""Profiling queries over the joined frame."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import clip, flag, ratio
from riskframe.operators.binning import bin_number
from riskframe.operators.prefix import exact_quantiles, wide_quantiles
from riskframe.operators.selection import column_variances, correlation_matrix
from riskframe.operators.wide import PLACE, long_values, with_feature
from riskframe.plans.training import missing_counts


def source_coverage(df: DataFrame, counts: dict[str, str]) -> DataFrame:
    """Applicants with records, their share and the record total per source."""
    def line(name: str, covered: Column, records: Column) -> Column:
        return F.struct(F.lit(name).alias("source"), covered.alias("applicants"),
                        (covered * 100.0 / F.count("*")).alias("share"),
                        records.cast("long").alias("n_records"))

    lines = [line("application", F.count("*"), F.count("*"))]
    lines += [line(name, F.count_if(F.col(c) > 0), F.sum(c)) for name, c in counts.items()]
    return df.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


def target_balance(df: DataFrame, target: str) -> DataFrame:
    total = df.count()
    return df.groupBy(target).agg(F.count("*").alias("n"),
                                  (F.count("*") / F.lit(total)).alias("share"))


def missing_top(df: DataFrame, n: int = 40) -> DataFrame:
    """Columns with the highest missing rate."""
    return missing_counts(df).where("n_null > 0").orderBy(
        F.desc("missing_rate"), "column").limit(n)


def sentinel_rates(df: DataFrame, column: str, sentinel: float, target: str) -> DataFrame:
    hit = F.col(column) == sentinel
    return df.agg(F.count("*").alias("n_rows"), F.count_if(hit).alias("n_sentinel"),
                  F.avg(flag(hit)).alias("share"),
                  F.avg(F.when(hit, F.col(target))).alias("rate_sentinel"),
                  F.avg(F.when(~hit, F.col(target))).alias("rate_other"))


def band(value: Column, bounds: list[float], labels: list[str]) -> Column:
    """Right-closed band label; NULL outside the bounds."""
    out = F.when((value <= bounds[0]) | (value > bounds[-1]) | value.isNull(), None)
    for upper, label in zip(bounds[1:], labels):
        out = out.when(value <= upper, label)
    return out


def band_rates(df: DataFrame, column: str, bounds: list[float], labels: list[str],
               target: str) -> DataFrame:
    return (df.select(band(F.col(column), bounds, labels).alias("band"), target)
            .where("band IS NOT NULL").groupBy("band")
            .agg(F.count("*").alias("n"), F.avg(target).alias("rate")))


def class_histogram(df: DataFrame, target: str, column: str, bins: int = 40,
                    cap: float = 0.99) -> DataFrame:
    """Counts per class and equal-width bin, values capped at a percentile."""
    limit = exact_quantiles(df.select(column), column, [cap]).first()["quantile"]
    capped = df.select(target, F.least(F.col(column), F.lit(limit)).alias("x")).where(
        "x IS NOT NULL")
    low, high = capped.agg(F.min("x"), F.max("x")).first()
    place = F.lit(0) if high == low else F.least(
        F.floor((F.col("x") - low) / F.lit(high - low) * bins), F.lit(bins - 1))
    return capped.groupBy(target, place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def top_variance_correlations(df: DataFrame, columns: list[str], n: int = 30) -> DataFrame:
    """Absolute Pearson matrix of the n most varying columns, as pairs."""
    chosen = [r["feature"] for r in column_variances(df, columns, sample=True).orderBy(
        F.desc("variance"), "feature").limit(n).collect()]
    matrix = correlation_matrix(df, chosen)
    rows = [(chosen[i], chosen[j], float(matrix[i, j]))
            for i, j in combinations(range(len(chosen)), 2)]
    return df.sparkSession.createDataFrame(rows, "first string, second string, abs_r double")


def affordability(df: DataFrame) -> DataFrame:
    credit, income = F.col("AMT_CREDIT"), F.col("AMT_INCOME_TOTAL")
    return df.withColumns({
        "ltv": ratio(credit, F.col("AMT_GOODS_PRICE"), otherwise=None, missing=None),
        "service": ratio(F.col("AMT_ANNUITY"), income, otherwise=None, missing=None),
        "income_to_credit": ratio(income, credit, otherwise=None, missing=None)})


def class_medians(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    return wide_quantiles(df, columns, [0.5], [target]).select(
        target, "feature", F.col("quantile").alias("median"))


def _presence(df: DataFrame, counts: dict[str, str], target: str) -> DataFrame:
    """Class counts per combination of presence flags: at most 2^k rows carry all pivots."""
    flags = [flag(F.col(c) > 0).cast("long").alias(name) for name, c in counts.items()]
    return df.groupBy(*flags).agg(F.count("*").alias("_n"), F.sum(target).alias("_y"))


def _rate() -> list[Column]:
    return [F.sum("_n").alias("n"), (F.sum("_y") / F.sum("_n")).alias("rate")]


def presence_rates(df: DataFrame, counts: dict[str, str], target: str) -> DataFrame:
    """Default rate per presence flag, and for applicants without bureau and prior history."""
    cells = _presence(df, counts, target)
    thin = ((F.col("has_bureau") == 0) & (F.col("has_prev") == 0)).cast("long")
    return (cells.withColumn("thin_credit", thin)
            .unpivot(["_n", "_y"], [*counts, "thin_credit"], "flag", "value")
            .groupBy("flag", "value").agg(*_rate()))


def presence_pairs(df: DataFrame, counts: dict[str, str], target: str) -> DataFrame:
    """Default rate of every pair of presence flags."""
    pairs = F.array(*[F.struct(F.lit(a).alias("first_flag"), F.lit(b).alias("second_flag"),
                               F.col(a).alias("first_value"), F.col(b).alias("second_value"))
                      for a, b in combinations(counts, 2)])
    return (_presence(df, counts, target).select("_n", "_y", F.explode(pairs).alias("p"))
            .groupBy("p.first_flag", "p.second_flag", "p.first_value", "p.second_value")
            .agg(*_rate()))


def target_correlations(df: DataFrame, columns: list[str], target: str,
                        min_rows: int = 100) -> DataFrame:
    """Point-biserial correlation with the target, strongest first.

    The quotient is written out because ``corr`` raises for a constant column.
    """
    x = F.col("value")
    y = F.when(x.isNotNull(), F.col("_y"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    found = long_values(df, columns, [F.col(target).cast("double").alias("_y")]).groupBy(
        PLACE).agg(F.count(x).alias("n"), F.when(spread > 0, F.covar_pop(x, y) / spread).alias("r"))
    return with_feature(found, columns).where(F.col("n") > min_rows).orderBy(
        F.desc(F.abs("r")), "feature")


def underpayment_rates(df: DataFrame, target: str) -> DataFrame:
    short = (F.coalesce(F.col("inst_payment_ratio_mean"), F.lit(1.0)) < 0.95) & (
        F.col("inst_late_cnt") > 0)
    return df.groupBy(flag(short).cast("long").alias("underpaid")).agg(
        F.count("*").alias("n"), F.avg(target).alias("rate"))


def age_income_rates(df: DataFrame, target: str) -> DataFrame:
    """Default rate and count by age band and income quintile, incomes above p99 left out."""
    income = F.col("AMT_INCOME_TOTAL")
    cap = exact_quantiles(df.select("AMT_INCOME_TOTAL"), "AMT_INCOME_TOTAL", [0.99]).first()
    kept = df.where(income <= cap["quantile"])
    cuts = exact_quantiles(kept.select("AMT_INCOME_TOTAL"), "AMT_INCOME_TOTAL",
                           [i / 5 for i in range(6)])
    edges = sorted({r["quantile"] for r in cuts.collect()})
    age = clip(-F.col("DAYS_BIRTH") / 365.25, 18.0, 80.0)
    # Age bounds and labels.
    bounds = [18, 25, 30, 35, 40, 50, 65, 80]
    labels = ["18-25", "25-30", "30-35", "35-40", "40-50", "50-65", "65-80"]
    return (kept.select(band(age, bounds, labels).alias("age_band"),
                        (bin_number(income, edges) + 1).cast("long").alias("income_quintile"),
                        target)
            .where("age_band IS NOT NULL").groupBy("age_band", "income_quintile")
            .agg(F.count("*").alias("n"), F.avg(target).alias("rate")))
