"""Quantile bins, weight of evidence and information value for many columns at once.

A bin is an integer: bin i holds values in (edge[i], edge[i+1]], the lowest edge
included. Missing values have their own bin. All columns share one pass: bin numbers
are computed side by side, unpivoted, and counted with partial aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.functions.exprs import MISSING
from riskframe.operators.prefix import wide_quantiles
from riskframe.operators.wide import PLACE, long_values

WOE_CLIP = 5.0
MISSING_BIN = -1


@dataclass
class WoeModel:
    """Fitted bins. ``edges[f]`` has one more entry than ``woe[f]``; ``missing[f]`` may lack f."""

    edges: dict[str, list[float]] = field(default_factory=dict)
    woe: dict[str, list[float]] = field(default_factory=dict)
    missing: dict[str, float] = field(default_factory=dict)
    iv: dict[str, float] = field(default_factory=dict)

    def keep(self, names: list[str]) -> "WoeModel":
        return WoeModel(*[{n: part[n] for n in names if n in part}
                          for part in (self.edges, self.woe, self.missing, self.iv)])

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """Long table (feature, bin, lo, hi, woe, is_missing)."""
        rows = [(f, i, e[i], e[i + 1] if len(e) > 1 else e[i], w, False)
                for f, e in self.edges.items() for i, w in enumerate(self.woe[f])]
        rows += [(f, MISSING_BIN, None, None, w, True) for f, w in self.missing.items()]
        return spark.createDataFrame(
            rows, "feature string, bin int, lo double, hi double, woe double, is_missing boolean")


def observed(name: str) -> Column:
    """The value as double, with sentinel and NaN as NULL."""
    value = F.col(name).cast("double")
    return F.when((value != MISSING) & ~F.isnan(value), value)


def quantile_edges(df: DataFrame, columns: list[str], bins: int = 10,
                   approximate: bool = False) -> dict[str, list[float]]:
    """Distinct quantile edges per column. The result holds at most bins + 1 numbers each.

    ``approximate`` trades exact edges for a sketch; use it beyond about 10 million rows.
    """
    values = df.select(*[observed(c).alias(c) for c in columns])
    probs = [i / bins for i in range(bins + 1)]
    rows = wide_quantiles(values, columns, probs, approximate=approximate)
    edges: dict[str, set[float]] = {}
    for row in rows.where("quantile IS NOT NULL").collect():
        edges.setdefault(row["feature"], set()).add(row["quantile"])
    return {c: sorted(edges[c]) for c in columns if c in edges}


def bin_number(value: Column, edges: list[float]) -> Column:
    """Bin of a value: how many inner edges lie below it. NULL goes to the missing bin."""
    inner = edges[1:-1]
    below = F.lit(0)
    for edge in inner:
        below = below + (value > edge).cast("int")
    return F.when(value.isNull(), MISSING_BIN).otherwise(below)


def bin_counts(df: DataFrame, target: str, edges: dict[str, list[float]],
               columns: list[str]) -> DataFrame:
    """Events and non-events per (feature, bin).

    Values in long form meet their edges in a broadcast join. The edge table has
    one row per column, so its size depends on the schema, not on the data. One short
    expression then bins every column, where a projection per column would generate
    methods too large for the JIT.
    """
    width = max((len(e) for e in edges.values()), default=2) - 2
    names = [f"_e{i}" for i in range(max(width, 0))]
    inner = [(i, c, *edges.get(c, [])[1:-1]) for i, c in enumerate(columns)]
    rows = [r + (None,) * (2 + len(names) - len(r)) for r in inner]
    table = df.sparkSession.createDataFrame(
        rows, ", ".join(["_f int", "feature string", *[f"{n} double" for n in names]]))
    long = long_values(df, [observed(c) for c in columns], [F.col(target).alias("_y")]).join(
        F.broadcast(table), F.col(PLACE) == F.col("_f"))
    below = F.lit(0)
    for n in names:
        below = below + F.coalesce((F.col("value") > F.col(n)).cast("int"), F.lit(0))
    place = F.when(F.col("value").isNull(), MISSING_BIN).otherwise(below)
    return long.groupBy("feature", place.alias("bin")).agg(
        F.count_if(F.col("_y") == 1).alias("event_count"),
        F.count_if(F.col("_y") == 0).alias("non_event_count"))


def add_woe(counts: DataFrame, constant: list[str] = ()) -> DataFrame:
    """WoE = ln(non-event share / event share), clipped; IV part per bin.

    Features with one class, and the named constant ones without a second bin, carry no
    information and are left out. The windows see one row per bin.
    """
    feature = Window.partitionBy("feature")
    events, others = F.col("event_count"), F.col("non_event_count")
    share_e, share_n = events / F.col("_e"), others / F.col("_n")
    odds = F.when(events == 0, WOE_CLIP).when(others == 0, -WOE_CLIP).otherwise(
        F.greatest(F.least(F.ln(share_n / share_e), F.lit(WOE_CLIP)), F.lit(-WOE_CLIP)))
    return (counts
            .withColumns({"_e": F.sum(events).over(feature), "_n": F.sum(others).over(feature),
                          "_bins": F.count("*").over(feature)})
            .where((F.col("_e") > 0) & (F.col("_n") > 0)
                   & ((F.col("_bins") > 1) | ~F.col("feature").isin(list(constant))))
            .withColumn("woe", odds)
            .withColumn("iv_contrib", (share_n - share_e) * F.col("woe"))
            .drop("_e", "_n", "_bins"))


def woe_table(df: DataFrame, target: str, columns: list[str], bins: int = 10,
              approximate: bool = False,
              edges: dict[str, list[float]] | None = None) -> DataFrame:
    """Binning table (feature, bin, event_count, non_event_count, woe, iv_contrib)."""
    found = quantile_edges(df, columns, bins, approximate) if edges is None else edges
    constant = [c for c in columns if len(found.get(c, [])) <= 1]
    return add_woe(bin_counts(df, target, found, columns), constant)


def iv_ranking(table: DataFrame, min_iv: float | None = None) -> DataFrame:
    """Information value per feature with its strength label, strongest first."""
    iv = F.col("iv")
    # Strength bounds and labels.
    strength = (F.when(iv >= 0.5, "very strong").when(iv >= 0.3, "strong")
                .when(iv >= 0.1, "medium").when(iv >= 0.02, "weak").otherwise("useless"))
    ranked = table.groupBy("feature").agg(F.sum("iv_contrib").alias("iv"))
    if min_iv is not None:
        ranked = ranked.where(iv >= min_iv)
    return ranked.withColumn("strength", strength).orderBy(iv.desc(), "feature")


def filter_by_iv(df: DataFrame, target: str, columns: list[str], min_iv: float = 0.02,
                 bins: int = 10, approximate: bool = False) -> tuple[DataFrame, dict[str, float]]:
    """The frame without columns of too little information value, and the values kept."""
    table = woe_table(df, target, columns, bins, approximate)
    kept = {r["feature"]: r["iv"] for r in iv_ranking(table, min_iv).collect()}
    return df.drop(*[c for c in columns if c not in kept]), kept


def fit_woe(df: DataFrame, target: str, columns: list[str], bins: int = 10,
            approximate: bool = False, min_iv: float | None = None) -> WoeModel:
    """Fit bins and WoE for all columns in one counting job."""
    edges = quantile_edges(df, columns, bins, approximate)
    rows = woe_table(df, target, columns, bins, edges=edges).collect()
    model = WoeModel()
    by_feature: dict[str, dict[int, tuple[float, float]]] = {}
    for r in rows:
        by_feature.setdefault(r["feature"], {})[r["bin"]] = (r["woe"], r["iv_contrib"])
    for name in columns:
        found = by_feature.get(name)
        if not found:
            continue
        iv = sum(part for _, part in found.values())
        if min_iv is not None and iv < min_iv:
            continue
        model.iv[name] = iv
        if MISSING_BIN in found:
            model.missing[name] = found[MISSING_BIN][0]
        n_bins = max(len(edges.get(name, [])) - 1, 0)
        if n_bins:
            model.edges[name] = [edges[name][0] - 1e-9, *edges[name][1:]]
            model.woe[name] = [found.get(i, (MISSING, 0.0))[0] for i in range(n_bins)]
    return model


def woe_value(name: str, model: WoeModel) -> Column:
    """WoE of a value. Outside the fitted range, or missing without a missing bin: sentinel."""
    value = observed(name)
    edges, woe = model.edges.get(name), model.woe.get(name, [])
    out = F.when(value.isNull(), F.lit(model.missing.get(name, MISSING)))
    if edges:
        out = out.when((value < edges[0]) | (value > edges[-1]), MISSING)
        for i, w in enumerate(woe):
            out = out.when(value <= edges[i + 1], F.lit(w))
    return out.otherwise(MISSING)


def apply_woe(df: DataFrame, model: WoeModel, keep: list[str] = ()) -> DataFrame:
    """Replace each fitted column by its WoE; a plain projection, no join."""
    return df.select(*keep, *[woe_value(c, model).alias(c) for c in model.iv])


def categorical_woe(df: DataFrame, target: str, columns: list[str],
                    smoothing: float = 0.5) -> DataFrame:
    """Smoothed WoE per category of each text column, rows with NULL left out."""
    long = df.select(F.col(target).alias("_y"), *columns).unpivot(
        ["_y"], columns, "feature", "category")
    events, others = df.agg(F.count_if(F.col(target) == 1),
                            F.count_if(F.col(target) == 0)).first()
    counts = long.where("category IS NOT NULL").groupBy("feature", "category").agg(
        F.count_if(F.col("_y") == 1).alias("event_count"),
        F.count_if(F.col("_y") == 0).alias("non_event_count"))
    sizes = counts.groupBy("feature").agg(F.count("*").alias("_k"))
    event = (F.col("event_count") + smoothing) / (events + smoothing * F.col("_k"))
    other = (F.col("non_event_count") + smoothing) / (others + smoothing * F.col("_k"))
    return (counts.join(sizes, "feature")
            .withColumn("woe", F.ln(other / event))
            .withColumn("iv_contrib", (other - event) * F.col("woe"))
            .select("feature", "category", "event_count", "non_event_count", "woe",
                    "iv_contrib"))
