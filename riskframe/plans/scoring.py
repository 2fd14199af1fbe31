"""Batch scoring: defaults, the training feature functions, probability, band, top factors."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions import application as app
from riskframe.functions.exprs import fill
from riskframe.operators import models
from riskframe.operators.binning import observed
from riskframe.operators.models import LinearScore
from riskframe.operators.prefix import wide_quantiles
from riskframe.sources.schema import KEY


def fit_defaults(df: DataFrame, columns: list[str], approximate: bool = False) -> dict[str, float]:
    """Median of every column, missing values left out; one number per column."""
    values = df.select(*[observed(c).alias(c) for c in columns])
    rows = wide_quantiles(values, columns, [0.5], approximate=approximate)
    return {r["feature"]: r["quantile"] for r in rows.collect()}


def fill_defaults(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """NULLs and absent columns become the stored default; given values stay."""
    present = set(df.columns)
    return df.withColumns({c: fill(F.col(c).cast("double"), v) if c in present else F.lit(v)
                           for c, v in defaults.items()})


@dataclass
class ScoreBundle:
    """Everything scoring needs, as plain values."""

    defaults: dict[str, float]
    model: LinearScore
    platt: tuple[float, float] | None = None
    version: str = "1"
    factors: int = 5
    labels: dict[str, str] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "ScoreBundle":
        values = json.loads(text)
        values["model"] = LinearScore(**values["model"])
        values["platt"] = tuple(values["platt"]) if values["platt"] else None
        return ScoreBundle(**values)


def request_features(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Defaults first, then the same feature functions that built the training frame."""
    return app.bureau_trend_features(app.secondary_features(app.application_features(
        fill_defaults(df, defaults))))


def _factors(bundle: ScoreBundle) -> Column:
    """The largest contributions of a row, as an ordered array of structs."""
    model = bundle.model
    entries = F.array(*[
        F.struct((-F.abs(model.contribution(i))).alias("size"),
                 F.lit(c).alias("feature"),
                 (F.lit(bundle.labels[c]) if c in bundle.labels else app.column_label(F.lit(c)))
                 .alias("label"),
                 model.contribution(i).alias("contribution"))
        for i, c in enumerate(model.columns)])
    best = F.slice(F.array_sort(entries), 1, bundle.factors)
    return F.transform(best, lambda e, i: F.struct(
        e["feature"].alias("feature"), e["label"].alias("label"),
        e["contribution"].alias("contribution"),
        F.when(e["contribution"] > 0, "increases_risk").otherwise("decreases_risk")
        .alias("direction"),
        (i + 1).alias("rank")))


def score(df: DataFrame, bundle: ScoreBundle, key: str = KEY) -> DataFrame:
    """(key, probability, risk_band, factors, model_version): a projection, no shuffle.

    It works the same on a batch table and on a stream of application rows.
    """
    features = request_features(df, bundle.defaults)
    features = fill_defaults(features, {c: bundle.defaults.get(c, m) for c, m in
                                        zip(bundle.model.columns, bundle.model.means)})
    raw = bundle.model.probability()
    calibrated = models.apply_platt(raw, bundle.platt) if bundle.platt else raw
    scored = features.withColumn("probability", calibrated)
    return scored.select(key, "probability", app.risk_band(F.col("probability")).alias("risk_band"),
                         _factors(bundle).alias("factors"),
                         F.lit(bundle.version).alias("model_version"))


def fit_bundle(frame: DataFrame, raw_columns: list[str], model_columns: list[str], label: str,
               version: str = "1", approximate: bool = False) -> ScoreBundle:
    """Defaults from the frame and a scorecard on features built exactly as at score time."""
    defaults = fit_defaults(frame, raw_columns, approximate)
    features = request_features(frame, defaults)
    model = models.fit_scorecard_model(features.select(label, *model_columns), model_columns, label)
    return ScoreBundle(defaults, model, version=version)
