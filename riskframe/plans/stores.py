"""Feature stores: scorecard, tree, combined, automatic, and their variants."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import application as app
from riskframe.functions.exprs import MISSING, null_to_sentinel
from riskframe.operators import autoagg, history, metrics
from riskframe.operators import binning, selection
from riskframe.operators.binning import WoeModel
from riskframe.plans.training import joined_frame, numeric_columns
from riskframe.session import cut_lineage
from riskframe.sources.schema import KEY, PROTECTED, TARGET, leaky_columns
from riskframe.sources.tables import align_columns


@dataclass
class Store:
    """A lazy feature table with the facts needed to rebuild it elsewhere."""

    frame: DataFrame
    columns: list[str]
    woe: WoeModel | None = None
    definitions: list = field(default_factory=list)


# ---- scorecard ------------------------------------------------------------------------

def fit_scorecard(df: DataFrame, bins: int = 10, min_iv: float = 0.02, correlation: float = 0.90,
                  approximate: bool = False) -> Store:
    """WoE store: IV filter, WoE transform, variance floor, IV-aware correlation pruning."""
    # read three times below: edges, counts, transform
    engineered = cut_lineage(app.application_features(df) if "AMT_CREDIT" in df.columns else df)
    model = binning.fit_woe(engineered, TARGET, numeric_columns(engineered), bins,
                            approximate, min_iv)
    # the transformed table feeds two statistics and the final store
    encoded = cut_lineage(binning.apply_woe(engineered, model, [KEY, TARGET]))
    kept = selection.keep_above_floor(encoded, list(model.iv))
    kept = selection.prune_by_value(encoded, kept, model.iv, correlation) if kept else []
    return Store(encoded.select(KEY, TARGET, *kept), kept, model.keep(kept))


def apply_scorecard(df: DataFrame, store: Store) -> DataFrame:
    engineered = app.application_features(df) if "AMT_CREDIT" in df.columns else df
    keep = [c for c in (KEY, TARGET) if c in engineered.columns]
    return binning.apply_woe(engineered, store.woe, keep)


# ---- tree store -----------------------------------------------------------------------

def history_features(frame: DataFrame, tables: dict[str, DataFrame],
                     legacy_weights: bool = False) -> DataFrame:
    """Windowed and status histories joined to an existing frame, all on the applicant key.

    When the frame is built from the same tables anyway, use
    ``joined_frame(tables, histories=True)``, which needs no further pass.
    """
    inst = history.instalment_features(tables["installments"], legacy_weights)
    parts = [
        inst.select(KEY, *history.LATE_COLUMNS, *history.HABIT_COLUMNS),
        history.status_profile(tables["bureau"], tables["bureau_balance"]),
        history.card_trends(tables["credit_card"], "AMT_CREDIT_LIMIT_ACTUAL"),
        history.rejection_profile(tables["previous_application"]),
    ]
    out = frame
    for part in parts:
        out = out.join(part, KEY, "left")
    return out.fillna({c: v for c, v in history.ABSENT.items() if c in out.columns})


def tree_features(frame: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """All engineered columns without selection; regulated and text columns removed."""
    out = app.application_features(frame) if "AMT_CREDIT" in frame.columns else frame
    out = app.secondary_features(out)
    if tables is not None:
        out = history_features(out, tables)
    out = app.drop_regulated(app.bureau_trend_features(out))
    features = numeric_columns(out)
    keep = [c for c in (KEY, TARGET) if c in out.columns]
    return null_to_sentinel(out.select(*keep, *features), features)


def fit_tree_store(frame: DataFrame, tables: dict[str, DataFrame] | None = None,
                   variance: float = 0.01, correlation: float = 0.95) -> Store:
    """Engineered columns after the variance and correlation filters, protected ones kept."""
    wide = cut_lineage(tree_features(frame, tables), drop_shuffles=True)
    features = numeric_columns(wide)
    protected = [c for c in PROTECTED if c in features]
    kept = selection.keep_varied(wide, features, variance, protected)
    kept = selection.prune_later(wide, kept, correlation, protected)
    return Store(wide.select(KEY, *kept, TARGET), kept)


def tree_store_from_tables(tables: dict[str, DataFrame]) -> Store:
    """Tree store with every history feature, one pass per child table."""
    return fit_tree_store(joined_frame(tables, histories=True))


def apply_tree_store(frame: DataFrame, columns: list[str],
                     tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Score-time rows through the same features, aligned to the stored columns."""
    return align_columns(tree_features(frame, tables), [KEY, *columns])


# ---- automatic store ------------------------------------------------------------------

def fit_auto_store(tables: dict[str, DataFrame], target: DataFrame | None = None,
                   min_iv: float = 0.0, correlation: float = 0.95, depth: int = 1) -> Store:
    """Automatic aggregates after the leakage guard, IV filter and left-to-right pruning."""
    matrix, features = autoagg.auto_features(tables, depth)
    denied = set(leaky_columns())
    leaky = [f.name for f in features if autoagg.is_leaky(f) or {f.display, f.name} & denied]
    matrix = app.repair_suffixes(app.drop_columns(matrix, leaky, ("FLAG_DOCUMENT",)))
    matrix = cut_lineage(matrix)
    names = [c for c in matrix.columns if c != KEY]
    kept = selection.prune_left_to_right(matrix, names, correlation)
    if target is not None and min_iv > 0:
        labelled = matrix.join(target.select(KEY, TARGET), KEY)
        ranking = binning.iv_ranking(binning.woe_table(labelled, TARGET, kept), min_iv)
        strong = {r["feature"] for r in ranking.collect()}
        kept = [c for c in kept if c in strong]
    return Store(matrix.select(KEY, *kept), kept, definitions=features)


# ---- combinations ---------------------------------------------------------------------

def side_by_side(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """Columns of both stores for the shared keys; the left one wins a name clash."""
    extra = [c for c in right.columns if c == key or c not in left.columns]
    return left.join(right.select(*extra), key)


def shared_keys(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    return left.select(key).join(right.select(key), key, "left_semi")


def combined_store(base: DataFrame, imputed: DataFrame, auto: DataFrame | None = None,
                   min_columns: int = 1) -> DataFrame:
    """Base features with the imputed score, optionally the automatic features.

    Raises when a NULL remains or too few columns arrive.
    """
    out = base.drop(*[c for c in imputed.columns if c in base.columns and c != KEY])
    out = side_by_side(out, imputed)
    if auto is not None:
        out = side_by_side(out, auto)
    features = numeric_columns(out)
    if len(features) < min_columns:
        raise ValueError(f"{len(features)} feature columns, expected at least {min_columns}")
    nulls = out.agg(F.sum(sum(F.col(c).isNull().cast("int") for c in features))).first()[0]
    if nulls:
        raise ValueError(f"{nulls} NULL cells in the combined store")
    return out


def extended_store(base: DataFrame, auto: DataFrame, times: DataFrame,
                   correlation: float = 0.90) -> DataFrame:
    """Base store plus the automatic and time features that add something new."""
    base_columns = numeric_columns(base)
    side = side_by_side(auto, times)
    new = [c for c in numeric_columns(side) if c not in base_columns]
    joined = side_by_side(base, side)
    novel = selection.novel_columns(joined, base_columns, new, correlation)
    return joined.select(KEY, *[c for c in base.columns if c != KEY], *novel)


def store_variants(store: DataFrame, source: DataFrame, categoricals: list[str]
                   ) -> dict[str, DataFrame]:
    """Numeric store, store with text columns, and both without regulated columns."""
    with_text = app.attach_categoricals(store, source, categoricals)
    return {"base": store, "categorical": with_text,
            "base_strict": app.drop_regulated(store, strict=True),
            "categorical_strict": app.drop_regulated(with_text, strict=True)}


def commit_decision(scored: DataFrame, label: str, baseline: str, candidate: str,
                    min_gain: float = 0.01) -> dict:
    """Whether a candidate store's scores beat the baseline's by at least ``min_gain`` Gini."""
    both = scored.select(label, baseline, candidate).unpivot(
        [label], [baseline, candidate], "model", "score")
    ginis = {r["model"]: r["gini"] for r in
             metrics.metric_suite(both, label, "score", ["model"]).collect()}
    gain = ginis[candidate] - ginis[baseline]
    return {"baseline_gini": ginis[baseline], "candidate_gini": ginis[candidate], "gain": gain,
            "decision": "commit" if gain >= min_gain else "defer"}


def interaction_candidates(df: DataFrame, importance: dict[str, float], top: int,
                           min_iv: float = 0.02) -> DataFrame:
    """IV of all pair products of the most important features, all pairs in one pass."""
    best = sorted((c for c in importance if c in df.columns),
                  key=lambda c: (-importance[c], c))[:top]
    pairs = [(a, b) for i, a in enumerate(best) for b in best[i + 1:]]
    products = app.pair_products(df, pairs)
    names = [f"{a}_x_{b}" for a, b in pairs]
    table = binning.woe_table(products.select(TARGET, *names), TARGET, names)
    return binning.iv_ranking(table, min_iv)
