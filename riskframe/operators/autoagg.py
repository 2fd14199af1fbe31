"""Automatic aggregation over the table graph.

Definitions are plain data: which child, which function, which column. They generate
one ``groupBy().agg`` per relation, can be stored as JSON, and replay on other tables.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import clip, fill, null_to_sentinel
from riskframe.operators import history
from riskframe.sources.schema import KEY, LEAKY_SOURCES, RELATIONS, TARGET, Relation

PRIMITIVES = ("count", "mean", "sum", "std", "num_unique")
_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


@dataclass(frozen=True)
class Feature:
    """``fn`` over a child column, grouped by the relation key. COUNT has no column."""

    child: str
    key: str
    fn: str
    column: str = ""

    @property
    def name(self) -> str:
        return f"{self.fn}__{self.child}__{self.column}".rstrip("_")

    @property
    def display(self) -> str:
        inner = f"{self.child}.{self.column}" if self.column else self.child
        return f"{self.fn.upper()}({inner})"

    def expression(self) -> Column:
        value = F.col(self.column) if self.column else None
        built = {"count": lambda: F.count("*"), "mean": lambda: F.avg(value),
                 "sum": lambda: F.sum(value).cast("double"), "std": lambda: F.stddev_samp(value),
                 "num_unique": lambda: F.size(F.collect_set(value)).cast("bigint")}[self.fn]()
        return built.alias(self.name, metadata={"display": self.display})


def leaf(feature: Feature) -> tuple[str, str]:
    """Child and column that a feature reads in the end; nested columns are named after their own feature."""
    parts = feature.column.split("__")
    return (parts[-2], parts[-1]) if len(parts) > 2 else (feature.child, feature.column)


def is_leaky(feature: Feature) -> bool:
    """Whether it aggregates, at any depth, a column that looks past the application date."""
    return leaf(feature) in LEAKY_SOURCES


def entity_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables restricted to months before the application, with the derived child columns.

    One loader for fitting and for replay, so both see the same rows. Children of
    unknown parents need no filter here: aggregates are joined from the parent side, so
    those rows shrink to partial sums before any shuffle and never reach the result.
    """
    kept = dict(tables)
    kept["application"] = tables["application"].drop(TARGET)
    for name in ("pos_cash", "credit_card"):
        kept[name] = tables[name].where(F.col("MONTHS_BALANCE") < 0)
    late = history.past_loan_delinquency(tables["bureau_balance"])
    kept["bureau"] = (tables["bureau"].join(late, "SK_ID_BUREAU", "left")
                      .fillna(0.0, ["bb_dpd_mean", "bb_dpd_max"]))
    kept["installments"] = tables["installments"].withColumns({
        "days_late": history.days_late(),
        "payment_diff": F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT")})
    return kept


def define(tables: dict[str, DataFrame], parent: str = "application",
           primitives: tuple[str, ...] = PRIMITIVES,
           relations: list[Relation] = tuple(RELATIONS)) -> list[Feature]:
    """Every primitive of every usable child column. Keys are never aggregated."""
    out: list[Feature] = []
    keys = {r.key for r in relations} | {TARGET}
    for relation in relations:
        if relation.parent != parent or relation.child not in tables:
            continue
        types = {c: t for c, t in tables[relation.child].dtypes if c not in keys}
        child = (relation.child, relation.key)
        if "count" in primitives:
            out.append(Feature(*child, "count"))
        for fn in ("mean", "sum", "std"):
            if fn in primitives:
                out += [Feature(*child, fn, c) for c, t in types.items() if t in _NUMERIC]
        if "num_unique" in primitives:
            out += [Feature(*child, "num_unique", c) for c, t in types.items() if t == "string"]
    return out


def build(tables: dict[str, DataFrame], features: list[Feature],
          parent: str = "application", own: bool = False) -> DataFrame:
    """Parent keys with all features; one aggregate and one left join per child.

    ``own`` keeps the parent's numeric columns. Text columns are categories, so the set of a group's
    values is small; counting sets spares the copy of every row per text column that several
    distinct counts would need.
    """
    groups: dict[tuple[str, str], list[Feature]] = {}
    for f in features:
        groups.setdefault((f.child, f.key), []).append(f)
    keys = list(dict.fromkeys(key for _, key in groups)) or [KEY]
    numbers = [c for c, t in tables[parent].dtypes if t in _NUMERIC and c not in keys] if own else []
    out = tables[parent].select(*keys, *numbers)
    for (child, key), wanted in groups.items():
        out = out.join(tables[child].groupBy(key).agg(*[f.expression() for f in wanted]),
                       key, "left")
    return out


def deepen(tables: dict[str, DataFrame], depth: int,
           primitives: tuple[str, ...] = PRIMITIVES) -> dict[str, DataFrame]:
    """Tables whose rows also carry the aggregates of their own children, for depth above 1."""
    if depth <= 1:
        return tables
    inner = deepen(tables, depth - 1, primitives)
    out = dict(tables)
    for parent in ("bureau", "previous_application"):
        wanted = define(inner, parent, primitives)
        key = "SK_ID_BUREAU" if parent == "bureau" else "SK_ID_PREV"
        if wanted:
            out[parent] = tables[parent].join(
                build(inner, wanted, parent).dropDuplicates([key]), key, "left")
    return out


def auto_features(tables: dict[str, DataFrame], depth: int = 1,
                  primitives: tuple[str, ...] = PRIMITIVES) -> tuple[DataFrame, list[Feature]]:
    """Feature matrix keyed by applicant with missing values as sentinel, and its definitions."""
    entities = deepen(entity_tables(tables), depth, primitives)
    features = define(entities, "application", primitives)
    recent = history.recent_payments(entities["installments"])
    matrix = build(entities, features, own=True).join(recent, KEY, "left")
    return null_to_sentinel(matrix, [c for c in matrix.columns if c != KEY]), features


def replay(tables: dict[str, DataFrame], features: list[Feature], depth: int = 1,
           columns: list[str] | None = None) -> DataFrame:
    """The stored definitions over other tables, optionally cut to the stored columns."""
    primitives = tuple(dict.fromkeys(f.fn for f in features)) or PRIMITIVES
    entities = deepen(entity_tables(tables), depth, primitives)
    recent = history.recent_payments(entities["installments"])
    matrix = build(entities, features, own=True).join(recent, KEY, "left")
    filled = null_to_sentinel(matrix, [c for c in matrix.columns if c != KEY])
    return filled if columns is None else filled.select(KEY, *columns)


def to_json(features: list[Feature]) -> str:
    return json.dumps([asdict(f) for f in features])


def from_json(text: str) -> list[Feature]:
    return [Feature(**f) for f in json.loads(text)]


def display_names(features: list[Feature]) -> dict[str, str]:
    return {f.name: f.display for f in features}
