"""Holdouts, folds and samples.

Time order comes from :func:`position`. Random choices are ordered by a seeded hash of
the row key, so the same rows are chosen on any number of partitions and after any
executor loss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.prefix import hash_chunk, hash_key, position, prefix_sums


def shuffled(df: DataFrame, key: Sequence[str], seed: int = 42, group: Sequence[str] = (),
             name: str = "position") -> DataFrame:
    """Position of each row in a seeded random order within its group."""
    keyed = df.withColumn("_h", hash_key(key, seed))
    return position(keyed, ["_h", *key], name, group, hash_chunk("_h")).drop("_h")


def out_of_time(df: DataFrame, time: str, key: Sequence[str], share: float = 0.2,
                seed: int = 42) -> DataFrame:
    """Add ``is_oot``: the latest share of rows with a known time, and the same share of the
    rows without one, chosen at random."""
    known = position(df.where(F.col(time).isNotNull()), [time, *key])
    unknown = shuffled(df.where(F.col(time).isNull()), key, seed)
    cut = F.floor(F.col("position_total") * (1 - share) + 1e-9)
    return known.unionByName(unknown).withColumn(
        "is_oot", F.col("position") >= cut).drop("position", "position_total")


def walk_forward_bounds(n: int, folds: int = 5, embargo: float = 0.02) -> list[dict[str, int]]:
    """Position ranges of expanding-window folds; folds that would be empty are left out."""
    block = max(1, n // (folds + 1))
    bounds = []
    for fold in range(folds):
        start = (fold + 1) * block
        end = n if fold == folds - 1 else min(start + block, n)
        train_end = start - int(start * embargo)
        if train_end > 0 and end > start:
            bounds.append({"fold": fold, "train_end": train_end, "valid_start": start,
                           "valid_end": end})
    return bounds


def walk_forward(positioned: DataFrame, folds: int = 5, embargo: float = 0.02) -> DataFrame:
    """One row per (row, fold it takes part in) with its role, from a positioned frame.

    Fold bounds are a handful of numbers, so each row emits its roles directly.
    """
    n = positioned.agg(F.max("position_total")).first()[0] or 0
    roles = []
    for b in walk_forward_bounds(int(n), folds, embargo):
        place = F.col("position")
        role = F.when(place < b["train_end"], "train").when(
            (place >= b["valid_start"]) & (place < b["valid_end"]), "valid")
        roles.append(F.struct(F.lit(b["fold"]).alias("fold"), role.alias("role")))
    if not roles:
        return positioned.withColumns({"fold": F.lit(0), "role": F.lit("train")}).limit(0)
    return (positioned.withColumn("_r", F.explode(F.array(*roles)))
            .where("_r.role IS NOT NULL")
            .withColumns({"fold": F.col("_r.fold"), "role": F.col("_r.role")}).drop("_r"))


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], folds: int = 5,
                     seed: int = 42, name: str = "fold") -> DataFrame:
    """Fold number with every class spread evenly: random position within the class, mod k."""
    return shuffled(df, key, seed, [label], "_p").withColumn(
        name, (F.col("_p") % folds).cast("int")).drop("_p", "_p_total")


def stratified_holdout(df: DataFrame, label: str, key: Sequence[str], share: float = 0.2,
                       seed: int = 42, name: str = "is_test") -> DataFrame:
    """The first ``share`` of each class in random order is the holdout."""
    out = shuffled(df, key, seed, [label], "_p")
    return out.withColumn(name, F.col("_p") < F.round(F.col("_p_total") * share)).drop(
        "_p", "_p_total")


def choose_folds(df: DataFrame, label: str, key: Sequence[str], time: str | None = None,
                 folds: int = 5, seed: int = 42) -> DataFrame:
    """Walk-forward roles when a time column exists, stratified roles otherwise.

    Both return (row, fold, role), so callers train and score the same way.
    """
    if time and time in df.columns:
        ordered = position(df, [time, *key])
        return walk_forward(ordered, folds).drop("position", "position_total")
    own = stratified_folds(df, label, key, folds, seed, "_own")
    every = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    return own.withColumn("fold", every).withColumn(
        "role", F.when(F.col("_own") == F.col("fold"), "valid").otherwise("train")).drop("_own")


def fold_audit(df: DataFrame, fold: str = "fold", label: str = "label",
               group: Sequence[str] = ()) -> DataFrame:
    """Size and positive rate per fold."""
    return df.groupBy(fold, *group).agg(
        F.count("*").alias("n"), F.sum(label).cast("long").alias("n_pos"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"))


def downsample_to_rate(df: DataFrame, label: str, key: Sequence[str], rate: float = 0.08,
                       seed: int = 42) -> DataFrame:
    """All positives and a random part of the negatives so that positives reach ``rate``."""
    ordered = shuffled(df, key, seed, [label], "_p")
    positives = df.agg(F.count_if(F.col(label) == 1)).first()[0]
    wanted = int(positives * (1 - rate) / rate)
    return ordered.where((F.col(label) == 1) | (F.col("_p") < wanted)).drop("_p", "_p_total")


def confident_rows(df: DataFrame, score: str, key: Sequence[str], low: float = 0.05,
                   high: float = 0.95, most: int | None = None, seed: int = 42,
                   label: str = "TARGET") -> DataFrame:
    """Rows with a very low or very high score, labelled by it; optionally a random ``most``."""
    sure = df.where((F.col(score) < low) | (F.col(score) >= high)).withColumn(
        label, (F.col(score) > 0.5).cast("int"))
    if most is None:
        return sure
    return shuffled(sure, key, seed, name="_p").where(F.col("_p") < most).drop("_p", "_p_total")


def with_pseudo_rows(train: DataFrame, pseudo: DataFrame, score: str) -> DataFrame:
    """Training rows plus pseudo-labelled rows, aligned on the training columns."""
    extra = pseudo.drop(score).select(*[c for c in train.columns if c in pseudo.columns])
    return train.unionByName(extra, allowMissingColumns=True)


def first_share(df: DataFrame, share: float, order: Sequence[str | Column],
                chunk: Column | None = None) -> DataFrame:
    """The first share of rows in the given order."""
    cut = F.floor(F.col("position_total") * share + 1e-9)
    return position(df, order, chunk=chunk).where(F.col("position") < cut).drop(
        "position", "position_total")


def prefix_event_rates(df: DataFrame, order: Sequence[str | Column], label: str,
                       shares: Sequence[float]) -> DataFrame:
    """Rows and events in each leading share of the ordered table."""
    run = prefix_sums(df.select(*[c for c in dict.fromkeys([*order, label])]), [], order,
                      {"n": F.lit(1), "events": F.col(label).cast("long")}, totals=["n"])
    rows = [F.max(F.when(F.col("n") <= F.floor(F.col("n_total") * s + 1e-9),
                         F.struct("n", "events"))).alias(f"s{i}") for i, s in enumerate(shares)]
    lines = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"s{i}.n").alias("n"),
                               F.col(f"s{i}.events").alias("events"))
                      for i, s in enumerate(shares)])
    return run.agg(*rows).select(F.inline(lines))
