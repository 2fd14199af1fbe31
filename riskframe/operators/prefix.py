"""Running totals, positions and exact quantiles without a single-task window.

A window over a whole table, or over one very large group, runs in one task. Here
rows are first split into ordered chunks. Each chunk is scanned by its own task,
and chunk totals (one row per group and chunk) carry the running sum across.

The chunk is either an expression that follows the sort order (a day, the high bits
of a hash) or, by default, the partition number after range partitioning. Range
boundaries are sampled, so that variant is written to a table before it is read twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.wide import PLACE, column_name, long_values
from riskframe.session import cut_lineage

_CHUNK = "_chunk"


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
                sums: dict[str, Column], chunk: Column | None = None,
                totals: Sequence[str] = ()) -> DataFrame:
    """Add inclusive running sums per group in the given order.

    ``sums`` maps an output name to the summed value. Names listed in ``totals`` also
    yield ``<name>_total``, the sum over the whole group. A ``chunk`` must never
    decrease along ``order``. NULL is a group of its own.
    """
    group = list(group)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    if chunk is None:
        ranged = df.repartitionByRange(*[F.col(g) for g in group], *keys)
        chunked = cut_lineage(ranged.withColumn(_CHUNK, F.spark_partition_id()))
    else:
        lowest = F.lit(-(2 ** 63))  # NULL sorts first, so its chunk does too
        chunked = df.withColumn(_CHUNK, F.coalesce(chunk.cast("bigint"), lowest))

    cells = chunked.groupBy(*group, _CHUNK).agg(
        *[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    earlier = Window.partitionBy(*group).orderBy(_CHUNK).rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = cells.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col(_CHUNK).alias("_c"),
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_total") for n in totals])

    inside = Window.partitionBy(*group, _CHUNK).orderBy(*keys).rowsBetween(
        Window.unboundedPreceding, 0)
    running = chunked.withColumns({f"_r_{n}": F.sum(v).over(inside) for n, v in sums.items()})
    same = running[_CHUNK] == offsets["_c"]
    for g in group:
        same = same & running[g].eqNullSafe(offsets[f"_g_{g}"])
    joined = running.join(offsets, same, "left")
    return joined.select(
        *[joined[c] for c in df.columns],
        *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
        *[F.col(f"{n}_total") for n in totals])


def position(df: DataFrame, order: Sequence[str | Column], name: str = "position",
             group: Sequence[str] = (), chunk: Column | None = None) -> DataFrame:
    """0-based position in the given order, with ``<name>_total`` as the row count.

    Without groups and chunk the rows are range-partitioned, sorted and written once, each with its place in
    its partition; later passes only add the number of rows before the partition.
    """
    if group or chunk is not None:
        out = prefix_sums(df, group, order, {name: F.lit(1)}, chunk, totals=[name])
        return out.withColumn(name, F.col(name) - 1)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    # the lower 33 bits count the rows of a partition
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns(
        {_CHUNK: F.spark_partition_id(), "_row": row}))
    counts = placed.groupBy(_CHUNK).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    # one line a partition
    offsets = cut_lineage(counts.select(
        F.col(_CHUNK).alias("_c"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias("_all")))
    return placed.join(F.broadcast(offsets), F.col(_CHUNK) == F.col("_c")).select(
        *[placed[c] for c in df.columns], (F.col("_row") + F.col("_before")).alias(name),
        F.col("_all").alias(f"{name}_total"))


def hash_key(columns: Sequence[str], seed: int) -> Column:
    """Seeded pseudo-random sort key of a row."""
    return F.xxhash64(*[F.col(c) for c in columns], F.lit(seed))


def hash_chunk(key: str, bits: int = 16) -> Column:
    """High bits of a hash: equal-sized chunks that follow the hash order."""
    return F.shiftright(F.col(key), 64 - bits)


def average_rank(df: DataFrame, value: str, group: Sequence[str] = (),
                 name: str = "rank", share: bool = False) -> DataFrame:
    """Rank of ``value`` with ties averaged; ``share`` divides by the group size.

    Equal values collapse to one row before ranks are summed up, so a value that
    fills a third of the table costs one row.
    """
    group = list(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(
        F.count("*").alias("_n"))
    run = prefix_sums(counts, group, [value], {"_cum": F.col("_n")}, totals=["_cum"])
    rank = F.col("_cum") - (F.col("_n") - 1) / F.lit(2.0)
    ranks = run.select(*group, value,
                       (rank / F.col("_cum_total") if share else rank).alias(name))
    return df.join(ranks, [*group, value], "left")


#: Accuracy of the sketches that bracket a rank, and widths of brackets as shares of the rows.
ACCURACY = 10_000
WIDTHS = (0.0005, 0.002, 0.02)
#: Groups whose brackets are broadcast.
BROADCAST_GROUPS = 10_000


def _brackets(df: DataFrame, value: str, probs: Sequence[float], group: Sequence[str]) -> DataFrame:
    """Per group: row count, and arrays of values at or below and at or above the ranks that each probability needs.

    A sketch misses a rank by n / ``ACCURACY`` at most. Of the widths, each group takes the smallest that
    covers this and four rows; groups of few rows take all values.
    """
    asked = [min(max(p + sign * w, 0.0), 1.0) for w in WIDTHS for sign in (-1, 1) for p in probs]
    found = df.groupBy(*group).agg(F.count("*").alias("_all"), F.percentile_approx(
        F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in asked]), F.lit(ACCURACY)).alias("_q"))
    n, size = F.col("_all"), len(probs)
    low = high = F.array(*[F.lit(None).cast("double")] * size)
    for i in reversed(range(len(WIDTHS))):
        wide = F.lit(WIDTHS[i] - 2.0 / ACCURACY) * n >= 4
        low = F.when(wide, F.slice("_q", 2 * i * size + 1, size)).otherwise(low)
        high = F.when(wide, F.slice("_q", (2 * i + 1) * size + 1, size)).otherwise(high)
    # a probability that was cut off at an end has no bound there
    ends = [[F.lit(w) for w in row] for row in ((p <= WIDTHS[-1] for p in probs), (p >= 1 - WIDTHS[-1] for p in probs))]
    open_low, open_high = (F.array(*row) for row in ends)
    return found.select(
        *group, "_all",
        F.transform(low, lambda x, i: F.when(x.isNull() | F.get(open_low, i), float("-inf")).otherwise(x)).alias("_low"),
        F.transform(high, lambda x, i: F.when(x.isNull() | F.get(open_high, i), float("nan")).otherwise(x)).alias("_high"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    group: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles, one row per group and probability.

    Same numbers as ``percentile``. Sketches bracket the ranks that are needed, then one pass counts: of the
    values outside all brackets only their number is kept, so hardly any value is shuffled.
    """
    group = list(group)
    rows = df.where(F.col(value).isNotNull())
    brackets = _brackets(rows, value, probs, group)
    # NaN, the largest double, is the open upper end
    v = F.col(value).cast("double")
    if group:
        brackets = cut_lineage(brackets.withColumnsRenamed({g: f"_b_{g}" for g in group}))
        # few groups hold many rows each, which must not meet in one task
        if brackets.count() <= BROADCAST_GROUPS:
            brackets = F.broadcast(brackets)
        same = reduce(lambda a, b: a & b, [rows[g].eqNullSafe(F.col(f"_b_{g}")) for g in group])
        placed = rows.join(brackets, same)
    else:
        one = brackets.first()  # one line of fixed size
        placed = rows.withColumns({"_all": F.lit(one["_all"]), "_low": F.array(*[F.lit(x) for x in one["_low"]]),
                                   "_high": F.array(*[F.lit(x) for x in one["_high"]])})
    # spelled out per probability, so that it is compiled
    above = [(F.get("_low", F.lit(i)) <= v, F.get("_high", F.lit(i)) < v) for i in range(len(probs))]
    region = reduce(lambda a, b: a + b, [x.cast("int") for pair in above for x in pair])
    inside = reduce(lambda a, b: a | b, [low & ~high for low, high in above])
    counts = (placed.select(*group, region.cast("long").alias("_r"), F.when(inside, F.col(value)).alias("_v"))
              .groupBy(*group, "_r", "_v").agg(F.count("*").alias("_n")))
    run = prefix_sums(counts, group, ["_r", "_v"], {"_cum": F.col("_n")}, F.col("_r"), totals=["_cum"])
    run = run.where("_v is not null").withColumnRenamed("_v", value) if value != "_v" else run.where("_v is not null")
    first, last = F.col("_cum") - F.col("_n"), F.col("_cum") - 1
    place = F.col("_p") * (F.col("_cum_total") - 1)
    # a product such as 0.7 * 10 must not land just below a whole number
    place = F.when(F.abs(place - F.round(place)) < 1e-9, F.round(place)).otherwise(place)
    low, high = F.floor("_place"), F.ceil("_place")
    hits = (run.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
            .withColumn("_place", place)
            .where(low.between(first, last) | high.between(first, last)))
    return (hits.groupBy(*group, F.col("_p").alias("prob"))
            .agg(F.max(F.when(low.between(first, last), F.col(value))).alias("_a"),
                 F.max(F.when(high.between(first, last), F.col(value))).alias("_b"),
                 F.max(F.col("_place") - low).alias("_w"))
            .select(*group, "prob",
                    (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias("quantile")))


def wide_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                   group: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Quantiles of many columns as rows ``(group, feature, prob, quantile)``.

    ``approximate`` uses a mergeable sketch per column instead of exact positions.
    """
    group = list(group)
    long = long_values(df, columns, group).where(F.col("value").isNotNull())
    if approximate:
        grid = F.array(*[F.lit(float(p)) for p in probs])
        found = long.groupBy(*group, PLACE).agg(
            F.percentile_approx("value", grid, F.lit(10000)).alias("_q"))
        pairs = F.explode(F.arrays_zip(grid.alias("prob"), F.col("_q").alias("quantile")))
        found = found.select(*group, PLACE, pairs.alias("_z")).select(
            *group, PLACE, "_z.prob", "_z.quantile")
    else:
        found = exact_quantiles(long, "value", probs, [*group, PLACE])
    return found.select(*group, column_name(columns).alias("feature"), "prob", "quantile")
