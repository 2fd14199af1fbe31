"""Mean target of the k nearest training rows of other folds.

Rows of equal place and fold collapse to one counted line. Cells of lines split at the median of
their widest column until they fit a task. Inside a cell a tree goes on splitting, down to leaves that still
hold a few times ``k`` rows of every row's other folds, and each line takes the exact nearest ones: where the
sphere around it reaches out of its leaf, it asks the cell above, up to the whole cell. Where a sphere crosses
the border of its cell, the other cells it touches are asked too: first for the rows in shells of the sphere,
which leaves one thin shell that holds the last distance, then for the rows of that shell. So the result is
exact for any number of cells, and what a line gathers is bounded by its shells, never by its sphere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.binning import observed
from riskframe.operators.prefix import wide_quantiles
from riskframe.session import cut_lineage

#: Lines of a cell that a task takes in.
CELL_LINES = 1 << 16
#: A leaf holds so many times k rows of other folds at least.
LEAF_TIMES = 2
#: Squared distances that differ by no more than this share are equal.
SAME = 1e-9
#: Shells a sphere is cut into, and the most lines of a shell that are listed one by one.
SHELLS, LISTED = 32, 128
#: Distances that a task holds at once.
HELD = 1 << 22
#: Lines of the tables that are broadcast.
BROADCAST_LINES = 100_000
#: A line of so large a share of all rows is joined by broadcast.
HOT_SHARE = 1000

_LINE = ["_h0", "_h1", "_fold"]


def _standardised(train: DataFrame, columns: Sequence[str]) -> Column:
    """Place of a row: columns in standard deviations from their mean; missing values sit at the median."""
    values = train.select(*[observed(c).alias(c) for c in columns])
    medians = {r["feature"]: r["quantile"] for r in wide_quantiles(values, list(columns), [0.5]).collect()}
    filled = {c: F.coalesce(observed(c), F.lit(medians.get(c, 0.0))) for c in columns}
    stats = train.agg(*[F.avg(v).alias(f"{c}__m") for c, v in filled.items()],
                      *[F.stddev_pop(v).alias(f"{c}__s") for c, v in filled.items()]).first()
    return F.array(*[(v - F.lit(stats[f"{c}__m"])) / F.lit(stats[f"{c}__s"] or 1.0) for c, v in filled.items()])


def _small(df: DataFrame, lines: int) -> DataFrame:
    return F.broadcast(df) if lines <= BROADCAST_LINES else df


def _cells(lines: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """Lines with ``_cell``, and whether there are several: cells split in two at the middle of their widest column
    while they are too large."""
    state, several = lines.withColumn("_cell", F.lit(0).cast("long")), False
    while True:
        large = cut_lineage(state.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most))
        n_large = large.count()
        if not n_large:
            return state, several
        # the widest column of each large cell, then the middle of its values
        wide = (state.join(_small(large.select("_cell"), n_large), "_cell", "left_semi")
                .select("_cell", F.posexplode("_z").alias("i", "x")).groupBy("_cell", "i")
                .agg(F.nanvl(F.max("x") - F.min("x"), F.lit(0.0)).alias("w")).groupBy("_cell").agg(F.max_by("i", "w").alias("_i"),
                                                                                F.max("w").alias("_w")))
        wide = cut_lineage(wide.where("_w > 0"))
        n = wide.count()
        if not n:
            return state, several
        middle = (state.join(_small(wide, n), "_cell").groupBy("_cell", "_i")
                  .agg(F.percentile_approx(F.get("_z", F.col("_i")), 0.5, 1000).alias("_at"),
                       F.min(F.get("_z", F.col("_i"))).alias("_bottom")))
        # the smallest values alone go below where they are the middle, so that no side is empty
        middle = cut_lineage(middle)
        value = F.get("_z", F.col("_i"))
        side = F.when((value < F.col("_at")) | (value == F.col("_bottom")), 0).otherwise(1)
        moved = state.join(_small(middle, n), "_cell", "left").withColumn("_next", F.when(
            F.col("_i").isNull(), F.xxhash64("_cell", F.lit(2))).otherwise(F.xxhash64("_cell", side)))
        state, several = cut_lineage(moved.withColumn("_cell", F.col("_next")).drop("_next", "_i", "_at", "_bottom")), True


class _Boxes:
    """Bounds of the training lines of every cell, one line a cell."""

    def __init__(self, cells: DataFrame):
        rows = cells.where("_n > 0")
        sides = rows.select("_cell", F.posexplode("_z").alias("i", "x")).groupBy("_cell", "i").agg(
            F.min("x").alias("low"), F.max("x").alias("high")).groupBy("_cell").agg(
            F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("sides"))
        # rows that a line finds in a cell at least, whatever its fold
        others = rows.groupBy("_cell", "_fold").agg(F.sum("_n").alias("n")).groupBy("_cell").agg(
            (F.sum("n") - F.max("n")).alias("others"))
        found = sides.join(others, "_cell").select("_cell", "sides.low", "sides.high", "others").collect()
        self.cell = np.array([r["_cell"] for r in found], np.int64)
        self.low, self.high = np.array([r["low"] for r in found]), np.array([r["high"] for r in found])
        self.others = np.array([r["others"] for r in found], np.int64)

    def nearest(self, z: np.ndarray) -> np.ndarray:
        """Squared distance of points from boxes; no line of a box is nearer, rounding included."""
        away = np.zeros((len(z), len(self.cell)))
        for c in range(z.shape[1]):
            x = z[:, c][:, None]
            away += np.maximum(np.maximum(self.low[:, c] - x, x - self.high[:, c]), 0.0) ** 2
        return away

    def farthest(self, z: np.ndarray) -> np.ndarray:
        """Squared distance that no line of a box exceeds."""
        away = np.zeros((len(z), len(self.cell)))
        for c in range(z.shape[1]):
            x = z[:, c][:, None]
            away += np.maximum(np.abs(self.low[:, c] - x), np.abs(x - self.high[:, c])) ** 2
        return away

    def enough(self, z: np.ndarray, k: int) -> np.ndarray:
        """Squared distance within which every point has k rows of other folds, or all there are."""
        away = self.farthest(z)
        order = np.argsort(away, axis=1)
        rows = np.cumsum(self.others[order], axis=1) >= k
        last = np.where(rows.any(axis=1), rows.argmax(axis=1), len(self.cell) - 1)
        return np.take_along_axis(away, order, 1)[np.arange(len(z)), last]

    def parts(self, n: int) -> list[np.ndarray]:
        """Numbers below n in parts whose distances from all boxes are held at once."""
        return np.array_split(np.arange(n), 8 * n * len(self.cell) // HELD + 1)


class _Tree:
    """Exact nearest lines within one cell."""

    def __init__(self, z: np.ndarray, fold: np.ndarray, n: np.ndarray, y: np.ndarray, k: int):
        self.z, self.fold, self.n, self.y, self.k = z, fold, n, y, k
        self.mean, self.reach = np.full(len(z), np.nan), np.full(len(z), np.inf)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean of each line, and the squared distance up to which rows count; without bound below k rows."""
        whole = np.arange(len(self.z))
        low, high = np.full(self.z.shape[1], -np.inf), np.full(self.z.shape[1], np.inf)
        todo: list[tuple] = [(whole, low, high, None)]
        while todo:
            rows, low, high, above = todo.pop()
            node = (rows, low, high, above)
            split = self._split(rows)
            if split is None:
                self._ask(rows, node)
                continue
            column, at = split
            left = self.z[rows, column] < at
            for side, bound in ((left, (low, np.where(np.arange(len(high)) == column, at, high))),
                                (~left, (np.where(np.arange(len(low)) == column, at, low), high))):
                todo.append((rows[side], *bound, node))
        return self.mean, self.reach

    def _split(self, rows: np.ndarray) -> tuple[int, float] | None:
        points = self.z[rows]
        column = int(np.argmax(np.ptp(points, axis=0)))
        at = float(np.median(points[:, column]))
        left = points[:, column] < at
        for side in (left, ~left):
            folds = np.bincount(self.fold[rows[side]], self.n[rows[side]])
            if not len(folds) or folds.sum() - folds.max() < LEAF_TIMES * self.k:
                return None
        return column, at

    def _ask(self, asked: np.ndarray, node: tuple | None) -> None:
        """Nearest lines from the node, then from the one above for lines whose sphere is not inside."""
        while node is not None and len(asked):
            rows, low, high, above = node
            left = []
            for part in np.array_split(asked, max(1, len(asked) * len(rows) // (1 << 23))):
                reach, mean = self._nearest(part, rows)
                points, radius = self.z[part], np.sqrt(reach)
                inside = ((points - radius[:, None] >= low) & (points + radius[:, None] < high)).all(axis=1)
                done = inside | (above is None)
                self.mean[part[done]], self.reach[part[done]] = mean[done], reach[done]
                left.append(part[~done])
            asked, node = np.concatenate(left), above

    def _nearest(self, part: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        away = np.zeros((len(part), len(rows)))
        for column in range(self.z.shape[1]):
            away += (self.z[part, column][:, None] - self.z[rows, column]) ** 2
        away[(self.fold[part][:, None] == self.fold[rows]) | (self.n[rows] == 0)] = np.inf
        take = min(self.k, len(rows))
        near = np.argpartition(away, take - 1, axis=1)[:, :take]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(away, near, 1), axis=1), 1)
        enough = np.cumsum(self.n[rows][near], axis=1) >= self.k
        last = np.where(enough.any(axis=1), enough.argmax(axis=1), take - 1)
        reach = np.take_along_axis(away, near, 1)[np.arange(len(part)), last]
        # all lines at the last distance count, and fewer than k rows do if there are no more
        reach *= 1 + SAME
        hit = (away <= reach[:, None]) & np.isfinite(away)
        weight = hit @ self.n[rows].astype(float)
        with np.errstate(invalid="ignore", divide="ignore"):
            return reach, np.where(weight > 0, (hit @ self.y[rows]) / weight, np.nan)


def _points(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _means(k: int, boxes: _Boxes | None) -> Callable[[pa.Table], pa.Table]:
    """Means inside a cell; ``_hi`` where the sphere of that squared radius touches other cells, else NULL."""
    def run(cell: pa.Table) -> pa.Table:
        z = _points(cell.column("_z"))
        fold = np.unique(cell.column("_fold").to_numpy(), return_inverse=True)[1]
        mean, reach = _Tree(z, fold, cell.column("_n").to_numpy(), cell.column("_y").to_numpy(), k).run()
        bound = np.full(len(z), np.nan)
        if boxes is not None:
            others = boxes.cell != cell.column("_cell")[0].as_py()
            for part in boxes.parts(len(z)):
                sphere = np.where(np.isfinite(reach[part]), reach[part], boxes.enough(z[part], k))
                touched = ((boxes.nearest(z[part]) <= sphere[:, None]) & others).any(axis=1)
                bound[part] = np.where(touched, sphere, np.nan)
        return cell.select([*_LINE, "_z"]).append_column("_mean", pa.array(mean, pa.float64(), from_pandas=True)) \
            .append_column("_hi", pa.array(bound, pa.float64(), from_pandas=True))

    return run


def _touched(boxes: _Boxes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each asked line once for every cell that has lines between its two distances."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, lo, hi = _points(batch.column("_z")), batch.column("_lo").to_numpy(), batch.column("_hi").to_numpy()
            for part in boxes.parts(len(z)) if len(z) else []:
                line, cell = np.nonzero((boxes.nearest(z[part]) <= hi[part, None])
                                        & (boxes.farthest(z[part]) > lo[part, None]))
                asked = batch.take(pa.array(part[line]))
                yield pa.RecordBatch.from_arrays([*asked.columns, pa.array(boxes.cell[cell], pa.int64())],
                                                 [*asked.schema.names, "_cell"])

    return run


def _blocks(z: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in blocks of near points."""
    todo, out = [np.arange(len(z))], []
    while todo:
        rows = todo.pop()
        wide = np.ptp(z[rows], axis=0)
        column = int(np.argmax(wide))
        left = z[rows, column] < np.median(z[rows, column])
        if len(rows) <= most or not left.any():
            out += np.array_split(rows, -(-len(rows) // most))
        else:
            todo += [rows[left], rows[~left]]
    return out


def _distances(cell: pa.Table) -> Iterator[tuple]:
    """(asked lines, their two distances, squared distances from lines of the cell, those lines' rows and sums).

    Lines that none of these asked lines may count are infinitely far or left out.
    """
    here = np.asarray(cell.column("_lo").is_null())
    fold = np.unique(cell.column("_fold").to_numpy(), return_inverse=True)[1]
    lines, asks = cell.filter(pa.array(here)), cell.filter(pa.array(~here))
    if not len(asks):
        return
    z, q, f, g = _points(lines.column("_z")), _points(asks.column("_z")), fold[here], fold[~here]
    n, y = lines.column("_n").to_numpy(), lines.column("_y").to_numpy()
    lo, hi = asks.column("_lo").to_numpy(), asks.column("_hi").to_numpy()
    blocks = _blocks(z, 1024)
    low, high = np.array([z[b].min(0) for b in blocks]), np.array([z[b].max(0) for b in blocks])
    for block in _blocks(q, 256):
        apart = np.maximum(np.maximum(low - q[block].max(0), q[block].min(0) - high), 0.0)
        near = [b for b, d in zip(blocks, (apart ** 2).sum(1)) if d <= hi[block].max() * (1 + SAME)]
        if not near:
            continue
        rows = np.concatenate(near)
        for part in np.array_split(block, len(block) * len(rows) // HELD + 1):
            away = np.zeros((len(part), len(rows)))
            for c in range(z.shape[1]):
                away += (q[part, c][:, None] - z[rows, c]) ** 2
            away[g[part][:, None] == f[rows]] = np.inf
            yield asks.select(_LINE).take(pa.array(part)), lo[part], hi[part], away, n[rows], y[rows]


def _found(keys: pa.Table, line: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    out = keys.take(pa.array(line))
    for name, values in columns.items():
        out = out.append_column(name, pa.array(values))
    return out


_SHELL = "_h0 long, _h1 long, _fold long, _from double, _to double, n long, y double, c long"
_LISTED = "_h0 long, _h1 long, _fold long, _away double, n long, y double"


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "double": pa.float64()}
    return pa.schema([(c, kinds[t]) for c, t in (x.split() for x in schema.split(", "))]).empty_table()


def _in_shells(cell: pa.Table) -> pa.Table:
    """Rows, their sum and lines of the cell in each shell of the asked spheres.

    Shells are open below and closed above. Below a negative distance the first one ends at 0.
    """
    out = [_empty(_SHELL)]
    for keys, lo, hi, away, n, y in _distances(cell):
        base = np.maximum(lo, 0.0)
        ends = np.column_stack([lo, base[:, None] + (hi - base)[:, None] * (np.arange(SHELLS) / SHELLS), hi])
        line, at = np.nonzero((away > lo[:, None]) & (away <= hi[:, None]))
        far, width = away[line, at], (hi - base)[line]
        with np.errstate(invalid="ignore", divide="ignore"):
            shell = np.clip(np.nan_to_num(np.ceil((far - base[line]) / width * SHELLS)), 0, SHELLS).astype(int)
        # the guess may be one off: the ends decide
        shell = np.where(far <= ends[line, shell], shell - 1, shell)
        shell = np.clip(np.where(far > ends[line, np.clip(shell + 1, 0, SHELLS + 1)], shell + 1, shell), 0, SHELLS)
        place = line * (SHELLS + 1) + shell
        size = len(lo) * (SHELLS + 1)
        count = np.bincount(place, minlength=size)
        full = np.flatnonzero(count)
        rows = np.zeros(size, np.int64)
        np.add.at(rows, place, n[at])
        total = np.bincount(place, y[at], size)
        out.append(_found(keys, full // (SHELLS + 1), {
            "_from": ends[:, :-1].ravel()[full], "_to": ends[:, 1:].ravel()[full], "n": rows[full],
            "y": total[full], "c": count[full]}))
    return pa.concat_tables([t.cast(out[0].schema) for t in out])


def _in_lists(cell: pa.Table) -> pa.Table:
    """Rows of the cell between the asked distances, equal distances of a line together."""
    out = [_empty(_LISTED)]
    for keys, lo, hi, away, n, y in _distances(cell):
        line, at = np.nonzero((away > lo[:, None]) & (away <= hi[:, None]))
        far = away[line, at]
        order = np.lexsort((far, line))
        line, at, far = line[order], at[order], far[order]
        first = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (far[1:] != far[:-1])]) if len(line) else line
        out.append(_found(keys, line[first], {
            "_away": far[first], "n": np.add.reduceat(n[at], first) if len(first) else n[:0],
            "y": np.add.reduceat(y[at], first) if len(first) else y[:0]}))
    return pa.concat_tables([t.cast(out[0].schema) for t in out])


def _ask_cells(asked: DataFrame, cells: DataFrame, boxes: _Boxes, answer, schema: str, most: int) -> DataFrame:
    """Answers of all cells that the asked lines touch; a task takes a cell and no more than ``most`` of its askers."""
    columns = ["_cell", *_LINE, "_z", "_lo", "_hi"]
    asked = asked.select(*columns[1:])
    kinds = ", ".join(f"{c} {t}" for c, t in [*asked.dtypes, ("_cell", "bigint")])
    pairs = cut_lineage(asked.mapInArrow(_touched(boxes), kinds))
    parts = pairs.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts"))
    few = F.broadcast(cut_lineage(parts))  # one line a cell
    lines = cells.where("_n > 0").join(few, "_cell").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    asks = pairs.join(few, "_cell").withColumn("_part", F.pmod(F.xxhash64(*_LINE), F.col("_parts")).cast("int"))
    none = F.lit(None).cast("double")
    both = lines.select("_part", *columns[:-2], none.alias("_lo"), none.alias("_hi"), "_n", "_y").unionByName(
        asks.select("_part", *columns, F.lit(0).cast("long").alias("_n"), F.lit(0.0).alias("_y")))
    return both.groupBy("_cell", "_part").applyInArrow(answer, schema)


def _across(opened: DataFrame, cells: DataFrame, boxes: _Boxes, k: int, most: int) -> DataFrame:
    """Means of lines whose sphere touches several cells.

    ``_hi`` bounds the last distance from above. Rounds cut the shell between ``_lo`` and ``_hi`` into thinner ones
    and keep the one that holds the k-th row, with the rows and the sum inside it, until few lines are left in it.
    """
    state = opened.select(*_LINE, "_z", F.lit(-1.0).alias("_lo"), "_hi", F.lit(0).cast("long").alias("_n0"),
                          F.lit(0.0).alias("_y0"))
    done, thin = [], []
    line = Window.partitionBy(*_LINE)
    while not thin or not state.isEmpty():
        shells = _ask_cells(state, cells, boxes, _in_shells, _SHELL, most).groupBy(*_LINE, "_from", "_to").agg(
            *[F.sum(c).alias(c) for c in ("n", "y", "c")])
        below = line.orderBy("_to").rowsBetween(Window.unboundedPreceding, -1)
        shells = shells.withColumns({f"{c}_in": F.coalesce(F.sum(c).over(below), F.lit(0)) for c in ("n", "y")})
        holds = F.col("_n0") + F.col("n_in") + F.col("n") >= k
        picked = cut_lineage(state.select(*_LINE, "_z", "_n0", "_y0").join(shells, _LINE, "left").groupBy(*_LINE).agg(
            F.first("_z").alias("_z"), F.first("_n0").alias("_n0"), F.first("_y0").alias("_y0"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("_all_n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("_all_y"),
            F.min_by(F.struct("_from", "_to", "n", "y", "c", "n_in", "y_in"), F.when(holds, F.col("_to"))).alias("s")))
        # no more than k rows at all, or the last distance is 0: the rows are known
        known = F.col("s").isNull() | (F.col("s._to") <= 0)
        n = F.col("_n0") + F.coalesce(F.col("s.n_in") + F.col("s.n"), F.col("_all_n"))
        y = F.col("_y0") + F.coalesce(F.col("s.y_in") + F.col("s.y"), F.col("_all_y"))
        done.append(picked.where(known).select(*_LINE, (y / F.nullif(n, F.lit(0))).alias("_mean")))
        rest = picked.where(~known).select(
            *_LINE, "_z", F.col("s._from").alias("_lo"), F.col("s._to").alias("_hi"),
            (F.col("_n0") + F.col("s.n_in")).alias("_n0"), (F.col("_y0") + F.col("s.y_in")).alias("_y0"),
            F.col("s.c").alias("_c"))
        few = (F.col("_c") <= LISTED) | (F.col("_hi") - F.col("_lo") <= F.col("_hi") * SAME)
        thin.append(rest.where(few).drop("_c"))
        state = rest.where(~few).drop("_c")
    left = thin[0]
    for part in thin[1:]:
        left = left.unionByName(part)
    # rows a little beyond the shell may be as far as the last one
    asked = left.withColumn("_hi", F.col("_hi") * (1 + 2 * SAME))
    listed = _ask_cells(asked, cells, boxes, _in_lists, _LISTED, most).groupBy(*_LINE, "_away").agg(
        F.sum("n").alias("n"), F.sum("y").alias("y"))
    upto = line.orderBy("_away").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    listed = left.select(*_LINE, "_n0", "_y0").join(listed, _LINE).withColumn("_upto", F.col("_n0") + F.sum("n").over(upto))
    listed = listed.withColumn("_reach", F.min(F.when(F.col("_upto") >= k, F.col("_away"))).over(line))
    mean = (F.first("_y0") + F.sum("y")) / (F.first("_n0") + F.sum("n"))
    found = listed.where(F.col("_away") <= F.col("_reach") * (1 + SAME)).groupBy(*_LINE).agg(mean.alias("_mean"))
    for part in done:
        found = found.unionByName(part)
    return found


def encode_neighbours(train: DataFrame, columns: list[str], target: str, fold: str,
                      test: DataFrame | None = None, k: int = 500, name: str = "neighbour_enc",
                      cell_lines: int = CELL_LINES) -> DataFrame:
    """Mean target of the ``k`` training rows nearest to each row, in standard deviations of ``columns``.

    All rows at the distance of the last one count, whichever cell they lie in. Training rows are encoded without their own fold, ``test``
    rows from all training rows. NULL is a fold of its own. Where no row of another fold exists, the result is the
    mean target of the other folds, or of all rows if there is no other fold.
    """
    place = _standardised(train, columns)
    number = F.xxhash64(F.col(fold).isNull(), F.col(fold).cast("string"))
    located = train.withColumn("_z", place).withColumns(
        {"_h0": F.xxhash64("_z"), "_h1": F.xxhash64(F.lit("second"), "_z"), "_fold": number})
    lines = located.groupBy(*_LINE).agg(F.first("_z").alias("_z"), F.count(F.lit(1)).alias("_n"),
                                        F.coalesce(F.sum(F.col(target).cast("double")), F.lit(0.0)).alias("_y"))
    asked = located
    if test is not None:
        # asked rows are lines without rows of a fold that no row has
        asked = test.withColumn("_z", place).withColumns(
            {"_h0": F.xxhash64("_z"), "_h1": F.xxhash64(F.lit("second"), "_z"), "_fold": F.lit(0).cast("long")})
        lines = lines.unionByName(asked.groupBy(*_LINE).agg(
            F.first("_z").alias("_z"), F.lit(0).cast("long").alias("_n"), F.lit(0.0).alias("_y")))
    cells, several = _cells(cut_lineage(lines), cell_lines)
    boxes = _Boxes(cells) if several else None
    means = cut_lineage(cells.groupBy("_cell").applyInArrow(
        _means(k, boxes), "_h0 long, _h1 long, _fold long, _z array<double>, _mean double, _hi double"))
    inside = means.where("_hi is null").select(*_LINE, "_mean")
    means = cut_lineage(inside.unionByName(_across(means.where("_hi is not null"), cells, boxes, k, cell_lines))) \
        if several else inside
    # lines that hold a large share of the rows never meet their rows in one task
    sizes = asked.groupBy(*_LINE).agg(F.count(F.lit(1)).alias("_rows"))
    total = asked.count()
    hot = cut_lineage(sizes.where(F.col("_rows") * HOT_SHARE >= total).select(*_LINE))
    few = F.broadcast(hot)
    cold = asked.join(few, _LINE, "left_anti").join(means.join(few, _LINE, "left_anti"), _LINE)
    warm = asked.join(F.broadcast(means.join(few, _LINE, "left_semi")), _LINE)
    found = cold.unionByName(warm)
    if test is not None:
        rate = train.agg(F.avg(F.col(target).cast("double"))).first()[0]
        return found.withColumn(name, F.coalesce("_mean", F.lit(rate))).drop("_z", *_LINE, "_mean")
    by_fold = located.groupBy("_fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("double")).alias("y"))
    every = by_fold.agg(F.sum("n").alias("_all_n"), F.sum("y").alias("_all_y")).first()
    others = F.lit(every["_all_n"]) - F.col("n")
    rest = by_fold.select("_fold", F.when(others > 0, (F.lit(every["_all_y"]) - F.col("y")) / F.nullif(others, F.lit(0)))
                          .otherwise(F.lit(every["_all_y"]) / F.lit(every["_all_n"])).alias("_rest")) if every["_all_n"] else \
        by_fold.select("_fold", F.lit(None).cast("double").alias("_rest"))
    # one line a fold
    return found.join(_small(rest, rest.count()), "_fold").withColumn(name, F.coalesce("_mean", "_rest")).drop(
        "_z", *_LINE, "_mean", "_rest")
