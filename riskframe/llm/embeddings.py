"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the
axis it then lies closest to, with the sign. A table joins as many such hashes as the largest group
of comparable vectors calls for, and a vector probes, besides its own bucket, those it missed by the least.
The number of tables follows from that: pairs drawn at the threshold meet in one of them with the
stated recall, so that pairs above it meet more often. Pairs that meet are verified by their cosine.

Equal vectors are one class from the start. Buckets give back sums of links per class and a tree of
links, never pairs; a pair is counted in the first bucket where it meets. Large buckets are cut into
blocks. Vectors within half the threshold's angle of a large bucket's pivot are all linked
by the triangle inequality: such a ball is counted as a whole, and its blocks are not compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import HOT_SHARE, connected, join_skewed, stored

THRESHOLD = 0.93
#: Share of pairs at the threshold that meet in some table.
RECALL = 0.995
PROBES = 3
#: Classes that share a bucket if all buckets were equal.
BUCKET = 64
#: Larger buckets are cut into blocks of about this many vectors.
BLOCK = 1024
#: Tables up to this many lines are broadcast.
BROADCAST_ROWS = 100_000
SEED = 20


@dataclass(frozen=True)
class Family:
    """Hash functions for vectors of ``dim`` numbers: ``tables`` of ``hashes`` each, ``probes`` further buckets."""

    dim: int
    hashes: int
    tables: int
    probes: int
    seed: int = SEED

    @property
    def padded(self) -> int:
        return max(2, 1 << (self.dim - 1).bit_length())

    def signs(self, table: int) -> np.ndarray:
        return np.random.default_rng([self.seed, self.dim, table]).choice([-1.0, 1.0], (self.hashes, 3, self.padded))

    def codes(self, units: np.ndarray) -> np.ndarray:
        """Buckets (rows x tables x 1 + probes) of unit vectors, a vector's own bucket first."""
        wide = np.zeros((len(units), self.padded))
        wide[:, :self.dim] = units
        near = min(self.padded, 4 if self.hashes <= 3 else 2)
        combos = np.array(list(product(range(near), repeat=self.hashes)))
        out = np.empty((len(units), self.tables, 1 + self.probes), np.int64)
        for table in range(self.tables):
            code = np.zeros((len(units), len(combos)), np.int64)
            missed = np.zeros((len(units), len(combos)))
            for number, signs in enumerate(self.signs(table)):
                turned = wide
                for flip in signs:
                    turned = _hadamard(turned * flip)
                size = np.abs(turned)
                axes = np.argsort(-size, axis=1, kind="stable")[:, :near]
                values = np.take_along_axis(turned, axes, 1)
                reach = np.take_along_axis(size, axes, 1)
                missed += ((reach[:, :1] - reach) ** 2)[:, combos[:, number]]
                code = code * (2 * self.padded) + (2 * axes + (values > 0))[:, combos[:, number]]
            order = np.argsort(missed, axis=1, kind="stable")[:, :1 + self.probes]
            # fewer combinations than probes: the last one again, which changes nothing
            order = np.pad(order, ((0, 0), (0, 1 + self.probes - order.shape[1])), mode="edge")
            out[:, table] = np.take_along_axis(code, order, 1)
        return out


def _hadamard(rows: np.ndarray) -> np.ndarray:
    n, width = rows.shape
    step = 1
    while step < width:
        rows = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack([rows[:, :, 0] + rows[:, :, 1], rows[:, :, 0] - rows[:, :, 1]], axis=2)
        step *= 2
    return rows.reshape(n, width) / np.sqrt(width)


@lru_cache(maxsize=64)
def family(dim: int, classes: int, threshold: float, recall: float = RECALL) -> Family:
    """Hashes a table from the number of classes, and tables from how often pairs at the threshold meet."""
    padded = max(2, 1 << (dim - 1).bit_length())
    hashes = max(1, int(np.ceil(np.log(max(classes, 1) / BUCKET) / np.log(2 * padded))))
    if dim == 1:
        return Family(dim, 1, 1, PROBES)
    rng, trials = np.random.default_rng(SEED), 2000
    one = rng.normal(size=(trials, dim))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other = rng.normal(size=(trials, dim))
    other -= (other * one).sum(axis=1, keepdims=True) * one
    other *= np.sqrt(1 - threshold ** 2) / np.linalg.norm(other, axis=1, keepdims=True)
    sample = Family(dim, hashes, 4, PROBES)
    a, b = sample.codes(one), sample.codes(threshold * one + other)
    met = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).mean()
    missed = max(1e-9, 1 - max(met, 1e-3))
    return Family(dim, hashes, max(1, int(np.ceil(np.log(1 - recall) / np.log(missed)))), PROBES)


def _usable(values: np.ndarray | None) -> bool:
    return values is not None and len(values) > 0 and bool(np.isfinite(values).all()) and bool(values.any())


_DIGESTED = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("k0", pa.int64()),
                       ("k1", pa.int64()), ("vector", pa.binary())])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, length and bytes of each vector, and 128 bits that tell label and vector."""
    for batch in batches:
        out = []
        vectors = batch.column("embedding")
        for i, (vec, label) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("vec_id", "label")))):
            values = vectors[i].values if label is not None and vectors[i].is_valid else None
            vector = None if values is None or values.null_count else values.to_numpy()
            if not _usable(vector):
                out.append((vec, None, None, None, None, None))
                continue
            raw = (vector + 0.0).tobytes()  # no negative zeros
            k0, k1 = np.frombuffer(hashlib.blake2b(f"{label}\n".encode() + raw, digest_size=16).digest(), np.int64)
            out.append((vec, label, len(vector), int(k0), int(k1), raw))
        columns = zip(*out) if out else [()] * len(_DIGESTED)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DIGESTED)], schema=_DIGESTED)


def _matrix(raw: list[bytes], dim: int, kind: str) -> np.ndarray:
    """Vectors of ``dim`` numbers in double precision, scaled to a largest entry of 1."""
    rows = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)
    return rows / np.abs(rows).max(axis=1, keepdims=True)


def _coded(families: dict[int, Family], kind: str):
    """Adds ``codes``: the buckets of every table, a vector's own bucket first in each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                rows = _matrix(part.column("vector").to_pylist(), dim, kind)
                codes = families[int(dim)].codes(rows / np.linalg.norm(rows, axis=1, keepdims=True))
                # the number of a bucket also tells label, length and table
                salt = np.array([int.from_bytes(hashlib.blake2b(f"{x}\n{dim}".encode(), digest_size=8).digest(), "little")
                                 for x in part.column("label").to_pylist()], np.uint64)
                flat = _spread(codes.view(np.uint64), salt).view(np.int64).reshape(len(rows), -1)
                at = pa.array(np.arange(len(rows) + 1) * flat.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in ("cid", "n", "dim", "vector")),
                     pa.ListArray.from_arrays(at, pa.array(flat.reshape(-1)))],
                    ["cid", "n", "dim", "vector", "codes"])

    return run


def _spread(codes: np.ndarray, salt: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        tables = np.arange(codes.shape[1], dtype=np.uint64)[None, :, None]
        x = codes + salt[:, None, None] + tables * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Verifier:
    """Links inside runs of equal groups; counts each pair in the first bucket where it meets."""

    def __init__(self, families: dict[int, Family], threshold: float, kind: str):
        self.families, self.threshold, self.kind = families, threshold, kind

    def _pairs(self, group: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of pairs of one group at or above the threshold."""
        norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        ends = np.append(starts[1:], len(group))
        small = np.zeros(len(group), bool)
        found = []
        for start, end in zip(starts, ends):
            if end - start <= 16:
                small[start:end] = True
                continue
            cosine = vectors[start:end] @ vectors[start:end].T / np.outer(norm[start:end], norm[start:end])
            i, j = np.nonzero(np.triu(cosine >= self.threshold, 1))
            found.append((start + i, start + j))
        for step in range(1, 16):
            i = np.flatnonzero((group[step:] == group[:-step]) & small[:-step])
            if not len(i):
                break
            cosine = np.einsum("ij,ij->i", vectors[i], vectors[i + step]) / (norm[i] * norm[i + step])
            i = i[cosine >= self.threshold]
            found.append((i, i + step))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def links(self, batch: pa.Table) -> pa.RecordBatch:
        out: list[tuple[np.ndarray, ...]] = []
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            column = {n: part.column(n).to_numpy() for n in (
                "bucket", "part_a", "part_b", "block", "cid", "n", "ball", "own", "tab")}
            keys = np.stack([column["bucket"], column["part_a"], column["part_b"]])
            group = np.cumsum(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            vectors = _matrix(part.column("vector").to_pylist(), dim, self.kind)
            i, j = self._pairs(group, vectors)
            # within two blocks only pairs across them are due, and members of a ball are linked already
            due = ((column["part_a"][i] == column["part_b"][i]) | (column["block"][i] != column["block"][j]))
            due &= (column["ball"][i] < 0) | (column["ball"][i] != column["ball"][j])
            due &= column["own"][i] | column["own"][j]
            i, j = i[due], j[due]
            codes = part.column("codes").combine_chunks().flatten().to_numpy().reshape(
                len(part), -1, 1 + self.families[int(dim)].probes)
            swap = column["cid"][i] > column["cid"][j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            table, bucket = column["tab"][i], column["bucket"][i]
            first = np.ones(len(i), bool)
            for t in range(codes.shape[1]):
                low, high = codes[i, t], codes[j, t]
                by_low = (low[:, :1] == high).any(axis=1)
                met = by_low | (high[:, :1] == low).any(axis=1)
                here = np.where(by_low, low[:, 0], high[:, 0]) == bucket
                first &= np.where(t < table, ~met, np.where(t == table, here, True))
            i, j = i[first], j[first]
            sums = np.zeros(len(part), np.int64)
            np.add.at(sums, i, column["n"][j])
            np.add.at(sums, j, column["n"][i])
            label = np.arange(len(part))
            while True:
                least, before = np.minimum(label[i], label[j]), label.copy()
                np.minimum.at(label, i, least)
                np.minimum.at(label, j, least)
                if (before == label).all():
                    break
            hit = np.flatnonzero(sums > 0)
            out.append((column["cid"][hit], sums[hit], column["cid"][label[hit]]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cid", "links", "root"])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                now = pa.Table.from_batches([batch.slice(at, BLOCK)])
                held = now if held is None else pa.concat_tables([held, now])
                keys = np.stack([held.column(n).to_numpy() for n in ("bucket", "part_a", "part_b")])
                last = (keys == keys[:, -1:]).all(axis=0)
                open_at = int(np.argmax(last))  # the last group may go on
                if open_at:
                    yield self.links(held.slice(0, open_at))
                    held = held.slice(open_at)
        if held is not None and len(held):
            yield self.links(held)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _near_pivot(angle: float, kind: str):
    """Keeps the lines (cid, vector, pivot, pivot_vector) whose angle is small enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for raw, pivot in zip(batch.column("vector").to_pylist(), batch.column("pivot_vector").to_pylist()):
                a, b = (_matrix([x], len(x) // np.dtype(kind).itemsize, kind)[0] for x in (raw, pivot))
                a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
                keep.append(2 * np.arctan2(np.linalg.norm(a - b), np.linalg.norm(a + b)) <= angle)
            yield batch.select(["cid", "pivot"]).filter(pa.array(keep, pa.bool_()))

    return run


def class_links(classes: DataFrame, families: dict[int, Family], threshold: float, block: int = BLOCK,
                kind: str = "f8") -> tuple[DataFrame, DataFrame]:
    """(cid, links) and edges (a, b) between classes (cid, n, label, dim, vector)."""
    coded = stored(classes.select("cid", "n", "label", "dim", "vector").mapInArrow(
        _coded(families, kind), "cid long, n long, dim int, vector binary, codes array<long>"), "vector-codes")
    # from here on, rows are narrow until vectors are joined to them for the one wide shuffle
    ways = 1 + PROBES
    entries = (coded.select("cid", "codes", F.posexplode("codes").alias("pos", "bucket"))
               .where(F.array_position("codes", F.col("bucket")) == F.col("pos") + 1)
               .select("cid", "bucket", F.floor(F.col("pos") / ways).cast("int").alias("tab"),
                       (F.col("pos") % ways == 0).alias("own")))
    sizes = stored(entries.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.when(F.col("own"), F.col("cid"))).alias("pivot")).where("size > 1"),
        "bucket-sizes")
    met, large = sizes.count(), sizes.where((F.col("size") > block) & F.col("pivot").isNotNull())
    n_large = large.count()
    rows = entries.join(_small(sizes, met), "bucket")
    balls = None
    if not n_large:
        rows = rows.withColumns({"ball": F.lit(-1).cast("long"), "block": F.lit(0),
                                 "part_a": F.lit(0), "part_b": F.lit(0)})
    else:
        pivots = large.join(coded.select(F.col("cid").alias("pivot"), F.col("vector").alias("pivot_vector")), "pivot")
        # a margin keeps rounding on the safe side
        near = (entries.join(_small(large.select("bucket"), n_large), "bucket").join(coded, "cid")
                .join(_small(pivots.drop("size"), n_large), "bucket").select("cid", "vector", "pivot", "pivot_vector")
                .mapInArrow(_near_pivot(np.arccos(threshold) / 2 - 1e-9, kind), "cid long, pivot long"))
        balls = stored(near.groupBy("cid").agg(F.min("pivot").alias("ball")), "balls")
        rows = stored(rows.join(balls, "cid", "left").withColumn("ball", F.coalesce("ball", F.lit(-1))), "vector-rows")
        # a large bucket has the blocks of its largest ball, and the blocks of all else before them
        parts = (rows.where(F.col("size") > block).groupBy("bucket", "ball").agg(F.count(F.lit(1)).alias("c"))
                 .withColumn("held", F.when(F.col("ball") >= 0, F.col("c")))
                 .groupBy("bucket").agg(F.sum("c").alias("all"), F.coalesce(F.max("held"), F.lit(0)).alias("most"),
                                        F.coalesce(F.max_by("ball", "held"), F.lit(-2)).alias("main"))
                 .select("bucket", "main", F.ceil((F.col("all") - F.col("most")) / block).alias("outer"),
                         F.ceil(F.col("most") / block).alias("inner")))
        rows = rows.join(_small(parts, n_large), "bucket", "left")
        deal, inside, whole = F.xxhash64("cid"), F.col("ball") == F.col("main"), F.col("outer").isNull()
        cut = F.when(whole, 0).when(inside, F.col("outer") + F.pmod(deal, F.col("inner"))).otherwise(
            F.pmod(deal, F.col("outer")))
        last = F.when(whole, 0).when(inside, F.col("outer") - 1).otherwise(F.col("outer") + F.col("inner") - 1)
        # blocks of the same ball need no comparison
        rows = (rows.withColumn("block", cut.cast("int"))
                .withColumn("other", F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last))))
                .withColumns({"part_a": F.least("block", "other").cast("int"),
                              "part_b": F.greatest("block", "other").cast("int")}))
    keys = ["bucket", "part_a", "part_b"]
    found = stored(rows.select(*keys, "block", "cid", "ball", "own", "tab").join(coded, "cid")
                   .repartition(*keys).sortWithinPartitions(*keys)
                   .mapInArrow(_Verifier(families, threshold, kind), "cid long, links long, root long"), "vector-links")
    sums = found.select("cid", "links")
    edges = found.select(F.col("cid").alias("a"), F.col("root").alias("b")).where("a <> b")
    if balls is not None:
        held = balls.join(classes.select("cid", "n"), "cid")
        total = held.groupBy("ball").agg(F.sum("n").alias("ball_n"), F.min("cid").alias("least"))
        inside = held.join(_small(total, n_large), "ball")
        sums = sums.union(inside.select("cid", F.col("ball_n") - F.col("n")))
        edges = edges.union(inside.select(F.col("cid").alias("a"), F.col("least").alias("b")).where("a <> b"))
    return sums.groupBy("cid").agg(F.sum("links").alias("links")), edges


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK,
                 bucket: int = BUCKET) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest reachable) and kept of every row.

    Only vectors of equal, non-null label and equal length are compared. Vectors that are null, empty, zero or
    hold null or non-finite numbers link with nothing: their component_id is their own vec_id. Copies are linked
    with each other. Rows without vec_id are linked and counted; they are kept if no row of their component has an
    id. Rows that repeat a vec_id are rows of their own. An empty table gives an empty result. Other columns are
    ignored.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "f4" if single else "f8"
    rows = stored(vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
                  .mapInArrow(_digested, "vec_id long, label string, dim int, k0 long, k1 long, vector binary"),
                  "vectors")
    classes = stored(rows.where("k0 is not null").groupBy("k0", "k1").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("label").alias("label"),
        F.first("dim").alias("dim"), F.first("vector").alias("vector"))
        .withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    # one line a dimension
    largest = (classes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).collect())
    families = {r["dim"]: family(r["dim"], r["n"] * BUCKET // bucket, threshold, recall) for r in largest}
    sums, edges = class_links(classes, families, threshold, block, kind)
    roots = connected(edges).select(F.col("v").alias("cid"), F.col("m").alias("root"))
    table = (classes.select("k0", "k1", "cid", "n", "least").join(roots, "cid", "left")
             .withColumn("root", F.coalesce("root", "cid")))
    component = table.groupBy("root").agg(F.min("least").alias("component"))
    table = stored(table.join(component, "root").join(sums, "cid", "left").select(
        F.struct("k0", "k1").alias("key"), "n", "component",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vector-components")
    narrow = rows.select("vec_id", F.struct("k0", "k1").alias("key"))
    hot = table.where(F.col("n") * HOT_SHARE >= rows.count())
    linked = join_skewed(narrow.where("key.k0 is not null"), table.drop("n"), hot, "key").select(
        "vec_id", "n_links", F.col("component").alias("component_id"))
    apart = narrow.where("key.k0 is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(apart).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
