"""Prefix trie over conversations, held as node tables behind minimal perfect hashes.

A prefix of turns has a 128-bit digest, chained from turn to turn. Subtrees of few rows go whole to a
shard: there the distinct digests get slots of a minimal perfect hash, verified against the stored digests,
counts are scattered into flat arrays over the slots, and sums flow along the array of parent slots from the
deepest level up. The nodes above all such subtrees, the crown, come as one line each with their counts
already added up, take the sums of what hangs below, and go through the same arrays, in bands of depth if
they are many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskframe.llm.common import stored
from riskframe.llm.mphf import KeyTable

#: Conversations that share a beginning, and the bound on its turns.
FAMILY, SHARED = 100, 6
#: Rows of the largest subtree that stays whole; a shard has about as many.
SUBTREE_ROWS = 1 << 16
#: Nodes of the crown handled at a time, and lines that are broadcast.
CROWN_NODES = 1 << 18
#: Range of ids whose decimal list is made in one group.
ID_RANGE = 1024

NODE = ["k0", "k1"]
PARENT = ["p0", "p1"]


def shared_turns(conv: Column) -> Column:
    """Number of turns that a conversation takes over from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % SHARED


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Rows conv_id, pos, digest, chars, n_turns; one row of pos -1 starts each conversation.

    Turns are ordered by turn (null first), then role, then text; null roles and texts are empty.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    turns = stored(rows.select(
        "conv_id", (place - 1).cast("long").alias("pos"), F.length("text").cast("long").alias("chars"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest")),
        "turns")
    n = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = n.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", shared_turns(F.col("conv_id")))
    bases = n.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    # of at most 199 conversations a base, and at most five of its turns
    convs = stored(convs.join(bases, "base", "left").select(
        "conv_id", "base", "h", (F.least("h", F.coalesce("base_n", F.lit(0))) + F.greatest(
            F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "conversations")
    own = turns.where(F.col("pos") >= shared_turns(F.col("conv_id")))
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < SHARED - 1))
    begun = (heads.withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base")
             .where("pos < h"))
    start = convs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.col("n_turns").alias("chars"),
                         F.lit(None).cast("binary").alias("digest"))
    columns = ["conv_id", "pos", "chars", "digest"]
    return own.select(columns).union(begun.select(columns)).union(start)


_ROWS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("left", pa.int64()), ("chars", pa.int64()),
                   *[(n, pa.int64()) for n in (*NODE, *PARENT)]])
_ROOT = hashlib.sha256(b"").digest()[:16]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per prefix: its node, the parent node, and how many turns are left after it."""
    state, depth, left = _ROOT, 0, 0
    for batch in batches:
        out, keys, parents = [], [], []
        for conv, pos, chars, digest in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "pos", "chars", "digest"))):
            parent = state
            if pos < 0:
                state, parent, depth, left, chars = _ROOT, _ROOT, 0, chars, 0
            else:
                state = hashlib.sha256(state + digest).digest()[:16]
                depth, left = depth + 1, left - 1
            out.append((conv, depth, left, chars))
            keys.append(state)
            parents.append(parent)
        words = [np.frombuffer(b"".join(x), np.int64).reshape(-1, 2) for x in (keys, parents)]
        numbers = np.array(out, np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(c)) for c in (*numbers.T, *words[0].T, *words[1].T)], schema=_ROWS)


def prefix_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, left, chars, node (k0, k1) and parent (p0, p1) for every prefix of every rebuilt conversation."""
    ordered = rebuilt(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return stored(ordered.mapInArrow(
        _chained, "conv_id long, depth long, left long, chars long, k0 long, k1 long, p0 long, p1 long"), "prefixes")


NODES = pa.schema([*[(n, pa.int64()) for n in (*NODE, *PARENT, "conv_id", "depth", "parent_conv_id", "n_convs",
                                              "n_children", "n_leaves", "saved_tokens")], ("top", pa.bool_())])
NODE_COLUMNS = ", ".join(f"{n} long" for n in NODES.names[:-1]) + ", top boolean"


def _words(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table.column(n).to_numpy() for n in names], axis=1).view(np.uint64)


def accumulate(table: pa.Table) -> pa.Table:
    """Node table of some rows: all rows of some subtrees, or one line a node.

    ``times`` is what a row adds to n_convs, ``children``, ``leaves`` and ``saved`` what hangs below its node
    outside of these rows. A node whose parent is not among the rows is marked ``top``.
    """
    rows = _words(table, NODE)
    order = np.lexsort(rows.T)
    new = np.append(True, (rows[order][1:] != rows[order][:-1]).any(axis=1))
    slots_of = KeyTable.build(rows[order[new]])
    slot, n = slots_of.slots(rows), int(new.sum())
    if (slot < 0).any():
        raise RuntimeError("a prefix is not in its table")

    def scattered(name: str, add=np.add, start: int = 0) -> np.ndarray:
        out = np.full(n, start, np.int64)
        add.at(out, slot, table.column(name).to_numpy())
        return out

    n_convs, conv = scattered("times"), scattered("conv_id", np.minimum, np.iinfo(np.int64).max)
    depth, chars = (scattered(c, np.maximum) for c in ("depth", "chars"))
    children, leaves, saved = (scattered(c) for c in ("children", "leaves", "saved"))
    above = np.zeros((n, 2), np.uint64)
    above[slot] = _words(table, PARENT)
    parent = np.where(depth > 0, slots_of.slots(above), -1)
    np.add.at(children, parent[parent >= 0], 1)
    leaves += children == 0
    saved += (n_convs - 1) * chars
    by_depth = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.append(True, depth[by_depth][1:] != depth[by_depth][:-1]))
    for start, end in zip(cuts, [*cuts[1:], n]):
        level = by_depth[start:end]
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    parent_conv = pa.array(np.where(parent >= 0, conv[parent], 0), mask=parent < 0)
    keys, above = slots_of.keys.view(np.int64), above.view(np.int64)
    return pa.Table.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in (
        np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]), np.ascontiguousarray(above[:, 0]),
        np.ascontiguousarray(above[:, 1]), conv, depth, parent_conv, n_convs, children, leaves, saved,
        parent < 0)], schema=NODES)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= CROWN_NODES else df


def _below(nodes: DataFrame) -> DataFrame:
    """What the top nodes hand to their parents."""
    return (nodes.where("top and depth > 0").groupBy(F.col("p0").alias("k0"), F.col("p1").alias("k1"))
            .agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"),
                 F.sum("saved_tokens").alias("saved")))


def _crown(crown: DataFrame, below: DataFrame, size: int, crown_nodes: int) -> list[DataFrame]:
    """Node tables of the crown, in bands of depth from below; a band is one task's table of bounded size."""
    widest, deepest = crown.groupBy("depth").count().agg(F.max("count"), F.max("depth")).first()
    height = deepest + 1 if size <= crown_nodes else max(1, crown_nodes // widest)
    # nodes of one level need not meet
    groups = -(-widest // crown_nodes) if height == 1 else 1
    done = []
    for band in range(deepest // height, -1, -1):
        part = crown.where(F.floor(F.col("depth") / height) == band).join(below, NODE, "left").fillna(
            0, ["children", "leaves", "saved"])
        part = part.withColumn("group", F.pmod(F.xxhash64(*NODE), F.lit(groups)))
        done.append(stored(part.groupBy("group").applyInArrow(accumulate, NODE_COLUMNS), "crown"))
        below = below.unionByName(_below(done[-1])).groupBy(NODE).agg(
            *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    return done


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the ids of each node, whose ranges come in order."""
    key, digest = None, None
    for batch in batches:
        out = []
        for k0, k1, ids in zip(*(batch.column(n).to_pylist() for n in ("k0", "k1", "ids"))):
            if (k0, k1) != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (k0, k1), hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
        yield _ends(out)
    if key is not None:
        yield _ends([(*key, digest.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        columns, (pa.int64(), pa.int64(), pa.string()))], ["k0", "k1", "ends_sha256"])


def prefix_trie(conversations: DataFrame, subtree_rows: int = SUBTREE_ROWS, crown_nodes: int = CROWN_NODES) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id belong to no conversation and are left out. Equal turn numbers go by role, then text;
    repeated rows are turns of their own; null turns come first; null roles and texts are empty. A conversation's
    family begins at ``conv_id - conv_id % 100`` with the sign of conv_id. An empty table has no node, not even
    a root. Texts of any length count whole. Other columns are ignored.
    """
    rows = prefix_rows(conversations)
    sums = rows.groupBy(NODE).agg(
        *[F.max(c).alias(c) for c in PARENT], F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.max("chars").alias("chars"), F.count(F.lit(1)).alias("times"), F.sum(F.col("left") + 1).alias("under"))
    crown = stored(sums.where(F.col("under") > subtree_rows).drop("under"), "crown-nodes")
    size = crown.count()
    above = _small(crown.select(*NODE, F.lit(True).alias("in_crown")), size)
    marked = rows.join(above, NODE, "left").where("in_crown is null").drop("in_crown")
    # the first node of a conversation outside the crown is the top of its subtree
    tops = marked.groupBy("conv_id").agg(F.min_by(F.xxhash64(*NODE), "depth").alias("tree"))
    stored_tops = stored(tops, "subtrees")
    shards = max(1, marked.count() // subtree_rows)
    light = (marked.join(stored_tops, "conv_id").withColumn("shard", F.pmod("tree", F.lit(shards)))
             .withColumns({"times": F.lit(1).cast("long"), **{c: F.lit(0).cast("long") for c in (
                 "children", "leaves", "saved")}}))
    tables = [stored(light.select("shard", *NODE, *PARENT, "conv_id", "depth", "chars", "times", "children", "leaves",
                                  "saved").groupBy("shard").applyInArrow(accumulate, NODE_COLUMNS), "nodes")]
    if size:
        tables += _crown(crown, _below(tables[0]), size, crown_nodes)
    nodes = tables[0]
    for more in tables[1:]:
        nodes = nodes.unionByName(more)
    # parents of the tops are in the crown
    parents = crown.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("above"))
    nodes = nodes.join(_small(parents, size), PARENT, "left").withColumn(
        "parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "above")))
    decimal = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ids = (rows.where("left = 0").groupBy(*NODE, F.floor(F.col("conv_id") / ID_RANGE).alias("range"))
           .agg(decimal.alias("ids")))
    ends = (ids.repartition(*NODE).sortWithinPartitions(*NODE, "range").select(*NODE, "ids")
            .mapInArrow(_joined_ids, "k0 long, k1 long, ends_sha256 string"))
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
