"""Near-duplicates by SimHash and an inverted index over byte positions.

A fingerprint has 64 bits, eight bytes. Two fingerprints within three bits differ in three bytes at
most, so they share at least five bytes at their positions. The index therefore holds every
fingerprint under each choice of five positions and their bytes: 56 postings of 40 bits. Inside a
posting list the shared bytes of a pair are tallied, pairs below five are passed over, and the rest
are verified bit by bit. Lists give back the tree of their links, never all pairs.

A list above ``LIST_LIMIT`` fingerprints is resolved another way, just as exactly and in linear
time: members that agree after clearing three of the 24 free bits are within three bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import HOT_SHARE, connected, join_skewed, stored

WORDS = 3
SEED = 42
MAX_BITS = 3
#: Bytes that fingerprints within MAX_BITS must share.
SHARED_BYTES = 8 - MAX_BITS
LIST_LIMIT = 2_000
#: Long texts are read in pieces of this size, cut at white space.
PIECE = 1 << 20

_COMBINATIONS = list(combinations(range(8), SHARED_BYTES))
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """Words of the text in pieces; each piece starts with the last two words before it."""
    at, carry = 0, []
    while at < len(raw):
        end = at + PIECE
        found = _SPACE.search(raw, end) if end < len(raw) else None
        end = found.start() if found else len(raw)
        words = carry + raw[at:end].split()
        yield words
        at, carry = end, words[-(WORDS - 1):]


def simhash(text: str | None) -> int:
    """Fingerprint as a signed 64-bit number; 0 for null, empty or blank texts.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are three words
    joined by spaces, repeats included; shorter texts are one shingle. A bit is set if more than half
    of the XXH64 hashes (seed 42) have it.
    """
    ones, total, last = np.zeros(64, np.int64), 0, []
    for words in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        last = words
        if len(words) >= WORDS:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS))))
            n = len(words) - WORDS + 1
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
            bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(n, 64)
            ones += bits.sum(axis=0, dtype=np.int32)
            total += n
    if not total and last:
        ones = np.unpackbits(np.array([xxhash.xxh64_intdigest(b" ".join(last), SEED)], np.uint64).view(np.uint8),
                             bitorder="little")
        total = 1
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fp (signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [simhash(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks, pa.int64())],
                                             ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _within(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of equal keys: every linked member and the smallest member it reaches."""
    label = np.arange(len(keys))
    links = []
    step = 1
    while step < len(keys):
        same = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(same):
            break
        differ = fps[same].view(np.uint64) ^ fps[same + step].view(np.uint64)
        tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        same, differ = same[tally >= SHARED_BYTES], differ[tally >= SHARED_BYTES]
        same = same[np.bitwise_count(differ) <= MAX_BITS]
        links.append(np.stack([same, same + step]))
        step += 1
    if not links:
        return fps[:0], fps[:0]
    low, high = np.concatenate(links, axis=1)
    while True:
        least = np.minimum(label[low], label[high])
        before = label.copy()
        np.minimum.at(label, high, least)
        np.minimum.at(label, low, least)
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(label)))
    return fps[moved], fps[label[moved]]


def _resolve(limit: int):
    """Reads postings sorted by key; yields links (a, b), and the members (a, key) of lists above ``limit``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("long_list", pa.bool_())])

    def out(a: np.ndarray, b: np.ndarray, long_list: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), long_list))],
                                          schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        overlong: list[int] = []  # key of a list whose first rows are out; at its end one more can begin
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            # the last list may go on in the next batch
            open_at = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if len(keys) - open_at > limit:
                open_at = len(keys)
                overlong.append(int(keys[-1]))
            yield from whole(keys[:open_at], fps[:open_at], overlong)
            keys, fps, overlong = keys[open_at:], fps[open_at:], overlong[-1:]
        yield from whole(keys, fps, overlong)

    def whole(keys: np.ndarray, fps: np.ndarray, overlong: list[int]) -> Iterator[pa.RecordBatch]:
        _, start, size = np.unique(keys, return_index=True, return_counts=True)
        big = np.repeat(size > limit, size) if len(keys) else np.zeros(0, bool)
        big |= np.isin(keys, overlong)
        yield out(fps[big], keys[big], True)
        a, b = _within(keys[~big], fps[~big])
        yield out(a, b, False)

    return run


def _long_lists(members: DataFrame) -> DataFrame:
    """Links among the members (a) of long lists (b): stars of those equal but for three free bits.

    A set has eight members at most, for three bits are left open.
    """
    free = F.array(*[F.array(*[F.lit(i) for i in range(8) if i not in c]) for c in _COMBINATIONS])
    masks = F.array(*[F.lit(sum(1 << i for i in c)) for c in combinations(range(8 * MAX_BITS), MAX_BITS)])
    rows = members.select(F.col("a").alias("fp"), F.col("b").alias("key"),
                          F.get(free, F.shiftright("b", 40).cast("int")).alias("free"),
                          F.explode(masks).alias("open"))
    spread = [F.expr(f"shiftleft(cast(shiftright(open, {8 * i}) & 255 as bigint), 8 * free[{i}])")
              for i in range(MAX_BITS)]
    mask = spread[0].bitwiseOR(spread[1]).bitwiseOR(spread[2])
    sets = (rows.select("fp", "key", "open", F.col("fp").bitwiseAND(F.bitwise_not(mask)).alias("rest"))
            .groupBy("key", "open", "rest").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1))
    return (sets.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
            .where("a <> b").distinct())


def links(fps: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fp`` within three bits; ``fp`` distinct."""
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255).cast("long")) for i in range(8)]
    postings = []
    for number, combination in enumerate(_COMBINATIONS):
        key = F.lit(number).cast("long")
        for i in combination:
            key = F.shiftleft(key, 8).bitwiseOR(byte[i])
        postings.append(key)
    index = fps.select("fp", F.explode(F.array(*postings)).alias("key"))
    found = stored(index.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp")
                   .mapInArrow(_resolve(list_limit), "a long, b long, long_list boolean"), "links")
    short = found.where("not long_list").select("a", "b")
    members = found.where("long_list")
    if members.isEmpty():
        return short
    return short.union(_long_lists(members))


def near_duplicates(docs: DataFrame, text: str = "text", list_limit: int = LIST_LIMIT) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (smallest doc_id reachable) of every row.

    Blank and null texts have fingerprint zero and are linked like any other. Repeated rows are kept
    and linked. Rows without doc_id are kept and link others; a component of such rows only has a
    null component_id. An empty table gives an empty result. Other columns are ignored.
    """
    marks = stored(fingerprints(docs, text), "fingerprints")
    groups = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")),
                    "distinct")
    roots = connected(links(groups.select("fp"), list_limit)).select(F.col("v").alias("fp"), F.col("m").alias("root"))
    rooted = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = stored(rooted.join(component, "root").select("fp", "n", "component_id"), "components")
    hot = table.where(F.col("n") * HOT_SHARE >= marks.count())
    return join_skewed(marks, table.drop("n"), hot, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, with their own columns, that are the first of their group of near-duplicates.

    The first is the row of the smallest doc_id, which is taken as a key: rows that repeat the smallest id all
    stay, and so do rows without one. Null and blank texts are near-duplicates of each other. An empty table
    gives an empty result.
    """
    groups = near_duplicates(docs.select("doc_id", "text"))
    later = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_later")).distinct()
    return docs.join(later, docs["doc_id"] == F.col("_later"), "left_anti")
