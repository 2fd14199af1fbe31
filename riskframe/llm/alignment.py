"""Cross-tokenizer alignment: which ids of two vocabularies end together, and how often.

Both tokenizers break before a space or line feed that follows something else, so a text falls into
stretches that are encoded and aligned apart; repeated stretches come from a bounded memo. The first
pass writes sums of linked id pairs per task. Their distinct pairs are dealt to shards by hash, and
every shard gets a minimal perfect hash whose slots hold the pairs, for verification. Counts are
dense vectors over the slots, added up in a tree. The second pass aligns the documents again and
looks the counts up.

The table goes to the tasks as one broadcast while its pairs are at most ``broadcast_pairs``
(``BROADCAST_PAIRS``: 16 bytes each, 64 MB). Beyond that, documents send their pairs to the shards.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import stored, tokenizer_path
from riskframe.llm.mphf import KeyTable, PerfectHash

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Stretches remembered per worker. Longer stretches are not remembered.
MEMO, MEMO_CHARS = 300_000, 64
#: Stretches encoded in one call.
ROW = 200
#: Pairs summed in a task before they are handed on.
FLUSH = 1_000_000
#: Pairs of one shard, and rows of partial sums that one dense vector takes in.
SHARD_PAIRS, VECTOR_ROWS = 1 << 18, 1 << 21
#: Vectors added at each step of the tree.
FAN_IN = 16
BROADCAST_PAIRS = 1 << 22
#: Texts handed on at a time.
ROWS = 256

# Characters that one side or the other may treat like white space never end a stretch.
_ODD = "᠎​﻿"
_BREAK = re.compile(rf"(?<=[^\s{_ODD}])(?=[ \n])")
_LOOSE = frozenset(filter(str.isspace, map(chr, range(0x3001)))) | set(_ODD)
# what keeps a text from being cut by plain replacement, besides neighbouring spaces and line feeds
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_UNUSUAL = (*_PAIRS, *sorted({*_LOOSE, "\x00"} - {" ", "\n"}))
_UNUSUAL_ASCII = tuple(x for x in _UNUSUAL if x.isascii())


def stretches(text: str) -> list[str]:
    """The text in pieces that both tokenizers encode apart; a piece starts with its white space."""
    if any(c in text for c in (_UNUSUAL_ASCII if text.isascii() else _UNUSUAL)):
        return _BREAK.split(text)
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n").strip("\x00").split("\x00")


def _byte_level() -> dict[str, int]:
    """Character of a byte-level vocabulary -> its byte: visible Latin-1 stands for itself, the rest follow 256."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Memo:
    """What is known of stretches; a full one becomes the older one, from which used ones come back."""

    def __init__(self) -> None:
        self.now: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}


class Pair:
    """Both tokenizers with the bytes of their tokens, and the memo of aligned stretches."""

    def __init__(self, first: str, second: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        to_byte = _byte_level()
        added = {t["id"]: t["content"].encode() for t in json.loads(self.a.to_str())["added_tokens"]}
        self.a_bytes = [added[i] if i in added else bytes(to_byte[c] for c in self.a.id_to_token(i) or "")
                        for i in range(self.a.get_vocab_size())]
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[1:-1], 16)]) if self.b.is_byte(i) else
                        b"" if self.b.is_control(i) else n.replace("▁", " ").encode()
                        for i, n in enumerate(names)]
        if any(c in name.lstrip(c) for name in names for c in ("▁", "\n")):
            raise ValueError("a piece reaches over a space or line feed: texts cannot be cut there")
        self.dummy = self.b.encode("\n")[:-1]
        self.space = self.b.piece_to_id("▁")
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes)]
        # an id as text with each mark behind it, by mark * width + id
        self.width = max(len(self.a_bytes), len(self.b_bytes))
        self.texts = [f"{i}{mark}" for mark in ",|;\n" for i in range(self.width)]
        self.memo = Memo()

    def _encode_second(self, parts: list[str]) -> list[list[int]]:
        """Ids of stretches; the library itself puts the space in front, which others do without."""
        found = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        return [[self.space] if p == " " else ids if p[0] == " " else ids[len(self.dummy):]
                for p, ids in zip(parts, found)]

    def _align(self, parts: list[str]) -> list[tuple] | None:
        """(n_a, n_b, n_groups, groups, links as bytes of a << 32 | b) of stretches; None if bytes differ.

        Stretches in a row are encoded together, for both sides break between them, unless one ends in
        white space: those come last, and alone.
        """
        tight = next((i for i, p in enumerate(parts) if p[-1] in _LOOSE), len(parts))
        rows = ["".join(parts[i:min(i + ROW, tight)]) for i in range(0, tight, ROW)] + parts[tight:]
        a, b = (np.array(list(chain.from_iterable(x)), np.int64) for x in (
            [e.ids for e in self.a.encode_batch_fast(rows, add_special_tokens=False)], self._encode_second(rows)))
        raw = "".join(parts).encode("utf-8", "surrogatepass")
        if (b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw
                or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw):
            return None
        ends_a, ends_b = self.sizes[0][a].cumsum(), self.sizes[1][b].cumsum()
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        closing_a, closing_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        # last group, first id and last id of every stretch
        limits = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in parts])
        last = np.searchsorted(ends, limits)
        links = (a[closing_a].astype(np.uint64) << np.uint64(32)) | b[closing_b].astype(np.uint64)
        # ids of all groups in their order, each with the mark that follows it
        size_a, size_b = np.diff(closing_a, prepend=-1), np.diff(closing_b, prepend=-1)
        before_a = np.repeat(np.cumsum(size_b) - size_b, size_a)
        before_b = np.repeat(np.cumsum(size_a), size_b)
        places_a, places_b = np.arange(len(a)) + before_a, np.arange(len(b)) + before_b
        out = np.empty(len(a) + len(b), np.int64)
        out[places_a], out[places_b] = a, b
        out[places_a[closing_a]] += self.width
        out[places_b[closing_b]] += 2 * self.width
        out[places_b[closing_b[last]]] += self.width
        texts = "".join(map(self.texts.__getitem__, out.tolist())).split("\n")
        n_a, n_b, n_groups = (np.diff(x, prepend=-1).tolist() for x in (closing_a[last], closing_b[last], last))
        raw_links, cuts = links.tobytes(), (8 * (last + 1)).tolist()
        return list(zip(n_a, n_b, n_groups, texts, (raw_links[i:j] for i, j in zip([0, *cuts], cuts))))

    def batch(self, texts: list[str | None], memo: Memo, extend=None) -> tuple[list[list[str]], dict[str, tuple]]:
        """Stretches of each text, and what is known of each stretch, passed through ``extend`` before it is kept.

        A text has no stretches if it has no tokens or its bytes differ from those of its tokens.
        """
        if len(memo.now) > MEMO:
            memo.older, memo.now = memo.now, {}
        cut = [stretches(" " + t) if t else [] for t in texts]
        fresh = set().union(*cut).difference(memo.now)
        again = fresh.intersection(memo.older) if memo.older else ()
        memo.now.update(zip(again, map(memo.older.__getitem__, again)))
        fresh = sorted(fresh.difference(again), key=lambda p: p[-1] in _LOOSE)
        found = self._align(fresh) if fresh else []
        if found is None:
            alone = {p: self._align([p]) for p in fresh}
            bad = {p for p, x in alone.items() if x is None}
            cut = [parts if bad.isdisjoint(parts) else [] for parts in cut]
            # stretches of left-out texts only are not counted, so nothing is known of them
            fresh = list(set().union(*cut).intersection(alone))
            found = [alone[p][0] for p in fresh]
        known = dict(zip(fresh, extend(found) if extend and found else found))
        short = {p: x for p, x in known.items() if len(p) <= MEMO_CHARS}
        memo.now.update(short)
        return cut, memo.now if len(short) == len(known) else {**memo.now, **known}


@lru_cache(maxsize=2)
def pair_of(first: str, second: str) -> Pair:
    return Pair(first, second)


def _small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _link_counts(cut: list[list[str]], known: dict[str, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of the aligned texts and how many links hold each."""
    times = Counter(chain.from_iterable(cut))
    links = [known[p][4] for p in times]
    weights = np.repeat(np.fromiter(times.values(), np.int64, len(times)),
                        np.fromiter(map(len, links), np.int64, len(times)) // 8)
    return _summed(np.frombuffer(b"".join(links), np.uint64), weights)


def _summed(pairs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, where, weights)
    return distinct, total


def _partial_sums(first: str, second: str):
    def out(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        pairs, n = _summed(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], ["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, held, size = pair_of(first, second), [], 0
        for batch in _small_batches(batches):
            held.append(_link_counts(*tools.batch(batch.column("t").to_pylist(), tools.memo)))
            size += len(held[-1][0])
            if size > 2 * FLUSH:
                held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size > FLUSH:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)

    return run


def _words(pairs: np.ndarray) -> np.ndarray:
    return pairs.astype(np.int64).view(np.uint64).reshape(-1, 1)


def _build_shard(frame: pd.DataFrame) -> pd.DataFrame:
    table = KeyTable.build(_words(frame["pair"].to_numpy()))
    return pd.DataFrame({"shard": frame["shard"].iloc[:1].to_numpy(), "size": [len(frame)],
                         "hash": [table.function.to_bytes()], "keys": [table.keys.tobytes()]})


def _table(hash_bytes: bytes, keys: bytes) -> KeyTable:
    return KeyTable(PerfectHash.from_bytes(hash_bytes), np.frombuffer(keys, np.uint64).reshape(-1, 1))


def _dense(sums: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    """Dense count vector of a shard from some of its partial sums."""
    names = ["shard", "part", "vector"]
    if not len(sums):
        return pd.DataFrame(columns=names)
    table = _table(shard["hash"].iloc[0], shard["keys"].iloc[0])
    slots = table.slots(_words(sums["pair"].to_numpy()))
    if (slots < 0).any():
        raise RuntimeError("a counted pair is not in the table of distinct pairs")
    vector = np.zeros(len(table.keys), np.int64)
    np.add.at(vector, slots, sums["n"].to_numpy())
    return pd.DataFrame({"shard": sums["shard"].iloc[:1].to_numpy(), "part": sums["part"].iloc[:1].to_numpy(),
                         "vector": [vector.tobytes()]}, columns=names)


def _add_vectors(frame: pd.DataFrame) -> pd.DataFrame:
    vector = sum(np.frombuffer(v, np.int64) for v in frame["vector"])
    return pd.DataFrame({"shard": frame["shard"].iloc[:1].to_numpy(), "part": frame["part"].iloc[:1].to_numpy(),
                         "vector": [vector.tobytes()]})


def count_table(docs: DataFrame, first: str, second: str, shard_pairs: int = SHARD_PAIRS,
                vector_rows: int = VECTOR_ROWS) -> tuple[DataFrame, int]:
    """One row per shard: shard, size, hash, keys (pairs by slot) and counts (by slot), from all of ``t``.

    Also the number that pairs are dealt by; a shard without pairs has no row.
    """
    sums = stored(docs.select("t").mapInArrow(_partial_sums(first, second), "pair long, n long"), "pair-sums")
    distinct = stored(sums.select("pair").distinct(), "pairs")
    shards = max(1, -(-distinct.count() // shard_pairs))
    shard = F.pmod(F.xxhash64("pair"), F.lit(shards)).cast("int")
    keys = stored(distinct.withColumn("shard", shard).groupBy("shard").applyInPandas(
        _build_shard, "shard int, size long, hash binary, keys binary"), "pair-hash")
    # each pair stands once in a task's sums, so the parts of a shard are even
    parts = max(1, -(-sums.count() // (shards * vector_rows)))
    dealt = sums.withColumn("shard", shard).withColumn("part", F.pmod(
        F.xxhash64("pair", "n", F.spark_partition_id()), F.lit(parts)).cast("int"))
    copies = keys.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    vectors = dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(
        _dense, "shard int, part int, vector binary")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        vectors = (vectors.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
                   .groupBy("shard", "part").applyInPandas(_add_vectors, vectors.schema))
    counted = keys.join(vectors.select("shard", F.col("vector").alias("counts")), "shard")
    return stored(counted, "pair-counts"), shards


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Highest count of each second id inside a shard."""
    for batch in batches:
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
            ids, where = np.unique(np.frombuffer(keys, np.uint64) & np.uint64(0xFFFFFFFF), return_inverse=True)
            top = np.zeros(len(ids), np.int64)
            np.maximum.at(top, where, np.frombuffer(counts, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(top)], ["b", "top"])


def _counted(pairs: np.ndarray, table: KeyTable, counts: np.ndarray, top: np.ndarray):
    """Count of each pair, and whether it is the highest of its second id; raises for an unknown pair."""
    slots = table.slots(pairs.reshape(-1, 1))
    if (slots < 0).any():
        raise RuntimeError("a pair of the second pass is not in the table")
    n = counts[slots]
    return n, n == top[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]


RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")
_ARROW = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in (
    "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])


def _digest(groups: tuple[str, ...]) -> str:
    return hashlib.sha256(";".join(groups).encode()).hexdigest()


#: What a worker knows of stretches and their counts, for one table at a time.
_COUNTED: dict[str, Memo] = {}


def _look_up_here(first: str, second: str, shared, run_id: str):
    """Second pass with the whole table at hand; the links of a stretch are looked up when it is aligned."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, (tables, top) = pair_of(first, second), shared.value
        table = KeyTable(PerfectHash.from_bytes(tables[0]), np.frombuffer(tables[1], np.uint64).reshape(-1, 1))
        counts = np.frombuffer(tables[2], np.int64)
        tools.memo = Memo()  # of the first pass
        if run_id not in _COUNTED:
            _COUNTED.clear()
            _COUNTED[run_id] = Memo()

        def counted(found: list[tuple]) -> Iterator[tuple]:
            n_a, n_b, n_groups, texts, links = zip(*found)
            n, best = _counted(np.frombuffer(b"".join(links), np.uint64), table, counts, top)
            sizes = [len(x) // 8 for x in links]
            at = np.cumsum([0, *sizes[:-1]])
            return zip(n_a, n_b, n_groups, sizes, np.add.reduceat(best.astype(np.int64), at).tolist(),
                       np.add.reduceat(n, at).tolist(), texts)

        for batch in _small_batches(batches):
            cut, known = tools.batch(batch.column("t").to_pylist(), _COUNTED[run_id], counted)
            out = []
            for doc, parts in zip(batch.column("doc_id").to_pylist(), cut):
                if parts:
                    *numbers, texts = zip(*map(known.__getitem__, parts))
                    out.append((doc, *map(sum, numbers), _digest(texts)))
                else:
                    out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)],
                                             schema=_ARROW)

    return run


def _send_pairs(first: str, second: str):
    """Second pass beyond the broadcast: the counts so far, and the document's distinct pairs."""
    schema = pa.schema([*[f for f in _ARROW if f.name not in ("n_best", "count_sum")],
                        ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = pair_of(first, second)
        for batch in _small_batches(batches):
            out = []
            cut, known = tools.batch(batch.column("t").to_pylist(), tools.memo)
            for doc, parts in zip(batch.column("doc_id").to_pylist(), cut):
                pairs, times = _link_counts([parts], known)
                n_a, n_b, n_groups, texts, _ = zip(*map(known.__getitem__, parts)) if parts else ((),) * 5
                out.append((doc, sum(n_a), sum(n_b), sum(n_groups), int(times.sum()), _digest(texts) if parts else "",
                            pairs.astype(np.int64), times))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)],
                                             schema=schema)

    return run


def _looked_up(top: np.ndarray):
    def run(sent: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        names = ["row", "n_best", "count_sum"]
        if not len(sent):
            return pd.DataFrame(columns=names)
        n, best = _counted(sent["pair"].to_numpy().view(np.uint64), _table(
            shard["hash"].iloc[0], shard["keys"].iloc[0]), np.frombuffer(shard["counts"].iloc[0], np.int64), top)
        found = pd.DataFrame({"row": sent["row"], "n_best": best * sent["times"], "count_sum": n * sent["times"]})
        return found.groupby("row", as_index=False).sum()[names]

    return run


def align_documents(docs: DataFrame, first: str | None = None, second: str | None = None,
                    broadcast_pairs: int = BROADCAST_PAIRS, shard_pairs: int = SHARD_PAIRS,
                    vector_rows: int = VECTOR_ROWS) -> DataFrame:
    """Alignment of every row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``first`` encodes a space and the text, ``second`` the text. Null and empty texts, and texts that
    one of the two does not give back byte for byte (a literal U+2581, say), have zeros and ''. Rows
    without doc_id and repeated rows count and come back like any other. Texts of any length are read
    whole. Ties for the highest count are all best. An empty table gives an empty result. Other
    columns are ignored.
    """
    first, second = first or tokenizer_path(FIRST), second or tokenizer_path(SECOND)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t"))
    table, shards = count_table(rows, first, second, shard_pairs, vector_rows)
    spark = docs.sparkSession
    # at most one row per id of the second vocabulary
    best = (table.select("keys", "counts").mapInArrow(_highest, "b long, top long")
            .groupBy("b").agg(F.max("top").alias("top")).toPandas())
    top = np.zeros(int(best["b"].max()) + 1 if len(best) else 1, np.int64)
    top[best["b"].to_numpy(np.int64)] = best["top"].to_numpy()
    size = table.agg(F.sum("size")).first()[0] or 0
    if size <= broadcast_pairs:
        parts = table.select("keys", "counts").toPandas()
        keys = np.frombuffer(b"".join(parts["keys"]), np.uint64).reshape(-1, 1)
        counts = np.frombuffer(b"".join(parts["counts"]), np.int64)
        whole = KeyTable.build(keys)
        placed = np.zeros(len(keys), np.int64)
        placed[whole.slots(keys)] = counts
        shared = spark.sparkContext.broadcast(
            ((whole.function.to_bytes(), whole.keys.tobytes(), placed.tobytes()), top))
        return rows.mapInArrow(_look_up_here(first, second, shared, uuid.uuid4().hex), RESULT)
    sent = stored(rows.mapInArrow(_send_pairs(first, second), RESULT.replace(
        "n_best long, count_sum long, ", "") + ", pairs array<long>, times array<long>")
        .withColumn("row", F.monotonically_increasing_id()), "sent-pairs")
    lines = sent.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    parts = max(1, -(-lines.count() // (shards * vector_rows)))
    lines = lines.withColumn("shard", F.pmod(F.xxhash64("pair"), F.lit(shards)).cast("int")).withColumn(
        "part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    copies = table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = (lines.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part"))
             .applyInPandas(_looked_up(top), "row long, n_best long, count_sum long")
             .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    return sent.drop("pairs", "times").join(found, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
