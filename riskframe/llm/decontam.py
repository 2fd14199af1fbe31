"""Benchmark decontamination: size-partitioned MinHash containment search.

A short test item inside a long document has a tiny Jaccard similarity to it, so items are
partitioned by size (powers of two of distinct shingles) and every document is looked at through
overlapping windows matched to each partition: twice its largest item, moved by that item's size.
Any passage of an item's length lies whole in one window, whose similarity to the item is bounded
from below by 0.8 / 4.2. Window and item are compared by a one-permutation MinHash of 256 bins; one
equal bin makes a candidate. Candidates are verified by exact containment of shingle texts.

A bitmap of the items' shingle hashes lets a document without any of them skip the windows, which
cannot change the result. Words are lower-cased runs of letters, digits and non-ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import stored

WORDS = 5
THRESHOLD = 0.8
#: log2 of the bins of a signature; large enough that an item's shingles rarely share a bin.
BIN_BITS = 8
#: Bitmaps have 128 bits or more per item shingle, 2^22 to 2^27 bits in all; a fuller one only passes more.
LEAST_BITS, MOST_BITS = 22, 27
#: Item tables of at most so many shingles (60 bytes each) are broadcast.
BROADCAST_ROWS = 200_000
#: Bytes hashed, and texts looked at, at once.
PIECE = 1 << 18
ROWS = 512

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word; ``begins`` are the first bytes of the texts."""
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = begins[begins < len(data)]
    first[begins] = inside[begins]
    last[begins[begins > 0] - 1] = inside[begins[begins > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        # words that end within one piece of the text; a longer word is a piece of its own
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        size = 1 << max(PIECE.bit_length() - 1, (high - low).bit_length())
        up, down = _powers(int(_BASE), size), _powers(int(_INVERSE), size)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[:high - low], out=sums[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        hashes[at:to] = _mixed((sums[b] - sums[a]) * down[a])
        at = to
    return starts, ends, hashes


class _Texts:
    """Shingles of a batch of texts: hash, first word and last word, text by text."""

    def __init__(self, column: pa.Array):
        lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
        offsets = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset:lowered.offset + len(lowered) + 1]
        raw = lowered.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        self.starts, self.ends, words = _words(self.data, offsets[:-1])
        edges = np.searchsorted(self.starts, offsets)
        counts = np.diff(edges)
        n = max(0, len(words) - WORDS + 1)
        total = np.zeros(n, np.uint64)
        for k in range(WORDS):
            total = total * _STEP + words[k:k + n]
        hashes = _mixed(total)
        owner = np.repeat(np.arange(len(counts)), counts)
        full = owner[:n] == owner[WORDS - 1:WORDS - 1 + n] if n else np.zeros(0, bool)
        # a text of fewer words is one shingle
        few = np.flatnonzero((counts > 0) & (counts < WORDS))
        short = np.zeros(len(few), np.uint64)
        for k in range(WORDS - 1):
            has = counts[few] > k
            short[has] = short[has] * _STEP + words[edges[few[has]] + k]
        at = np.concatenate([np.flatnonzero(full), edges[few]])
        order = np.argsort(at, kind="stable")
        self.hash = np.concatenate([hashes[full], _mixed(short + counts[few].astype(np.uint64))])[order]
        self.word = at[order]
        self.size = np.concatenate([np.full(full.sum(), WORDS), counts[few]])[order]
        self.owner = owner[self.word] if len(owner) else np.zeros(0, np.int64)

    def shingle(self, i: int) -> str:
        words = range(self.word[i], self.word[i] + self.size[i])
        return b" ".join(self.data[self.starts[w]:self.ends[w]].tobytes() for w in words).decode()


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield batch.slice(low, ROWS)


def item_shingles(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, h, shingle: the distinct shingles of every item. Null or wordless texts have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            texts = _Texts(batch.column("t"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(texts.owner)), pa.array(texts.hash.view(np.int64)),
                 pa.array([texts.shingle(i) for i in range(len(texts.hash))], pa.string())],
                names=["item_id", "h", "shingle"])

    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item_id"),
                                                      F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "item_id long, h long, shingle string").distinct()


def _bitmap(shingles: DataFrame) -> tuple[np.ndarray, int]:
    bits = min(MOST_BITS, max(LEAST_BITS, (128 * shingles.count()).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1).cast("long")) + 1
    parts = (shingles.groupBy(F.bitmap_bucket_number(slot).alias("b"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).collect())
    out = np.zeros((1 << bits) // 8, np.uint8)
    for part in parts:
        piece = np.frombuffer(part["m"], np.uint8)
        at = (part["b"] - 1) * len(piece)
        out[at:at + len(piece)] = piece
    return out, bits


def _marks(docs: DataFrame, bitmap: np.ndarray, bits: int, classes: list[int]) -> DataFrame:
    """Window minima (doc_id, class, h) and shingles (doc_id, -1, h, shingle) that may be an item's."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def present(hashes: np.ndarray) -> np.ndarray:
        slot = hashes & np.uint64((1 << bits) - 1)
        return (held.value[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def minima(hashes: np.ndarray, hits: np.ndarray, step: int) -> np.ndarray:
        """Bin minima of the windows that hold a hit."""
        windows = np.unique(np.concatenate([hits // step, np.maximum(hits // step - 1, 0)]))
        at = windows[:, None] * step + np.arange(2 * step)[None, :]
        inside = at < len(hashes)
        held_in = np.where(inside, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(2**64 - 1))
        held_in.sort(axis=1)
        bins = held_in >> np.uint64(64 - BIN_BITS)
        least = np.ones(held_in.shape, bool)
        least[:, 1:] = bins[:, 1:] != bins[:, :-1]
        return np.unique(held_in[least])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            texts = _Texts(batch.column("t"))
            hit = np.flatnonzero(present(texts.hash))
            doc, cls, h, shingle = [], [], [], []
            edges = np.searchsorted(texts.owner, np.unique(texts.owner[hit]))
            for low in edges:
                who = texts.owner[low]
                high = int(np.searchsorted(texts.owner, who, "right"))
                own = texts.hash[low:high]
                mine = hit[np.searchsorted(hit, low):np.searchsorted(hit, high)]
                _, once = np.unique(texts.hash[mine], return_index=True)
                for i in mine[once]:
                    doc.append(who), cls.append(-1), h.append(texts.hash[i]), shingle.append(texts.shingle(i))
                for c in classes:
                    least = minima(own, mine - low, 2 << c)
                    least = least[present(least)]
                    doc.extend([who] * len(least)), cls.extend([c] * len(least)), h.extend(least)
                    shingle.extend([None] * len(least))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(cls, pa.int32()),
                 pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(shingle, pa.string())],
                names=["doc_id", "class", "h", "shingle"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, class int, h long, shingle string")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every pair at ``threshold`` or more.

    Containment is the share of an item's distinct shingles that the whole document has. Null, empty
    and wordless texts are in no pair, nor are rows without id; rows that repeat an id count as one
    text. Empty tables give an empty result. Other columns, whatever their names, are ignored.
    """
    shingles = stored(item_shingles(items), "items")
    sizes = shingles.groupBy("item_id").agg(F.countDistinct("shingle").alias("n_item"))
    sizes = stored(sizes.withColumn("class", F.floor(F.log2("n_item")).cast("int")), "sizes")
    # the bin is the top bits, so the signed minimum within a bin is the unsigned one
    signature = (shingles.join(sizes, "item_id")
                 .groupBy("item_id", "class", F.shiftright("h", 64 - BIN_BITS).alias("bin"))
                 .agg(F.min("h").alias("h")).drop("bin"))
    bitmap, bits = _bitmap(shingles)
    classes = sorted(r["class"] for r in sizes.select("class").distinct().collect())
    marks = stored(_marks(docs, bitmap, bits, classes), "marks")
    small = F.broadcast if shingles.count() <= BROADCAST_ROWS else (lambda df: df)
    candidates = (marks.where("class >= 0").join(small(signature), ["class", "h"])
                  .select("doc_id", "item_id").distinct())
    shared = (marks.where("class < 0").select("doc_id", "shingle")
              .join(small(shingles.select("item_id", "shingle")), "shingle")
              .groupBy("doc_id", "item_id").agg(F.countDistinct("shingle").alias("n_shared")))
    return (shared.join(candidates, ["doc_id", "item_id"]).join(small(sizes.drop("class")), "item_id")
            .withColumn("containment", F.col("n_shared") / F.col("n_item"))
            .where(F.col("containment") >= threshold)
            .select("doc_id", "item_id", "n_shared", "n_item", "containment"))


def keep_uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs``, with their own columns, that hold no benchmark item."""
    found = contaminated(docs.select("doc_id", "text"), items).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, docs["doc_id"] == F.col("_found"), "left_anti")


SQL = rf"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w
           FROM documents),
b AS (SELECT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w
      FROM benchmark),
ds AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - {WORDS - 2}, 2)),
         lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) AS s FROM d WHERE len(w) > 0),
bs AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - {WORDS - 2}, 2)),
         lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n_item FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item,
       count(*) / any_value(n_item) AS containment
FROM ds JOIN bs ON ds.s = bs.s JOIN n ON n.id = bs.id
GROUP BY 1, 2 HAVING count(*) / any_value(n_item) >= {THRESHOLD}
"""
