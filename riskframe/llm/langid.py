"""Language identification with hyperdimensional n-gram profiles.

Every letter owns a random vector of +1 and -1. A trigram is the product (binding) of its letters'
vectors, each rotated (permuted) by its place. A text is the sum (bundle) of its trigram vectors,
a language the bundle of its training texts, and a text gets the language of the largest cosine.

Letters are lower-cased; runs of anything else count as one boundary, which takes part in the
trigrams at either end of a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
DIMENSIONS = 1024
#: Code points are taken modulo this prime, so Latin letters never share a vector.
ALPHABET = 1021
SEED = 20240611
#: Texts are bundled in groups of at most so many texts and characters, longer texts in pieces, and
#: trigrams bound so many at a time, which bounds a task's memory.
GROUP_TEXTS = 64
PIECE_CHARS = 1 << 18
SLICE_TRIGRAMS = 4096
#: Rows handed to Python at a time.
ROWS = 256
#: Cosines of unrelated vectors scatter by 1/sqrt(dimensions); so many times that is above their noise.
NOISE_TIMES = 4
#: Share of the held-out labelled texts of a size class below its clean score.
CLEAN_SHARE = 0.001
#: Bounds of the threshold as shares of the clean score.
LEAST_SHARE, MOST_SHARE = 0.25, 0.5


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Letter number of each code point; 0 for anything that is no letter."""
    return np.fromiter((cp % ALPHABET + 1 if chr(cp).isalpha() else 0 for cp in range(0x110000)),
                       np.int32, 0x110000)


@lru_cache(maxsize=2)
def _vectors(dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors, rotated by two, one and no place."""
    base = np.random.default_rng(SEED).integers(0, 2, (ALPHABET + 1, dimensions), np.int8) * 2 - 1
    base = base.astype(np.int8)
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def _bind(codes: np.ndarray, dimensions: int) -> np.ndarray:
    first, second, third = _vectors(dimensions)
    return (first[codes >> 20] * second[(codes >> 10) & 1023] * third[codes & 1023]).astype(np.float32)


def _letter_run(text: str) -> np.ndarray:
    """Letter numbers of the text, lower-cased, with one 0 for each run of anything else and at both ends."""
    parts, at = [np.zeros(1, np.int16)], 0
    while at < len(text):
        end = at + PIECE_CHARS
        while end < len(text) and end > at + PIECE_CHARS // 2 and text[end].isalpha():
            end -= 1  # lower case can depend on neighbours, so words stay whole if they can
        points = np.frombuffer(text[at:end].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        parts.append(_letters()[points].astype(np.int16))
        at = end
    letters = np.concatenate([*parts, parts[0]])
    kept = np.ones(len(letters), bool)
    kept[1:] = (letters[1:] > 0) | (letters[:-1] > 0)
    return letters[kept]


def _groups(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text number, trigram code and count of every distinct trigram, for few texts or a piece of one at a time."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for i, text in enumerate(texts):
        run = _letter_run(text)
        # a trigram belongs to the piece of its middle letter, so pieces overlap by two
        for at in range(0, max(1, len(run) - 2), PIECE_CHARS):
            part = run[at:at + PIECE_CHARS + 2]
            if held and (size + len(part) > PIECE_CHARS or len(held) == GROUP_TEXTS):
                yield _counted(held)
                held, size = [], 0
            held.append((i, part))
            size += len(part)
    if held:
        yield _counted(held)


def _counted(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owners, codes = [], []
    for i, run in held:
        run = run.astype(np.int64)
        middle = np.flatnonzero(run[1:-1] > 0) + 1
        codes.append(run[middle - 1] << 20 | run[middle] << 10 | run[middle + 1])
        owners.append(np.full(len(middle), i))
    keys, counts = np.unique(np.concatenate(owners) << 30 | np.concatenate(codes), return_counts=True)
    return keys >> 30, keys & ((1 << 30) - 1), counts


def _slices(codes: np.ndarray, dimensions: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Vectors of some thousand of the distinct ``codes`` at a time."""
    for at in range(0, len(codes), SLICE_TRIGRAMS):
        end = min(at + SLICE_TRIGRAMS, len(codes))
        yield at, end, _bind(codes[at:end], dimensions)


def bundle(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One vector per text; zero for a text without letters."""
    return _bundles(texts, dimensions)[0]


def _bundles(texts: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Vector and number of distinct trigrams of every text."""
    out, sizes = np.zeros((len(texts), dimensions), np.float32), np.zeros(len(texts), np.int64)
    piecewise: dict[int, np.ndarray] = {}  # codes of texts that come in several pieces
    for owner, codes, counts in _groups(texts):
        here, row = np.unique(owner, return_inverse=True)
        for i in here:
            if len(texts[i]) >= PIECE_CHARS:
                piecewise[i] = np.union1d(piecewise.get(i, codes[:0]), codes[owner == i])
        sizes[here] += np.bincount(row, minlength=len(here))
        distinct, place = np.unique(codes, return_inverse=True)
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(0, len(distinct) + SLICE_TRIGRAMS, SLICE_TRIGRAMS))
        for number, (at, end, bound) in enumerate(_slices(distinct, dimensions)):
            some = order[edges[number]:edges[number + 1]]
            weights = np.zeros((len(here), end - at), np.float32)
            weights[row[some], place[some] - at] = counts[some]
            out[here] += weights @ bound
    for i, codes in piecewise.items():
        sizes[i] = len(codes)
    return out, sizes


def train_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
                   rows_per_language: int = 20_000, dimensions: int = DIMENSIONS) -> dict[str, list[float]]:
    """Prototype vector of each language, from at most about ``rows_per_language`` texts of each.

    Rows without text or language teach nothing. The sample is drawn by a hash of ``key``; all rows
    are taken where a language has fewer. The driver gets languages x dimensions numbers.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"),
                           F.col(lang).cast("string").alias("l")).where("t is not null and l is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    rare = [name for name, n in counts.items() if n <= rows_per_language]
    draw = F.pmod(F.xxhash64("k", F.lit(SEED)), F.lit(1 << 30))
    taken = F.col("l").isin(rare)
    for name, n in counts.items():
        if n > rows_per_language:
            taken = taken | ((F.col("l") == name) & (draw < int(rows_per_language / n * (1 << 30))))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("t").to_pylist(), batch.column("l").to_pylist()
            for name in set(langs):
                for _, codes, n in _groups([t for t, l in zip(texts, langs) if l == name]):
                    distinct, place = np.unique(codes, return_inverse=True)
                    total = np.bincount(place, n, len(distinct)).astype(np.float32)
                    for at, end, bound in _slices(distinct, dimensions):
                        sums[name] = sums.get(name, 0.0) + (total[at:end] @ bound).astype(np.float64)
        yield pa.RecordBatch.from_pydict(
            {"l": pa.array(list(sums), pa.string()),
             "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    cells = (rows.where(taken).select("t", "l").mapInArrow(partial, "l string, v array<double>")
             .select("l", F.posexplode("v").alias("i", "x"))
             .groupBy("l", "i").agg(F.sum("x").alias("x")).collect())
    profiles: dict[str, np.ndarray] = {}
    for cell in cells:
        profiles.setdefault(cell["l"], np.zeros(dimensions))[cell["i"]] = cell["x"]
    return {name: profiles[name].tolist() for name in sorted(profiles) if profiles[name].any()}


def predicted(profiles: dict[str, list[float]], text: str = "text", dimensions: int = DIMENSIONS) -> Column:
    """Struct (lang_pred, score, trigrams): language of the largest cosine, that cosine, 0 at least, and
    the number of distinct trigrams.

    ``und`` with score 0 for a null text, a text without letters, or if there is no profile. Ties go
    to the first language by name.
    """
    names = list(profiles)
    prototypes = np.array([profiles[n] for n in names], np.float64).reshape(len(names), dimensions)
    unit = (prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True)).astype(np.float32)

    @F.pandas_udf("lang_pred string, score double, trigrams long")
    def identify(texts: pd.Series) -> pd.DataFrame:
        if len(texts) <= ROWS:
            return judged(texts)
        return pd.concat([judged(texts.iloc[i:i + ROWS]) for i in range(0, len(texts), ROWS)], ignore_index=True)

    def judged(texts: pd.Series) -> pd.DataFrame:
        vectors, sizes = _bundles([t if isinstance(t, str) else "" for t in texts], dimensions)
        length = np.linalg.norm(vectors, axis=1)
        if not names:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "trigrams": sizes})
        cosine = vectors @ unit.T / np.maximum(length, 1e-9)[:, None]
        best = cosine.argmax(axis=1)
        known = length > 0
        score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(float)
        return pd.DataFrame({"lang_pred": [names[b] if k else UNKNOWN for b, k in zip(best, known)],
                             "score": score, "trigrams": sizes})

    return identify(F.col(text).cast("string"))


def held_out(key: str = "doc_id") -> Column:
    """Rows kept out of training: crc32 of the key as text leaves 2 modulo 4 (false for a null key)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; profiles come from the rows not held out.

    Null text: ``und``, 0. Repeated rows are kept. Other columns, whatever their names, are ignored.
    """
    base = docs.select("doc_id", "text", "lang")
    profiles = train_profiles(base.where(~held_out() & F.col("doc_id").isNotNull()))
    return (base.select("doc_id", held_out().alias("held_out"), predicted(profiles).alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))


def _size_class(verdict: Column) -> Column:
    """Whole part of the binary logarithm of the number of distinct trigrams."""
    return F.floor(F.log2(verdict["trigrams"])).cast("int")


def thresholds(labelled: DataFrame, profiles: dict[str, list[float]]) -> list[float]:
    """Least cosine of a known language for each size class (0 to 31) of texts.

    The clean score of a class is the lowest of its ``labelled`` texts that are identified rightly, but
    for a share of ``CLEAN_SHARE``, and no higher than that of a larger class. The threshold is the
    noise floor, held between ``LEAST_SHARE`` and ``MOST_SHARE`` of the clean score. Classes above the
    largest that has such texts are judged like it, those below the smallest not at all; the noise
    floor alone counts if no class has any. The driver gets at most 32 x 1001 counts.
    """
    floor = NOISE_TIMES / DIMENSIONS ** 0.5
    verdict = predicted(profiles)
    found = labelled.select("lang", verdict.alias("p")).where("p.lang_pred = lang and p.trigrams > 0")
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in (found.groupBy(_size_class(F.col("p")).alias("c"), F.floor(F.col("p.score") * 1000).cast("int").alias("s"))
              .agg(F.count(F.lit(1)).alias("n")).collect()):
        counts.setdefault(r["c"], []).append((r["s"], r["n"]))
    if not counts:
        return [floor] * 32
    out, clean = [0.0] * 32, 1.0
    for c in range(31, min(counts) - 1, -1):
        known = sorted(counts.get(min(c, max(counts)), []))
        if known:
            scores, sizes = np.array(known).T
            clean = min(clean, scores[(np.cumsum(sizes) > CLEAN_SHARE * sizes.sum()).argmax()] / 1000)
        out[c] = float(np.clip(floor, LEAST_SHARE * clean, MOST_SHARE * clean))
    return out


def keep_identified(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """Rows of ``docs``, with their own columns, that are in a known language.

    Texts that are null, hold no letter, or have ``min_chars`` characters and a best cosine below the
    threshold of their size go; the thresholds come from the rows held out. Of shorter texts many clean
    ones score no higher than noise, so the cosine does not count against them.
    """
    rows = docs.select("doc_id", "text", "lang")
    profiles = train_profiles(rows.where(~held_out()))
    verdict = predicted(profiles)
    least = F.get(F.array(*[F.lit(t) for t in thresholds(rows.where(held_out()), profiles)]), _size_class(verdict))
    odd = (F.length("text") >= min_chars) & (verdict["score"] < least)
    return docs.where((verdict["lang_pred"] != UNKNOWN) & ~odd)
