"""SentencePiece ids by streaming Viterbi, and back.

A text is read left to right. Only the scores of the last ``longest`` positions are kept, for no
piece reaches further back; pieces are committed as soon as the backpointers of all positions that
can still be extended meet at one boundary. Where no piece of the vocabulary holds a non-space
before a space mark, all paths meet at every space, so each word with its leading spaces is a stretch
of its own, and repeated stretches come from a bounded memo. The same
holds between any two characters that no piece has side by side.

Pieces and scores are those of the model file; the best path is the one of the largest score sum,
ties going to the longer last piece. Unknown characters, and a literal U+2581, become byte pieces, so that
every text decodes to itself.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
MARK = "▁"
#: Stands for a literal MARK of the text; no valid text holds a lone surrogate.
LITERAL = "\ud800"
#: Stretches remembered per Python worker; the memo is emptied when full.
MEMO = 250_000
#: Longer stretches are not remembered.
MEMO_CHARS = 64
#: Texts handed on at a time.
ROWS = 256


class Vocabulary:
    """Pieces, scores and bytes of a model file."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = range(sp.get_piece_size())
        names = [sp.id_to_piece(i) for i in size]
        plain = [i for i in size if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.scores = {names[i]: sp.get_score(i) for i in plain}
        self.byte_ids = {int(names[i][1:-1], 16): i for i in size if sp.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self.unknown_score = min(self.scores.values()) - 10
        to_byte = {i: b for b, i in self.byte_ids.items()}
        self.bytes = [bytes([to_byte[i]]) if i in to_byte
                      else names[i].replace(MARK, " ").encode() if i in set(plain) or names[i] in self.ids
                      else b"" for i in size]
        #: True if paths always meet before a space that follows something else
        self.words_apart = not any(MARK in name.lstrip(MARK) for name in self.ids)
        #: character -> (next characters, score of the piece that ends here)
        self.trie: dict = {}
        for name, score in self.scores.items():
            branch = self.trie
            for char in name[:-1]:
                branch = branch.setdefault(char, ({}, None))[0]
            branch[name[-1]] = (branch.get(name[-1], ({}, None))[0], score)
        #: neighbours inside a piece; all paths meet between two characters that never are
        self.pairs = {name[i:i + 2] for name in self.ids for i in range(len(name) - 1)}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def keep(self, key: str, known: bytes) -> None:
        """Remember; a full memo becomes the older one, from which used entries come back."""
        if len(self.memo) >= MEMO:
            self.older, self.memo = self.memo, {}
        self.memo[key] = known

    def fallback(self, char: str) -> list[int]:
        raw = MARK.encode() if char == LITERAL else char.encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in raw]


@lru_cache(maxsize=2)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def stream(chars: str, vocab: Vocabulary) -> Iterator[int]:
    """Ids of the best segmentation of ``chars`` (spaces as marks), in order, as they become certain."""
    longest, unknown, never, ids = vocab.longest, vocab.unknown_score, float("-inf"), vocab.ids
    best = [0.0] + [never] * longest  # scores of the best paths to the positions from ``low`` on
    low = done = 0
    back = [0] * longest  # their last boundaries, for the positions after the last commit
    check, trie = 2 * longest, vocab.trie

    def pieces(path: list[int]) -> Iterator[int]:
        for start, end in zip(path, path[1:]):
            piece = chars[start:end]
            if piece in ids:
                yield ids[piece]
            else:
                yield from vocab.fallback(piece)

    def path_to(end: int) -> list[int]:
        path = [end]
        while path[-1] != done:
            path.append(back[path[-1] - done - 1])
        return path[::-1]

    for start in range(len(chars)):
        if start >= check:
            # every piece from here on starts at one of the window's positions
            paths = [path_to(p) for p in range(start - longest + 1, start + 1)]
            meet = 0
            while all(len(p) > meet + 1 and p[meet + 1] == paths[0][meet + 1] for p in paths):
                meet += 1
            if meet:
                yield from pieces(paths[0][:meet + 1])
                back = back[paths[0][meet] - done:]
                done = paths[0][meet]
            best, low = best[start - low:], start
            check = max(start + longest, done + 2 * longest)
        score = best[start - low]
        best.append(never)
        back.append(0)
        branch = trie
        for end, char in enumerate(chars[start:start + longest], start + 1):
            found = branch.get(char)
            if found is None:
                break
            branch, own = found
            if own is not None and score + own > best[end - low]:
                best[end - low], back[end - done - 1] = score + own, start
        if chars[start] not in ids and score + unknown > best[start + 1 - low]:
            best[start + 1 - low], back[start - done] = score + unknown, start
    if len(chars) > done:
        yield from pieces(path_to(len(chars)))


def _stretches(text: str, vocab: Vocabulary) -> Iterator[str]:
    """Cut the text, with a leading space, before every space that follows something else."""
    words = text.split(" ")
    if not vocab.words_apart:
        yield " " + text
        return
    spaces = 0
    for word in words:
        spaces += 1
        if word:
            yield " " * spaces + word
            spaces = 0
    if spaces:
        yield " " * spaces


def encode(text: str | None, vocab: Vocabulary) -> np.ndarray:
    """Ids of a text; none for null or empty."""
    if not text:
        return np.zeros(0, np.int32)
    memo = vocab.memo
    # usual case: single spaces, so words alone are the keys
    words = text.split(" ")
    if vocab.words_apart and "" not in words:
        found = list(map(memo.get, words))
        if None in found:
            found = [_remember(w, " " + w, vocab) if f is None else f for w, f in zip(words, found)]
    else:
        found = [_remember(s, s, vocab) for s in _stretches(text, vocab)]
    return np.frombuffer(b"".join(found), np.int32)


def _remember(key: str, stretch: str, vocab: Vocabulary) -> bytes:
    known = vocab.memo.get(key) or vocab.older.get(key)
    if known is None:
        chars = stretch.replace(MARK, LITERAL).replace(" ", MARK)
        if chars[1:].isalpha():  # letters are seldom apart
            known = array("i", stream(chars, vocab)).tobytes()
        else:
            cuts = [i for i in range(1, len(chars)) if chars[i - 1:i + 1] not in vocab.pairs]
            parts = [chars[a:b] for a, b in zip([0, *cuts], [*cuts, len(chars)])]
            known = b"".join([_remember_part(p, vocab) for p in parts])
    if len(key) <= MEMO_CHARS:
        vocab.keep(key, known)
    return known


def _remember_part(chars: str, vocab: Vocabulary) -> bytes:
    key = "\0" + chars  # no clash with whole stretches
    known = vocab.memo.get(key) or vocab.older.get(key)
    if known is None:
        known = array("i", stream(chars, vocab)).tobytes()
    if len(chars) <= MEMO_CHARS:
        vocab.keep(key, known)
    return known


def decode(ids: list[int], vocab: Vocabulary) -> str:
    """Text of ids; the space that encoding puts in front is taken off."""
    raw = b"".join(map(vocab.bytes.__getitem__, ids))
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a worker holds the ids of few texts at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield batch.slice(low, ROWS)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))


def encode_column(df: DataFrame, text: str = "text", out: str = "ids", model: str = MODEL) -> DataFrame:
    """``df`` with the column ``text`` replaced by ``out``, an array of ids, at the end.

    Null and empty texts give no ids. All other columns and repeated rows stay; a column that has
    the name ``out`` is replaced.
    """
    rest = [c for c in df.columns if c not in (text, out)]
    rows = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in _small(batches):
            parts = [encode(t, vocab) for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], _lists(parts)], names=[*rest, out])

    schema = T.StructType([*rows.schema.fields[:len(rest)], T.StructField(out, T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)


def decode_column(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` with ``out``, the text of the ids, at the end; null ids give empty text."""
    rest = [c for c in df.columns if c != out]
    rows = df.select(*[F.col(f"`{c}`") for c in rest])
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in _small(batches):
            column = batch.column(at).fill_null(pa.scalar([], batch.column(at).type))
            flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
            texts = [decode(flat[a:b].tolist(), vocab) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*rest, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_ids, round_trip (the ids decode to the text) of every row; null text as empty.

    Encoding and decoding share one pass, so that an executor needs one Python worker a core.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in _small(batches):
            texts = batch.column("text").to_pylist()
            ids = [encode(t, vocab) for t in texts]
            same = [decode(i.tolist(), vocab) == t for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _lists(ids), pa.array(same, pa.bool_())], names=["doc_id", "ids", "same"])
        # the worker may go on with other work: it keeps the newer memo only
        vocab.older = {}
        pa.default_memory_pool().release_unused()

    schema = T.StructType([rows.schema.fields[0], T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("same", T.BooleanType())])
    return rows.mapInArrow(run, schema).select(
        "doc_id", "ids", F.size("ids").alias("n_ids"), F.col("same").alias("round_trip"))
