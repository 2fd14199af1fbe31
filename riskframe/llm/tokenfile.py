"""Token ids in compressed blocks: an adaptive context-mixing range coder.

Ids are cut into blocks of 4096 that are coded on their own, so any block can be decoded alone and is
checked by its CRC-32. Three models predict the next id inside a block: the id last seen after the
same two ids (order 2), after the same id (order 1), and the majority of the ids so far (order 0). A symbol
says which prediction holds, or else the bit length of the id; its distribution mixes adaptive
counts of order 0 with counts chosen by the confidence of the order-1 and order-2 predictions. The
remaining bits of an unpredicted id follow at equal probability. Symbols drive a range coder.

Many blocks are coded at once. Decoding, every numpy operation advances all blocks of a batch by one id.
Encoding, predictions and tables are looked up ahead, and only the range coder goes id by id.

A block is ``TID1``, counts, checksum, a table of the documents' shares of the block, and the coded
bytes. Files are Parquet tables with a block a row and columns to seek by (part, seq, at, n).
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from riskframe.llm.common import new_path, tokenizer_path

TOKENIZER = tokenizer_path("byte_bpe_50k.json")
END = 0
BLOCK = 4096
#: Blocks coded side by side; a task holds so many times BLOCK ids.
LANES = 2048
_HEADER = struct.Struct("<4sIIII")  # mark, ids, shares, bytes of payload, CRC-32 of the ids
_SHARE = np.dtype([("no", "<u8"), ("doc_id", "<i8"), ("n", "<u4"), ("last", "u1")])

_SLOTS = 1024
_SYMBOLS = 20  # three predictions, then bit lengths 0 to 16
_WIDTH = 32  # running sums of a table; those after the total are never reached
_TRUST = 3  # levels of confidence of a prediction
_PAIRS = _TRUST * _TRUST
_GAIN, _EVERY = 16, 64
#: The coder works on 48 bits and shifts out 16; spans lie above 2^32 before an id is coded, so that its
#: symbol and its bits, 15 each, need no shift between. Its numbers are whole doubles below 2^53. Floors of
#: their quotients are exact: one that is no whole number lies 2^-48 of itself or more below the next.
_TOP, _FULL, _DIGIT = 2.0 ** 32, 2.0 ** 48 - 1, 2.0 ** 16

_BIT_LENGTH = np.array([i.bit_length() for i in range(1 << 16)])
_PLAIN = (3 + _BIT_LENGTH).astype(np.int8)
#: Bits that follow a symbol: none after a prediction, else all below the id's highest.
_EXTRA = np.maximum(np.arange(_SYMBOLS) - 4, 0)
_PART = 0.5 ** _EXTRA
_REST = 2.0 ** _EXTRA - 1
#: Smallest id of each symbol that is no prediction; from these the bits that follow are counted.
_LEAST = np.where(np.arange(_SYMBOLS) < 4, 0, 1 << _EXTRA)


class _Tables:
    """Symbol tables of a batch of blocks that start together, one for each pair of confidences.

    Tables are mixed anew from the counts after 8, 16, 32 and then every 64 ids. The running sums of a
    table lie side by side, so that all looks into one fall into the same line of the CPU's cache; a
    total stays below 21,000, as counts are cut by a quarter whenever 1024 at most are added.
    """

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.rows = _TRUST * _TRUST * lanes
        self.counts = np.zeros((_SYMBOLS, _TRUST, _TRUST, lanes), np.int16)
        self.new = np.zeros(self.counts.size, np.int16)
        self.sums = np.zeros((_SYMBOLS + 1, self.rows), np.int16)
        self.table = np.full((self.rows, _WIDTH), np.iinfo(np.int16).max, np.int16)
        self.flat = self.table.reshape(-1)
        self.steps = 0
        self._mix()

    def _mix(self) -> None:
        """Distribution by both confidences: counts of that pair, of either alone, and of order 0."""
        self.counts -= self.counts >> 2
        self.counts += self.new.reshape(self.counts.shape)
        self.new[:] = 0
        two = self.counts.sum(axis=2, keepdims=True, dtype=np.int16)
        one = self.counts.sum(axis=1, keepdims=True, dtype=np.int16)
        freq = self.counts << 1
        freq += two
        freq += one
        freq += (two.sum(axis=1, keepdims=True, dtype=np.int16) >> 1) + 1
        for s, line in enumerate(freq.reshape(_SYMBOLS, -1)):
            np.add(self.sums[s], line, out=self.sums[s + 1])
        self.table[:, :_SYMBOLS + 1] = self.sums.T

    def look(self, at: np.ndarray) -> np.ndarray:
        return self.flat.take(at, mode="clip")

    def until_mix(self) -> int:
        """Ids of each block that are still to be counted before the tables change."""
        return next((n for n in (8, 16, 32) if self.steps < n), self.steps - self.steps % _EVERY + _EVERY) - self.steps

    def count(self, seen: np.ndarray, steps: int = 1) -> None:
        np.add.at(self.new, seen, np.int16(_GAIN))
        self.steps += steps
        if self.steps % _EVERY == 0 or self.steps in (8, 16, 32):
            self._mix()


class _Major:
    """The majority of the ids so far of each block, and by how many ids it leads."""

    def __init__(self, lanes: int):
        self.id, self.lead = np.zeros(lanes, np.uint32), np.zeros(lanes, np.int16)

    def learn(self, x: np.ndarray) -> None:
        major, lead = self.id[:len(x)], self.lead[:len(x)]
        lead += (major == x).astype(np.int16) * np.int16(2) - np.int16(1)
        major += (x - major) * (lead < 0).astype(np.uint32)  # a lost lead of -1 becomes the new id's of 1
        np.abs(lead, out=lead)


def _slots(last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the contexts of order 2 and order 1."""
    last = last * np.uint32(40503)
    return (last + before * np.uint32(30011) >> 5) & (_SLOTS - 1), (last >> 4) & (_SLOTS - 1)


class _Memory:
    """Predictions of each block by the ids last seen in the contexts, for ids that come one by one."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        #: of order 2 and of order 1: the id last seen in a context, times four, plus the trust in it: 2 if
        #: it was predicted rightly when it was last seen, else 1
        self.entries = [np.zeros(lanes * _SLOTS, np.uint32) for _ in range(2)]
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def predict(self, k: int) -> None:
        # blocks of one language use the same contexts often, so those of all lanes lie side by side
        self.slot = [slot.astype(np.intp) * len(self.lane) + self.lane[:k]
                     for slot in _slots(self.last[:k], self.before[:k])]
        self.entry = [e.take(slot, mode="clip") for e, slot in zip(self.entries, self.slot)]
        self.guess = [e >> 2 for e in self.entry]
        self.pair = ((self.entry[0] & 3) * np.uint32(_TRUST) + (self.entry[1] & 3)).astype(np.intp)

    def learn(self, x: np.ndarray) -> None:
        fresh = x * np.uint32(4) + np.uint32(1)
        for entries, slot, guess in zip(self.entries, self.slot, self.guess):
            entries[slot] = fresh + (guess == x).astype(np.uint32)
        self.before[:len(x)] = self.last[:len(x)]
        self.last[:len(x)] = x


def _known_ahead(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``_Memory`` says of whole blocks, a row each: pair of trusts, and 0 to 2 if an id is predicted
    by order 2, else by order 1, or by neither. The id before an id in its context stands next to it
    when a block is sorted by context, so no step has to wait for another."""
    last, before = np.zeros(ids.shape, np.uint32), np.zeros(ids.shape, np.uint32)
    last[:, 1:], before[:, 2:] = ids[:, :-1], ids[:, :-2]
    base = (np.arange(len(ids)) * ids.shape[1])[:, None]
    flat, found, bits = ids.reshape(-1), [], ids.shape[1].bit_length()
    place = np.arange(ids.shape[1], dtype=np.uint32 if bits <= 22 else np.uint64)
    for slot in _slots(last, before):
        keys = np.sort(slot.astype(place.dtype) << bits | place, axis=1)
        order, slot = (keys & ((1 << bits) - 1)).astype(np.intp) + base, keys >> bits
        x = flat.take(order)
        same = np.zeros(ids.shape, bool)
        np.equal(slot[:, 1:], slot[:, :-1], out=same[:, 1:])
        right = x == 0  # an empty place guesses id 0, without any trust
        right[:, 1:] = np.where(same[:, 1:], x[:, 1:] == x[:, :-1], right[:, 1:])
        state = np.zeros(ids.shape, np.uint8)
        state[:, 1:] = (right[:, :-1].view(np.uint8) + np.uint8(1)) * same[:, 1:].view(np.uint8)
        state |= (right & same).view(np.uint8) << 2
        back = np.empty(ids.size, np.uint8)
        back[order] = state
        found.append(back.reshape(ids.shape))
    two, one = found
    miss = np.where(two > 3, np.uint8(0), np.uint8(2) - (one >> 2))
    return (two & 3) * np.uint8(_TRUST) + (one & 3), miss


def _lengths(blocks: list) -> tuple[np.ndarray, np.ndarray]:
    """Order of the blocks by falling length, and how many are still running at each step."""
    sizes = np.array(blocks)
    order = np.argsort(-sizes, kind="stable")
    running = np.searchsorted(-sizes[order], -np.arange(sizes.max() if len(sizes) else 0), "left")
    return order, running


#: Marks a place where no digit was put out; digits have 16 bits and a carry.
_NONE = np.uint32(1 << 31)


def _payloads(digits: np.ndarray) -> list[bytes]:
    """Bytes of each block from the digits put out by step, of a block a row, with their carries passed on."""
    rows = np.ascontiguousarray(digits)
    some = rows < _NONE
    ends = np.cumsum(some.sum(axis=1)).tolist()
    digit = rows[some]
    over = np.flatnonzero(digit >> 16)
    while len(over):  # a block's first digit has no carry
        digit[over] &= 0xFFFF
        digit[over - 1] += 1
        over = over[digit[over - 1] >> 16 > 0] - 1
    coded = digit.astype(">u2")
    return [coded[i:j].tobytes() for i, j in zip([0, *ends], ends)]


#: Steps and blocks that are looked up in one go.
_AHEAD, _TOGETHER = 8, 16


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Code blocks of ids below 65536, each on its own."""
    if not blocks:
        return []
    order, running = _lengths([len(b) for b in blocks])
    m, longest = len(blocks), len(running)
    ids, pairs = np.zeros((longest, m), np.uint16), np.zeros((longest, m), np.uint8)
    symbols = np.zeros((longest, m), np.int8)
    for start in range(0, m, _TOGETHER):
        columns = order[start:start + _TOGETHER]
        some = np.zeros((len(columns), longest), np.uint16)
        for row, i in enumerate(columns):
            some[row, :len(blocks[i])] = blocks[i]
        pair, symbol = _known_ahead(some)
        part = slice(start, start + len(columns))
        ids[:, part], pairs[:, part], symbols[:, part] = some.T, pair.T, symbol.T
    tables, major = _Tables(m), _Major(m)
    low, span = np.zeros(m), np.full(m, _FULL)
    # two digits at most of an id, and three at the end
    digits = np.full((2 * longest + 3, m), _NONE)

    def put(line: int, which: np.ndarray) -> None:
        now = low.take(which)
        digit = np.floor(now * (1 / _TOP))
        digits[line][which] = digit.astype(np.uint32)
        low[which] = (now - digit * _TOP) * _DIGIT

    step = 0
    while step < longest:
        k = running[step]
        stop = min(step + min(_AHEAD, tables.until_mix()), longest)
        while running[stop - 1] < k:
            stop -= 1
        x, symbol = ids[step:stop, :k].astype(np.uint32), symbols[step:stop, :k]
        for line, now in zip(x, symbol):
            wrong = ((major.lead[:k] <= 0) | (major.id[:k] != line)).view(np.int8)
            now += (now == 2).view(np.int8) * wrong
            major.learn(line)
        x = x.astype(np.intp)
        symbol = np.where(symbol > 2, _PLAIN.take(x), symbol).astype(np.intp)
        row = pairs[step:stop, :k].astype(np.intp) * m + tables.lane[:k]
        at = row * _WIDTH
        total = tables.look(at + _SYMBOLS).astype(np.float64)
        at += symbol
        start, end = tables.look(at), tables.look(at + 1)
        width, start = (end - start).astype(np.float64), start.astype(np.float64)
        rest = (x - _LEAST.take(symbol)) * (symbol > 2)
        share, rest = _PART.take(symbol), rest.astype(np.float64)
        for i in range(stop - step):
            part = np.floor(span[:k] / total[i])
            own = np.floor(part * width[i] * share[i])
            now = low[:k]
            now += part * start[i] + own * rest[i]
            span[:k] = own
            which = np.flatnonzero(own < _TOP)
            own = own.take(which)
            for line in (2 * (step + i), 2 * (step + i) + 1):
                if len(which):
                    put(line, which)
                    own *= _DIGIT
                    span[which] = own
                    short = own < _TOP
                    which, own = which[short], own[short]
        tables.count((row + symbol * tables.rows).reshape(-1), stop - step)
        step = stop
    for line in (-3, -2, -1):
        put(line, tables.lane)
    out: list[bytes] = [b""] * m
    for first in range(0, m, _TOGETHER):
        for i, payload in zip(order[first:], _payloads(digits[:, first:first + _TOGETHER].T)):
            out[i] = payload
    return out


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """Ids of coded blocks of the given numbers of ids."""
    if not payloads:
        return []
    order, running = _lengths(sizes)
    m, longest = len(payloads), len(running)
    data = np.zeros((m, max(map(len, payloads)) // 2 + 8), np.uint16)
    for row, i in enumerate(order):
        data[row, :len(payloads[i]) // 2] = np.frombuffer(payloads[i], ">u2")
    tables, memory, major = _Tables(m), _Memory(m), _Major(m)
    code, span = np.zeros(m), np.full(m, _FULL)
    for j in range(3):
        code = code * _DIGIT + data[:, j]
    place = np.arange(m) * data.shape[1] + 3
    data = data.reshape(-1)
    ids = np.zeros((longest, m), np.uint16)

    for step, k in enumerate(running):
        memory.predict(k)
        row = memory.pair * m + tables.lane[:k]
        sums = tables.table.take(row, axis=0, mode="clip")
        total = sums[:, _SYMBOLS].astype(np.float64)
        now = code[:k]
        part = np.floor(span[:k] / total)
        value = np.minimum(np.floor(now / part), total - 1).astype(np.int16)
        # the symbol's share begins at the last sum up to the value: count these sums, eight bytes at a time
        below = (sums <= value[:, None]).view(np.uint64)
        below = below[:, 0] + below[:, 1] + below[:, 2] + below[:, 3]
        symbol = (below * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.intp) - 1
        at = tables.lane[:k] * _WIDTH + symbol
        sums = sums.reshape(-1)
        start = sums.take(at, mode="clip")
        width = sums.take(at + 1, mode="clip") - start
        own = np.floor(part * width.astype(np.float64) * _PART.take(symbol, mode="clip"))
        now -= part * start.astype(np.float64)
        rest = np.minimum(np.floor(now / own), _REST.take(symbol, mode="clip"))
        now -= rest * own
        span[:k] = own
        which = np.flatnonzero(own < _TOP)
        own = own.take(which)
        while len(which):
            spot = place.take(which)
            now[which] = now.take(which) * _DIGIT + data.take(spot, mode="clip").astype(np.float64)
            place[which] = spot + 1
            own *= _DIGIT
            span[which] = own
            short = own < _TOP
            which, own = which[short], own[short]
        plain = (_LEAST.take(symbol, mode="clip") + rest.astype(np.intp)).astype(np.uint32)
        known = np.concatenate([*memory.guess, major.id[:k], plain])
        x = known.take(np.minimum(symbol, 3) * k + tables.lane[:k], mode="clip")
        ids[step, :k] = x
        memory.learn(x)
        major.learn(x)
        tables.count(row + symbol * tables.rows)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * m
    for column, i in enumerate(order):
        out[i] = ids[:sizes[i], column]
    return out


#: The characters that stand for bytes in the library's vocabulary.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SHOWN} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Words that begin with a letter and have only letters of the Latin blocks, marks of ASCII but the
#: apostrophe, and single line feeds inside, and the pieces the library's splitting cuts them into.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-&(-/:-@\[-`{-~"
_PLAIN_WORD = re.compile(rf"[{_LETTERS}](?:[{_LETTERS}{_MARKS}]|\n(?=\S))*")
_PIECE = re.compile(rf"[{_LETTERS}]+|[{_MARKS}]+|\n")


class _Tokens:
    """Ids of texts by the tokenizers library, which sees each distinct word once.

    The library's own word splitting always breaks at a single space between two characters that are
    no white space, and the space goes to the word behind it. So words between such spaces can be
    encoded apart, or in any such row, where a token that begins with a space starts a word. Plain
    words are cut into runs of letters and of marks, as the library does, and these go straight to the
    library's BPE model. Words are remembered; a full memo becomes the older one, from which used words
    come back.
    """

    MEMO = 600_000
    PARTS = 200_000
    ROW = 500

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        self.library = Tokenizer.from_file(path)
        pieces = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        self.starts = np.array([p.startswith("\u0120") for p in pieces])
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: pieces of words that have no space before them
        self.parts: dict[str, bytes] = {}
        self.marks = dict(zip(",.;:!?", self._encode(list(",.;:!?"))))
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        split, added = settings["pre_tokenizer"] or {}, [t["content"] for t in settings["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        #: the library splits as described, and no added token can lie in a word of letters
        self.direct = (settings["normalizer"] is None and split.get("type") == "ByteLevel"
                       and split.get("use_regex", True) and not split.get("add_prefix_space", True)
                       and not any(t.rstrip(",.;:!?").isalpha() or not t.strip(",.;:!?") for t in added))
        self.model = self.library.model
        if self.direct and settings["model"]["type"] == "BPE":
            # the same model without the cache of its own, which would mostly hold words that are remembered here
            plain = {k: v for k, v in settings["model"].items()
                     if v is not None and k not in ("type", "vocab", "merges")}
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in settings["model"]["merges"]]
            self.model = models.BPE(settings["model"]["vocab"], merges, cache_capacity=0, **plain)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("H", e.ids).tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that stand apart, each with the space before it."""
        out: list[bytes] = []
        rows = [words[i:i + self.ROW] for i in range(0, len(words), self.ROW)]
        for row, coded in zip(rows, self._encode([" " + " ".join(r) for r in rows])):
            cuts = (2 * np.flatnonzero(self.starts[np.frombuffer(coded, np.uint16)])).tolist()
            if len(cuts) == len(row):
                out += [coded[i:j] for i, j in zip(cuts, [*cuts[1:], len(coded)])]
            else:
                out += self._encode([" " + w for w in row])
        return out

    @staticmethod
    def _apart(word: str) -> bool:
        odd = "\u180e\u200b\ufeff"
        return word.isalnum() or bool(word) and not any(c.isspace() or c in odd for c in (word[0], word[-1]))

    def _merged(self, piece: str) -> bytes:
        """Ids of a piece that is not split further, by the model alone."""
        if not piece.isascii() or not piece.isalnum():
            piece = piece.encode().decode("latin-1").translate(_BYTES)
        return array("H", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _pieces(self, word: str) -> bytes:
        """Ids of a plain word, with the space before it, from those of its pieces."""
        first, *rest = _PIECE.findall(word)
        ids = (self.memo.get(first) or self.older.get(first)) if rest else None
        if ids is None:
            ids = self._merged(" " + first)
            if rest:
                self.memo[first] = ids
        for piece in rest:
            part = self.parts.get(piece)
            if part is None:
                part = self.parts[piece] = self._merged(piece)
            ids += part
        return ids

    def _known(self, words: list[str]) -> list[bytes | None]:
        """Ids of distinct words, each with the space before it; none for words that do not stand apart."""
        if len(self.memo) > self.MEMO:
            self.older, self.memo = self.memo, {}
        if len(self.parts) > self.PARTS:
            self.parts = {}
        memo, older, plain = self.memo, self.older, _PLAIN_WORD.fullmatch
        tokenize, added, parts = self.model.tokenize, self.added.search, self.marks
        out, others = list(map(memo.get, words)), []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            word = words[i]
            ids = older.get(word)
            if ids is None and self.direct:
                if word.isascii() and word.isalpha():
                    ids = array("H", [t.id for t in tokenize("\u0120" + word)]).tobytes()
                elif word[-1:] in parts and word[:-1].isalpha() and word.isascii():
                    base = word[:-1]  # a mark behind a word, the commonest of words in pieces
                    ids = memo.get(base) or older.get(base)
                    if ids is None:
                        ids = memo[base] = array("H", [t.id for t in tokenize("\u0120" + base)]).tobytes()
                    ids += parts[word[-1]]
                elif plain(word) and not added(word):
                    ids = self._merged(" " + word) if word.isalpha() else self._pieces(word)
            if ids is not None:
                out[i] = memo[word] = ids
            elif self._apart(word):
                others.append(i)
        for i, ids in zip(others, self._words([words[i] for i in others])):
            out[i] = memo[words[i]] = ids
        return out

    def batch(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not len(texts):
            return []
        rows = pc.split_pattern(texts, " ")
        coded = rows.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = coded.indices.to_numpy().astype(np.int64)
        ends = np.cumsum(rows.value_lengths().to_numpy())
        first = np.concatenate([[0], ends[:-1]])
        known = self._known(words)
        loose = np.fromiter((k is None for k in known), bool, len(known))
        whole = np.logical_or.reduceat(loose[at], first)  # texts with words that do not stand apart
        # a text's first word has no space before it
        heads, which = np.unique(at[first], return_inverse=True)
        pieces = [k or b"" for k in known] + self._encode([words[i] for i in heads.tolist()])
        at[first] = len(words) + which
        if whole.any():
            odd = np.flatnonzero(whole)
            plain = coded.indices.to_numpy()
            at[first[odd]] = len(pieces) + np.arange(len(odd))
            pieces += self._whole([[words[i] for i in plain[first[t]:ends[t]].tolist()] for t in odd.tolist()])
            left = np.repeat(~whole, ends - first)
            left[first] = True
            at = at[left]
            first = np.concatenate([[0], np.cumsum(np.where(whole, 1, ends - first))[:-1]])
        starts = np.cumsum([0, *map(len, pieces)]) // 2
        ids = pa.ListArray.from_arrays(pa.array(starts, pa.int32()),
                                       pa.array(np.frombuffer(b"".join(pieces), np.uint16)))
        flat = ids.take(pa.array(at)).flatten().to_numpy()
        sizes = np.add.reduceat(np.diff(starts)[at], first)
        return np.split(flat, np.cumsum(sizes)[:-1])

    def _whole(self, rows: list[list[str]]) -> list[bytes]:
        """Ids of texts, given by their words, of which those that do not stand apart join their neighbours."""
        memo, rows = self.memo, [self._joined(row) for row in rows]
        rest = list({w for row in rows for w in row[1:] if w not in memo})
        extra = dict(zip(rest, self._encode([" " + w for w in rest])))
        heads = self._encode([row[0] for row in rows])
        return [head + b"".join([extra[w] if w in extra else memo[w] for w in row[1:]])
                for head, row in zip(heads, rows)]

    def _joined(self, words: list[str]) -> list[str]:
        """Words of a text, those that do not break apart put together with their neighbours."""
        out = [words[0]]
        loose = not self._apart(words[0])
        for word in words[1:]:
            odd = not self._apart(word)
            if loose or odd:
                out[-1] += " " + word
            else:
                out.append(word)
            loose = odd
        return out


@lru_cache(maxsize=1)
def _tokens(path: str) -> _Tokens:
    return _Tokens(path)


def _chunks(texts: pa.Array, size: int = 8_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Slices of texts of about ``size`` bytes or of one text, and where they start."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n
        if held >= size or i == len(texts) - 1:
            yield start, texts.slice(start, i + 1 - start)
            start, held = i + 1, 0


_ROWS = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("at", pa.int64()), ("n", pa.int32()),
                   ("block", pa.binary())])


def _coded(pending: list, seq: int, at: int, take: int) -> pa.RecordBatch:
    """Blocks of the first ``take`` pending ids, which are removed from ``pending``."""
    shares, left, flat = [], take, []
    while left:
        no, doc_id, ids = pending[0]
        got = ids[:left]
        done = len(got) == len(ids)
        shares.append((no, doc_id, len(got), done))
        flat.append(got)
        left -= len(got)
        if done:
            pending.pop(0)
        else:
            pending[0] = (no, doc_id, ids[len(got):])
    flat = np.concatenate(flat)
    blocks = [flat[i:i + BLOCK] for i in range(0, len(flat), BLOCK)]
    payloads = encode_blocks(blocks)
    rows, share, used = [], 0, 0
    for block, payload in zip(blocks, payloads):
        need, table = len(block), []
        while need:
            no, doc_id, n, done = shares[share]
            got = min(need, n - used)
            used, need = used + got, need - got
            table.append((no, doc_id, got, done and used == n))
            if used == n:
                share, used = share + 1, 0
        head = np.array(table, _SHARE).tobytes()
        check = zlib.crc32(block.astype("<u4").tobytes())
        rows.append(_HEADER.pack(b"TID1", len(block), len(table), len(payload), check) + head + payload)
    sizes = [len(b) for b in blocks]
    starts = at + np.cumsum([0, *sizes[:-1]])
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(rows), pa.int32()), pa.array(range(seq, seq + len(rows)), pa.int64()),
         pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(rows, pa.binary())], schema=_ROWS)


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> None:
    """Encode every text, add the end id, and write the ids in ascending doc_id order below ``path``.

    Null texts count as empty and have the end id alone. Rows without doc_id are left out; rows that
    repeat a doc_id follow each other, by text. The vocabulary has at most 65536 ids.
    """
    rows = (docs.where(F.col("doc_id").isNotNull())
            .select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pending, waiting, no, seq, at = _tokens(tokenizer), [], 0, 0, 0, 0
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for start, texts in _chunks(batch.column("text")):
                for key, ids in zip(keys[start:], coder.batch(texts)):
                    pending.append((no, key, np.append(ids, np.uint16(END))))
                    no, waiting = no + 1, waiting + len(ids) + 1
                while waiting >= LANES * BLOCK:
                    out = _coded(pending, seq, at, LANES * BLOCK)
                    seq, at, waiting = seq + out.num_rows, at + LANES * BLOCK, waiting - LANES * BLOCK
                    yield out
        if waiting:
            yield _coded(pending, seq, at, waiting)

    rows.mapInArrow(run, "part int, seq long, at long, n int, block binary").write.option(
        "compression", "none").parquet(path)


def parse_block(block: bytes) -> tuple[int, int, np.ndarray, bytes]:
    """Number of ids, checksum, shares of documents and payload of a block."""
    mark, n, shares, size, check = _HEADER.unpack_from(block)
    if mark != b"TID1":
        raise ValueError("not a block of token ids")
    table = np.frombuffer(block, _SHARE, shares, _HEADER.size)
    start = _HEADER.size + shares * _SHARE.itemsize
    return n, check, table, block[start:start + size]


_PIECES = pa.schema([("part", pa.int32()), ("no", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int64()),
                     ("first", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])


def read_shares(files: DataFrame) -> DataFrame:
    """Decode every block by itself; one row per document's share of a block, with its ids' CRC-32.

    Raises if a block's ids do not have the checksum that was stored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, LANES):
                part = batch.slice(low, LANES)
                blocks = [parse_block(b) for b in part.column("block").to_pylist()]
                decoded = decode_blocks([b[3] for b in blocks], [b[0] for b in blocks])
                out: list[tuple] = []
                for (n, check, table, _), ids, p, seq, at in zip(
                        blocks, decoded, *(part.column(c).to_pylist() for c in ("part", "seq", "at"))):
                    raw = ids.astype("<u4").tobytes()
                    if zlib.crc32(raw) != check:
                        raise ValueError(f"checksum of block {seq} of part {p} differs")
                    done = 0
                    for no, doc_id, size, _ in table.tolist():
                        out.append((p, no, doc_id, seq, at + done, size, zlib.crc32(raw[4 * done:4 * (done + size)])))
                        done += size
                columns = list(zip(*out)) or [()] * len(_PIECES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)

    return files.select("part", "seq", "at", "block").mapInArrow(
        run, "part int, no long, doc_id long, seq long, first long, n long, crc long")


def _product(a: int, b: int) -> int:
    """Product of two polynomials modulo the one of CRC-32, highest power in the lowest bit."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@lru_cache(maxsize=100_000)
def _power_of_bytes(n: int) -> int:
    """x to the power 8 n modulo the polynomial."""
    out, square = 0x80000000, 0x00800000
    while n:
        if n & 1:
            out = _product(square, out)
        square, n = _product(square, square), n >> 1
    return out


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings put together, from their own and the length of the second."""
    return _product(_power_of_bytes(second_bytes), first) ^ second


@F.pandas_udf(T.LongType())
def _whole_crc(pieces: pd.Series) -> pd.Series:
    def one(parts) -> int:
        crc = 0
        for part in sorted(parts, key=lambda p: p["seq"]):
            crc = joined_crc(crc, part["crc"], 4 * part["n"])
        return crc

    return pieces.map(one)


def read_digest(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files below ``path`` alone."""
    files = spark.read.schema("part int, seq long, at long, n int, block binary").parquet(path)
    parts = files.groupBy("part").agg(F.sum("n").alias("ids"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a line for each file part
    offsets = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    shares = read_shares(files)
    # most documents lie in one block; the others need their checksums put together
    docs = shares.groupBy("part", "no").agg(
        F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"),
        F.collect_list(F.struct("seq", "n", "crc")).alias("pieces"))
    return (docs.join(F.broadcast(offsets), "part")
            .select("doc_id", (F.col("offset") + F.col("first")).alias("start"), "n_tokens",
                    _whole_crc("pieces").alias("ids_crc32")))


def token_file(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and read the digest of every document back.

    An empty table gives an empty result. Other columns, whatever their names, are ignored.
    """
    path = new_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer)
    return read_digest(docs.sparkSession, path)
