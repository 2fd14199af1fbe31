"""A minimal perfect hash function over distinct 64-bit or wider keys, in numpy.

Keys are thrown at a bit array of about two places a key; places hit once are taken, and the keys
that met go on to the next, smaller array. The rank of a key's bit among all bits set is its slot, so
``n`` keys fill the slots 0 to ``n - 1``. A foreign key also gets a slot or none, hence whoever looks
keys up compares them with the keys stored in the slots.
"""

from __future__ import annotations

import numpy as np

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
#: Places per key of a level.
SPREAD = 2


def _mixed(words: np.ndarray, seed: int) -> np.ndarray:
    """One hash per row of ``words`` (rows x words), of all its words."""
    with np.errstate(over="ignore"):
        out = np.full(len(words), (np.uint64(seed) + np.uint64(1)) * _MIX[2], np.uint64)
        for word in words.T:
            out = (out ^ word) + _MIX[2]
            out = (out ^ (out >> np.uint64(30))) * _MIX[0]
            out = (out ^ (out >> np.uint64(27))) * _MIX[1]
            out ^= out >> np.uint64(31)
    return out


class PerfectHash:
    """Slots of a fixed set of keys; ``keys`` is an array (rows x words) of uint64 without repeats."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        left, sizes, levels = keys, [], []
        while len(left):
            if len(sizes) == 200:
                raise ValueError("keys are not distinct")
            size = max(64, SPREAD * len(left))
            at = (_mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            left = left[~alone[at]]
            sizes.append(size)
            levels.append(alone)
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1, or the slot of another key, for a key that was not in the set."""
        out = np.full(len(keys), -1, np.int64)
        open_rows, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_rows):
                break
            at = start + (_mixed(keys[open_rows], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[open_rows[hit]] = self.rank[at[hit]]
            open_rows, start = open_rows[~hit], start + size
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], np.int64).tobytes()
        return head + np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "PerfectHash":
        levels = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes = np.frombuffer(raw, np.int64, levels, 8).tolist()
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, -1, 8 * (levels + 1)), count=sum(sizes))
        return cls(sizes, bits.astype(bool))


class KeyTable:
    """Keys in the slots of their perfect hash, so that every lookup is verified."""

    def __init__(self, function: PerfectHash, keys: np.ndarray):
        self.function, self.keys = function, keys

    @classmethod
    def build(cls, keys: np.ndarray) -> "KeyTable":
        function = PerfectHash.build(keys)
        placed = np.empty_like(keys)
        placed[function.slots(keys)] = keys
        return cls(function, placed)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots, -1 for keys that are not in the table."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        out = self.function.slots(keys)
        return np.where((out >= 0) & (self.keys[out] == keys).all(axis=1), out, -1)
