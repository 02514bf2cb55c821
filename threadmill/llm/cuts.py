"""Places in a text that no piece of a vocabulary can cross.

A piece that holds the characters b and c side by side is bc itself, or holds abc or bcd, a and d being their neighbours. Where the vocabulary has none of the
three, the text falls apart into two that have nothing to do with each other, in merging as in summing over segmentations. So a word of any length - a
line of Chinese, a block of base64 - becomes many short ones, which numpy works on side by side; results stay exactly the same.
"""

from __future__ import annotations

import numpy as np


class Table:
    """Places of 64-bit keys in a list, found by hashing: keys that meet in a slot go on to a further table."""

    def __init__(self, keys: np.ndarray):
        self.missing, self.levels = len(keys), []
        left = np.arange(len(keys))
        while len(left):
            bits = max(10, int(len(left)).bit_length() + 3)
            shift, factor = np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.levels))
            slot = (keys[left].view(np.uint64) * factor >> shift).astype(np.int64)
            slots, taken = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, self.missing, dtype=np.int32)
            _, first = np.unique(slot, return_index=True)
            slots[slot[first]], taken[slot[first]] = keys[left[first]], left[first]
            self.levels.append((factor, shift, slots, taken))
            left = np.delete(left, first)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, the number of keys where there is none."""
        out = np.full(len(keys), self.missing, dtype=np.int32)
        for factor, shift, slots, taken in self.levels:
            slot = (keys.view(np.uint64) * factor >> shift).view(np.int64)
            np.minimum(out, np.where(slots[slot] == keys, taken[slot], self.missing), out=out)
        return out


class Cuts:
    def __init__(self, pieces: list[str]):
        self.pairs = self._table({p for p in pieces if len(p) == 2})
        self.triples = self._table({p[k : k + 3] for p in pieces for k in range(len(p) - 2)})

    @staticmethod
    def _keys(codes: np.ndarray, n: int) -> np.ndarray:
        """A number for the n characters from each place on."""
        size = max(0, len(codes) - n + 1)
        out = np.zeros(size, dtype=np.int64)
        for k in range(n):
            out = out << 21 | codes[k : k + size]
        return out

    @classmethod
    def _table(cls, names: set[str]) -> Table:
        return Table(np.array(sorted(int(cls._keys(np.array([ord(c) for c in x], dtype=np.int64), len(x))[0]) for x in names), dtype=np.int64))

    def before(self, codes: np.ndarray) -> np.ndarray:
        """True for the characters (code points) before which no piece can go on; the first one is."""
        codes = codes.astype(np.int64)
        out = np.ones(len(codes), dtype=bool)
        joined = self.pairs.find(self._keys(codes, 2)) < self.pairs.missing
        triple = self.triples.find(self._keys(codes, 3)) < self.triples.missing
        joined[:-1] |= triple
        joined[1:] |= triple
        out[1:] = ~joined
        return out
