"""Elias-Fano encoding of non-decreasing numbers.

A number's low bits stand in a packed array, its high bits as the place of a one: the i-th number's one is at (number >> low) + i. With low = log2(largest / n)
that is 2 + low bits a number. The place of every SAMPLE-th one is kept in 32 bits, so select looks at the bits between two samples only; there is no table of 64-bit
offsets. Any single number is found without decoding the others.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
#: Numbers that are packed or unpacked at once.
_BLOCK = 1 << 16
_HEAD = struct.Struct("<QQB")


class EliasFano:
    def __init__(self, n: int, low: int, least: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.least, self.lows, self.highs, self.samples = n, low, least, lows, highs, samples

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        """numbers: int64 or uint64, non-decreasing; what is stored is their distance to the first."""
        n = len(numbers)
        least = int(numbers[0]) if n else 0
        above = numbers.astype(np.uint64) - (numbers[:1].astype(np.uint64) if n else np.uint64(0))  # modulo 2^64, so that any range fits
        most = int(above[-1]) if n else 0
        low = max(0, ((most + 1) // max(n, 1)).bit_length() - 1)
        places = (above >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = int(places[-1]) + 1 if n else 0
        if bits > 0xFFFFFFFF:
            raise ValueError("too many numbers for samples of 32 bits")
        ones = np.zeros(bits, dtype=bool)
        ones[places] = True
        packed = [np.packbits((above[k : k + _BLOCK, None] >> np.arange(low, dtype=np.uint64)[None, :] & np.uint64(1)).astype(bool), bitorder="little") for k in range(0, n if low else 0, _BLOCK)]
        lows = np.concatenate(packed) if packed else np.zeros(0, np.uint8)
        return cls(n, low, least, lows, np.packbits(ones, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def _low_of(self, first: int, end: int) -> np.ndarray:
        if not self.low:
            return np.zeros(end - first, dtype=np.uint64)
        begin = first * self.low
        bits = np.unpackbits(self.lows[begin >> 3 : (end * self.low + 7) >> 3], bitorder="little")[begin & 7 :][: (end - first) * self.low]
        return (bits.reshape(-1, self.low).astype(np.uint64) << np.arange(self.low, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)

    def select(self, first: int, end: int) -> np.ndarray:
        """The places of the ones first to end - 1."""
        block = first // SAMPLE
        begin = int(self.samples[block])
        stop_at = (end + SAMPLE - 1) // SAMPLE
        stop = int(self.samples[stop_at]) if stop_at < len(self.samples) else 8 * len(self.highs)
        bits = np.unpackbits(self.highs[begin >> 3 : (stop + 7) >> 3], bitorder="little")[begin & 7 :]
        return np.flatnonzero(bits)[first - block * SAMPLE : end - block * SAMPLE] + begin

    def between(self, first: int, end: int) -> np.ndarray:
        """The numbers first to end - 1 as int64."""
        parts = [np.zeros(0, np.uint64)]
        for a in range(first, end, _BLOCK):
            b = min(end, a + _BLOCK)
            highs = (self.select(a, b) - np.arange(a, b)).astype(np.uint64)
            parts.append((highs << np.uint64(self.low)) + self._low_of(a, b))
        return (np.concatenate(parts) + np.uint64(self.least % (1 << 64))).view(np.int64)

    def __getitem__(self, i: int) -> int:
        return int(self.between(i, i + 1)[0])

    def first_at_least(self, number: int) -> int:
        """The first place whose number is not below, n if there is none."""
        below, above = 0, self.n
        while below < above:
            middle = (below + above) // 2
            below, above = (middle + 1, above) if self[middle] < number else (below, middle)
        return below

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.least % (1 << 64), self.low) + self.samples.astype("<u4").tobytes() + self.lows.tobytes() + self.highs.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, least, low = _HEAD.unpack_from(data)
        samples = np.frombuffer(data, "<u4", (n + SAMPLE - 1) // SAMPLE, _HEAD.size)
        at = _HEAD.size + 4 * len(samples)
        size = (n * low + 7) >> 3 if low else 0
        # Blocks are packed on their own; _BLOCK * low is a multiple of 8, so together they are one row of bits.
        return cls(n, low, least, np.frombuffer(data, np.uint8, size, at), np.frombuffer(data, np.uint8, len(data) - at - size, at + size), samples)
