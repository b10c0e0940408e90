"""Wavelet matrix over numpy: rank, select, access, counting and occurrence lookup."""

from __future__ import annotations

import numpy as np

_WORD = 64


class BitVector:
    """Packed bits with a rank directory of one count for each 64-bit word."""

    def __init__(self, words: np.ndarray, n: int):
        self.words, self.n = words, n
        self.before = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    @classmethod
    def of(cls, bits: np.ndarray) -> BitVector:
        return cls(pack(bits), len(bits))

    @property
    def ones(self) -> int:
        return int(self.before[-1])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[np.minimum(word, len(self.words) - 1)] & below)

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Positions of the k-th (from 0) occurrences of ``bit``."""
        counts = self.before if bit else np.arange(len(self.before)) * _WORD - self.before
        word = np.searchsorted(counts, k, side="right") - 1
        inside = self.words[word] if bit else ~self.words[word]
        bits = np.unpackbits(inside.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        seen = np.cumsum(bits, axis=1)
        return word * _WORD + np.argmax(seen > (k - counts[word])[:, None], axis=1)


def pack(bits: np.ndarray) -> np.ndarray:
    """Little-endian words of a 0/1 array; at least one word."""
    packed = np.packbits(bits, bitorder="little")
    words = np.zeros(max(1, -(-len(bits) // _WORD)) * 8, dtype=np.uint8)
    words[: len(packed)] = packed
    return words.view("<u8")


class WaveletMatrix:
    """Symbols below 2**levels; level 0 holds the highest bits."""

    def __init__(self, planes: list[BitVector], n: int):
        self.planes, self.n, self.levels = planes, n, len(planes)
        self.zeros = [p.n - p.ones for p in planes]

    @classmethod
    def build(cls, symbols: np.ndarray, levels: int) -> WaveletMatrix:
        planes, now = [], symbols
        for shift in range(levels - 1, -1, -1):
            bits = (now >> now.dtype.type(shift)) & now.dtype.type(1)
            ones = bits.astype(bool)
            planes.append(BitVector.of(ones))
            if shift:
                now = np.concatenate((now.take(np.flatnonzero(~ones)), now.take(np.flatnonzero(ones))))
        return cls(planes, len(symbols))

    def follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` goes under ``symbol`` in the order behind the last level."""
        for level, plane in enumerate(self.planes):
            ones = plane.rank(at)
            bit = (symbol >> (self.levels - 1 - level)) & 1
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self.follow(symbol, at) - self.follow(symbol, np.zeros_like(at))

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at the positions, and where these go behind the last level."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for level, plane in enumerate(self.planes):
            bit, ones = plane.get(at).astype(np.int64), plane.rank(at)
            symbol = symbol << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return symbol, at

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th (from 0) occurrences of one symbol."""
        at = k + int(self.follow(np.array([symbol]), np.array([0]))[0])
        for level in range(self.levels - 1, -1, -1):
            bit = symbol >> (self.levels - 1 - level) & 1
            at = self.planes[level].select(at - self.zeros[level] if bit else at, bit)
        return at

    def count(self, symbol: int, low: int, high: int) -> int:
        ends = self.follow(np.array([symbol, symbol]), np.array([low, high]))
        return int(ends[1] - ends[0])

    def occurrences(self, symbol: int) -> np.ndarray:
        return self.select(symbol, np.arange(self.count(symbol, 0, self.n)))

    def decode(self, dtype: type = np.uint32) -> np.ndarray:
        """All symbols, by undoing the partitions from the last level upwards."""
        now = np.zeros(self.n, dtype=dtype)
        for level in range(self.levels - 1, -1, -1):
            plane = self.planes[level]
            ones = np.unpackbits(plane.words.view(np.uint8), count=self.n, bitorder="little").view(bool)
            if level < self.levels - 1:
                out = np.empty_like(now)
                out[np.flatnonzero(~ones)], out[np.flatnonzero(ones)] = now[: self.zeros[level]], now[self.zeros[level] :]
                now = out
            now |= ones.astype(dtype) << dtype(self.levels - 1 - level)
        return now
