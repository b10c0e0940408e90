"""Bit-sliced Hamming comparison: vertical planes and carry-save counters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BITS = 64
#: Planes added between two looks at whether a block can be abandoned.
STRIDE = 8


def planes(values: np.ndarray) -> np.ndarray:
    """Vertical bit planes of uint64 values: (64, words), bit j of a word is row j of its block."""
    n = len(values)
    words = -(-n // BITS)
    padded = np.zeros(words * BITS, dtype="<u8")
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return packed.view("<u8")


def unpack(mask: np.ndarray, n: int) -> np.ndarray:
    """Positions of the set bits of a vertical mask over n rows."""
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), count=n, bitorder="little"))


def within(differences: Iterable[np.ndarray], words: int, radius: int) -> np.ndarray:
    """Mask of the rows whose difference planes hold at most ``radius`` ones.

    Each plane is added to carry-save counters of all rows at once.  The
    counters start so that they overflow at radius + 1, and words all of whose
    rows have overflowed are abandoned.
    """
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius
    alive = np.arange(words)
    counters = [np.full(words, ~np.uint64(0) if start >> b & 1 else 0, dtype=np.uint64) for b in range(width)]
    over = np.zeros(words, dtype=np.uint64)
    every = ~np.uint64(0)
    for k, plane in enumerate(differences):
        carry = plane[alive] if len(alive) < words else plane
        for b in range(width):
            carry, counters[b] = counters[b] & carry, counters[b] ^ carry
        over |= carry
        if k % STRIDE == STRIDE - 1:
            left = over != every
            if not left.all():
                alive, over = alive[left], over[left]
                counters = [c[left] for c in counters]
                if not len(alive):
                    break
    mask = np.zeros(words, dtype=np.uint64)
    mask[alive] = ~over
    return mask


def neighbours(block: np.ndarray, value: int, radius: int) -> np.ndarray:
    """Mask of the rows of a block of planes within ``radius`` of one value."""
    def differ() -> Iterator[np.ndarray]:
        for b in range(BITS):
            yield ~block[b] if value >> b & 1 else block[b]

    return within(differ(), block.shape[1], radius)


def paired(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Positions i at which left[i] and right[i] differ in at most ``radius`` bits."""
    if not len(left):
        return np.empty(0, dtype=np.int64)
    a, b = planes(left), planes(right)
    return unpack(within((a[k] ^ b[k] for k in range(BITS)), a.shape[1], radius), len(left))
