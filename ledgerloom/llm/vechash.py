"""Words of whole Arrow batches and their rolling hashes, in numpy without a loop over words.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  The prefix sums of
``T[byte] * B**i`` (mod 2**64) give any byte range's polynomial hash; the same
over mixed word hashes gives the hash of any run of words.  Each family (0 or 1)
has its own table and bases, so two families make a 128-bit key.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from .common import binary, offsets_of

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def _family(k: int) -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(20_240_601 + k)
    bases = rng.integers(0, 2**62, 2, dtype=np.int64)
    return rng.integers(0, 2**64, 256, dtype=np.uint64) | U(1), int(bases[0]) * 8 + 5, int(bases[1]) * 8 + 5


#: A text's bytes and words are hashed in blocks, so that no array of 64-bit numbers is longer, whatever the text.
BLOCK = 1 << 18


@cache
def powers(base: int) -> np.ndarray:
    """base**0 .. base**(BLOCK-1) mod 2**64."""
    full = np.full(BLOCK, base % 2**64, np.uint64)
    full[0] = 1
    return np.multiply.accumulate(full)


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def _times(base: int, at: np.ndarray) -> np.ndarray:
    """base**at for ascending positions."""
    out = np.empty(len(at), np.uint64)
    cuts = np.searchsorted(at, np.arange(0, int(at[-1]) + 1 if len(at) else 0, BLOCK)).tolist() + [len(at)]
    for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        out[a:z] = powers(base)[at[a:z] - k * BLOCK] * U(pow(base, k * BLOCK, 2**64))
    return out


def prefix_at(values, n: int, base: int, at: np.ndarray) -> np.ndarray:
    """sum of values[i] * base**i for i below each of the ascending positions ``at``; values(a, b): a block of them."""
    out = np.empty(len(at), np.uint64)
    carry, done = U(0), 0
    for a in range(0, n + 1, BLOCK):
        b = min(a + BLOCK, n)
        inside = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values(a, b) * powers(base)[: b - a], out=inside[1:])
        inside *= U(pow(base, a, 2**64))
        to = int(np.searchsorted(at, b, side="right"))
        out[done:to] = carry + inside[at[done:to] - a]
        carry, done = carry + inside[-1], to
    return out


class Words:
    """The words of a text column: ``start``/``end`` bytes, ``first`` word of each row (rows + 1 entries)."""

    def __init__(self, column: pa.Array, space: np.ndarray = SPACE, fold: np.ndarray | None = None):
        """space: which bytes part words; fold: what each byte reads as."""
        column = binary(column)
        off = offsets_of(column)
        buf = column.buffers()[2]
        self.bytes = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
        if fold is not None:
            self.bytes = fold[self.bytes]
        self.off = off - off[0]
        n = len(self.bytes)
        word = ~space[self.bytes]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = word[:-1], word[1:]
            before[self.off[:-1][self.off[:-1] < n]] = False
            after[self.off[1:][self.off[1:] > 0] - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)

    def hashes(self, family: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        tab, base, _ = _family(family)
        with np.errstate(over="ignore"):
            first, last = (prefix_at(lambda a, b: tab[self.bytes[a:b]], len(self.bytes), base, x) for x in (self.start, self.end))
            return mix((last - first) * _times(inverse(base), self.start))

    def windows(self, size: int, family: int = 0, hashes: np.ndarray | None = None) -> np.ndarray:
        """The hash of words i .. i+size-1 at each i, over row ends too (see ``inside``)."""
        _, _, base = _family(family)
        w = self.hashes(family) if hashes is None else hashes
        if len(w) < size:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            g = prefix_at(lambda a, b: w[a:b], len(w), base, np.arange(len(w) + 1))
            return mix((g[size:] - g[:-size]) * _times(inverse(base), np.arange(len(w) - size + 1)))

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def inside(self, size: int) -> np.ndarray:
        """The words at which a window of ``size`` starts and ends in the same row."""
        row = self.row()
        return np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1]) if len(row) >= size else np.zeros(0, np.int64)
