"""Vectorised text primitives on code points (numpy only).

A word is a maximal run of letters and digits of the lower-cased text, in any
script.  Words, word hashes and shingles are computed for a whole text at once.
"""

from __future__ import annotations

import functools

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
CHAR = np.uint64(0x100000001B3)


@functools.cache
def _alnum() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def is_letter(points: np.ndarray) -> np.ndarray:
    return _letters()[points]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """CHAR ** (0 .. n-1) modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 64, 2 * len(_POWERS))
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, CHAR)]), dtype=np.uint64)
    return _POWERS


class Words:
    """The words of a text: their characters, where each starts, and a 64-bit hash of each."""

    __slots__ = ("chars", "starts", "lengths", "hashes")

    def __init__(self, text: str):
        points = codes(text.lower())
        at = np.flatnonzero(_alnum()[points])
        self.chars = points[at]
        if not len(at):
            self.starts = self.lengths = np.empty(0, dtype=np.int64)
            self.hashes = np.empty(0, dtype=np.uint64)
            return
        first = np.empty(len(at), dtype=bool)
        first[0] = True
        np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
        self.starts = np.flatnonzero(first)
        self.lengths = np.diff(self.starts, append=len(at))
        place = np.arange(len(at)) - np.repeat(self.starts, self.lengths)
        weighed = (self.chars.astype(np.uint64) + np.uint64(1)) * powers(int(self.lengths.max()))[place]
        self.hashes = mix(np.add.reduceat(weighed, self.starts) + self.lengths.astype(np.uint64) * MULT)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words; a shorter text is one shingle, a text without words has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        out = out * MULT + hashes[j : n - width + 1 + j]
    return mix(out + np.uint64(width))
