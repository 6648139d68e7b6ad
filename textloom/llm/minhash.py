"""Shingle sets and one-permutation MinHash signatures of single texts (numpy, no Spark).

A text's words are the runs of bytes other than space and \\t..\\r after A-Z are lower-cased; its
set holds the hashes of its distinct five-word shingles.  One hash per shingle serves the whole
signature: the top bits choose a bin, each bin keeps its smallest hash, and an empty bin borrows
from a bin that a fixed hash of (bin, attempt) names, which keeps collisions unbiased.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
BINS, BANDS, ROWS = 512, 64, 8  # BANDS * ROWS == BINS
WORD_CACHE = 200_000

_SHIFT = np.uint64(64 - 9)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE - 1, -1, -1)], dtype=np.uint64)
_ATTEMPTS = 24


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _grid(rows: int, cols: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, rows * cols + 1, dtype=np.uint64) * _MULT + np.uint64(salt)).reshape(rows, cols)


_DONOR = (_grid(_ATTEMPTS, BINS, 11) % np.uint64(BINS)).astype(np.int64)
_BAND = _grid(BANDS, ROWS, 29) | np.uint64(1)
_RANK = _grid(BINS, BINS, 47)


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to WORD_CACHE words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, seen: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; one hash of the whole sequence if it is shorter than width."""
    w = words(text)
    if not w:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(seen.__getitem__, w), dtype=np.uint64, count=len(w))
    with np.errstate(over="ignore"):
        if len(w) < width:
            whole = np.uint64(len(w))
            for x in h:
                whole = whole * _MULT + x
            return mix(np.array([whole ^ np.uint64(0x5851F42D4C957F2D)], dtype=np.uint64))
        powers = _POWERS if width == SHINGLE else np.array([pow(int(_MULT), k, 1 << 64) for k in range(width - 1, -1, -1)], dtype=np.uint64)
        out = h[: len(h) - width + 1] * powers[0]
        for k in range(1, width):
            out = out + h[k : len(h) - width + 1 + k] * powers[k]
    return np.unique(mix(out))


def signature(sh: np.ndarray) -> np.ndarray:
    """BINS minima of a non-empty sorted set, empty bins filled by densification."""
    bins = (sh >> _SHIFT).astype(np.int64)
    first = np.empty(len(sh), dtype=bool)
    first[0] = True
    np.not_equal(bins[1:], bins[:-1], out=first[1:])
    sig = np.zeros(BINS, dtype=np.uint64)
    full = np.zeros(BINS, dtype=bool)
    own = bins[first]
    sig[own], full[own] = sh[first], True
    empty = np.flatnonzero(~full)
    for k in range(_ATTEMPTS):
        if not len(empty):
            return sig
        donor = _DONOR[k, empty]
        good = full[donor]
        sig[empty[good]] = sig[donor[good]]
        empty = empty[~good]
    if len(empty):  # few distinct shingles: the full bin of the smallest rank for this bin
        sig[empty] = sig[own[np.argmin(_RANK[np.ix_(empty, own)], axis=1)]]
    return sig


def bands(sh: np.ndarray) -> np.ndarray:
    """BANDS bucket hashes of a non-empty sorted set."""
    with np.errstate(over="ignore"):
        return mix((mix(signature(sh)).reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| over sorted distinct arrays."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="mergesort")
    inter = int((both[1:] == both[:-1]).sum())
    return inter * 100 >= percent * (len(both) - inter)
