"""Vectorised 64-bit hashing of words and shingles over UTF-8 byte arrays.

A word's hash is a polynomial in a random odd base over random byte values,
modulo 2**64; prefix sums give all words of a slice at once without a Python
object per word. Equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * U(2) + U(1)

#: ASCII lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word separators: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_powers = np.ones(1, U)
_inverses = np.ones(1, U)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept between calls."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, _BASE, U)
        steps[0] = 1
        _powers = np.cumprod(steps)
        steps[1:] = _INVERSE
        _inverses = np.cumprod(steps)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run without separators; runs
    end with their document."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(separators[data], out=inside[1:-1])
    change = inside[1:] != inside[:-1]
    ends_at = offsets[1:-1]
    ends_at = ends_at[(ends_at > 0) & (ends_at < len(data))]
    joined = ends_at[inside[ends_at] & inside[ends_at + 1]]
    points = np.flatnonzero(change)
    if len(joined):
        joined = np.unique(joined)
        points = np.sort(np.concatenate([points, joined, joined]), kind="stable")
    start, end = points[::2], points[1::2]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of data[start:end] after folding bytes, for many spans."""
    powers, inverses = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[fold][data] * powers[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverses[start] + (end - start).astype(U))


def shingles(words: np.ndarray, doc: np.ndarray, k: int, n_docs: int, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each run of ``k`` words. With ``whole_short`` a
    document of fewer words gives one shingle of all its words."""
    counts = np.bincount(doc, minlength=n_docs)
    out, owner = np.zeros(0, U), np.zeros(0, np.int64)
    if len(words) >= k:
        last = len(words) - k + 1
        full = doc[:last] == doc[k - 1 :]
        acc = np.zeros(last, U)
        for j in range(k):
            acc = mix(acc * U(3) + words[j : j + last])
        out, owner = acc[full], doc[:last][full]
    if whole_short and ((counts > 0) & (counts < k)).any():
        short = np.flatnonzero((counts > 0) & (counts < k))
        first = np.cumsum(counts) - counts
        acc = np.zeros(len(short), U)
        for j in range(k - 1):
            has = counts[short] > j
            nxt = mix(acc * U(3) + words[np.minimum(first[short] + j, len(words) - 1)])
            acc = np.where(has, nxt, acc)
        acc = mix(acc + counts[short].astype(U))
        order = np.argsort(np.concatenate([owner, short]), kind="stable")
        out, owner = np.concatenate([out, acc])[order], np.concatenate([owner, short])[order]
    return out, owner
