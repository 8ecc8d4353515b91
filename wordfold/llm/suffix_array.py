"""Suffix arrays by two-stage sorting, for many strings at once.

Stage one sorts only the suffixes that are smaller than their successor
(type S), directly by content. Stage two scans the buckets of first symbols
in order and induces the others (type L): when suffix ``i`` is reached and
suffix ``i - 1`` is of type L, it takes the next free place in its bucket.
Both work on whole arrays: a bucket is scanned in one step per run of equal
symbols, and the predecessors of a step keep its order.

Strings are bytes; each ends in a separator that is smaller than any byte, so
no comparison goes beyond a string. Equal suffixes of different strings stand
in the order of their positions' induction.
"""

from __future__ import annotations

import numpy as np


def join_strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, string of each position): bytes plus one, separators zero."""
    total = int(sizes.sum()) + len(sizes)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    inside = np.arange(total) - begin[owner]
    symbols = np.zeros(total, np.uint16)
    body = inside < sizes[owner]
    symbols[body] = data[(starts[owner] + inside)[body]].astype(np.uint16) + 1
    return symbols, owner


def smaller_than_next(symbols: np.ndarray) -> np.ndarray:
    """Type S: the suffix is smaller than the one after it."""
    n = len(symbols)
    order = np.zeros(n, np.int8)
    order[:-1] = np.sign(symbols[1:].astype(np.int32) - symbols[:-1].astype(np.int32))
    order[-1] = -1
    settled = np.where(order != 0, np.arange(n), n - 1)
    after = np.minimum.accumulate(settled[::-1])[::-1]  # the next place where symbols differ
    return (order[after] > 0) & (symbols > 0)


def words_at(symbols: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Four symbols from ``places + depth`` as one number (zero beyond the end)."""
    padded = np.concatenate([symbols, np.zeros(4, np.uint16)]).astype(np.uint64)
    key = np.zeros(len(places), np.uint64)
    for j in range(4):
        key = (key << np.uint64(16)) | padded[np.minimum(places + depth + j, len(padded) - 1)]
    return key


def sort_directly(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``places`` ordered by their suffixes, refined four symbols at a time
    among those that are still tied. A suffix ends at its separator."""
    padded = np.concatenate([symbols, np.zeros(8, np.uint16)])
    quads = np.zeros(len(symbols), np.uint64)
    for j in range(4):
        quads = (quads << np.uint64(16)) | padded[j : j + len(symbols)].astype(np.uint64)
    # what follows a separator inside the four symbols belongs to another string
    for j in range(3):
        ended = (quads >> np.uint64(16 * (3 - j))) & np.uint64(0xFFFF) == 0
        keep = np.uint64(((1 << 64) - 1) ^ ((1 << (16 * (3 - j))) - 1))
        quads[ended] &= keep
    order = places[np.argsort(quads[places], kind="stable")]
    keys = quads[order]
    tied = np.zeros(len(order), bool)
    same = (keys[1:] == keys[:-1]) & (keys[1:] & np.uint64(0xFFFF) != 0)
    tied[1:] |= same
    tied[:-1] |= same
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(~same)
    depth = 4
    at = np.flatnonzero(tied)
    while len(at):
        sub, groups = order[at], group[at]
        key = quads[np.minimum(sub + depth, len(quads) - 1)]
        key[sub + depth >= len(quads)] = 0
        by = np.argsort(key, kind="stable")
        by = by[np.argsort(groups[by], kind="stable")]
        order[at] = sub[by]
        key, groups = key[by], groups[by]
        same = (key[1:] == key[:-1]) & (groups[1:] == groups[:-1]) & (key[1:] & np.uint64(0xFFFF) != 0)
        group_new = np.zeros(len(at), np.int64)
        group_new[1:] = np.cumsum(~same)
        group[at] = group_new
        still = np.zeros(len(at), bool)
        still[1:] |= same
        still[:-1] |= same
        at = at[still]
        depth += 4
    return order


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order, the separators' first."""
    n = len(symbols)
    small = smaller_than_next(symbols)
    direct = sort_directly(symbols, np.flatnonzero(small))
    first = symbols[direct]
    present = np.unique(symbols).tolist()
    bounds = dict(zip(present, zip(np.searchsorted(first, present, "left").tolist(), np.searchsorted(first, present, "right").tolist(), strict=True), strict=True))
    waiting: dict[int, list[np.ndarray]] = {c: [] for c in present}
    out: list[np.ndarray] = []

    def induce(scanned: np.ndarray) -> None:
        before = scanned[scanned > 0] - 1
        before = before[~small[before] & (symbols[before] > 0)]
        if not len(before):
            return
        at = symbols[before]
        by = np.argsort(at, kind="stable")
        before, at = before[by], at[by]
        cuts = np.flatnonzero(np.diff(at)) + 1
        for part in np.split(before, cuts):
            waiting[int(symbols[part[0]])].append(part)

    separators = np.flatnonzero(symbols == 0)
    out.append(separators)
    induce(separators)
    for c in present:
        if c == 0:
            continue
        while waiting[c]:  # type L; equal symbols before them follow in the same bucket
            batch = np.concatenate(waiting[c])
            waiting[c] = []
            out.append(batch)
            induce(batch)
        lo, hi = bounds[c]
        if hi > lo:
            out.append(direct[lo:hi])
            induce(direct[lo:hi])
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    if len(found) != n:
        raise AssertionError("a suffix was not induced")
    return found


def common_prefixes(symbols: np.ndarray, order: np.ndarray, longest: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, up to
    ``longest`` symbols and never beyond a separator."""
    out = np.zeros(len(order), np.int64)
    padded = np.concatenate([symbols, np.zeros(longest + 1, np.uint16)])
    alive = np.arange(1, len(order))
    for depth in range(longest):
        a, b = padded[order[alive] + depth], padded[order[alive - 1] + depth]
        alive = alive[(a == b) & (a > 0)]
        if not len(alive):
            break
        out[alive] += 1
    return out
