"""Suffix arrays by induced sorting and permuted longest common prefixes, in numpy.

Suffixes are classed as L or S, leftmost-S substrings are sorted by induction, named and, while
names repeat, sorted by recursion on the text of names; the sorted leftmost-S suffixes induce the
rest. The scans take many buckets in one step where none of them induces into another, and a run
of one symbol at once, so each suffix is handled once, in the order of the sequential algorithm.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for S-type suffixes (smaller than their right neighbour); the last one is S-type."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    rises = t[change] < t[change + 1]
    s = np.ones(n, bool)
    s[: n - 1] = np.repeat(rises, np.diff(np.concatenate([[-1], change])))[: n - 1] if len(change) and change[-1] == n - 2 else False
    return s


def _order(keys: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0, by 16 bits at a time (numpy sorts those by radix)."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    high = keys >> 16
    return order[np.argsort(high[order].astype(np.uint16), kind="stable")] if high.any() else order


def _dealt(keys: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Places for items with these bucket numbers, in order, moving the buckets' ends `at`."""
    order = _order(keys)
    ordered = keys[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(start, len(keys)))
    first = ordered[start]
    places = np.empty(len(keys), at.dtype)
    places[order] = np.repeat(at[first] - step * start, size) + step * np.arange(len(keys))
    at[first] += step * size
    return places


def _run_lengths(t: np.ndarray) -> np.ndarray:
    """How many symbols directly left of each one are the same."""
    at = np.arange(len(t))
    fresh = np.ones(len(t), bool)
    fresh[1:] = t[1:] != t[:-1]
    return at - np.maximum.accumulate(np.where(fresh, at, 0))


def _steps(lands: np.ndarray, symbols: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive buckets that may be scanned in one step: none induces into another of its step.

    symbols: the buckets in scan order, rising or falling; lands: for each, the nearest other
    bucket that one of its suffixes induces into.
    """
    sign = 1 if len(symbols) < 2 or symbols[0] < symbols[1] else -1
    found, first, limit = [], 0, 0
    for at, (c, reach) in enumerate(zip((sign * symbols).tolist(), (sign * lands).tolist())):
        if at == first:
            limit = reach
        elif c >= limit:
            found.append((first, at))
            first, limit = at, reach
        elif reach < limit:
            limit = reach
    return [*found, (first, len(symbols))]


def _with_runs(t: np.ndarray, seeds: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Seeds of some buckets and the suffixes of their runs of one symbol, in the order of induction:
    first all seeds of a bucket, then those one further left, and so on."""
    more = left[seeds]
    if not more.any():
        return seeds
    order = np.repeat(np.arange(len(seeds)), more + 1)
    back = np.arange(len(order)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    at = seeds[order] - back
    return at[np.lexsort((back, t[at]))]


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array that sorted leftmost-S suffixes induce."""
    n = len(t)
    sa = np.full(n, -1, np.int32)
    ends = np.cumsum(sizes).astype(np.int32)
    heads, symbols = (ends - sizes).astype(np.int32), np.flatnonzero(sizes)
    left = _run_lengths(t)
    runs = np.zeros(len(sizes), bool)
    runs[t[left > 0]] = True
    sa[_dealt(t[lms[::-1]], ends - 1, -1)] = lms[::-1]
    # where the suffix to the left goes to another bucket: when L-type ones are scanned, or S-type ones
    other = np.flatnonzero(t[:-1] != t[1:]) + 1
    rising, falling = other[~s[other - 1]], other[s[other - 1]]
    for step, source in ((1, rising), (-1, falling)):
        goes, kind = np.zeros(n, bool), ~s if step > 0 else s
        goes[source] = True
        lands = np.full(len(sizes), n + len(sizes) if step > 0 else -1, np.int64)
        (np.minimum if step > 0 else np.maximum).at(lands, t[source], t[source - 1])
        scan, at = symbols[::step], heads.copy() if step > 0 else ends - 1
        for a, b in _steps(lands[scan], scan):
            lowest, highest = (scan[a], scan[b - 1])[::step]
            part = slice(heads[lowest], ends[highest])
            held = sa[part][::step]
            held = held[held >= 0]
            if runs[lowest : highest + 1].any():
                # a suffix that starts a run of one symbol brings the run along
                seeds = held[kind[held]]
                grown = _with_runs(t, seeds, left)
                if len(grown) > len(seeds):
                    free = heads[lowest : highest + 1].copy() if step > 0 else ends[lowest : highest + 1] - 1
                    sa[_dealt(t[grown] - lowest, free, step)] = grown
                    held = sa[part][::step]
                    held = held[held >= 0]
            j = held[goes[held]] - 1
            if len(j):
                sa[_dealt(t[j], at, step)] = j
        if step > 0:  # the leftmost-S suffixes have done their work
            sa[s[sa] & (sa >= 0)] = -1
    sa[0] = n - 1
    return sa


def _named(t: np.ndarray, ordered: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Names of sorted leftmost-S substrings: equal ones, compared symbol by symbol, share one."""
    length = stop[ordered] - ordered
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = length[1:] != length[:-1]
    ties = np.flatnonzero(~fresh)
    if len(ties):
        size = length[ties]
        begin = np.cumsum(size) - size
        inside = np.arange(size.sum()) - np.repeat(begin, size)
        differ = t[np.repeat(ordered[ties], size) + inside] != t[np.repeat(ordered[ties - 1], size) + inside]
        fresh[ties] = np.logical_or.reduceat(differ, begin)
    return np.cumsum(fresh) - 1


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of small integers above 0; sorted by at least the first `depth` symbols if given.

    Works on the text with a sentinel 0 at its end; the sentinel's suffix isn't returned.
    """
    return _sorted(np.append(t, 0).astype(np.int32), len(t) if depth is None else depth)[1:].astype(np.int64)


def _sorted(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array, to this depth, of a text that ends in its only 0, the least symbol."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    s = _types(t)
    sizes = np.bincount(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    # leftmost-S substrings are sorted by inducing from unsorted ones
    sa = _induce(t, s, lms, sizes)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    del sa
    stop = np.empty(n, np.int64)
    stop[lms] = np.minimum(np.append(lms[1:], n - 1) + 1, n)
    names = _named(t, ordered, stop)
    # a leftmost-S substring has three symbols at least, and each further one two new ones;
    # the text of names ends in the sentinel's, its only 0
    if names[-1] + 1 < len(lms) and depth > 3:
        name = np.empty(n, np.int32)
        name[ordered] = names
        ordered = lms[_sorted(name[lms], depth // 2)]
    return _induce(t, s, ordered, sizes)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, cap: int, fresh: np.ndarray | None = None) -> np.ndarray:
    """For each text position, the common prefix of its suffix and the one before it in the array.

    Values below `cap` are exact; others are `cap` at least, less what a position lies behind the
    irreducible one that it is reduced to. Only irreducible values are compared symbol by symbol;
    `fresh` names positions that are compared in any case, so none lies far behind.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([t, np.zeros(4, t.dtype)]).astype(np.uint64)
    word = padded[:-3] | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(32) | padded[3:] << np.uint64(48)
    word = np.concatenate([word, np.zeros(cap + 8, np.uint64)])
    i = np.arange(n)
    irreducible = before < 0
    irreducible |= (i == 0) | (before == 0)
    inner = ~irreducible
    irreducible[inner] = t[i[inner] - 1] != t[before[inner] - 1]
    if fresh is not None:
        irreducible[fresh] = True
    at = np.flatnonzero(irreducible)
    value = np.zeros(len(at), np.int64)
    live = np.flatnonzero(before[at] >= 0)
    h = 0
    while len(live) and h < cap:
        differ = word[at[live] + h] ^ word[before[at[live]] + h]
        stop = differ != 0
        low = differ[stop] & (~differ[stop] + np.uint64(1))
        value[live[stop]] = h + (np.log2(low.astype(np.float64)).astype(np.int64) >> 4)
        live = live[~stop]
        h += 4
    value[live] = cap
    limit = np.minimum(n - at, n - np.maximum(before[at], 0))
    value = np.minimum(value, np.where(before[at] >= 0, limit, 0))
    gap = np.diff(np.concatenate([at, [n]]))
    return np.maximum(0, np.repeat(value, gap) - (i - np.repeat(at, gap)))
