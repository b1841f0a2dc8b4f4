"""Word shingles and SetSketch registers in numpy.

A set's sketch has m registers. Every element drives a Poisson process of rate a*m whose arrivals
fall on random registers, so a register's first arrival over the set is exponential with rate
a*|set|; the register keeps floor(1 - log_b(first arrival)), truncated to [0, q+1]. Two sketches
merge by their element-wise maximum. A register agrees in two sets with about their Jaccard
similarity, which makes runs of registers usable as bands.
"""

from __future__ import annotations

import numpy as np
import xxhash

from terrazzo.llm.common import mix64

BASE = 1.001
RATE = 20.0
TOP = 2**16 - 2
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SIDE = np.uint64(0xA0761D6478BD642F)


class WordIds(dict):
    """Word bytes -> 64-bit id; emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


def shingles(text: str | None, width: int, ids: WordIds) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words.

    Words are split at ASCII white space after lower-casing A-Z. With fewer words the whole
    sequence is one shingle; without any, the set is empty.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        total = mix64(total * _ODD[0] + hashed[i : i + len(total)])
    return np.unique(total)


def sketch(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SetSketch registers (uint16) of non-empty sets, a row for each."""
    count = len(sets)
    first = np.full(count * m, np.inf)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    element = np.concatenate(sets) if count else np.zeros(0, np.uint64)
    at = np.zeros(len(element))
    step = 0
    while len(element):
        width = 1 if step < 2 else 4 if step < 10 else 16
        turn = np.arange(step, step + width, dtype=np.uint64)
        draw = mix64(element[:, None] + (turn * _STEP + np.uint64(1))[None, :])
        gap = -np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / (RATE * m)
        times = at[:, None] + np.cumsum(gap, axis=1)
        register = (mix64(draw ^ _SIDE) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, (owner[:, None] * m + register).ravel(), times.ravel())
        latest = first.reshape(count, m).max(axis=1)
        at = times[:, -1]
        live = at < latest[owner]
        element, owner, at = element[live], owner[live], at[live]
        step += width
    level = np.floor(1.0 - np.log(first) / np.log(BASE))
    return np.clip(level, 0, TOP + 1).astype(np.uint16).reshape(count, m)


def bands(registers: np.ndarray, n_bands: int) -> np.ndarray:
    """One 64-bit key (int64) per band of registers, its number mixed in."""
    count, m = registers.shape
    rows = m // n_bands
    parts = registers[:, : rows * n_bands].reshape(count, n_bands, rows).astype(np.uint64)
    key = np.tile(np.arange(1, n_bands + 1, dtype=np.uint64) * _ODD[1], (count, 1))
    for r in range(rows):
        key = mix64(key * _ODD[0] + parts[:, :, r] + np.uint64(1))
    return key.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def joint_estimate(n_u, n_v, greater, less, m: int) -> np.ndarray:
    """Jaccard similarity of greatest likelihood, from the set sizes and the numbers of registers
    that are greater and less in the first sketch (the rest agree)."""
    n_u, n_v, greater, less = (np.asarray(x, np.float64) for x in (n_u, n_v, greater, less))
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    same = m - greater - less

    def value(j):
        up, down = _p(np.maximum(u - v * j, 1e-12)), _p(np.maximum(v - u * j, 1e-12))
        return greater * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    golden = (5**0.5 - 1) / 2
    for _ in range(20):  # the likelihood has one maximum
        left, right = high - golden * (high - low), low + golden * (high - low)
        rise = value(left) < value(right)
        low, high = np.where(rise, left, low), np.where(rise, high, right)
    return (low + high) / 2
