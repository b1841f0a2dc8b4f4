"""Lookups by tiles against the dense pyramid."""

from __future__ import annotations

import numpy as np
import pytest

from terrazzo.operators import correlation

FEATURES = "scene string, frame long, y long, x long, f array<double>"
ASKED = "scene string, i long, j long, y long, x long, u double, v double"


def maps(n=3, h=21, w=34, c=6, seed=0):
    return np.random.default_rng(seed).normal(size=(n, h, w, c))


def dense(one, two, u, v, levels, radius):
    """Windows by the volume of all pairs, padded with zeros; whole cells only are averaged."""
    volume, out = np.einsum("abc,dec->abde", one, two) / 16, []
    for level in range(levels):
        if level:
            h, w = (n // 2 * 2 for n in volume.shape[2:])
            volume = volume[:, :, :h, :w].reshape(*volume.shape[:2], h // 2, 2, w // 2, 2).mean(axis=(3, 5))
        wide = np.pad(volume, ((0, 0), (0, 0), (50, 50), (50, 50)))
        for y in range(u.shape[0]):
            for x in range(u.shape[1]):
                a, b = u[y, x] / 2**level, v[y, x] / 2**level
                left, top = int(np.floor(a)), int(np.floor(b))
                for i in range(-radius, radius + 1):
                    for j in range(-radius, radius + 1):
                        c = wide[y, x, top + j + 50 : top + j + 52, left + i + 50 : left + i + 52]
                        out.append(((1 - b + top) * c[0] + (b - top) * c[1]) @ (1 - a + left, a - left))
    return np.array(out).reshape(levels, *u.shape, -1)


def rows(f, scene="s"):
    return [(scene, k, y, x, f[k, y, x].tolist()) for k in range(f.shape[0]) for y in range(f.shape[1]) for x in range(f.shape[2])]


@pytest.mark.parametrize("levels, radius, tile", [(4, 3, 16), (3, 1, 5), (1, 2, 64)])
def test_lookups_equal_the_dense_pyramid(spark, levels, radius, tile):
    f = maps()
    rng = np.random.default_rng(1)
    h, w = f.shape[1:3]
    u, v = rng.uniform(-6, w + 6, (h, w)), rng.uniform(-6, h + 6, (h, w))
    u[0, :5], v[0, :5] = np.arange(5), 16.0  # whole numbers, and borders of tiles
    asked = [("s", 0, 1, y, x, float(u[y, x]), float(v[y, x])) for y in range(h) for x in range(w)]
    want = dense(f[0], f[1], u, v, levels, radius)
    got = correlation.lookup(spark.createDataFrame(rows(f), FEATURES), spark.createDataFrame(asked, ASKED), levels, radius, tile).collect()
    assert len(got) == h * w * levels
    assert max(np.abs(np.array(r.window) - want[r.level, r.y, r.x]).max() for r in got) < 1e-9


def test_odd_lookups(spark):
    f = maps(2, 9, 9, 3)
    asked = [("s", 0, 1, 99, 0, 1.0, 1.0), ("s", 0, 1, 0, 0, None, 1.0), ("s", 0, 1, 0, 0, float("nan"), 1.0), ("t", 0, 1, 0, 0, 1.0, 1.0), ("s", 0, 7, 0, 0, 1.0, 1.0), ("s", 0, 1, 0, 0, 5000.0, -900.0), ("s", 1, 1, 2, 3, 3.0, 2.0)]
    got = {(r.i, r.j, r.y, r.x): r.window for r in correlation.lookup(spark.createDataFrame(rows(f), FEATURES), spark.createDataFrame(asked, ASKED), 1, 1).collect()}
    assert set(got) == {(0, 1, 0, 0), (0, 7, 0, 0), (1, 1, 2, 3)}
    assert got[0, 1, 0, 0] == got[0, 7, 0, 0] == [0.0] * 9
    assert got[1, 1, 2, 3][4] == pytest.approx((f[1, 2, 3] ** 2).sum() / 16)
    assert correlation.lookup(spark.createDataFrame([], FEATURES), spark.createDataFrame(asked, ASKED)).count() == 0
