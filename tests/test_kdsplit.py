"""Nearest points by split space, against all distances."""

from __future__ import annotations

import numpy as np
import pytest

from terrazzo.operators import kdsplit

POINTS = "id long, x double, y double, z double"


def clouds(seed: int):
    """Tight clusters, equal points, and far outliers on both sides."""
    rng = np.random.default_rng(seed)
    right = np.concatenate([rng.normal(size=(400, 3)) * 0.01 + c for c in ((0, 0, 0), (5, 5, 5), (5, 5.1, 5))] + [np.tile([[1.0, 1.0, 1.0]], (60, 1)), [[1e6, -1e6, 3.0], [-400.0, 0.0, 0.0]]])
    left = np.concatenate([rng.normal(size=(150, 3)) * 0.02 + (5, 5, 5), rng.normal(size=(50, 3)) * 3, np.tile([[1.0, 1.0, 1.0]], (5, 1)), [[-1e7, 2e6, 0.0], [1e6, 1e6, 1e6], [900.0, 0.0, 0.0]]])
    return left, right


def frame(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], POINTS)


@pytest.mark.parametrize("k, leaf_points, asked", [(1, 40, 16), (3, 40, 1000), (5, 5000, 64), (70, 30, 50)])
def test_nearest_equals_all_distances(spark, k, leaf_points, asked):
    left, right = clouds(k)
    got = {(r.id, r["rank"]): (r.id2, r.dist) for r in kdsplit.nearest(frame(spark, left), frame(spark, right), k, leaf_points, asked).collect()}
    dist = np.sqrt(sum((left[:, None, c] - right[None, :, c]) ** 2 for c in range(3)))
    order = np.argsort(dist, axis=1, kind="stable")[:, :k]
    assert got == {(i, n + 1): (int(j), float(dist[i, j])) for i in range(len(left)) for n, j in enumerate(order[i])}


def test_leaves_are_bounded_where_points_differ():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(size=(4000, 3)) * 1e-3, rng.normal(size=(4000, 3)) * 1e3])
    tree = kdsplit.Splits(points[::2], 32)
    assert tree.leaves == 32 and np.bincount(tree.leaf_of(points)).max() < 1.5 * len(points) / 32


def test_few_and_odd_points(spark):
    none = frame(spark, [])
    some = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, float("inf"), 0.0, 0.0), (None, 0.0, 0.0, 0.0), (5, 3.0, 4.0, 0.0)], POINTS)
    assert kdsplit.nearest(none, some).count() == kdsplit.nearest(some, none).count() == 0
    assert sorted(map(tuple, kdsplit.nearest(some, some, 4).collect())) == [(1, 1, 0.0, 1), (1, 5, 5.0, 2), (5, 1, 5.0, 2), (5, 5, 0.0, 1)]
