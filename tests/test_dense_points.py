"""Neighbours where many points lie in reach: the work follows the points, and the results all distances."""

from __future__ import annotations

import numpy as np
import pytest

from terrazzo.operators import graph, spatial

POINTS = "id long, x double, y double, z double"


def frame(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], POINTS)


def clouds(seed: int):
    """Points in reach of each other, copies of some, and a few apart."""
    rng = np.random.default_rng(seed)
    near = rng.normal(size=(150, 3)) * 0.05
    return np.concatenate([near, near[:40], np.tile(near[:1], (30, 1)), rng.normal(size=(20, 3)) * 2])


@pytest.mark.parametrize("k, radius, with_self", [(4, 0.3, False), (5, 0.02, True), (40, 0.1, False)])
def test_knn_equals_all_distances(spark, k, radius, with_self):
    points = clouds(k)
    got = {(r.id, r["rank"]): (r.id2, r.dist) for r in spatial.knn(frame(spark, points), frame(spark, points), k, radius, with_self).collect()}
    dist = np.sqrt(sum((points[:, None, c] - points[None, :, c]) ** 2 for c in range(3)))
    want = {}
    for i, row in enumerate(dist):
        order = [int(j) for j in np.argsort(row, kind="stable") if row[j] <= radius and (with_self or j != i)]
        want |= {(i, n + 1): (j, float(row[j])) for n, j in enumerate(order[:k])}
    assert got == want


def test_knn_forms_no_pairs_of_all_points_in_reach(spark, monkeypatch):
    monkeypatch.setattr(spatial, "within", lambda *_: pytest.fail("all pairs in reach"))
    points = frame(spark, clouds(1))
    assert spatial.knn_edges(points, 4, 0.5).count() > 0


def reached(points, radius):
    """node -> least node reachable, of the points that have another in reach."""
    dist = np.sqrt(sum((points[:, None, c] - points[None, :, c]) ** 2 for c in range(3)))
    near = dist <= radius
    out = {}
    for i in range(len(points)):
        if i in out or near[i].sum() < 2:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in group:
                    group.add(j)
                    todo.append(j)
        out |= dict.fromkeys(group, i)
    return out


@pytest.mark.parametrize("pairs_of_cells, radius", [(1 << 16, 0.05), (4, 0.05), (4, 0.3)])
def test_links_have_the_components_of_all_pairs(spark, pairs_of_cells, radius):
    rng = np.random.default_rng(7)
    # walls that face each other at about the radius, so that outermost points don't tell
    wall = rng.uniform(-1, 1, size=(60, 3)) * [0.2 * radius, 0.2 * radius, 0.02 * radius]
    points = np.concatenate([clouds(2), *[wall + [3, 3, k * 0.995 * radius] for k in range(4)], *[wall[::-1] + [5, 5, k * 1.1 * radius] for k in range(4)]])
    got = {r.node: r.component for r in graph.components(spatial.links_within(frame(spark, points), radius, pairs_of_cells)).collect()}
    assert got == reached(points, radius)


def test_links_of_dense_points_grow_with_the_points(spark):
    points = frame(spark, np.random.default_rng(3).normal(size=(2000, 3)) * 0.01)
    assert spatial.links_within(points, 0.1).count() < 3 * 2000
