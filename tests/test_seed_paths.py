"""Paths to seeds over blocks, against one search over all."""

from __future__ import annotations

import heapq

import numpy as np
import pytest

from terrazzo.operators import spatial

EDGES, POINTS = "lo long, hi long, cost double", "id long, x double, y double, z double"


def dijkstra(edges, seeds) -> dict[int, tuple[float, int]]:
    near: dict[int, list] = {}
    for a, b, c in edges:
        near.setdefault(a, []).append((b, c))
        near.setdefault(b, []).append((a, c))
    best, queue = {s: (0.0, s) for s in seeds}, [(0.0, s, s) for s in sorted(seeds)]
    while queue:
        total, seed, i = heapq.heappop(queue)
        if best[i] != (total, seed):
            continue
        for j, c in near.get(i, ()):
            if j not in best or (total + c, seed) < best[j]:
                best[j] = (total + c, seed)
                heapq.heappush(queue, (total + c, seed, j))
    return best


def run(spark, edges, seeds, points, **how):
    got = spatial.shortest_to_seeds(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(s,) for s in seeds], "id long"), spark.createDataFrame(points, POINTS), **how)
    return {r.id: (r.cost, r.seed) for r in got.collect()}


def test_a_chain_of_a_thousand_points_takes_rounds_by_blocks(spark):
    n = 1000
    points, edges = [(i, i * 0.1, 0.0, 0.0) for i in range(n)], [(i, i + 1, 1.0) for i in range(n - 1)]
    # 99.9 long in blocks of 10: ten blocks, so ten rounds and one that finds nothing to send
    got = run(spark, edges, [0], points, width=10.0, rounds=11)
    assert got == {i: (float(i), 0) for i in range(n)}
    with pytest.raises(RuntimeError, match="did not settle"):
        run(spark, edges, [0], points, width=10.0, rounds=5)


@pytest.mark.parametrize("width", [None, 0.5, 5.0])
def test_blocks_of_any_width_give_the_same_paths(spark, width):
    rng = np.random.default_rng(7)
    xyz = rng.uniform(-1, 1, (150, 3))
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 150, (260, 2)) if a != b})
    edges = [(a, b, float(rng.choice([0.0, 0.5, 1.0, 1.5]))) for a, b in edges]  # many ties
    seeds = [3, 50, 149]
    want = dijkstra(edges, seeds)
    got = run(spark, edges, seeds, [(i, *p.tolist()) for i, p in enumerate(xyz)], width=width)
    assert got == {i: want.get(i, (0.0, i)) for i in range(150)}


def test_points_dealt_by_id(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK_POINTS", 4)
    edges = [(i, i + 1, 0.25) for i in range(8)]
    got = run(spark, edges, [4], [(i, 0.0, 0.0, 0.0) for i in range(12)])
    assert got == {i: (abs(i - 4) * 0.25, 4) if i < 9 else (0.0, i) for i in range(12)}


def test_no_seeds_no_edges(spark):
    got = spatial.shortest_to_seeds(spark.createDataFrame([], EDGES), spark.createDataFrame([], "id long"), spark.createDataFrame([(1, 0.0, 0.0, 0.0)], POINTS), width=1.0)
    assert [tuple(r) for r in got.collect()] == [(1, 1, 0.0)]


def test_a_component_too_large_for_a_task_is_refused(monkeypatch):
    from terrazzo.operators import selection

    monkeypatch.setattr(selection, "MOST_EDGES", 2)
    with pytest.raises(ValueError, match="3 edges in one component"):
        selection.agglomerate({i: 1 for i in range(4)}, [(0, 1, 1.0, 1.0), (1, 2, 1.0, 1.0), (2, 3, 1.0, 1.0)], 1.0, 1.0)
