"""Bundle adjustment: recovery of perturbed scenes, and against one dense system a round."""

from __future__ import annotations

import numpy as np
import pytest

from terrazzo.functions import lie
from terrazzo.operators import adjust

CAMERA = (60.0, 62.0, 20.0, 16.0)
POSES = "scene string, frame long, pose array<double>, fixed boolean"
POINTS = "scene string, frame long, pixel long, u double, v double, disparity double, sensor double, sensor_weight double"
FACTORS = "scene string, i long, j long, pixel long, tu double, tv double, wu double, wv double"


def scene(name: str, n: int, seed: int, noise: float = 0.0):
    """True and perturbed tables of a scene whose frames look at a wavy wall."""
    rng = np.random.default_rng(seed)
    true = lie.exp(np.array([[0.12 * i, 0.05 * np.sin(i), 0.03 * i, 0.01 * i, -0.02 * i, 0.015 * np.cos(i)] for i in range(n)]))
    grid = np.array([(u, v) for v in range(2, 32, 6) for u in range(2, 40, 6)], float)
    depth = 0.3 + 0.1 * rng.random((n, len(grid)))
    start = lie.mul(lie.exp(np.where(np.arange(n)[:, None] < 2, 0, rng.normal(size=(n, 6)) * 0.02)), true)
    first = depth * (1 + 0.1 * rng.normal(size=depth.shape))
    factors = []
    for i in range(n):
        for j in range(n):
            if 0 < abs(i - j) <= 2:
                relative = np.broadcast_to(lie.mul(true[j], lie.inv(true[i])), (len(grid), 7))
                seen, front, *_ = adjust.linearise(CAMERA, relative, grid[:, 0], grid[:, 1], depth[i], np.zeros((len(grid), 2)))
                seen = seen + noise * rng.normal(size=seen.shape)
                factors += [(name, i, j, p, *seen[p].tolist(), 1.0, 0.5 + 0.5 * (p % 2)) for p in range(len(grid)) if front[p]]
    poses = [(name, i, start[i].tolist(), i < 2) for i in range(n)]
    points = [(name, i, p, *grid[p].tolist(), float(first[i, p]), float(depth[i, p]) if p % 3 == 0 else None, 1.0) for i in range(n) for p in range(len(grid))]
    return true, depth, poses, points, factors


def tables(spark, *scenes):
    poses, points, factors = ([row for s in scenes for row in s[k]] for k in (2, 3, 4))
    cameras = [(name, *CAMERA) for name in sorted({p[0] for p in poses})]
    return spark.createDataFrame(poses, POSES), spark.createDataFrame(points, POINTS), spark.createDataFrame(factors, FACTORS), spark.createDataFrame(cameras, "scene string, fx double, fy double, cx double, cy double")


def dense(poses, points, factors, rounds: int, damping: adjust.Damping):
    """Energies, poses and inverse depths by one system over all variables."""
    pose = np.array([p[2] for p in sorted(poses, key=lambda p: p[1])])
    order = {(p[1], p[2]): k for k, p in enumerate(points)}
    d = np.array([p[5] for p in points])
    sensor, held = np.array([p[6] or 0.0 for p in points]), np.array([damping.sensor if p[6] is not None else 0.0 for p in points])
    z = np.array([order[f[1], f[3]] for f in factors])
    i, j = np.array([f[1] for f in factors]), np.array([f[2] for f in factors])
    uv, target, weight = np.array([points[k][3:5] for k in z]), np.array([f[4:6] for f in factors]), np.array([f[6:8] for f in factors])
    n, m = len(pose) * 6, len(d)
    touched = np.unique(z)
    free = np.concatenate([[6 * p[1] + k for k in range(6)] for p in sorted(poses, key=lambda p: p[1]) if not p[3]] + [n + touched]).astype(int)
    energies = []
    for turn in range(rounds + 1):
        r, front, ji, jj, jz = adjust.linearise(CAMERA, lie.mul(pose[j], lie.inv(pose[i])), uv[:, 0], uv[:, 1], d[z], target)
        w = weight * front[:, None]
        loss = np.where(np.abs(r) > 1, 2 * np.abs(r) - 1, r * r)
        energies.append((w * loss).sum() + (held * (d - sensor) ** 2)[touched].sum())
        if turn == rounds:
            break
        w = (w / np.maximum(np.abs(r), 1)).ravel()
        jac = np.zeros((len(z), 2, n + m))
        for f in range(len(z)):
            jac[f, :, 6 * i[f] : 6 * i[f] + 6] += ji[f]
            jac[f, :, 6 * j[f] : 6 * j[f] + 6] += jj[f]
            jac[f, :, n + z[f]] += jz[f]
        jac = jac.reshape(-1, n + m)
        a, b = jac.T @ (jac * w[:, None]), -jac.T @ (w * r.ravel())
        a[range(n, n + m), range(n, n + m)] += held
        b[n:] -= held * (d - sensor)
        diagonal = np.diag(a).copy()
        a[range(n), range(n)] += damping.pose * diagonal[:n] + damping.pose_ep
        a[range(n, n + m), range(n, n + m)] += damping.depth * diagonal[n:] + damping.depth_ep
        x = np.zeros(n + m)
        x[free] = np.linalg.solve(a[np.ix_(free, free)], b[free])
        pose = lie.mul(lie.exp(x[:n].reshape(-1, 6)), pose)
        d = adjust.retracted(d, x[n:])
    return energies, pose, d


def test_jacobians_are_derivatives():
    rng = np.random.default_rng(4)
    relative, u, v, d, h = lie.exp(rng.normal(size=(5, 6)) * 0.2), rng.uniform(0, 40, 5), rng.uniform(0, 32, 5), rng.uniform(0.2, 0.6, 5), 1e-6
    at = lambda g, d: adjust.linearise(CAMERA, g, u, v, d, np.zeros((5, 2)))[0]
    _, front, ji, jj, jz = adjust.linearise(CAMERA, relative, u, v, d, np.zeros((5, 2)))
    assert front.all()
    for k in range(6):
        step = lie.exp(np.tile(h * np.eye(6)[k], (5, 1)))
        assert np.allclose(jj[..., k], (at(lie.mul(step, relative), d) - at(lie.mul(lie.inv(step), relative), d)) / (2 * h), atol=1e-4)
        assert np.allclose(ji[..., k], (at(lie.mul(relative, lie.inv(step)), d) - at(lie.mul(relative, step), d)) / (2 * h), atol=1e-4)
    assert np.allclose(jz, (at(relative, d + h) - at(relative, d - h)) / (2 * h), atol=1e-4)


@pytest.fixture(scope="module")
def two():
    return scene("a", 5, 1), scene("b", 4, 2, noise=0.4)


@pytest.fixture(scope="module")
def adjusted(spark, two):
    return adjust.bundle_adjustment(*tables(spark, *two), rounds=6)


def test_perturbed_poses_and_depths_come_back(adjusted, two):
    true, depth, *_ = two[0]
    got = {r.frame: np.array(r.pose) for r in adjusted.poses.where("scene = 'a'").collect()}
    assert all(np.abs(lie.matrix(got[i]) - lie.matrix(true[i])).max() < 1e-3 for i in range(len(true)))
    points = adjusted.points.where("scene = 'a'").collect()
    assert len(points) == depth.size and np.median([abs(r.disparity - depth[r.frame, r.pixel]) for r in points]) < 1e-3


def test_energy_falls_in_every_round_until_a_scene_stops(adjusted):
    rows = sorted((r.scene, r.round, r.energy) for r in adjusted.history.collect())
    for name in "ab":
        energy = [e for s, _, e in rows if s == name]
        assert len(energy) > 3 and all(y < x for x, y in zip(energy, energy[1:-1])) and energy[-1] <= energy[-2] * (1 + 1e-9) and energy[-1] < (0.2 if name == "b" else 1e-3) * energy[0]  # b has noise


def test_rounds_equal_one_dense_system(spark, two):
    damping = adjust.Damping(pose=1e-3, depth=1e-2)
    got = adjust.bundle_adjustment(*tables(spark, *two), rounds=3, stop=-1.0, damping=damping)
    history, poses, points = got.history.collect(), got.poses.collect(), got.points.collect()
    for s in two:
        name = s[2][0][0]
        energies, pose, d = dense(s[2], s[3], s[4], 3, damping)
        assert np.allclose([r.energy for r in sorted(history, key=lambda r: r.round) if r.scene == name], energies, rtol=1e-6)
        assert all(np.abs(lie.matrix(np.array(r.pose)) - lie.matrix(pose[r.frame])).max() < 1e-6 for r in poses if r.scene == name)
        mine = {(r.frame, r.pixel): r.disparity for r in points if r.scene == name}
        assert max(abs(mine[p[1], p[2]] - d[k]) for k, p in enumerate(s[3])) < 1e-6


def test_odd_tables(spark, two):
    poses, points, factors, cameras = tables(spark, two[0])
    more = spark.createDataFrame([("a", 0, 99, 0, 1.0, 1.0, 1.0, 1.0), ("a", 0, 1, 777, 1.0, 1.0, 1.0, 1.0), ("gone", 0, 1, 0, 1.0, 1.0, 1.0, 1.0), ("a", 0, 1, 0, None, 1.0, 1.0, 1.0)], FACTORS)
    lone = spark.createDataFrame([("a", 0, 500, 1.0, 1.0, 0.5, None, None), ("empty", 0, 1, 1.0, 1.0, 0.7, None, 1.0)], POINTS)
    alone = spark.createDataFrame([("empty", 0, [0.0] * 6 + [1.0], None)], POSES)
    plain = adjust.bundle_adjustment(poses, points, factors, cameras, rounds=2)
    odd = adjust.bundle_adjustment(poses.unionByName(alone), points.unionByName(lone), factors.unionByName(more), cameras, rounds=2)
    same = lambda df: {(r.scene, r.frame): np.round(r.pose, 9).tolist() for r in df.collect()}
    assert same(odd.poses.where("scene = 'a'")) == same(plain.poses) and odd.poses.where("scene = 'empty'").count() == 1
    kept = {(r.scene, r.frame, r.pixel): r.disparity for r in odd.points.collect()}
    assert kept["a", 0, 500] == 0.5 and kept["empty", 0, 1] == 0.7
    none = adjust.bundle_adjustment(poses.limit(0), points.limit(0), factors.limit(0), cameras.limit(0))
    assert none.poses.count() == none.points.count() == none.history.count() == 0
