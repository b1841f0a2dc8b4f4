"""Lifting, poses, images and block helpers on small cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo import config
from terrazzo.functions import images
from terrazzo.operators import lift, poses, slam, temporal


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


EYE = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def moved(x=0.0, y=0.0, z=0.0):
    p = list(EYE)
    p[3], p[7], p[11] = x, y, z
    return p


def test_lift_of_one_frame(spark):
    points = frame(spark, [(i, float(i), 0.0, 1.0) for i in range(4)], "id long, x double, y double, z double")
    frames = frame(spark, [(0, EYE, 1.0, 1.0, 0.0, 0.0, 4, 1), (1, EYE, 1.0, 1.0, 0.0, 0.0, 4, 1)], "f int, pose array<double>, fx double, fy double, cx double, cy double, width int, height int")
    depth = frame(spark, [(f, u, 0, 1.0) for f in (0, 1) for u in range(4)], "f int, pu int, pv int, measured double")
    visible = lift.visible_points(points, frames, depth)
    assert visible.count() == 8
    masks = frame(spark, [(0, 4, u, 0) for u in (0, 2)] + [(0, 5, u, 0) for u in (1, 2, 3)], "f int, track long, pu int, pv int")
    atoms = frame(spark, [(0, 0), (1, 0), (2, 1), (3, 1)], "id long, atom long")
    out = lift.lift(visible, masks, atoms, 1)
    assert sorted((r["atom"], r["gm"], r["cnt"]) for r in out["leaf_i"].collect()) == [(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 2)]
    assert sorted((r["atom"], r["frame"], r["cnt"]) for r in out["leaf_n"].collect()) == [(0, 0, 2), (1, 0, 2)]
    assert sorted(map(tuple, out["unions"].collect())) == [(4, 0), (4, 2), (5, 1), (5, 2), (5, 3)]
    assert [r["track"] for r in lift.lift(visible, masks, atoms, 3)["masks"].collect()] == [5]


def test_views_leave_no_point_out(spark):
    """Random points and turned cameras: the same as projecting every point into every frame."""
    rng = np.random.default_rng(4)
    xyz = rng.uniform(-4, 4, (400, 3))
    frames, depth, want = [], [], set()
    for f in range(5):
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        turn[:, 0] *= np.sign(np.linalg.det(turn))
        at = rng.uniform(-1, 1, 3)
        pose = np.eye(4)
        pose[:3, :3], pose[:3, 3] = turn, at
        frames.append((f, pose.ravel().tolist(), 20.0, 18.0, 11.5, 7.0, 24, 16))
        local = (xyz - at) @ turn
        for i, (x, y, z) in enumerate(local.tolist()):
            if z > 1e-3:
                u, v = 20 * x / z + 11.5, 18 * y / z + 7
                if 0 <= u < 24 and 0 <= v < 16:
                    depth.append((f, int(u), int(v), z))
        front = {}
        for g, pu, pv, z in depth:
            if g == f:
                front[pu, pv] = min(z, front.get((pu, pv), np.inf))
        depth = [d for d in depth if d[0] != f] + [(f, pu, pv, z) for (pu, pv), z in front.items()]
        for i, (x, y, z) in enumerate(local.tolist()):
            if z > 1e-3:
                u, v = 20 * x / z + 11.5, 18 * y / z + 7
                if 0 <= u < 24 and 0 <= v < 16 and abs(front[int(u), int(v)] - z) <= 0.05:
                    want.add((f, i, int(u), int(v)))
    points = frame(spark, [(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")
    cameras = frame(spark, frames, "f int, pose array<double>, fx double, fy double, cx double, cy double, width int, height int")
    pixels = frame(spark, depth, "f int, pu int, pv int, measured double")
    for block in (0.3, 1.0, 20.0):
        assert {tuple(r) for r in lift.visible_points(points, cameras, pixels, block=block).collect()} == want
    blocks = frame(spark, [(i, j, k) for i in range(-4, 4) for j in range(-4, 4) for k in range(-4, 4)], "bx int, by int, bz int")
    assert lift.in_view(blocks, cameras.withColumn("far", F.lit(3.0)), 1.0).count() < 5 * 512 / 2 and len(want) > 50


def test_numbers_are_dense_over_partitions(spark):
    rows = lift.numbered(spark.range(100).select((F.col("id") * 7 % 101).alias("k")), ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(100))


def test_first_pose_becomes_the_origin(spark):
    rows = frame(spark, [("s", i, moved(x=2.0 + i)) for i in range(3)], "scene string, frame long, pose array<double>")
    got = {r["frame"]: r["pose"][3] for r in poses.align_to_first(rows).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 2.0}


def test_errors_of_equal_poses_are_zero(spark):
    rows = frame(spark, [("s", i, moved(float(i), float(i * i), 1.0)) for i in range(4)] + [("s", 9, None)], "scene string, frame long, pose array<double>")
    errors = [r["e"] for r in poses.pose_errors(poses.usable_pairs(rows, rows)).collect()]
    assert len(errors) == 6 and max(errors) < 1e-4


def test_pose_quality(spark):
    good = [("good", i, moved(0.01 * i)) for i in range(20)]
    jump = [("jump", i, moved(0.01 * i + (50 if i > 9 else 0))) for i in range(2000)]
    torn = [("torn", i, moved() if i % 2 else None) for i in range(20)]
    got = {r["scene"]: r["ok"] for r in poses.pose_quality(frame(spark, good + jump + torn, "scene string, frame long, pose array<double>")).collect()}
    assert got == {"good": True, "jump": False, "torn": False}


def test_keyframe_prune_and_shift(spark):
    rows = frame(spark, [(0, f, d) for f, d in ((0, 9.0), (1, 9.0), (2, 1.0), (3, 9.0))], "s int, frame long, d double")
    assert sorted(r["frame"] for r in temporal.scan_groups(rows, "s", ["frame"], poses.prune_keyframes()).collect()) == [0, 2, 3]
    edges = frame(spark, [(0, 1), (1, 2), (2, 3)], "i long, j long")
    assert sorted(map(tuple, poses.without_keyframe(edges, 1, "i", "j").collect())) == [(1, 2)]


def test_lone_keyframe_takes_the_sensor(spark):
    rows = frame(spark, [("a", 0.5, 0.2), ("b", 0.5, 0.2), ("b", 0.5, 0.0)], "scene string, disparity double, sensor double")
    assert sorted((r["scene"], r["disparity"]) for r in poses.filled_disparity(rows).collect()) == [("a", 0.2), ("b", 0.5), ("b", 0.5)]


def test_mesh_samples_follow_the_area(spark):
    big, small = (0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 3.0, 0.0), (9.0, 9.0, 9.0, 10.0, 9.0, 9.0, 9.0, 10.0, 9.0)
    schema = "t long, " + ", ".join(f"{p}{q} double" for p in "abc" for q in "xyz")
    rows = poses.sampled_mesh(frame(spark, [(0, *big), (1, *small)], schema), 1000).collect()
    n = sum(r["t"] == 0 for r in rows)
    assert abs(len(rows) - 1000) <= 2 and abs(n - 900) <= 2
    assert all(r["x"] >= 0 and r["y"] >= 0 and r["x"] + r["y"] <= 3 + 1e-9 for r in rows if r["t"] == 0)


def test_samples_do_not_depend_on_partitions(spark):
    ids = spark.range(500).select(F.lit("s").alias("scene"), "id")
    a, b = (sorted(r["id"] for r in poses.sampled_ids(ids.repartition(n), 20).collect()) for n in (1, 9))
    assert a == b and len(a) == 20


def test_block_helpers(spark):
    blocks = frame(spark, [(0, 1, 1, 0, [[1.0], [2.0]])], "gi int, gj int, bi int, bj int, rows array<array<double>>")
    sizes = frame(spark, [(0, 2, 3), (1, 1, 4)], "grp int, rows_per_block int, blocks int")
    assert sorted(map(tuple, slam.raveled(blocks, sizes).collect())) == [(2, 6, 1.0), (3, 6, 2.0)]
    got = slam.symmetric_lookup(frame(spark, [(1, 2, 5.0)], "a int, b int, value double"), frame(spark, [(2, 1), (1, 2)], "a int, b int"))
    assert [r["value"] for r in got.collect()] == [5.0, 5.0]
    a = frame(spark, [(0, 0, 1.0), (0, 1, 2.0)], "i long, j long, value double")
    assert sorted(map(tuple, slam.damped_by(a, 0.5, frame(spark, [(0, 3.0)], "i long, damping double")).collect())) == [(0, 0, 4.5), (0, 1, 2.0)]


def test_images():
    a = np.arange(16.0).reshape(4, 4)
    assert images.resize(a, 2, 2, "nearest").tolist() == [[0, 2], [8, 10]]
    assert images.resize(a, 2, 2, "area").tolist() == [[2.5, 4.5], [10.5, 12.5]]
    assert np.allclose(images.resize(a, 4, 4, "linear"), a)
    k = np.array([[10.0, 0, 2], [0, 10, 2], [0, 0, 1]])
    u, v = images.rectification(4, 4, k, np.zeros(4), k)
    assert np.allclose(images.sample(a, u, v), a)
    f = np.random.default_rng(0).normal(size=(8, 8, 3))
    pyramid = images.correlation_pyramid(f, f, 2)
    v, u = np.mgrid[:8, :8].astype(float)
    window = images.correlation_window(pyramid, u, v, 1)
    assert window.shape == (8, 8, 2, 9) and window[3, 3, 0, 4] == pytest.approx(pyramid[0][3, 3, 3, 3])


def test_config_names_what_is_missing():
    c = config.parsed('{"a": {"b": 1}}')
    assert c.a.b == 1
    with pytest.raises(AttributeError, match="'x'"):
        c.x
