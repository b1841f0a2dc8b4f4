"""SE3 columns against numpy, infill and extrapolation of poses."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazzo.functions import lie, se3
from terrazzo.operators import motion

ANGLES = (0, 1e-12, 1e-8, 1e-6, 1e-4, 0.0199, 0.0201, 0.1, 1, 2, 3, np.pi - 1e-6, np.pi - 1e-9)


def tangents(seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    axes = rng.normal(size=(len(ANGLES) * 3, 3))
    axes /= np.linalg.norm(axes, axis=1)[:, None]
    return np.concatenate([rng.normal(size=axes.shape), axes * np.repeat(ANGLES, 3)[:, None]], 1)


def array(df, name):
    return np.stack(df[name].to_numpy())


@pytest.fixture(scope="module")
def poses(spark):
    xi = tangents()
    a, b = lie.exp(xi), lie.exp(tangents(1)[::-1])
    b[::2, 3:] *= -1  # the other quaternion of the same turn
    df = spark.createDataFrame([(i, *(v.tolist() for v in row)) for i, row in enumerate(zip(xi, a, b))], "id int, xi array<double>, a array<double>, b array<double>")
    return xi, a, b, df.coalesce(1)


def test_columns_agree_with_numpy(poses):
    xi, a, b, df = poses
    one, two = F.col("a"), F.col("b")
    made = {"exp": se3.exp(F.col("xi")), "log": se3.log(one), "log_b": se3.log(two), "product": se3.product(one, two), "inverse": se3.inverse(one), "adjoint": se3.adjoint(one, F.col("xi")), "act": se3.act(one, F.slice("xi", 1, 3)), "between": se3.interpolate(one, two, F.lit(0.3)), "ahead": se3.extrapolate(one, two)}
    got = df.select("id", *[c.alias(n) for n, c in made.items()]).toPandas().sort_values("id")
    want = {"exp": a, "log": lie.log(a), "log_b": lie.log(b), "product": lie.mul(a, b), "inverse": lie.inv(a), "adjoint": lie.adjoint(a, xi), "act": lie.act(a, xi[:, :3]), "between": lie.interpolate(a, b, np.full(len(a), 0.3)), "ahead": lie.extrapolate(a, b)}
    for name, value in want.items():
        assert np.abs(array(got, name) - value).max() < 1e-9, name
    assert np.abs(array(got, "log") - xi).max() < 1e-9  # also at angles near 0 and pi


def test_adjoint_carries_a_tangent_over(poses):
    xi, a, _, df = poses
    small = se3.scaled(F.col("xi"), F.lit(0.1))
    got = df.select("id", se3.product(F.col("a"), se3.exp(small)).alias("x"), se3.product(se3.exp(se3.adjoint(F.col("a"), small)), F.col("a")).alias("y")).toPandas()
    assert np.abs(lie.matrix(array(got, "x")) - lie.matrix(array(got, "y"))).max() < 1e-9


def test_nulls_stay_null(spark):
    null = F.lit(None).cast("array<double>")
    one = F.array(*[F.lit(float(k == 6)) for k in range(7)])
    row = spark.range(1).select(se3.exp(null).alias("a"), se3.log(null).alias("b"), se3.product(one, null).alias("c"), se3.inverse(null).alias("d"), se3.interpolate(null, one, F.lit(0.5)).alias("e"), se3.adjoint(one, null).alias("f")).first()
    assert all(v is None for v in row)


def track(n: int = 12) -> np.ndarray:
    return lie.exp(np.array([[0.1 * i, 0.02 * i * i, -0.05 * i, 0.1 * i, 0.03 * i, -0.2] for i in range(n)]))


def test_infill_between_keyframes(spark):
    poses, keys = track(), (2, 5, 9)
    frames = spark.createDataFrame([("s", i, i, p.tolist(), i in keys) for i, p in enumerate(poses)] + [("none", 1, 1, poses[0].tolist(), False)], "u string, id long, t long, v array<double>, key boolean")
    got = {r.id: np.array(r.pose) for r in motion.infilled(frames, "u", F.col("key")).collect()}
    assert set(got) == set(range(12))
    for i in range(12):
        left = max([k for k in keys if k <= i], default=2)
        right = min([k for k in keys if k > left], default=left) if i > left else left
        share = (i - left) / (right - left + 1e-3)
        want = poses[left] if i <= 2 or left == 9 else lie.interpolate(poses[left], poses[right], np.array(share))
        assert np.abs(got[i] - want).max() < 1e-9, i


def test_extrapolation_takes_the_last_two_poses(spark):
    poses = track()
    frames = spark.createDataFrame([("s", i, i, p.tolist()) for i, p in enumerate(poses)] + [("one", 50, 0, poses[0].tolist())], "u string, id long, t long, v array<double>")
    got = {r.id: np.array(r.pose) for r in motion.extrapolated(frames, "u").collect()}
    assert set(got) == set(range(2, 12))
    assert all(np.abs(got[i] - lie.extrapolate(poses[i - 2], poses[i - 1])).max() < 1e-9 for i in got)


def test_extrapolation_keeps_the_sign_of_the_pose_before(spark):
    turn = lambda half: [0.0, 0.0, 0.0, 0.0, 0.0, float(np.sin(half)), float(np.cos(half))]
    # half angles 0 and 1.75: the step's quaternion has a negative real part, so its least turn is the other way
    step = 1.75 - np.pi
    frames = spark.createDataFrame([("s", i, i, turn(h)) for i, h in enumerate((0.0, 1.75, 0.1))], "u string, id long, t long, v array<double>")
    got = {r.id: np.array(r.pose) for r in motion.extrapolated(frames, "u").collect()}
    assert np.abs(got[2] - turn(1.5 * step)).max() < 1e-9


@pytest.mark.parametrize("tile", [3, 1000])
def test_tiles_hold_every_pair_of_frames_once(spark, tile):
    from terrazzo.operators import poses as op

    rows = [(s, f, [float(f)], [0.0]) for s, n in (("a", 17), ("b", 2), ("c", 1)) for f in range(n)]
    pairs = spark.createDataFrame(rows, "scene string, frame long, p array<double>, g array<double>")
    got = sorted((r.scene, r.p[0], r.p2[0]) for r in op.frame_pairs(pairs.withColumn("g", F.array(F.lit(0.0))), tile).collect())
    assert got == sorted((s, float(i), float(j)) for s, n in (("a", 17), ("b", 2), ("c", 1)) for i in range(n) for j in range(i + 1, n))
