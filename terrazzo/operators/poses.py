"""Tables of poses, keyframes and scene metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.functions import geometry as geo
from terrazzo.operators import temporal
from terrazzo.operators.common import first_in


def centre(pose: str = "pose") -> dict[str, Column]:
    return {c: F.col(pose)[k] for c, k in (("x", 3), ("y", 7), ("z", 11))}


def align_to_first(poses: DataFrame) -> DataFrame:
    """Poses of each scene relative to its first frame; poses(scene, frame, pose)."""
    first = F.first_value("pose").over(Window.partitionBy("scene").orderBy("frame"))
    return poses.withColumn("first", first).select("scene", "frame", geo.compose(geo.invert_pose("first"), "pose").alias("pose"))


def usable_pairs(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """scene, frame, p, g of frames with a pose on both sides."""
    rows = predicted.select("scene", "frame", F.col("pose").alias("p")).join(truth.select("scene", "frame", F.col("pose").alias("g")), ["scene", "frame"])
    return rows.where("p is not null and g is not null")


#: Frames of a block; a tile of pairs holds two blocks.
TILE = 256


def frame_pairs(pairs: DataFrame, tile: int = TILE) -> DataFrame:
    """scene, p, g, p2, g2 of every two frames of a scene, the earlier one first.

    A scene's frames are dealt into blocks, and each two blocks meet in a tile of their own, so no key
    holds more than about two blocks of frames, however long the scene is.
    """
    size = pairs.groupBy("scene").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks"))
    placed = pairs.join(size, "scene").withColumn("block", F.pmod(F.xxhash64("frame"), F.col("blocks")).cast("int"))
    one = placed.select("scene", F.col("block").alias("a"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("b"), F.struct(F.col("frame").alias("f"), "p", "g").alias("s"))
    two = placed.select("scene", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("a"), F.col("block").alias("b"), F.struct(F.col("frame").alias("f"), "p", "g").alias("t"))
    both = one.join(two, ["scene", "a", "b"]).where("s.f <> t.f and (a < b or s.f < t.f)")
    first = F.col("s.f") < F.col("t.f")
    sides = both.select("scene", F.when(first, F.col("s")).otherwise(F.col("t")).alias("i"), F.when(first, F.col("t")).otherwise(F.col("s")).alias("j"))
    return sides.select("scene", F.col("i.p").alias("p"), F.col("i.g").alias("g"), F.col("j.p").alias("p2"), F.col("j.g").alias("g2"))


def pose_errors(pairs: DataFrame, tile: int = TILE) -> DataFrame:
    """scene, e: for every pair of frames of a scene the larger of the angle between the relative
    rotations and that between the relative translations, in degrees."""
    both = frame_pairs(pairs, tile).withColumns({"a": geo.compose(geo.invert_pose("p"), "p2"), "b": geo.compose(geo.invert_pose("g"), "g2")})
    trace = sum((F.col("a")[i * 4 + k] * F.col("b")[i * 4 + k] for i in range(3) for k in range(3)), F.lit(0.0))
    turn = geo.rotation_degrees(trace)
    shift = geo.translation_degrees(*[F.col("a")[k] for k in (3, 7, 11)], *[F.col("b")[k] for k in (3, 7, 11)])
    return both.select("scene", F.greatest(turn, shift).alias("e"))


def pose_quality(poses: DataFrame, coverage: float = 0.8, most_runs: int = 8) -> DataFrame:
    """scene, share, runs, n_jumps, ok: ground truth that covers, isn't torn, and doesn't jump."""
    rows = poses.select(F.col("scene").alias("u"), F.col("frame").alias("t"), F.col("frame").alias("id"), F.col("pose").isNotNull().alias("valid"), *[c.alias(n) for n, c in centre().items()])
    share = rows.groupBy("u").agg(F.avg(F.col("valid").cast("double")).alias("share"))
    torn = temporal.runs(rows, "u", F.col("valid")).groupBy("u").agg(F.count(F.lit(1)).alias("runs"))
    w = Window.partitionBy("u").orderBy("t")
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in "xyz"), F.lit(0.0)))
    near = F.col("t") - F.lag("t").over(w) == 1
    gaps = rows.where("valid").withColumns({"gap": step, "near": near}).where("near and gap is not null")
    bound = gaps.groupBy("u").agg(F.greatest(F.lit(0.35), 8 * F.percentile("gap", F.lit(0.99)), 25 * F.percentile("gap", F.lit(0.5))).alias("most"))
    jumps = gaps.join(bound, "u").groupBy("u").agg(F.sum((F.col("gap") > F.col("most")).cast("long")).alias("n_jumps"))
    out = share.join(torn, "u").join(jumps, "u", "left").withColumn("n_jumps", F.coalesce("n_jumps", F.lit(0).cast("long")))
    return out.select(F.col("u").alias("scene"), "share", "runs", "n_jumps", ((F.col("share") >= coverage) & (F.col("runs") <= most_runs) & (F.col("n_jumps") == 0)).alias("ok"))


def prune_keyframes(distance: float = 4.0, gap: int = 16):
    """Sequential rule on rows (frame, d): drop the second-newest keyframe when it lies within
    `distance` of the newest and dropping it leaves no gap above `gap`. For temporal.scan_groups."""

    def keep(rows: pd.DataFrame) -> pd.Series:
        kept: list[int] = []
        frames, d = rows.frame.tolist(), rows.d.tolist()
        for i in range(len(frames)):
            if len(kept) > 1 and d[i] < distance - 1e-4 and frames[i] - frames[kept[-2]] <= gap:
                kept.pop()
            kept.append(i)
        return pd.Series([i in set(kept) for i in range(len(frames))], dtype=bool)

    return keep


def without_keyframe(table: DataFrame, removed: int, *columns: str) -> DataFrame:
    """A table keyed by keyframe numbers after one is taken out: its rows go, later ones move down."""
    for c in columns:
        table = table.where(F.col(c) != removed)
    return table.withColumns({c: F.when(F.col(c) > removed, F.col(c) - 1).otherwise(F.col(c)) for c in columns})


def reproject(pixels: DataFrame, k: tuple[float, float, float, float], relative: str = "relative", near: float = 0.1) -> DataFrame:
    """Adds u2, v2, d2, valid: pixels (u, v, disparity) seen after a relative pose; valid if both
    depths lie beyond `near`."""
    x, y, one, d = geo.unproject_disparity("u", "v", "disparity", *k)
    r = F.col(relative)
    moved = [r[i * 4] * x + r[i * 4 + 1] * y + r[i * 4 + 2] * one + r[i * 4 + 3] * d for i in range(3)]
    u2, v2, d2 = geo.project_homogeneous(*moved, d, *k)
    return pixels.withColumns({"u2": u2, "v2": v2, "d2": d2, "valid": (moved[2] > near) & (F.lit(1.0) > near)})


def filled_disparity(keyframes: DataFrame) -> DataFrame:
    """A lone keyframe takes the sensor's disparity where there is one."""
    n = F.count(F.lit(1)).over(Window.partitionBy("scene"))
    return keyframes.withColumn("disparity", F.when(n == 1, F.coalesce(F.when(F.col("sensor") > 0, F.col("sensor")), F.col("disparity"))).otherwise(F.col("disparity")))


def merge_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Concatenated payloads where the last of each key wins; ties in the order go to the higher row."""
    return first_in(rows, [key], [F.desc(order), F.desc("id")])


def reindexed(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Contiguous numbers 0.. of each key's rows."""
    return rows.withColumn("index", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))


def sampled_ids(ids: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """Without replacement: the `most` rows of each scene of least seeded hash, the same for any
    partitioning; all if there are fewer."""
    return first_in(ids.withColumn("__h", F.xxhash64("id", F.lit(seed))), ["scene"], ["__h", "id"], most).drop("__h")


def sampled_mesh(triangles: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """t, x, y, z: about `total` points of a mesh, uniform by area.

    triangles(t, ax .. cz). A triangle gets its share of points rounded at random, so no running
    sum over the mesh is needed.
    """
    a, b, c = ([F.col(f"{p}{q}") for q in "xyz"] for p in "abc")
    u, v = [x - y for x, y in zip(b, a)], [x - y for x, y in zip(c, a)]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    area = F.sqrt(sum((x * x for x in cross), F.lit(0.0))) / 2
    unit = lambda k: (F.pmod(F.xxhash64("t", F.lit(seed), k), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    whole = triangles.agg(F.sum(area).alias("whole"))
    share = triangles.crossJoin(F.broadcast(whole)).withColumn("n", F.floor(area / F.col("whole") * total + unit(F.lit(-1))).cast("int")).where("n > 0")
    placed = share.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    placed = placed.withColumns({"r1": F.sqrt(unit(F.col("k") * 2)), "r2": unit(F.col("k") * 2 + 1)})
    return placed.select("t", *[((1 - F.col("r1")) * x + F.col("r1") * (1 - F.col("r2")) * y + F.col("r1") * F.col("r2") * z).alias(q) for q, x, y, z in zip("xyz", a, b, c)])


def aligned(points: DataFrame, rotation: np.ndarray, shift: np.ndarray, scale: float = 1.0) -> DataFrame:
    """x, y, z moved by a similarity."""
    moved = [sum((F.lit(scale * float(rotation[i, k])) * F.col(c) for k, c in enumerate("xyz")), F.lit(float(shift[i]))) for i in range(3)]
    return points.withColumns(dict(zip("xyz", moved)))
