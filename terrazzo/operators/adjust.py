"""Bundle adjustment: poses and inverse depths from where pixels are seen again, by Gauss-Newton.

A factor says that a pixel of frame i is seen at (tu, tv) in frame j. Its residual is where the
pixel's point projects to, less that target; its Jacobian has a 2x6 block for either pose and a 2x1
block for the inverse depth. Inverse depths are eliminated pixel by pixel (Schur complement), so a
keyframe with its pixels is one group of a cogroup, each group gives blocks of the reduced system of
its frames, blocks are summed over the groups, and each scene's small system is solved in a task.
Steps go back to poses (SE3, from the left) and to inverse depths.

Each round is one pass over the pixels: it takes the last steps, then gives the blocks of the new
state. It ends in one checkpoint of the pixels, and a table of the poses (a row a frame); the driver sees
how many scenes still move, and nothing else. A scene stops when its energy falls by less than a
share; a step that raises it is taken back.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terrazzo.functions import lie, se3
from terrazzo.operators.common import settled, stored
from terrazzo.operators.slam import MOST_VARIABLES

#: Depth under which a point isn't seen, and the step of an inverse depth that is void.
NEAR, VOID = 0.1, 10.0
LEAST_DISPARITY = 1e-3


class Damping(NamedTuple):
    """Share of the diagonal and constant that are added to it, for poses and inverse depths; weight of measured ones."""

    pose: float = 1e-4
    pose_ep: float = 1e-6
    depth: float = 1e-4
    depth_ep: float = 1e-6
    sensor: float = 0.05


class Adjusted(NamedTuple):
    """poses(scene, frame, pose, fixed), points(scene, frame, pixel, disparity), history(scene, round, energy)."""

    poses: DataFrame
    points: DataFrame
    history: DataFrame


def linearise(camera, relative, u, v, disparity, target):
    """Residuals (n, 2), whether the point is in front, and Jacobians of the pose of i and of j (n, 2, 6) and
    of the inverse depth (n, 2), for pixels (u, v) of i seen at `target` in j; relative: pose of j after that of i undone."""
    fx, fy, cx, cy = camera
    m = lie.matrix(relative)
    turn, shift = m[..., :3, :3], m[..., :3, 3]
    ray = np.stack([(u - cx) / fx, (v - cy) / fy, np.ones_like(u)], -1)
    x, y, z = np.moveaxis((turn @ ray[..., None])[..., 0] + shift * disparity[:, None], -1, 0)
    front = z > NEAR
    depth = np.where(front, z, 1.0)
    residual = np.stack([fx * x / depth + cx, fy * y / depth + cy], -1) - target
    none = np.zeros_like(x)
    projected = np.stack([np.stack([fx / depth, none, -fx * x / depth**2], -1), np.stack([none, fy / depth, -fy * y / depth**2], -1)], -2)
    # a tangent [tau, phi] moves the point (x, y, z) of inverse depth d by tau d + phi x point
    lever = np.stack([np.stack([none, z, -y], -1), np.stack([-z, none, x], -1), np.stack([y, -x, none], -1)], -2)
    on_j = np.concatenate([projected * disparity[:, None, None], projected @ lever], -1)
    tau, phi = on_j[..., :3], on_j[..., 3:]
    on_i = -np.concatenate([tau @ turn, (phi + np.cross(tau, shift[:, None, :])) @ turn], -1)
    return residual, front, on_i, on_j, (projected @ shift[..., None])[..., 0]


def huber_weight(r: np.ndarray) -> np.ndarray:
    return np.where(np.abs(r) > 1, 1 / np.maximum(np.abs(r), 1), 1.0)


def _energy(r: np.ndarray) -> np.ndarray:
    return np.where(np.abs(r) > 1, 2 * np.abs(r) - 1, r * r)


class Keyframe(NamedTuple):
    """Pixels of a keyframe and their factors: `at` is a factor's pixel, `slot` the place of its frame j."""

    camera: np.ndarray
    u: np.ndarray
    v: np.ndarray
    sensor: np.ndarray
    sensor_weight: np.ndarray
    at: np.ndarray
    slot: np.ndarray
    target: np.ndarray
    weight: np.ndarray


def system(k: Keyframe, relative: np.ndarray, disparity: np.ndarray, damping: Damping):
    """H (damped), E, C (damped), v, w and the energy of a keyframe; slot 0 is the keyframe itself."""
    n, size = len(disparity), len(relative) + 1
    r, front, on_i, on_j, on_z = linearise(k.camera, relative[k.slot], k.u[k.at], k.v[k.at], disparity[k.at], k.target)
    weight = k.weight * front[:, None]
    energy = float((weight * _energy(r)).sum())
    weight = weight * huber_weight(r)
    h, v, e = np.zeros((size, 6, size, 6)), np.zeros((size, 6)), np.zeros((n, size, 6))
    for s in range(size - 1):
        own = k.slot == s
        a, b, z, w, res = on_i[own], on_j[own], on_z[own], weight[own], r[own]
        wa, wb = a * w[..., None], b * w[..., None]
        for x, p, wp in ((0, a, wa), (s + 1, b, wb)):
            v[x] -= np.einsum("nca,nc->a", wp, res)
            np.add.at(e[:, x], k.at[own], np.einsum("nca,nc->na", wp, z))
            h[x, :, x] += np.einsum("nca,ncb->ab", p, wp)
        cross = np.einsum("nca,ncb->ab", a, wb)
        h[0, :, s + 1] += cross
        h[s + 1, :, 0] += cross.T
    c = np.bincount(k.at, (weight * on_z**2).sum(1), n)
    w = -np.bincount(k.at, (weight * on_z * r).sum(1), n)
    held = damping.sensor * k.sensor_weight
    c, w = c + held, w - held * (disparity - k.sensor)
    energy += float((held * (disparity - k.sensor) ** 2).sum())
    for s in range(size):
        h[s, range(6), s, range(6)] *= 1 + damping.pose
    return h.reshape(size * 6, size * 6), e.reshape(n, size * 6), c * (1 + damping.depth) + damping.depth_ep, v.ravel(), w, energy


def retracted(disparity: np.ndarray, step: np.ndarray) -> np.ndarray:
    return np.maximum(disparity + np.where(step > VOID, 0.0, step), LEAST_DISPARITY)


#: Of a scene, its pixels (and, in other rows, blocks of frames a and b; those without b are right sides, without a the energy).
PIXELS = "i long, pixel long, u double, v double, disparity double, before double, sensor double, sensor_weight double, seen array<struct<j: long, tu: double, tv: double, wu: double, wv: double>>"


def _number(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def _pass(schema, damping: Damping):
    """A keyframe's pixels after the last step, and the blocks of the reduced system there."""
    kinds = pa.schema(schema)

    def run(pixels, frames):
        if not pixels.num_rows or not frames.num_rows:
            return kinds.empty_table()
        pixels, frame = pixels.combine_chunks(), frames.to_pylist()[0]
        mode, others = frame["mode"], frame["others"]
        columns = {f.name: pa.nulls(pixels.num_rows, f.type) if f.name not in pixels.column_names else pixels[f.name] for f in kinds}
        if mode == "keep":
            return pa.table(columns, schema=kinds)
        place = {o["j"]: s for s, o in enumerate(others)}
        rows = pixels["seen"].to_pylist()
        flat = [(p, place[o["j"]], o["tu"], o["tv"], o["wu"], o["wv"]) for p, row in enumerate(rows) for o in row]
        table = np.array(flat, np.float64).reshape(-1, 6)
        one = lambda name: _number(pixels[name])
        key = Keyframe(np.array(frame["camera"]), one("u"), one("v"), np.nan_to_num(one("sensor")), np.nan_to_num(one("sensor_weight")), table[:, 0].astype(int), table[:, 1].astype(int), table[:, 2:4], table[:, 4:6])
        disparity = one("disparity")
        if mode == "move":
            _, e, c, _, w, _ = system(key, np.array([o["old"] for o in others]), disparity, damping)
            x = np.concatenate([frame["x"], *[o["x"] for o in others]])
            columns["before"] = pa.chunked_array([pa.array(disparity)])
            disparity = retracted(disparity, (w - e @ x) / c)
            columns["disparity"] = pa.chunked_array([pa.array(disparity)])
        h, e, c, v, w, energy = system(key, np.array([o["new"] for o in others]), disparity, damping)
        scaled = e / c[:, None]
        h, v = h - e.T @ scaled, v - scaled.T @ w
        names, free = [frame["i"]] + [o["j"] for o in others], [frame["free"]] + [o["free"] for o in others]
        blocks = [(None, None, [energy])]
        for s, a in enumerate(names):
            if not free[s]:
                continue
            blocks.append((a, None, v[6 * s : 6 * s + 6].tolist()))
            blocks += [(a, b, h[6 * s : 6 * s + 6, 6 * t : 6 * t + 6].ravel().tolist()) for t, b in enumerate(names) if free[t]]
        more = {f.name: pa.nulls(len(blocks), f.type) for f in kinds}
        more["scene"] = pixels["scene"].take(pa.array([0] * len(blocks)))
        for name, values in zip(("a", "b", "block"), zip(*blocks)):
            more[name] = pa.array(values, kinds.field(name).type)
        return pa.concat_tables([pa.table(columns, schema=kinds), pa.table(more, schema=kinds)])

    return run


def _steps(rows: pd.DataFrame, ep: float) -> dict[int, np.ndarray]:
    """Steps of a scene's free poses, from its summed blocks."""
    names = np.unique(rows.a)
    if 6 * len(names) > MOST_VARIABLES:
        raise ValueError(f"{6 * len(names)} variables, more than {MOST_VARIABLES}")
    a, b = np.zeros((len(names), 6, len(names), 6)), np.zeros((len(names), 6))
    for row, column, block in zip(rows.a, rows.b, rows.block):
        s = np.searchsorted(names, row)
        if pd.isna(column):
            b[s] = block[:6]
        else:
            a[s, :, np.searchsorted(names, column)] = np.reshape(block, (6, 6))
    size = 6 * len(names)
    x = np.linalg.solve(a.reshape(size, size) + ep * np.eye(size), b.ravel()).reshape(-1, 6)
    return {int(n): step for n, step in zip(names, x)}


#: Of a frame: its pose and the one before, the step between them, whether its scene moves on, and its energy.
STATE = "frame long, pose array<double>, before array<double>, x array<double>, fixed boolean, mode string, energy double, back boolean"


def _judged(stop: float, ep: float, last: bool):
    """A scene's frames after a pass: with the next step, or at rest (back, if the last step raised the energy)."""

    def run(at: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        at = at.assign(x=[np.zeros(6)] * len(at))
        if not len(at) or at["mode"].iloc[0] == "keep":
            return at
        total, before = blocks[blocks.a.isna()].block, at.energy.iloc[0]
        now = float(total.iloc[0][0]) if len(total) else np.nan
        fell = np.isnan(before) or now < before
        goes = not last and not np.isnan(now) and (np.isnan(before) or now < before * (1 - stop))
        at["mode"] = "move" if goes else "keep"
        at["back"] = not fell and not np.isnan(now)
        at["energy"] = now if fell else before
        if goes:
            steps = _steps(blocks[blocks.a.notna()], ep) if blocks.a.notna().any() else {}
            x = np.array([steps.get(f, np.zeros(6)) for f in at.frame])
            pose = np.array(at.pose.tolist())
            at["before"], at["x"], at["pose"] = at.pose, list(x), list(lie.mul(lie.exp(x), pose))
        return at

    return run


def bundle_adjustment(poses: DataFrame, points: DataFrame, factors: DataFrame, cameras: DataFrame, rounds: int = 8, stop: float = 1e-6, damping: Damping = Damping()) -> Adjusted:
    """Poses and inverse depths of every scene, each until it stops or `rounds` are over.

    poses(scene, frame, pose, fixed), world to camera; points(scene, frame, pixel, u, v, disparity,
    sensor, sensor_weight); factors(scene, i, j, pixel, tu, tv, wu, wv); cameras(scene, fx, fy, cx, cy).
    A scene needs a fixed pose. Factors without their point, pose or camera are left out, as are null
    targets; points without a factor keep their inverse depth. A factor that occurs twice counts twice.
    """
    kind = poses.schema["scene"].dataType
    seen = factors.where("tu is not null and tv is not null").join(poses.select("scene", F.col("frame").alias("i")), ["scene", "i"], "left_semi").join(poses.select("scene", F.col("frame").alias("j")), ["scene", "j"], "left_semi").join(cameras.select("scene"), "scene", "left_semi")
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    seen = seen.groupBy("scene", "i", "pixel").agg(F.array_sort(F.collect_list(F.struct(F.col("j").cast("long").alias("j"), F.col("tu").cast("double").alias("tu"), F.col("tv").cast("double").alias("tv"), number("wu").alias("wu"), number("wv").alias("wv")))).alias("seen"))
    given = points.select("scene", F.col("frame").cast("long").alias("i"), F.col("pixel").cast("long").alias("pixel"), *[F.col(c).cast("double").alias(c) for c in ("u", "v", "disparity", "sensor", "sensor_weight")])
    measured = F.col("sensor").isNotNull() & F.col("sensor_weight").isNotNull()
    given = given.withColumns({"sensor_weight": F.when(measured, F.col("sensor_weight")).otherwise(0.0), "before": F.col("disparity")})
    pixels = settled(given.join(seen, ["scene", "i", "pixel"]))
    edges = settled(pixels.select("scene", "i", F.explode("seen.j").alias("j")).distinct().join(cameras.select("scene", F.array(*[F.col(c).cast("double") for c in ("fx", "fy", "cx", "cy")]).alias("camera")), "scene"))
    schema = T._parse_datatype_string(f"scene {kind.simpleString()}, {PIXELS}, a long, b long, block array<double>")
    run = _pass(to_arrow_schema(schema), damping)

    def passed(pixels: DataFrame, state: DataFrame) -> DataFrame:
        one = state.select("scene", F.col("frame").alias("i"), F.col("before").alias("bi"), F.col("pose").alias("pi"), F.col("x").alias("xi"), (~F.col("fixed")).alias("fi"), "mode")
        two = state.select("scene", F.col("frame").alias("j"), F.col("before").alias("bj"), F.col("pose").alias("pj"), F.col("x").alias("xj"), (~F.col("fixed")).alias("fj"))
        between = lambda a, b: se3.product(F.col(b), se3.inverse(F.col(a)))
        other = F.struct("j", between("bi", "bj").alias("old"), between("pi", "pj").alias("new"), F.col("xj").alias("x"), F.col("fj").alias("free"))
        frames = edges.join(one, ["scene", "i"]).join(two, ["scene", "j"]).groupBy("scene", "i", "camera", "mode", F.col("xi").alias("x"), F.col("fi").alias("free")).agg(F.sort_array(F.collect_list(other)).alias("others"))
        frames = frames.toDF(*frames.columns)  # columns of its own: both sides stem from the pixels
        return settled(pixels.groupBy("scene", "i").cogroup(frames.groupBy("scene", "i")).applyInArrow(run, schema))

    def energies(state: DataFrame, turn: int) -> DataFrame:
        return state.where("block is not null and a is null").groupBy("scene").agg(F.lit(turn).alias("round"), F.sum(F.col("block")[0]).alias("energy"))

    at = poses.select("scene", F.col("frame").cast("long").alias("frame"), "pose", F.col("pose").alias("before"), F.array(*[F.lit(0.0)] * 6).alias("x"), F.coalesce("fixed", F.lit(False)).alias("fixed"), F.lit("first").alias("mode"), F.lit(None).cast("double").alias("energy"), F.lit(False).alias("back"))
    at = settled(at)
    state = passed(pixels, at)
    history = energies(state, 0)
    for turn in range(1, rounds + 2):
        # beyond its end a block of six or of one has nulls, which sums leave out
        sums = state.where("block is not null").groupBy("scene", "a", "b").agg(F.array(*[F.sum(F.get("block", F.lit(k))) for k in range(36)]).alias("block"))
        judged = at.groupBy("scene").cogroup(sums.groupBy("scene")).applyInPandas(_judged(stop, damping.pose_ep, turn > rounds), f"scene {kind.simpleString()}, {STATE}")
        at = stored(judged)
        if at.where("mode = 'move'").isEmpty():
            break
        state = passed(state.where("block is null").drop("a", "b", "block"), at)
        history = history.unionByName(energies(state, turn))
    undone = at.groupBy("scene").agg(F.max("back").alias("back"))
    end = state.where("block is null").select("scene", "i", "pixel", "disparity", "before").join(undone, "scene").select("scene", F.col("i").alias("frame"), "pixel", F.when(F.col("back"), F.col("before")).otherwise(F.col("disparity")).alias("new"))
    moved = given.select("scene", F.col("i").alias("frame"), "pixel", "disparity").join(end, ["scene", "frame", "pixel"], "left").select("scene", "frame", "pixel", F.coalesce("new", "disparity").alias("disparity"))
    return Adjusted(at.select("scene", "frame", F.when(F.col("back"), F.col("before")).otherwise(F.col("pose")).alias("pose"), "fixed"), moved, history)
