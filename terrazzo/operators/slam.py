"""Relational parts of pose estimation: factor edges, block-sparse algebra, interpolation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.operators.common import settled


def neighbourhood_edges(frames: DataFrame, key: str, reach: int) -> DataFrame:
    """key, i, j with 0 < |i - j| <= reach, both directions; frames(key, i).

    Offsets are exploded and joined by number, so it costs 2 * reach rows a frame.
    """
    offsets = F.explode(F.array(*[F.lit(d) for d in range(-reach, reach + 1) if d]))
    wanted = frames.select(key, "i").withColumn("d", offsets).select(key, "i", (F.col("i") + F.col("d")).alias("j"))
    return wanted.join(frames.select(key, F.col("i").alias("j")), [key, "j"], "left_semi").select(key, "i", "j")


def new_edges(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(present, keys, "left_anti")


def proximity_order(pairs: DataFrame, n: int, quantum: float = 1e-3) -> list:
    """Sort columns: distance in quanta, then the edge's number."""
    return [F.rint(F.col("dist") / quantum), F.col("i") * n + F.col("j")]


def proximity_edges(pairs: pd.DataFrame, n: int, rad: int, threshold: float, nms: int, budget: int, present: tuple[tuple[int, int], ...] = ()) -> pd.DataFrame:
    """i, j: edges to the rad + 1 frames before each frame, then the nearest others under the threshold.

    Others reach back at least `rad` frames. Edges present already and edges taken here keep an
    area free around themselves: of distance `nms` (in both indices together), less for frames that
    are close. Both directions are made, until more than `budget` edges are.
    """
    edges = _proximity_edges(*(pairs[c].to_numpy() for c in ("i", "j", "dist")), n, rad, threshold, nms, budget, present)
    return pd.DataFrame(edges, columns=["i", "j"])


def _proximity_edges(i: np.ndarray, j: np.ndarray, dist: np.ndarray, n: int, rad: int, threshold: float, nms: int, budget: int, present: tuple[tuple[int, int], ...] = ()) -> list[tuple[int, int]]:
    taken = [(a, b) for a in range(n) for b in range(max(0, a - rad - 1), a)]
    closed = set(taken)

    def close(a: int, b: int) -> None:
        reach = max(min(abs(a - b) - 2, nms), 0)
        closed.update((a + x, b + y) for x in range(-reach, reach + 1) for y in range(abs(x) - reach, reach - abs(x) + 1))

    for edge in present:
        close(*edge)
    wanted = (j <= i - rad) & (dist <= threshold)
    i, j, dist = i[wanted], j[wanted], dist[wanted]
    order = np.lexsort((i * n + j, np.rint(dist / 1e-3)))
    for edge in zip(i[order].tolist(), j[order].tolist()):
        if 2 * len(taken) > budget:
            break
        if edge not in closed:
            taken.append(edge)
            close(*edge)
    return sorted({e for a, b in taken for e in ((a, b), (b, a))})


def sequence_edges(scenes: DataFrame, rad: int, threshold: float, nms: int, budget: int) -> DataFrame:
    """scene, i, j: proximity edges of frames whose distance is that of one value; scenes(scene, values in frame order).

    A scene is one row, many rows are a batch, and its pairs are made in the worker. A scene of one frame has no edges.
    """

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 256):  # scenes whose edges are held at a time
                scene, values = batch.column("scene").slice(start, 256), batch.column("values").slice(start, 256)
                found = []
                for frames in values:
                    v = np.asarray(frames.values.to_numpy(zero_copy_only=False), np.float64)  # null: NaN, near nothing
                    i, j = np.tril_indices(len(v), -1)
                    edges = _proximity_edges(i, j, np.abs(v[i] - v[j]), len(v), rad, threshold, nms, budget)
                    found.append(np.array(edges, np.int64).reshape(-1, 2))
                names = scene.take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
                ends = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([names, pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["scene", "i", "j"])

    return scenes.select("scene", "values").mapInArrow(run, f"scene {scenes.schema['scene'].dataType.simpleString()}, i long, j long")


def coalesce_blocks(blocks: DataFrame) -> DataFrame:
    """i, j, value: repeated cells summed."""
    return blocks.groupBy("i", "j").agg(F.sum("value").alias("value"))


def add(a: DataFrame, b: DataFrame, sign: float = 1.0) -> DataFrame:
    return coalesce_blocks(a.select("i", "j", "value").unionByName(b.select("i", "j", (F.col("value") * sign).alias("value"))))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def transposed_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """A^T B: join on the shared row, multiply, sum by column pair."""
    right = b.select("i", F.col("j").alias("k"), F.col("value").alias("w"))
    return a.join(right, "i").groupBy(F.col("j").alias("i"), F.col("k").alias("j")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def transposed_vector(a: DataFrame, v: DataFrame) -> DataFrame:
    """A^T v of v(i, value) as (i, value)."""
    return a.join(v.select("i", F.col("value").alias("w")), "i").groupBy(F.col("j").alias("i")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def scale_rows(a: DataFrame, weights: DataFrame) -> DataFrame:
    return a.join(weights.select("i", "weight"), "i").select("i", "j", (F.col("value") * F.col("weight")).alias("value"))


def without_columns(a: DataFrame, fixed: DataFrame) -> DataFrame:
    return a.join(fixed.select("j"), "j", "left_anti").select("i", "j", "value")


def damped(a: DataFrame, ep: float, lam: float) -> DataFrame:
    """ep + lam * diagonal added to the diagonal."""
    return a.withColumn("value", F.when(F.col("i") == F.col("j"), F.col("value") * (1 + lam) + ep).otherwise(F.col("value")))


def damped_by(a: DataFrame, ep: float, damping: DataFrame) -> DataFrame:
    """ep + each variable's own damping (i, damping) added to the diagonal."""
    own = damping.select("i", "damping")
    joined = a.join(own, "i", "left")
    return joined.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("value") + ep + F.coalesce("damping", F.lit(0.0))).otherwise(F.col("value")).alias("value"))


def raveled(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """i, j, value with scalar numbers: blocks(gi, gj, bi, bj, rows array<array<double>>) of groups
    that lie one after the other; sizes(grp, rows_per_block, blocks), a row a group."""
    offset = F.coalesce(F.sum(F.col("rows_per_block") * F.col("blocks")).over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sizes.withColumn("offset", offset).select("grp", "offset", "rows_per_block")
    one = at.select(F.col("grp").alias("gi"), F.col("offset").alias("oi"), F.col("rows_per_block").alias("ri"))
    two = at.select(F.col("grp").alias("gj"), F.col("offset").alias("oj"), F.col("rows_per_block").alias("rj"))
    cells = blocks.select("gi", "gj", "bi", "bj", F.posexplode("rows").alias("r", "line")).select("gi", "gj", "bi", "bj", "r", F.posexplode("line").alias("c", "value"))
    placed = cells.join(one, "gi").join(two, "gj")  # Spark broadcasts them while they are few
    return placed.select((F.col("oi") + F.col("bi") * F.col("ri") + F.col("r")).alias("i"), (F.col("oj") + F.col("bj") * F.col("rj") + F.col("c")).alias("j"), "value")


def symmetric_lookup(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """a, b, value of wanted group pairs, from (a, b) or, transposed, from (b, a)."""
    straight = blocks.select("a", "b", F.col("value").alias("v1"))
    turned = blocks.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("value").alias("v2"))
    return wanted.join(straight, ["a", "b"], "left").join(turned, ["a", "b"], "left").select("a", "b", F.coalesce("v1", "v2").alias("value"))


def inverse_diagonal(a: DataFrame) -> DataFrame:
    return a.where("i = j").select("i", "j", (1 / F.when(F.col("value") != 0, F.col("value"))).alias("value"))


#: A dense system of more variables than this is refused (32 MB).
MOST_VARIABLES = 2000


def schur_solve(h: DataFrame, e: DataFrame, c: DataFrame, v: DataFrame, w: DataFrame, scene: str | None = None) -> tuple[DataFrame, DataFrame]:
    """x and z, as (i, value), of [H E; E^T C] [x; z] = [v; w] with a diagonal C.

    The reduced system has a row per pose; each scene's is solved in a task of its own (one scene,
    if no column names it), and the many z by back-substitution in relations. A scene of more than
    MOST_VARIABLES poses is an error.
    """
    keys = [scene] if scene else ["scene"]
    named = lambda df: df if scene else df.withColumn("scene", F.lit(0))
    h, e, c, v, w = (named(df) for df in (h, e, c, v, w))
    inverse = c.where("i = j").select(*keys, "i", (1 / F.when(F.col("value") != 0, F.col("value"))).alias("inv"))
    # rows are the eliminated variables, columns the poses
    below = e.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "value")
    scaled = below.join(inverse, [*keys, "i"]).select(*keys, "i", "j", (F.col("value") * F.col("inv")).alias("scaled"))
    product = below.withColumnRenamed("j", "k").join(scaled, [*keys, "i"]).groupBy(*keys, F.col("j").alias("i"), F.col("k").alias("j")).agg((-F.sum(F.col("value") * F.col("scaled"))).alias("value"))
    down = scaled.join(w, [*keys, "i"]).groupBy(*keys, F.col("j").alias("i")).agg((-F.sum(F.col("value") * F.col("scaled"))).alias("value"))
    system = h.select(*keys, "i", "j", "value").unionByName(product)
    system = system.unionByName(v.select(*keys, "i", "value").unionByName(down).withColumn("j", F.lit(None).cast("long")))
    system = system.groupBy(*keys, "i", "j").agg(F.sum("value").alias("value"))

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        right = cells.j.isna()
        ids = np.unique(cells.i)
        if len(ids) > MOST_VARIABLES:
            raise ValueError(f"{len(ids)} variables, more than {MOST_VARIABLES}")
        a, b = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
        left = cells[~right]
        a[np.searchsorted(ids, left.i), np.searchsorted(ids, left.j.astype("int64"))] = left.value
        b[np.searchsorted(ids, cells.i[right])] = cells.value[right]
        return pd.DataFrame({keys[0]: cells[keys[0]].iloc[0], "i": ids, "value": np.linalg.solve(a, b)})

    kind = system.schema[keys[0]].dataType.simpleString()
    x = settled(system.groupBy(*keys).applyInPandas(solve, f"{keys[0]} {kind}, i long, value double"))
    used = below.join(x.select(*keys, F.col("i").alias("j"), F.col("value").alias("x")), [*keys, "j"]).groupBy(*keys, "i").agg(F.sum(F.col("value") * F.col("x")).alias("used"))
    z = w.join(used, [*keys, "i"], "left").join(inverse, [*keys, "i"]).select(*keys, "i", ((F.col("value") - F.coalesce("used", F.lit(0.0))) * F.col("inv")).alias("value"))
    return (x, z) if scene else (x.drop("scene"), z.drop("scene"))


def frame_distances(flows: DataFrame, beta: float = 0.3, least: float = 0.75, far: float = 1000.0) -> DataFrame:
    """i, j, dist of flows(i, j, full, shift, valid): a blend of mean flows, both directions averaged;
    `far` where fewer than `least` of a pair's pixels are valid."""
    flow = F.when(F.col("valid"), beta * F.col("full") + (1 - beta) * F.col("shift"))
    one = flows.groupBy("i", "j").agg(F.avg(flow).alias("d"), F.avg(F.col("valid").cast("double")).alias("share")).select("i", "j", F.when(F.col("share") < least, F.lit(far)).otherwise(F.col("d")).alias("d"))
    back = one.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("d").alias("d2"))
    return one.join(back, ["i", "j"], "left").select("i", "j", ((F.col("d") + F.coalesce("d2", F.col("d"))) / 2).alias("dist"))


def sensor_anchors(pixels: DataFrame) -> DataFrame:
    """Disparities at every eighth pixel from 3, where the depth is valid."""
    return pixels.where("u % 8 = 3 and v % 8 = 3 and depth > 0").withColumn("disparity", 1 / F.when(F.col("depth") > 0, F.col("depth")))
