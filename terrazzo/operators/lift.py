"""From pixels to sparse evidence: masks lifted onto visible points, frame by frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazzo.functions import geometry as geo
from terrazzo.operators.common import settled

#: Blocks along the side of a cell in which frames and blocks meet.
COARSE = 8


def in_view(blocks: DataFrame, frames: DataFrame, size: float) -> DataFrame:
    """Pairs of a block of space and a frame whose view it may reach into: blocks(bx, by, bz), frames
    with `far`, the depth beyond which a frame sees nothing. A block is judged by the ball around it
    against the view's four sides and its depth, so none that can be seen is left out.

    Frames and blocks meet by cells of COARSE blocks: those of the box around the frame's view, which
    ends at `far`, so a frame meets what is near it however far the scene goes on."""
    step = COARSE * size
    reach = size * 3**0.5 / 2 * (1 + 1e-9)
    corners = [geo.apply_pose((u - F.col("cx")) / F.col("fx") * depth, (v - F.col("cy")) / F.col("fy") * depth, depth, "pose") for u, v, depth in ((F.lit(0.0), F.lit(0.0), F.lit(0.0)), *[(u, v, F.col("far") + 2 * reach) for u in (F.lit(0.0), F.col("width").cast("double")) for v in (F.lit(0.0), F.col("height").cast("double"))])]
    boxed = frames
    for k, c in enumerate("xyz"):
        low, high = F.least(*[p[k] for p in corners]), F.greatest(*[p[k] for p in corners])
        # a middle within the reach of all sides lies within twice the reach of this hull
        boxed = boxed.withColumn(f"__c{c}", F.explode(F.sequence(F.floor((low - 2 * reach) / step), F.floor((high + 2 * reach) / step))))
    cells = blocks.withColumns({f"__c{c}": F.floor((F.col(f"b{c}") + 0.5) * size / step) for c in "xyz"})
    pairs = cells.join(boxed, ["__cx", "__cy", "__cz"]).drop("__cx", "__cy", "__cz")
    middle = [(F.col(f"b{c}") + 0.5) * size for c in "xyz"]
    x, y, z = geo.world_to_camera(*middle, "pose")
    pairs = pairs.withColumns({"__x": x, "__y": y, "__z": z})

    def inside(across: str, focal: str, centre: str, extent: str) -> Column:
        """Not beyond the side at pixel 0, nor beyond the one at the image's other end."""
        low = F.col(focal) * F.col(across) + F.col(centre) * F.col("__z")
        rest = F.col(extent) - F.col(centre)
        high = rest * F.col("__z") - F.col(focal) * F.col(across)
        return (low >= -reach * F.sqrt(F.col(focal) ** 2 + F.col(centre) ** 2)) & (high >= -reach * F.sqrt(F.col(focal) ** 2 + rest**2))

    near = (F.col("__z") > -reach) & (F.col("__z") <= F.col("far") + reach)
    return pairs.where(near & inside("__x", "fx", "cx", "width") & inside("__y", "fy", "cy", "height")).drop("__x", "__y", "__z")


def visible_points(points: DataFrame, frames: DataFrame, depth: DataFrame, tolerance: float = 0.05, block: float = 0.5) -> DataFrame:
    """f, id, pu, pv of the points that a frame sees.

    points(id, x, y, z), frames(f, pose, fx, fy, cx, cy, width, height), depth(f, pu, pv, measured).
    Points go with their block of space, and only blocks in a frame's view are joined to it; what
    survives the image's borders meets the depth pixels in an equi-join.
    """
    key = ["bx", "by", "bz"]
    placed = points.select("id", "x", "y", "z", *[geo.voxel(c, block).alias(f"b{c}") for c in "xyz"])
    far = depth.groupBy("f").agg((F.max(F.when(geo.finite("measured"), F.col("measured"))) + tolerance).alias("far"))
    seen = placed.join(in_view(placed.select(*key).distinct(), frames.join(far, "f"), block), key)
    x, y, z = geo.world_to_camera("x", "y", "z", "pose")
    u, v = geo.project(x, y, z, "fx", "fy", "cx", "cy")
    pixels = seen.select("f", "id", z.alias("zc"), u.alias("u"), v.alias("v"), "width", "height").where((F.col("u") >= 0) & (F.col("u") < F.col("width")) & (F.col("v") >= 0) & (F.col("v") < F.col("height")))
    pixels = pixels.withColumns({"pu": F.col("u").cast("int"), "pv": F.col("v").cast("int")})
    return pixels.join(depth, ["f", "pu", "pv"]).where(geo.visible("u", "v", "zc", "measured", "width", "height", tolerance)).select("f", "id", "pu", "pv")


def lift(visible: DataFrame, masks: DataFrame, atoms: DataFrame, least: int = 5) -> dict[str, DataFrame]:
    """leaf_i, leaf_n, masks and unions of masks(f, track, pu, pv) over visible points.

    A mask stays if it claims `least` visible points; a frame stays if a mask of it does. Kept masks
    get dense numbers in the order (frame, track), kept frames dense numbers in their order; both
    numberings run over tables of masks and of frames, not over pixels.
    """
    claimed = masks.join(visible, ["f", "pu", "pv"]).select("f", "track", "id").distinct()
    sizes = claimed.groupBy("f", "track").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    frames = numbered(sizes.select("f").distinct(), ["f"], "frame")
    kept = numbered(sizes.join(frames, "f"), ["frame", "track"], "gm")
    named = claimed.join(kept.select("f", "track", "gm", "frame"), ["f", "track"])
    owned = atoms.select("id", "atom")
    leaf_i = named.join(owned, "id").groupBy("atom", "frame", "gm").agg(F.count(F.lit(1)).alias("cnt"))
    leaf_n = visible.select("f", "id").distinct().join(frames, "f").join(owned, "id").groupBy("atom", "frame").agg(F.count(F.lit(1)).alias("cnt"))
    return {"leaf_i": leaf_i, "leaf_n": leaf_n, "masks": kept.select("gm", "frame", "f", "track", "size"), "unions": named.select("track", "id").distinct()}


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds dense numbers 0.. in a total order: ranges are sorted apart and shifted by their sizes."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % (1 << 33))
    ranged = settled(ranged)
    sizes = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    if not before:
        return df.withColumn(name, F.lit(0).cast("long"))
    shift = F.create_map(*[F.lit(x) for pair in before for x in pair])
    return ranged.withColumn(name, (shift[F.col("__part")] + F.col("__at")).cast("long")).drop("__part", "__at")
