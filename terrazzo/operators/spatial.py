"""Points on grids: voxels, nearest neighbours, seeds, adjacency, splats.

All pairs within a radius bucket both sides on a grid as wide as it and equi-join a point's 27 cells, so
they cost the points in reach and never a cross join. The k nearest split space (kdsplit), with or
without a radius: their cost doesn't follow how many points lie in reach.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazzo.functions.geometry import voxel
from terrazzo.operators import graph, kdsplit
from terrazzo.operators.common import first_in, settled, stored

XYZ = ("x", "y", "z")


def with_cell(points: DataFrame, size: float, names: tuple[str, str, str] = ("gx", "gy", "gz")) -> DataFrame:
    return points.withColumns({g: voxel(c, size) for g, c in zip(names, XYZ)})


def occupancy(points: DataFrame, size: float) -> DataFrame:
    """Distinct cells and their centres."""
    cells = with_cell(points, size).select("gx", "gy", "gz").distinct()
    return cells.withColumns({f"c{c}": (F.col(g) + 0.5) * size for c, g in zip(XYZ, ("gx", "gy", "gz"))})


def downsample(points: DataFrame, size: float, values: tuple[str, ...] = XYZ) -> DataFrame:
    """Mean of each cell; the grid's origin is 0."""
    return with_cell(points, size).groupBy("gx", "gy", "gz").agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n"))


def distance2(suffix: str = "2") -> Column:
    d = [F.col(c) - F.col(f"{c}{suffix}") for c in XYZ]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """All pairs (id, id2, dist) of left and right points at most `radius` apart."""
    cells = with_cell(left.select("id", *XYZ), radius)
    shift = F.explode(F.array(*[F.struct(*[F.lit(d).alias(n) for n, d in zip("abc", (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    near = cells.withColumn("s", shift).select("id", *XYZ, (F.col("gx") + F.col("s.a")).alias("gx"), (F.col("gy") + F.col("s.b")).alias("gy"), (F.col("gz") + F.col("s.c")).alias("gz"))
    other = with_cell(right.select(F.col("id").alias("id2"), *[F.col(c).alias(f"{c}2") for c in XYZ]).withColumns({c: F.col(f"{c}2") for c in XYZ}), radius).drop(*XYZ)
    return near.join(other, ["gx", "gy", "gz"]).withColumn("dist", F.sqrt(distance2())).where(F.col("dist") <= radius).select("id", "id2", "dist")


def knn(left: DataFrame, right: DataFrame, k: int, radius: float, with_self: bool = True) -> DataFrame:
    """id, id2, dist, rank: the k nearest right points within `radius`; ties to the lower id."""
    return kdsplit.nearest(left, right, k, radius=radius, with_self=with_self)


def nearest(left: DataFrame, right: DataFrame, k: int = 1, radius: float = 0.1) -> DataFrame:
    """id, id2, dist, rank of the k nearest without a cap on the distance; see kdsplit.

    `radius` is left from the search by growing radii and says nothing now.
    """
    return kdsplit.nearest(left, right, k)


#: Pairs of points that two cells may bring to a comparison of all; above, the cells are halved.
PAIRS_OF_CELLS = 1 << 16


def _boxes(cells: DataFrame, *more: Column) -> DataFrame:
    """cell, n, its least id, low and high corner of its points, and more; cells(cell, id, x, y, z)."""
    corner = lambda f: F.array(*[f(c) for c in XYZ])
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), corner(F.min).alias("low"), corner(F.max).alias("high"), *more)


def _length(d: list[Column]) -> Column:
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def _apart(a: str, b: str) -> tuple[Column, Column]:
    """Least and greatest distance of points of two boxes, rounded as the distance of two points is."""
    low, high = ([F.col(f"{s}{e}")[k] for k in range(3)] for s, e in ((a, "low"), (a, "high")))
    low2, high2 = ([F.col(f"{s}{e}")[k] for k in range(3)] for s, e in ((b, "low"), (b, "high")))
    near = [F.greatest(low[k] - high2[k], low2[k] - high[k], F.lit(0.0)) for k in range(3)]
    far = [F.greatest(high[k] - low2[k], high2[k] - low[k]) for k in range(3)]
    return _length(near), _length(far)


def _side(boxes: DataFrame, name: str) -> DataFrame:
    return boxes.select(*[F.col(c).alias(f"{name}{c}") for c in boxes.columns])


def links_within(points: DataFrame, radius: float, pairs_of_cells: int = PAIRS_OF_CELLS) -> DataFrame:
    """a, b: links that have the components of all pairs of points at most `radius` apart, and no fewer nodes.

    Points in a cell narrower than half the radius are all in reach of each other and are linked to the
    cell's least id, so a dense place costs its points and not their pairs. Two cells are linked through
    their outermost points if some of these are in reach. Only cells that are then still in different
    components and may hold a pair in reach are compared: all their points if they are few, else cells
    of half the width, and so on.
    """
    finite = " and ".join(f"abs({c}) < double('Infinity')" for c in XYZ)
    plain = settled(points.select("id", *[F.col(c).cast("double").alias(c) for c in XYZ]).where(f"id is not null and {finite}"))
    width = 0.51 * radius

    def in_cells(size: float) -> DataFrame:
        return plain.withColumn("cell", F.array(*[voxel(c, size) for c in XYZ]))

    place = F.struct(*XYZ)
    outer = F.array_distinct(F.array(*[f(place, c) for c in XYZ for f in (F.min_by, F.max_by)]))
    at = in_cells(width)
    boxes = settled(_boxes(at, outer.alias("outer")))
    stars = at.join(boxes.select("cell", "least"), "cell").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    beside = F.explode(F.array(*[F.array(*[(F.col("acell")[k] + s[k]) for k in range(3)]) for s in steps]))
    reach = lambda p, q: _length([p[c] - q[c] for c in XYZ]) <= radius
    met = _side(boxes, "a").withColumn("bcell", beside).join(_side(boxes, "b"), "bcell").where(_apart("a", "b")[0] <= radius)
    met = settled(met.select("acell", "bcell", "an", "bn", "aleast", "bleast", F.exists("aouter", lambda p: F.exists("bouter", lambda q: reach(p, q))).alias("linked")))
    found = stars.unionByName(_linked(met.where("linked")))
    # the least ids stand for their cells
    group = graph.components(_linked(met.where("linked")))
    of = lambda side: group.select(F.col("node").alias(f"{side}least"), F.col("component").alias(f"{side}group"))
    open_ = met.where("not linked").join(of("a"), "aleast", "left").join(of("b"), "bleast", "left")
    open_ = open_.where(F.coalesce("agroup", "aleast") != F.coalesce("bgroup", "bleast")).select("acell", "bcell", "an", "bn", "aleast", "bleast")
    while True:
        open_ = settled(open_)
        few = F.col("an") * F.col("bn") <= pairs_of_cells
        pairs = open_.where(few).join(_side(at.select("cell", *XYZ), "a"), "acell").join(_side(at.select("cell", *XYZ), "b"), "bcell")
        found = found.unionByName(_linked(pairs.where(_length([F.col(f"a{c}") - F.col(f"b{c}") for c in XYZ]) <= radius).select("aleast", "bleast").distinct()))
        many = open_.where(~few).select("acell", "bcell", "aleast", "bleast")
        if many.isEmpty():
            return found
        width /= 2
        at = in_cells(width)
        parts = settled(_boxes(at)).drop("least").withColumn("up", F.transform("cell", lambda x: F.floor(x / 2)))
        met = many.withColumnRenamed("acell", "aup").join(_side(parts, "a"), "aup").withColumnRenamed("bcell", "bup").join(_side(parts, "b"), "bup")
        near, far = _apart("a", "b")
        met = settled(met.where(near <= radius).withColumn("linked", far <= radius))
        done = met.where("linked").select("aleast", "bleast").distinct()
        found = found.unionByName(_linked(done))
        open_ = met.where("not linked").join(done, ["aleast", "bleast"], "left_anti").select("acell", "bcell", "an", "bn", "aleast", "bleast")


def _linked(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("aleast").alias("a"), F.col("bleast").alias("b"))


def undirected(pairs: DataFrame) -> DataFrame:
    """lo, hi, dist: each edge once."""
    return pairs.where("id <> id2").groupBy(F.least("id", "id2").alias("lo"), F.greatest("id", "id2").alias("hi")).agg(F.min("dist").alias("dist"))


def knn_edges(points: DataFrame, k: int, radius: float) -> DataFrame:
    return undirected(knn(points, points, k, radius, with_self=False))


def edge_costs(edges: DataFrame, normals: DataFrame, weight: float = 4.0) -> DataFrame:
    """lo, hi, dist, cost: distance times 1 + weight (1 - |ni . nj|)."""
    one = normals.select(F.col("id").alias("lo"), "nx", "ny", "nz")
    two = normals.select(F.col("id").alias("hi"), *[F.col(c).alias(f"{c}2") for c in ("nx", "ny", "nz")])
    dot = F.abs(F.col("nx") * F.col("nx2") + F.col("ny") * F.col("ny2") + F.col("nz") * F.col("nz2"))
    return edges.join(one, "lo").join(two, "hi").select("lo", "hi", "dist", (F.col("dist") * (1 + weight * (1 - dot))).alias("cost"))


def seeds(points: DataFrame, size: float, digits: int = 9) -> DataFrame:
    """gx, gy, gz, id: the point of each cell nearest to the cell's mean.

    Squared distances are compared at `digits` digits and ties go to the lowest id, so the order
    in which a mean was summed can't decide.
    """
    cells = with_cell(points, size)
    mean = cells.groupBy("gx", "gy", "gz").agg(*[F.avg(c).alias(f"{c}2") for c in XYZ])
    scored = cells.join(mean, ["gx", "gy", "gz"]).withColumn("d", F.round(distance2(), digits))
    return scored.groupBy("gx", "gy", "gz").agg(F.min(F.struct("d", "id"))["id"].alias("id"))


#: Points of a block without coordinates.
BLOCK_POINTS = 100_000


def _settled_block(kind: str):
    """One block's part of a round: labels that have come in go along its edges to the end (Dijkstra), and
    what they improve goes out along the edges that leave it.

    edges(block, a, b, cost, to): those that start in the block; labels(block, id, seed, total, new).
    Gives labels (to = null) and messages (to = the block they are for).
    """
    names = ["block", "id", "seed", "total", "to"]

    def run(edges: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        if not len(labels):
            return pd.DataFrame([], columns=names)
        block = labels.block.iloc[0]
        best: dict[int, tuple[float, int]] = {}
        for i, total, seed in zip(labels.id[~labels.new], labels.total[~labels.new], labels.seed[~labels.new]):
            best[i] = (total, seed)
        queue = []
        for i, total, seed in zip(labels.id[labels.new], labels.total[labels.new], labels.seed[labels.new]):
            if i not in best or (total, seed) < best[i]:
                best[i] = (total, seed)
                queue.append((total, seed, i))
        heapq.heapify(queue)
        edges = edges.sort_values("a", kind="stable")
        starts = {int(x): k for x, k in zip(*np.unique(edges.a, return_index=True))} if len(edges) else {}
        ends, costs, to = edges.b.to_numpy(), edges.cost.to_numpy(), edges.to.to_numpy()
        sources = edges.a.to_numpy()
        out: dict[int, tuple[float, int, object]] = {}
        while queue:
            total, seed, i = heapq.heappop(queue)
            if best[i] != (total, seed):
                continue
            k = starts.get(i, len(ends))
            while k < len(ends) and sources[k] == i:
                j, label = int(ends[k]), (total + costs[k], seed)
                if to[k] == block:
                    if j not in best or label < best[j]:
                        best[j] = label
                        heapq.heappush(queue, (*label, j))
                elif j not in out or label < out[j][:2]:
                    out[j] = (*label, to[k])
                k += 1
        rows = [(block, i, seed, total, None) for i, (total, seed) in best.items()] + [(block, j, seed, total, where) for j, (total, seed, where) in out.items()]
        return pd.DataFrame(rows, columns=names)

    return run, f"block {kind}, id long, seed long, total double, to {kind}"


def shortest_to_seeds(costs: DataFrame, seed_ids: DataFrame, points: DataFrame, rounds: int = 2000, width: float | None = None) -> DataFrame:
    """id, seed, cost: the seed nearest along the edges; an unreachable point is its own.

    Points lie in blocks: cells of the grid of `width` if points(id, x, y, z) have places, else dealt by
    id, BLOCK_POINTS each. A round settles each block into which labels came with one search of its
    own, and sends what improved over the edges between blocks; so rounds follow the blocks that a path
    crosses and not its edges. A block is one task. Ties go to the lower seed. Ends when no label moves;
    if some still do after `rounds` it raises.
    """
    if width is not None:
        block = F.concat_ws("/", *[voxel(c, width).cast("string") for c in XYZ])
    else:
        dealt = max(1, -(-points.count() // BLOCK_POINTS))
        block = F.pmod(F.xxhash64("id"), F.lit(dealt)).cast("string")
    place = settled(points.select("id", block.alias("block")).distinct())
    both = costs.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "cost").union(costs.select("hi", "lo", "cost"))
    edges = both.join(place.select(F.col("id").alias("a"), "block"), "a").join(place.select(F.col("id").alias("b"), F.col("block").alias("to")), "b")
    edges = stored(edges.select("block", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("cost").cast("double").alias("cost"), "to"))
    run, schema = _settled_block("string")
    labels = None
    sent = stored(seed_ids.join(place, "id").select("block", F.col("id").cast("long").alias("id"), F.col("id").cast("long").alias("seed"), F.lit(0.0).alias("total")))
    for _ in range(rounds):
        live = sent.select("block").distinct()
        held = sent.withColumn("new", F.lit(True))
        if labels is not None:
            held = held.unionByName(labels.join(live, "block", "left_semi").withColumn("new", F.lit(False)))
        out = stored(edges.join(live, "block", "left_semi").groupBy("block").cogroup(held.groupBy("block")).applyInPandas(run, schema))
        now = out.where("to is null").drop("to")
        labels = now if labels is None else stored(labels.join(live, "block", "left_anti").unionByName(now))
        better = out.where("to is not null").groupBy(F.col("to").alias("block"), "id").agg(F.min(F.struct("total", "seed")).alias("m")).select("block", "id", "m.seed", "m.total")
        old = labels.select("block", "id", F.col("seed").alias("s0"), F.col("total").alias("t0"))
        sent = stored(better.join(old, ["block", "id"], "left").where("t0 is null or total < t0 or (total = t0 and seed < s0)").select("block", "id", "seed", "total"))
        if sent.isEmpty():
            break
    else:
        raise RuntimeError(f"paths to seeds did not settle in {rounds} rounds")
    found = labels.select("id", "seed", "total")
    rest = points.select("id").join(found, "id", "left_anti").select("id", F.col("id").alias("seed"), F.lit(0.0).alias("total"))
    return found.unionByName(rest).select("id", "seed", F.col("total").alias("cost"))


def adjacency(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """a, b, cross_edges: edges between the points of two atoms."""
    one, two = (atoms.select(F.col("id").alias(e), F.col("atom").alias(f"{e}_atom")) for e in ("lo", "hi"))
    joined = edges.join(one, "lo").join(two, "hi").where("lo_atom <> hi_atom")
    return joined.groupBy(F.least("lo_atom", "hi_atom").alias("a"), F.greatest("lo_atom", "hi_atom").alias("b")).agg(F.count(F.lit(1)).alias("cross_edges"))


def majority_vote(neighbours: DataFrame, labels: DataFrame, unknown: int = -1) -> DataFrame:
    """id, label, votes: the label most frequent among neighbours; ties to the nearest of them."""
    voted = neighbours.join(labels.select(F.col("id").alias("id2"), "label"), "id2").groupBy("id", "label").agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("nearest"))
    return first_in(voted, ["id"], [F.desc("votes"), "nearest"]).select("id", F.coalesce("label", F.lit(unknown)).alias("label"), "votes")


def crop(points: DataFrame, frame: DataFrame, padding: float) -> DataFrame:
    """Points inside the other cloud's bounding box, padded, borders included."""
    box = frame.agg(*[f(c).alias(f"{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    inside = points.crossJoin(F.broadcast(box))
    for c in XYZ:
        inside = inside.where(F.col(c).between(F.col(f"lo{c}") - padding, F.col(f"hi{c}") + padding))
    return inside.select(points.columns)


def splat(points: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """px, py, z, id: the front of each pixel; among points within `tolerance` of it the lowest id."""
    front = points.groupBy("px", "py").agg(F.min("z").alias("front"))
    return points.join(front, ["px", "py"]).where(F.col("z") <= F.col("front") + tolerance).groupBy("px", "py").agg(F.first("front").alias("z"), F.min("id").alias("id"))


def discs(points: DataFrame, voxel_size: float, focal: float, most: int = 8) -> DataFrame:
    """Every pixel that a point covers: offsets within ceil(voxel/2 * focal / z), at most 8."""
    radius = F.least(F.ceil(F.lit(0.5 * voxel_size * focal) / F.col("z")), F.lit(most)).cast("int")
    wide = points.where("z > 0").withColumn("radius", radius)
    wide = wide.withColumn("du", F.explode(F.sequence(-F.col("radius"), F.col("radius")))).withColumn("dv", F.explode(F.sequence(-F.col("radius"), F.col("radius"))))
    return wide.where("du * du + dv * dv <= radius * radius").withColumns({"px": F.col("px") + F.col("du"), "py": F.col("py") + F.col("dv")}).drop("du", "dv", "radius")
