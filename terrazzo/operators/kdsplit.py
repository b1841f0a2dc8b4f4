"""Nearest points: space split at sampled quantiles, leaves searched only where needed.

A k-d tree over a bounded sample of the right points splits space so that each leaf holds about
LEAF_POINTS of them, wherever they lie: dense places get small leaves, and a far outlier lies in one
like any other. Each left point is first compared with the leaf that a descent towards it ends in. Its
k-th distance then goes to the other leaves, and it is sent to those whose box (of their real points)
is no farther. A task compares one leaf with a bounded number of left points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.operators.common import settled

XYZ = ("x", "y", "z")
LEAF_POINTS = 4096
#: Left points that one task compares with a leaf.
ASKED = 4096
#: Sampled points that place the splits, for each leaf, and leaves at most (8 MB of sample).
PER_LEAF, MOST_LEAVES = 32, 1 << 13


class Splits:
    """Splits of space as arrays, a node each: axis (-1: a leaf), value, and left and right child; box by leaf."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.value, self.child, self.leaves = [], [], [], 0
        self._split(sample, leaves)
        self.low = self.high = self.count = None

    def _split(self, points: np.ndarray, leaves: int) -> int:
        node = len(self.axis)
        self.axis.append(-1)
        self.value.append(0.0)
        self.child.append((self.leaves, -1))
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(3)
        if leaves < 2 or not spread.max() > 0:  # equal points can't be split
            self.leaves += 1
            return node
        axis = int(spread.argmax())
        cut = float(np.median(points[:, axis]))
        right = points[:, axis] >= cut
        if right.all():
            right = points[:, axis] > cut
            cut = float(points[right, axis].min())
        self.axis[node], self.value[node] = axis, cut
        first = self._split(points[~right], leaves // 2)
        self.child[node] = (first, self._split(points[right], leaves - leaves // 2))
        return node

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        found = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if self.axis[node] < 0:
                found[at] = self.child[node][0]
                continue
            right = points[at, self.axis[node]] >= self.value[node]
            for part, child in zip((at[~right], at[right]), self.child[node]):
                if len(part):
                    stack.append((child, part))
        return found

    def with_boxes(self, rows: list[tuple]) -> "Splits":
        """rows: (leaf, count, least x, y, z, most x, y, z) of the leaves that hold points."""
        low, high, count = np.full((self.leaves, 3), np.inf), np.full((self.leaves, 3), -np.inf), np.zeros(self.leaves, np.int64)
        for leaf, n, *box in rows:
            count[leaf], low[leaf], high[leaf] = n, box[:3], box[3:]
        nodes = len(self.axis)
        self.low, self.high, self.count = np.empty((nodes, 3)), np.empty((nodes, 3)), np.zeros(nodes, np.int64)
        for node in reversed(range(nodes)):  # children come after their parent
            if self.axis[node] < 0:
                leaf = self.child[node][0]
                self.low[node], self.high[node], self.count[node] = low[leaf], high[leaf], count[leaf]
            else:
                a, b = self.child[node]
                self.low[node], self.high[node] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])
                self.count[node] = self.count[a] + self.count[b]
        return self

    def away(self, node: int, points: np.ndarray) -> np.ndarray:
        """Distance of each point from a node's box (infinite if it holds nothing)."""
        if not self.count[node]:
            return np.full(len(points), np.inf)
        gap = np.maximum(np.maximum(self.low[node] - points, points - self.high[node]), 0)
        return np.sqrt((gap**2).sum(1))

    def home(self, points: np.ndarray) -> np.ndarray:
        """A leaf with points near each point: towards the nearer box at every split."""
        found = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if self.axis[node] < 0:
                found[at] = self.child[node][0]
                continue
            a, b = self.child[node]
            inside = points[at, self.axis[node]] >= self.value[node]
            one, two = self.away(a, points[at]), self.away(b, points[at])
            right = (two < one) | ((one == two) & inside & (self.count[b] > 0))
            for part, child in ((at[~right], a), (at[right], b)):
                if len(part):
                    stack.append((child, part))
        return found

    def bound(self, points: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each point has k others, from the leaves' far corners."""
        leaf = np.array([n for n in range(len(self.axis)) if self.axis[n] < 0 and self.count[n]], np.int64)
        out = np.full(len(points), np.inf)
        if not len(leaf):
            return out
        for i in range(0, len(points), 256):
            p = points[i : i + 256, None]
            far = np.sqrt((np.maximum(np.abs(p - self.low[leaf]), np.abs(p - self.high[leaf])) ** 2).sum(2))
            order = np.argsort(far, axis=1)
            enough = np.cumsum(self.count[leaf][order], axis=1) >= k
            some = enough.any(1)
            first = np.take_along_axis(order, enough.argmax(1)[:, None], 1)
            out[i : i + 256] = np.where(some, np.take_along_axis(far, first, 1)[:, 0], np.inf)
        return out

    def reached(self, points: np.ndarray, within: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of the leaves but `home` whose box is no farther than `within`."""
        who, where, stack = [], [], [(0, np.arange(len(points)))]
        within = within * (1 + 1e-12) + 1e-300
        while stack:
            node, at = stack.pop()
            at = at[self.away(node, points[at]) <= within[at]]
            if not self.count[node] or not len(at):
                continue
            if self.axis[node] < 0:
                at = at[home[at] != self.child[node][0]]
                who.append(at)
                where.append(np.full(len(at), self.child[node][0]))
            else:
                stack += [(child, at) for child in self.child[node]]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, where))


def _points(batch, first: int = 1) -> np.ndarray:
    return np.stack([batch.column(first + i).to_numpy() for i in range(3)], 1)


def _compared(k: int, with_self: bool = True):
    """The k nearest of a leaf's points (those of another id, if not `with_self`) to each of the left points sent to it."""

    def run(right: pd.DataFrame, left: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(right) and len(left):
            r = right[list(XYZ)].to_numpy()
            ids = right["id"].to_numpy()
            for i in range(0, len(left), 256):
                p = left[list(XYZ)].to_numpy()[i : i + 256]
                square = sum((p[:, None, c] - r[None, :, c]) ** 2 for c in range(3))
                dist = np.sqrt(square)
                if not with_self:
                    dist[left["id"].to_numpy()[i : i + 256, None] == ids] = np.inf
                if k < len(r):
                    kth = np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
                    row, at = np.nonzero(dist <= kth)
                else:
                    row, at = np.divmod(np.arange(dist.size), len(r))
                part = pd.DataFrame({"id": left["id"].to_numpy()[i : i + 256][row], "id2": ids[at], "dist": dist[row, at]}).sort_values(["id", "dist", "id2"])
                if not with_self:
                    part = part[part.id != part.id2]
                out.append(part[part.groupby("id").cumcount() < k])
        return pd.concat(out) if out else pd.DataFrame({"id": [], "id2": [], "dist": []}).astype({"id": "int64", "id2": "int64"})

    return run


def nearest(left: DataFrame, right: DataFrame, k: int = 1, leaf_points: int = LEAF_POINTS, asked: int = ASKED, radius: float = float("inf"), with_self: bool = True) -> DataFrame:
    """id, id2, dist, rank of the k right points nearest to each left point and at most `radius` away; ties
    go to the lower id2. Points of the left point's own id don't count if not `with_self`.

    Points without an id or with a null or non-finite place take no part. Fewer than k right points are
    all given. Of right points in one place those of the k + 1 least ids are enough, so copies of a
    point fill no leaf.
    """
    spark = left.sparkSession
    finite = " and ".join(f"{c} is not null and abs({c}) < double('Infinity')" for c in XYZ)
    plain = lambda df: df.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in XYZ]).where(f"id is not null and {finite}")
    left, right = plain(left), plain(right)
    same = F.dense_rank().over(Window.partitionBy(*XYZ).orderBy("id"))
    right = right.withColumn("__same", same).where(F.col("__same") <= k + 1).drop("__same")
    count = right.count()
    leaves = min(MOST_LEAVES, max(1, -(-count // leaf_points)))
    wanted = leaves * PER_LEAF
    dealt = F.xxhash64("id", F.lit(3))
    # at most twice `wanted` rows, of three numbers each
    sample = right.where(dealt / 2.0**64 + 0.5 < 1.5 * wanted / max(count, 1)).select(*XYZ).limit(2 * wanted).toPandas().to_numpy().astype(float) if leaves > 1 else np.zeros((0, 3))
    splits = Splits(sample, leaves)
    sent = spark.sparkContext.broadcast(splits)

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.leaf_of(_points(batch)))], names=["id", *XYZ, "leaf"])

    placed = settled(right.mapInArrow(place, "id long, x double, y double, z double, leaf long"))
    # a row a leaf
    boxes = placed.groupBy("leaf").agg(F.count(F.lit(1)), *[f(c) for f in (F.min, F.max) for c in XYZ]).collect()
    known = spark.sparkContext.broadcast(splits.with_boxes([tuple(b) for b in boxes]))

    def at_home(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known.value.home(_points(batch)))], names=["id", *XYZ, "leaf"])

    def further(batches):
        for batch in batches:
            points, tree = _points(batch), known.value
            within = batch.column(5).to_numpy(zero_copy_only=False).astype(float)
            open_ = np.isnan(within)
            within[open_] = tree.bound(points[open_], k) if with_self else np.inf
            within = np.minimum(within, radius)
            at, leaf = tree.reached(points, within, batch.column(4).to_numpy())
            for i in range(0, len(at), 8192):
                rows = pa.array(at[i : i + 8192])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in range(4)], pa.array(leaf[i : i + 8192])], names=["id", *XYZ, "leaf"])

    def compared(queries: DataFrame) -> DataFrame:
        """Queries (id, x, y, z, leaf); a leaf that many ask is given to several tasks."""
        load = queries.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / asked).cast("int").alias("parts"))
        ask = queries.join(load, "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        have = placed.join(load, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return have.groupBy("leaf", "part").cogroup(ask.groupBy("leaf", "part")).applyInPandas(_compared(k, with_self), "id long, id2 long, dist double")

    first = settled(left.mapInArrow(at_home, "id long, x double, y double, z double, leaf long"))
    home = settled(compared(first))
    reach = home.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far")).select("id", F.when(F.col("n") >= k, F.col("far")).alias("far"))
    away = first.join(reach, "id", "left").select("id", *XYZ, "leaf", "far").mapInArrow(further, "id long, x double, y double, z double, leaf long")
    both = home.unionByName(compared(settled(away))).where(F.col("dist") <= radius)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "id2"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)
