"""Connected components of an edge table, without driver-side links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.llm.common import materialise


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with their node's least neighbour. The key of its own makes the join shuffle both
    sides, so adaptive execution can split a node with very many edges."""
    key = F.xxhash64("u").alias("key")
    return edges.select(key, "u", "v").join(least.select(key, "u", "m"), ["key", "u"])


#: So many different edges (16 MB) fit in one task, which then settles them all.
IN_TASK = 1_000_000


def _settled(batches):
    """(node, component) of all edges (u, v) of a task: roots are hooked to smaller ones until none is left."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    node, at = np.unique(np.concatenate([np.concatenate(side) for side in zip(*parts)]), return_inverse=True)
    one, two = np.split(at, 2)
    root = np.arange(len(node))
    while (root[one] != root[two]).any():
        low, high = np.minimum(root[one], root[two]), np.maximum(root[one], root[two])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, in_task: int = IN_TASK) -> DataFrame:
    """node, component (the least node reachable) of every node that has an edge.

    Up to `in_task` different edges, counted first, are settled in one task. More take alternating
    large-star and small-star steps: each round groups by node with partial minima and joins the
    minimum back, so a node with very many neighbours is split by adaptive execution. Each round
    ends in a checkpoint; the loop ends when a round changes nothing.
    Null ends and self-loops are no edges; repeated edges count once.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = materialise(edges)
    before = _fingerprint(edges)
    if before[0] <= in_task:
        return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_settled, "node long, component long")
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = _with_least(both.where("v > u"), least).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = _with_least(edges, least).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
