"""Connected components and chains on relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.operators.common import first_in, settled


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """node, component: the least node reachable, for every node that has an edge.

    Each round a node takes the least label around it and then the label of that label, which
    halves the distances left; it ends when a round changes nothing.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = settled(both.union(both.select("v", "u")).distinct())
    label = settled(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component")))
    for _ in range(rounds):
        around = both.join(label.select(F.col("node").alias("v"), F.col("component").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        lower = label.join(around, F.col("node") == F.col("u")).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = settled(lower.join(jump, "component", "left").select("node", "was", F.coalesce("further", "component").alias("component")))
        label = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def nearest_container(nodes: DataFrame) -> DataFrame:
    """id, up: the smallest other interval that holds a node's interval; nodes(id, lo, hi, size).

    Intervals of a tree are nested or apart, so a node's containers all hold its lower end: both
    sides are binned at powers of two of the interval's length and joined by bin.
    """
    level = F.ceil(F.log2(F.col("hi") - F.col("lo") + 1)).cast("int")
    outer = nodes.select(F.col("id").alias("up"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("size").alias("size2"), level.alias("bin"))
    outer = outer.withColumn("slot", F.explode(F.sequence(F.floor(F.col("lo2") / F.pow(F.lit(2.0), F.col("bin"))), F.floor(F.col("hi2") / F.pow(F.lit(2.0), F.col("bin"))))))
    bins = outer.select("bin").distinct()
    inner = nodes.crossJoin(F.broadcast(bins)).withColumn("slot", F.floor(F.col("lo") / F.pow(F.lit(2.0), F.col("bin"))))  # at most 64 bins
    held = inner.join(outer, ["bin", "slot"]).where("lo2 <= lo and hi <= hi2 and up <> id and (size2 > size or (lo2 < lo or hi2 > hi))")
    return first_in(held, ["id"], [(F.col("hi2") - F.col("lo2")), "size2", "up"]).select("id", "up", "size", "size2")


def collapse_chains(nodes: DataFrame, ratio: float = 0.95) -> DataFrame:
    """id, rep: nodes joined with their nearest container of nearly their size; the largest stays."""
    nodes = nodes.select("id", "lo", "hi", "size")
    links = nearest_container(nodes).where(F.col("size") >= ratio * F.col("size2"))
    joined = components(links.select(F.col("id").alias("a"), F.col("up").alias("b")))
    sized = nodes.join(joined, F.col("id") == F.col("node"), "left").select("id", "size", F.coalesce("component", "id").alias("component"), (F.col("hi") - F.col("lo")).alias("width"))
    top = first_in(sized, ["component"], [F.desc("size"), F.desc("width"), "id"]).select("component", F.col("id").alias("rep"))
    return sized.join(top, "component").select("id", "rep")
