"""Sparse mask and frame evidence of atoms, and what is scored from it.

leaf_n(atom, f, n): visible points; leaf_i(atom, f, <mask>, cnt): points claimed by a mask.
A mask is named by the columns MASK together with its frame.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.operators.common import first_in, settled

MASK = ["g", "seg"]
NODE = ["lvl", "node"]


def count_by(df: DataFrame, *keys: str, name: str = "cnt") -> DataFrame:
    """Group count; also the coalescing of repeated keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def sum_by(df: DataFrame, *keys: str, value: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(value))


def signatures(leaf_i: DataFrame, leaf_n: DataFrame) -> DataFrame:
    """Per atom and frame, the vector of claimed shares at unit length times sqrt(min(largest, 1))."""
    x = leaf_i.join(leaf_n, ["atom", "f"]).withColumn("x", F.col("cnt") / F.col("n"))
    w = Window.partitionBy("atom", "f")
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(w))
    return x.withColumn("s", F.col("x") / length * F.sqrt(F.least(F.max("x").over(w), F.lit(1.0)))).select("atom", "f", *MASK, "s")


def affinity(edges: DataFrame, leaf_i: DataFrame, leaf_n: DataFrame) -> DataFrame:
    """a, b, num, w: agreement of the signatures at an edge's ends, and frames that could tell.

    A frame counts if both ends are visible in it and at least one is claimed by a mask.
    """
    s = signatures(leaf_i, leaf_n)
    left, right = (s.select(F.col("atom").alias(e), "f", *MASK, F.col("s").alias(f"s{e}")) for e in "ab")
    num = edges.select("a", "b").join(left, "a").join(right, ["b", "f", *MASK]).groupBy("a", "b").agg(F.sum(F.col("sa") * F.col("sb")).alias("num"))
    claimed = leaf_i.select("atom", "f").distinct().withColumn("m", F.lit(1))
    seen = leaf_n.select("atom", "f").join(claimed, ["atom", "f"], "left")
    left, right = (seen.select(F.col("atom").alias(e), "f", F.col("m").alias(f"m{e}")) for e in "ab")
    w = edges.select("a", "b").join(left, "a").join(right, ["b", "f"]).where("ma is not null or mb is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    return num.join(w, ["a", "b"]).where("num > 0 and w > 0")


def must_link(edges: DataFrame, least_affinity: float = 0.98, least_frames: int = 8) -> DataFrame:
    return edges.withColumn("affinity", F.col("num") / F.col("w")).where((F.col("affinity") >= least_affinity) & (F.col("w") >= least_frames))


def beta_prior(edges: DataFrame) -> DataFrame:
    """One row (a0, b0): moments of the edges' affinities as a Beta prior."""
    mean, var = F.avg(F.col("num") / F.col("w")), F.var_pop(F.col("num") / F.col("w")) + 1e-12
    return edges.agg(mean.alias("mu"), var.alias("var")).select("mu", F.greatest(F.col("mu") * (1 - F.col("mu")) / F.col("var") - 1, F.lit(1e-3)).alias("k")).select((F.col("mu") * F.col("k")).alias("a0"), ((1 - F.col("mu")) * F.col("k")).alias("b0"))


def border_gain(edges: DataFrame, region: DataFrame) -> DataFrame:
    """ra, rb, gain: evidence pooled over the border of two regions, shrunk to the prior."""
    prior = beta_prior(edges)  # one row
    left, right = (region.select(F.col("atom").alias(e), F.col("region").alias(f"r{e}")) for e in "ab")
    pooled = edges.join(left, "a").join(right, "b").where("ra <> rb").groupBy(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb")).agg(F.sum("num").alias("num"), F.sum("w").alias("w"))
    return pooled.crossJoin(F.broadcast(prior)).select("ra", "rb", ((F.col("a0") + F.col("num")) / (F.col("a0") + F.col("b0") + F.col("w"))).alias("gain"))


def sums_up(members: DataFrame, leaf: DataFrame, *keys: str, value: str) -> DataFrame:
    """Sums of the leaves' values by node and keys; members(node, atom) lists every ancestor of an atom.

    A leaf meets the list of its nodes in one row, by a shuffled join: the tables of a tree look small to the
    planner, which would send them through the driver. Leaves under one coarsest node then lie together before
    the list is laid out, so a task combines them to nearly the size of the result. Only speed and memory rest
    on that place, and Spark splits one that is too large.
    """
    paths = members.groupBy("atom").agg(F.collect_list(F.struct(*NODE)).alias("nodes"))
    held = leaf.join(paths.hint("merge"), "atom").withColumn("top", F.array_max("nodes")).hint("rebalance", "top")
    return held.select(F.inline("nodes"), *keys, value).groupBy(*NODE, *keys).agg(F.sum(value).alias(value))


def node_evidence(members: DataFrame, leaf_i: DataFrame, leaf_n: DataFrame, least: float = 8, share: float = 0.05) -> DataFrame:
    """Eligible rows (node, f, mask, i, n, q, size): what masks share with nodes that a frame sees enough of.

    One pass over the leaf tables gives all nodes of a tree: members(node, atom) lists every
    ancestor of an atom, so sums up the tree are group-bys. All sides grow with the input: the joins
    here and in what follows are shuffled ones, as adaptive plans would send each side under their
    limit through the driver.
    """
    n = sums_up(members, leaf_n, "f", value="n")
    seen = n.withColumn("size", F.sum("n").over(Window.partitionBy(*NODE))).where(F.col("n") >= F.greatest(F.lit(float(least)), F.col("size") * share))
    i = sums_up(members, leaf_i, "f", *MASK, value="cnt").withColumnRenamed("cnt", "i")
    q = leaf_i.groupBy("f", *MASK).agg(F.sum("cnt").alias("q"))
    return i.join(seen.hint("merge"), [*NODE, "f"]).join(q.hint("merge"), ["f", *MASK])


def iou() -> Column:
    return F.col("i").cast("double") / (F.col("q") + F.col("n") - F.col("i"))


def coverage() -> Column:
    return F.col("i").cast("double") / F.col("n")


def purity() -> Column:
    return F.col("i").cast("double") / F.col("q")


def best_masks(rows: DataFrame) -> DataFrame:
    """The mask of largest IoU of each node and frame; ties to the lowest mask."""
    scored = rows.withColumns({"iou": iou(), "cov": coverage(), "pur": purity()})
    return first_in(scored, [*NODE, "f"], [F.desc("iou"), *MASK])


def covering(rows: DataFrame, retain: float = 0.5) -> DataFrame:
    return rows.where(F.col("i") >= F.col("n") * retain)


def phi(rows: DataFrame, alpha: float = 2.0, beta: float = 2.0, floor: float = 0.05) -> DataFrame:
    """Graded endorsement cov^alpha pur^beta IoU of rows whose weight reaches the floor."""
    weight = F.pow(coverage(), F.lit(alpha)) * F.pow(purity(), F.lit(beta))
    return rows.withColumn("weight", weight).where(F.col("weight") >= floor).withColumn("phi", F.col("weight") * iou())


def client_means(phis: DataFrame, tracks: DataFrame, eligible: DataFrame) -> DataFrame:
    """node, track, value: mean of phi over a track's masks in the node's eligible frames.

    A mask without endorsement adds 0 above and 1 below; two masks in one frame count twice below.
    """
    top = phis.join(tracks, ["f", *MASK]).groupBy(*NODE, "track").agg(F.sum("phi").alias("total"))
    # only pairs that some mask endorses are looked up, frame by frame of their track
    asked = top.select(*NODE, "track").join(tracks.select("track", "f"), "track")
    seen = asked.join(eligible.select(*NODE, "f").distinct(), [*NODE, "f"]).groupBy(*NODE, "track").agg(F.count(F.lit(1)).alias("den"))
    return top.join(seen, [*NODE, "track"], "left").select(*NODE, "track", (F.col("total") / F.greatest(F.coalesce("den", F.lit(0)), F.lit(1))).alias("value"))


def nested(lo: str = "lo", hi: str = "hi", other: str = "2") -> Column:
    """Whether either interval of a pair of tree nodes holds the other."""
    a, b, c, d = F.col(lo), F.col(hi), F.col(lo + other), F.col(hi + other)
    return ((a <= c) & (d <= b)) | ((c <= a) & (b <= d))


def co_mask_votes(rows: DataFrame, crowd: int = 100, alpha: float = 2.0, beta: float = 2.0, floor: float = 0.05) -> DataFrame:
    """Votes of a mask for pairs of nodes that it may join: (id, id2, f, vote).

    rows(id, lo, hi, f, mask, i, n, q). Before the self-join each mask keeps its `crowd` purest
    nodes, which bounds the pairs; two purities under floor^(1/beta) in sum can't reach the floor.
    """
    ranked = first_in(rows.withColumn("pur", purity()), ["f", *MASK], [F.desc("pur"), "id"], crowd, "r")
    other = ranked.select("f", *MASK, *[F.col(c).alias(f"{c}2") for c in ("id", "lo", "hi", "i", "n", "pur", "r")])
    pairs = ranked.join(other.hint("merge"), ["f", *MASK]).where("r < r2").where(F.col("pur") + F.col("pur2") >= floor ** (1 / beta)).where(~nested())
    i, n = F.col("i") + F.col("i2"), F.col("n") + F.col("n2")
    weight = F.pow(i / n, F.lit(alpha)) * F.pow(F.least(F.col("pur") + F.col("pur2"), F.lit(1.0)), F.lit(beta))
    return pairs.withColumn("weight", weight).where(F.col("weight") >= floor).select(F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("id2"), "f", (F.col("weight") * (i / (F.col("q") + n - i))).alias("vote"))


def best_votes(votes: DataFrame) -> DataFrame:
    """id, id2, joins (sum of the best vote of each frame), frames."""
    return votes.groupBy("id", "id2", "f").agg(F.max("vote").alias("vote")).groupBy("id", "id2").agg(F.sum("vote").alias("joins"), F.count(F.lit(1)).alias("frames"))


def co_eligible(pairs: DataFrame, eligible: DataFrame) -> DataFrame:
    """id, id2, n_co: frames in which both nodes of a pair are eligible (0 if none)."""
    one = eligible.select("id", "f").distinct()
    other = one.select(F.col("id").alias("id2"), "f", F.lit(1).alias("hit"))
    return pairs.select("id", "id2").join(one.hint("merge"), "id", "left").join(other.hint("merge"), ["id2", "f"], "left").groupBy("id", "id2").agg(F.count("hit").alias("n_co"))


def track_proposals(strengths: DataFrame, known: DataFrame, crowd: int = 100) -> DataFrame:
    """Pairs of nodes under one track: non-nested, among its `crowd` strongest, not yet known.

    strengths(track, id, lo, hi, s).
    """
    best = strengths.groupBy("track", "id", "lo", "hi").agg(F.max("s").alias("s"))
    top = first_in(best, ["track"], [F.desc("s"), "id"], crowd)
    other = top.select("track", *[F.col(c).alias(f"{c}2") for c in ("id", "lo", "hi")])
    pairs = top.join(other, "track").where("id < id2").where(~nested()).select("id", "id2").distinct()
    return pairs.join(known.select("id", "id2"), ["id", "id2"], "left_anti")


#: Different (k, n) that the mixture may bring to the driver (12 MB).
IN_DRIVER = 500_000


def mixture(pairs: DataFrame, rounds: int = 50, in_driver: int = IN_DRIVER) -> tuple[float, float, float]:
    """(p_same, p_diff, share) of a binomial mixture over (k, n), by a fixed number of EM rounds.

    Equal pairs are counted once, with their number. Up to `in_driver` different ones, the rounds
    run on the driver's copy; beyond, each round is one aggregate and five numbers come to it.
    """
    p_s, p_d, share = 0.5, 0.02, 0.1
    counted = pairs.groupBy(F.col("k").cast("double").alias("k"), F.col("n").cast("double").alias("n")).agg(F.count(F.lit(1)).cast("double").alias("c")).persist()
    try:
        different = counted.count()
        local = counted.toPandas() if different <= in_driver else None
        for _ in range(rounds if different else 0):
            if local is not None:
                k, n, c = (local[x].to_numpy() for x in ("k", "n", "c"))
                same = np.log(share) + k * np.log(p_s) + (n - k) * np.log(1 - p_s)
                diff = np.log(1 - share) + k * np.log(p_d) + (n - k) * np.log(1 - p_d)
                g = c / (1 + np.exp(np.clip(diff - same, -50, 50)))
                sums = g.sum() / c.sum(), (g * k).sum(), (g * n).sum(), ((c - g) * k).sum(), ((c - g) * n).sum()
            else:
                k, n, c = F.col("k"), F.col("n"), F.col("c")
                same = math.log(share) + k * math.log(p_s) + (n - k) * math.log(1 - p_s)
                diff = math.log(1 - share) + k * math.log(p_d) + (n - k) * math.log(1 - p_d)
                weighed = counted.withColumn("g", c / (1 + F.exp(F.least(F.greatest(diff - same, F.lit(-50.0)), F.lit(50.0)))))
                g = F.col("g")
                sums = weighed.agg(F.sum(g) / F.sum(c), F.sum(g * k), F.sum(g * n), F.sum((c - g) * k), F.sum((c - g) * n)).first()
            share = min(max(sums[0], 1e-12), 1 - 1e-12)
            p_s = min(max(sums[1] / max(sums[2], 1e-9), 1e-3), 1 - 1e-3)
            p_d = min(max(sums[3] / max(sums[4], 1e-9), 1e-4), 1 - 1e-4)
    finally:
        counted.unpersist()
    return max(p_s, p_d), min(p_s, p_d), share


def log_likelihood_ratio(p_s: float, p_d: float) -> Column:
    """Cost of an edge with k joins in n chances: same object over different ones."""
    return F.col("k") * F.log(F.lit(p_s / p_d)) + (F.col("n") - F.col("k")) * F.log(F.lit((1 - p_s) / (1 - p_d)))


def set_overlaps(sets: DataFrame, key: str = "track", element: str = "atom", most: int | None = None) -> DataFrame:
    """key, key2, inter, size, size2, iou of all pairs of sets that share an element.

    The join is on the element and its groups are as large as the sets that hold it; `most`
    asserts a bound on that (a violation raises, nothing is dropped).
    """
    sets = sets.select(key, element).distinct()
    if most is not None:
        crowd = sets.groupBy(element).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
        if crowd > most:
            raise ValueError(f"an element is in {crowd} sets, more than {most}")
    size = sets.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    pairs = sets.join(sets.withColumnRenamed(key, f"{key}2"), element).where(F.col(key) < F.col(f"{key}2")).groupBy(key, f"{key}2").agg(F.count(F.lit(1)).alias("inter"))
    joined = pairs.join(size, key).join(size.select(F.col(key).alias(f"{key}2"), F.col("size").alias("size2")), f"{key}2")
    return joined.withColumn("iou", F.col("inter").cast("double") / (F.col("size") + F.col("size2") - F.col("inter")))


def _prefixes(sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """classes(rep, n, items, members) of equal sets, and the first items (element, rep, n, at) of each.

    Items are sorted by rarity. Two sets whose overlap is `least` of their union share an element among
    the first n - ceil(least * n) + 1 of either, so the rest needs no join.
    """
    often = sets.groupBy("e").agg(F.count(F.lit(1)).alias("f"))
    items = F.array_sort(F.collect_list(F.struct("f", "e")))
    whole = sets.join(often, "e").groupBy("s").agg(items.alias("items"))
    named = whole.select("s", F.col("items.e").alias("items"), F.size("items").alias("n"), F.sha2(F.to_json("items"), 256).alias("print"))
    classes = named.groupBy("n", "print").agg(F.min("s").alias("rep"), F.first("items").alias("items"), F.collect_list("s").alias("members")).select("rep", "n", "items", "members")
    classes = settled(classes)
    long = F.col("n") - F.ceil(least * F.col("n") - 1e-9).cast("int") + 1
    return classes, classes.select("rep", "n", F.posexplode(F.slice("items", F.lit(1), long)).alias("at", "e"))


def _candidates(prefixes: DataFrame, least: float) -> DataFrame:
    """rep, rep2 of sets that share a prefix element and whose sizes and places of it allow the overlap."""
    other = prefixes.select("e", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    needed = F.ceil(least / (1 + least) * (F.col("n") + F.col("n2")) - 1e-9)
    possible = 1 + F.least(F.col("n") - 1 - F.col("at"), F.col("n2") - 1 - F.col("at2")) + F.least("at", "at2")
    sized = (F.least("n", "n2") >= least * F.greatest("n", "n2") - 1e-9) & (possible >= needed)
    return prefixes.join(other, "e").where((F.col("rep") < F.col("rep2")) & sized).select("rep", "rep2").distinct()


def similar_sets(sets: DataFrame, least: float = 0.8, key: str = "track", element: str = "atom") -> DataFrame:
    """key, key2, inter, size, size2, iou of the pairs of sets whose overlap is `least` of their union.

    Equal sets are one class; classes meet by their rarest elements only, so an element that very many
    sets hold brings none of them together, and are then compared whole. A class of many equal sets
    has as many pairs as it has: those are all results.
    """
    plain = sets.select(F.col(key).alias("s"), F.col(element).alias("e")).where("s is not null and e is not null").distinct()
    classes, prefixes = _prefixes(plain, least)
    one = classes.select("rep", F.col("items").alias("i1"), F.col("n").alias("n1"), F.col("members").alias("m1"))
    two = classes.select(F.col("rep").alias("rep2"), F.col("items").alias("i2"), F.col("n").alias("n2"), F.col("members").alias("m2"))
    met = _candidates(prefixes, least).join(one, "rep").join(two, "rep2").withColumn("inter", F.size(F.array_intersect("i1", "i2")).cast("long"))
    near = met.where(F.col("inter").cast("double") / (F.col("n1") + F.col("n2") - F.col("inter")) >= least)
    pairs = near.select("inter", "n1", "n2", "m2", F.explode("m1").alias("a")).select("inter", "n1", "n2", "a", F.explode("m2").alias("b"))
    # of a class, each member with those after it
    sorted_members = classes.where(F.size("members") > 1).select("n", F.array_sort("members").alias("m"))
    equal = sorted_members.select("n", "m", F.posexplode("m").alias("at", "a")).select("n", "a", F.explode(F.slice("m", F.col("at") + 2, F.size("m"))).alias("b"))
    size = F.col("n").cast("long")
    pairs = pairs.select("a", "b", "inter", F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2")).unionByName(equal.select("a", "b", size.alias("inter"), size.alias("n1"), size.alias("n2")))
    pairs = settled(pairs)  # results, which callers turn and rank more than once
    first = F.col("a") < F.col("b")
    turned = pairs.select(F.least("a", "b").alias(key), F.greatest("a", "b").alias(f"{key}2"), "inter", F.when(first, F.col("n1")).otherwise(F.col("n2")).alias("size"), F.when(first, F.col("n2")).otherwise(F.col("n1")).alias("size2"))
    return turned.withColumn("iou", F.col("inter").cast("double") / (F.col("size") + F.col("size2") - F.col("inter")))


def mutual_best(overlaps: DataFrame, chunks: DataFrame, least: float = 0.8, margin: float = 1.2) -> DataFrame:
    """track, track2, iou: pairs that are each other's best in the other's chunk, by a margin.

    The runner-up is taken among pairs that reach `least`, and is 0 where there is none.
    """
    chunk = chunks.select("track", "chunk")
    both = overlaps.where(F.col("iou") >= least).select("track", "track2", "iou")
    both = both.unionByName(both.select(F.col("track2").alias("track"), F.col("track").alias("track2"), "iou"))
    both = both.join(chunk, "track").join(chunk.select(F.col("track").alias("track2"), F.col("chunk").alias("chunk2")), "track2").where("chunk <> chunk2")
    w = Window.partitionBy("track", "chunk2").orderBy(F.desc("iou"), "track2")
    best = both.withColumns({"r": F.row_number().over(w), "next": F.lead("iou", 1, 0.0).over(w)}).where("r = 1")
    back = best.select(F.col("track").alias("b2"), F.col("track2").alias("b1"), F.col("next").alias("next2"))
    pairs = best.where("track < track2").join(back, (F.col("track") == F.col("b1")) & (F.col("track2") == F.col("b2")))
    return pairs.where((F.col("iou") >= margin * F.col("next")) & (F.col("iou") >= margin * F.col("next2"))).select("track", "track2", "iou")
