"""Queries on memberships, tables of metrics, and the sequential stages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.functions import geometry as geo
from terrazzo.operators import evidence as ev
from terrazzo.operators import contraction, graph, metrics, selection, slam
from terrazzo.operators.common import first_in, settled
from terrazzo.plans import proxies as px
from terrazzo.plans.evidence import IDS, TRACKS, _affinity, _intervals, _kn, _rows, _tracks, r

def _members(spark, d) -> DataFrame:
    return px.memberships(spark, d).select((F.col("f").cast("long") * 1_000_000 + F.col("seg")).alias("hyp"), "id")


def owner_smallest_wins(spark, d):
    memb = _members(spark, d)
    size = memb.groupBy("hyp").agg(F.count(F.lit(1)).alias("size"))
    return first_in(memb.join(size, "hyp"), ["id"], ["size", "hyp"]).select("id", "hyp", "size")


def pack_offsets(spark, d):
    """Ragged packing: sizes and running ends. The running sum crosses partitions by their totals,
    so no task sees all hypotheses."""
    sizes = _members(spark, d).groupBy("hyp").agg(F.count(F.lit(1)).alias("size")).withColumn("part", F.floor(F.col("hyp") / 1_000_000))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("total"))
    before = parts.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    inside = F.sum("size").over(Window.partitionBy("part").orderBy("hyp").rowsBetween(Window.unboundedPreceding, 0))
    return sizes.withColumn("inside", inside).join(before, "part").select("hyp", "size", (F.col("before") + F.col("inside")).cast("long").alias("offset_end"))


def membership_budget(spark, d):
    return metrics.membership_stats(_members(spark, d), 5).select("n_points", r("mean_memb"), "max_memb", "over_budget")


def dense_reindex(spark, d):
    """Surviving hypotheses of at least 14 points under dense numbers per frame."""
    sizes = _members(spark, d).groupBy("hyp").agg(F.count(F.lit(1)).alias("size")).where("size >= 14")
    return sizes.withColumn("f", F.floor(F.col("hyp") / 1_000_000)).select("hyp", (F.dense_rank().over(Window.partitionBy("f").orderBy("hyp")) - 1).cast("long").alias("dense"))


def _truth(spark, d) -> DataFrame:
    """Instances of 20 parts; every tenth is excluded, its points stay."""
    gt = F.floor((F.col("p_partkey") + 5) / 20)
    return px.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(gt % 10 != 9, gt).alias("gt"))


def instance_recall_ar(spark, d):
    truth = _truth(spark, d)
    return metrics.average_recall(metrics.instance_ious(_members(spark, d), truth), truth).select(r("ar"), r("r50"), r("r75"), r("r90"), "n_gt")


def gt_match_hypotheses(spark, d):
    return metrics.matched_hypotheses(metrics.instance_ious(_members(spark, d), _truth(spark, d)))


def seed_topk(spark, d):
    rows = px.table(spark, d, "lineitem").withColumn("f", F.year("l_shipdate"))
    return first_in(rows, ["f"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 100, "place").select("f", "place", "l_orderkey", "l_linenumber")


def class_name_normalize(spark, d):
    name = F.lower(F.trim(F.regexp_replace("p_type", r"\s+", " ")))
    return px.table(spark, d, "part").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_type").alias("spellings"))


def default_lookup(spark, d):
    classes = px.table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("class"))
    return px.table(spark, d, "orders").join(classes, "o_custkey", "left").groupBy(F.coalesce("class", F.lit(-1)).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = px.table(spark, d, "orders").join(px.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    old = F.year("o_orderdate") < 1997
    one = lambda df: df.groupBy("c_nationkey").agg(F.avg("o_totalprice").alias("value"))
    return one(rows.where(old & (F.col("c_nationkey") > 2))), one(rows.where(~old & (F.col("c_nationkey") < 22)))


def before_after_dashboard(spark, d):
    return metrics.dashboard(*_halves(spark, d), "c_nationkey").select("c_nationkey", r("before", 4), r("after", 4), r("delta", 4), "status")


def comparable_mean(spark, d):
    board = metrics.dashboard(*_halves(spark, d), "c_nationkey")
    both = board.where("before is not null and after is not null")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delta"), 4).alias("mean_delta"))


def timing_mean_of_ratios(spark, d):
    rows = px.table(spark, d, "orders")
    ratio = F.col("o_totalprice") / (F.col("o_custkey") + 1)
    return rows.groupBy("o_orderpriority").agg(F.round(F.avg(ratio), 4).alias("mean_ratio"), F.round(F.sum(F.col("o_totalprice") * F.col("o_custkey")) / F.sum("o_custkey"), 4).alias("weighted"), F.round(F.percentile("o_totalprice", F.lit(0.99)), 4).alias("p99"))


def complete_keys_mean(spark, d):
    """Means over nations of the statuses that every nation has."""
    rows = px.table(spark, d, "orders").join(px.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    per = rows.groupBy("c_nationkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    nations = rows.agg(F.countDistinct("c_nationkey").alias("n"))
    return per.groupBy("o_orderstatus").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(nations)).where("c = n").select("o_orderstatus", r("mean", 4))


def fingerprint_manifest(spark, d):
    key = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus")
    return px.table(spark, d, "orders").select("o_orderkey", F.sha2(key, 256).alias("fingerprint"))


def completeness_check(spark, d):
    """Orders whose recorded fingerprint still holds; a third were recorded under another status."""
    key = lambda s: F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), s), 256)
    orders = px.table(spark, d, "orders")
    manifest = orders.select(F.col("o_orderkey").alias("k"), key(F.when(F.col("o_orderkey") % 3 == 0, F.lit("?")).otherwise(F.col("o_orderstatus"))).alias("was"))
    joined = orders.join(manifest, F.col("o_orderkey") == F.col("k"))
    return joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum((key("o_orderstatus") == F.col("was")).cast("long")).alias("complete"))


def scene_list(spark, d):
    """Nations in the order of the two numbers in their name, given by region and key."""
    rows = px.table(spark, d, "nation").select(F.format_string("scene%04d_%02d", F.col("n_regionkey"), F.col("n_nationkey")).alias("scene"))
    major, minor = (F.regexp_extract("scene", r"scene(\d+)_(\d+)", k).cast("int") for k in (1, 2))
    return rows.select("scene", F.row_number().over(Window.orderBy(major, minor, "scene")).alias("place"))


def block_normal_equations(spark, d):
    rows = slam.coalesce_blocks(px.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), (F.col("l_suppkey") % 10).alias("j"), F.col("l_quantity").alias("value")))
    return slam.damped(slam.transposed_product(rows, rows), 1.0, 0.0).select("i", "j", r("value", 4))


def block_vector_product(spark, d):
    rows = slam.coalesce_blocks(px.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), (F.col("l_suppkey") % 10).alias("j"), F.col("l_quantity").alias("value")))
    ones = px.table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_custkey") % 7).cast("double").alias("value"))
    return slam.transposed_vector(rows, ones).select("i", r("value", 4))


def block_sum_and_subset(spark, d):
    rows = px.table(spark, d, "lineitem").select((F.col("l_partkey") % 20).alias("i"), (F.col("l_suppkey") % 10).alias("j"), F.col("l_quantity").alias("value"))
    fixed = rows.where("j < 3").select("j").distinct()
    both = slam.add(slam.without_columns(rows, fixed), rows.where("i < 5"), -1.0)
    return slam.transpose(both).select("i", "j", r("value", 4))


def schur_solution(spark, d):
    """A small normal system with a diagonal block, solved by its reduced system: (kind, i, value)."""
    rows = slam.coalesce_blocks(px.table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("i"), (F.col("l_suppkey") % 8).alias("j"), (F.col("l_quantity") / 100).alias("value")))
    h = slam.damped(slam.transposed_product(rows, rows), 50.0, 1.0)
    e = slam.transpose(rows)
    c = rows.groupBy("i").agg((F.sum(F.col("value") * F.col("value")) + 5).alias("value")).select("i", F.col("i").alias("j"), "value")
    v = h.groupBy("i").agg(F.avg("value").alias("value"))
    w = rows.groupBy("i").agg(F.sum("value").alias("value"))
    x, z = slam.schur_solve(h, e, c, v, w)
    return x.withColumn("kind", F.lit("pose")).unionByName(z.select("i", "value").withColumn("kind", F.lit("disparity"))).select("kind", "i", r("value", 6))


def image_sizes(spark, d):
    """Long-side size, resize-and-crop and intrinsics of images as wide and high as parts say."""
    rows = px.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40 + 100).alias("w"), (F.col("p_partkey") % 900 + 64).cast("int").alias("h"))
    w, h = geo.long_side_size("w", "h", 512)
    fx, fy, cx, cy = geo.rescale_intrinsics(F.lit(500.0), F.lit(510.0), F.col("w") / 2, F.col("h") / 2, F.col("lw") / F.col("w"), F.col("lh") / F.col("h"))
    return rows.withColumns({"lw": w, "lh": h}).select("p_partkey", "lw", "lh", F.round(fx, 6).alias("fx"), F.round(fy, 6).alias("fy"), F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"), geo.nearest_index(F.lit(3), F.col("w"), F.col("lw")).alias("src"))


def depth_codes(spark, d):
    """Prices as depths in metres to whole millimetres and back."""
    rows = px.table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 33).alias("m"))
    return rows.select("p_partkey", geo.to_millimetres("m").alias("mm")).withColumn("back", F.round(geo.from_millimetres("mm"), 6))


def constrained_components(spark, d):
    """Grouped by the components of all links: a union never leaves one, so the result is that of one pass."""
    tracks = _tracks(spark, d)
    links = settled(ev.mutual_best(ev.similar_sets(tracks), tracks.select("track", "chunk").distinct()))
    groups = graph.components(links, "track", "track2")
    pairs = links.join(groups.select(F.col("node").alias("track"), F.col("component").alias("scene")), "track")
    pairs = pairs.select("scene", "iou", F.col("track").alias("a"), F.col("track2").alias("b"), F.floor(F.col("track") / 10**9).alias("chunk_a"), F.floor(F.col("track2") / 10**9).alias("chunk_b"))
    return selection.per_scene(pairs, selection.constrained_components, "track long, component long").drop("scene")


def _tree_edges(spark, d) -> DataFrame:
    """scene, a, b, num, w, a0, b0: affinity edges inside scenes of 64 parts, with the prior of all."""
    affinity = settled(_affinity(spark, d))
    inside = affinity.where(F.floor(F.col("a") / 64) == F.floor(F.col("b") / 64))
    return inside.crossJoin(F.broadcast(ev.beta_prior(affinity))).withColumn("scene", F.floor(F.col("a") / 64))  # one row


def agglomerate_tree(spark, d):
    """A merge tree per scene of 64 parts."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        atoms = sorted({*rows.a, *rows.b})
        at = {x: i for i, x in enumerate(atoms)}
        listed = [(at[a], at[b], n, float(w)) for a, b, n, w in sorted(zip(rows.a, rows.b, rows.num, rows.w))]
        return selection.agglomerate({i: 1 for i in range(len(atoms))}, listed, float(rows.a0.iloc[0]), float(rows.b0.iloc[0]))

    return selection.per_scene(_tree_edges(spark, d), build, "node long, parent long, left long, right long, lo long, hi long, size long")


def _contraction_rows(spark, d) -> DataFrame:
    """scene, id, id2, cost and both intervals; a scene is a component of the edges of positive cost."""
    pairs = settled(_kn(spark, d))
    p_s, p_d, _ = ev.mixture(pairs)
    costs = pairs.select("id", "id2", ev.log_likelihood_ratio(p_s, p_d).alias("cost"))
    groups = graph.components(costs.where("cost > 0"), "id", "id2").select(F.col("node").alias("id"), F.col("component").alias("scene"))
    inside = costs.join(groups, "id").join(groups.select(F.col("id").alias("id2"), F.col("scene").alias("scene2")), "id2").where("scene = scene2")
    width = lambda c: F.pow(F.lit(2.0), F.floor(F.col(c) / 10**12)).cast("long")
    place = lambda c: F.col(c) % 10**12
    return inside.select("scene", "id", "id2", "cost", *[e.alias(n) for c, s in (("id", ""), ("id2", "2")) for e, n in ((place(c) * width(c), f"lo{s}"), ((place(c) + 1) * width(c) - 1, f"hi{s}"))])


def gaec_candidates(spark, d):
    """Contractions of each component of edges of positive cost: none ever leaves one."""
    return contraction.contracted(_contraction_rows(spark, d), 400)


def _cover_rows(spark, d) -> DataFrame:
    rows = _intervals(ev.phi(_rows(spark, d)))
    return rows.select(F.floor(F.col("lo") / 64).alias("scene"), "lvl", "id", "lo", "hi", (F.col("g") * F.lit(10**9).cast("long") + F.col("seg")).alias("track"), (F.col("f").cast("long") * F.lit(10**10).cast("long") + F.col("g") * F.lit(10**9).cast("long") + F.col("seg")).alias("mask"), "phi")


def _candidates(rows: pd.DataFrame) -> list:
    base = int(rows.scene.iloc[0]) * 64
    found = []
    for (lo, hi, node), part in rows.groupby(["lo", "hi", "id"]):
        values = part.groupby("track").phi.mean()
        found.append((int(node), np.arange(lo - base, hi - base + 1), dict(zip(values.index.tolist(), values.tolist()))))
    return sorted(found, key=lambda c: (-len(c[1]), c[0]))


def lazy_greedy_cover(spark, d):
    def cover(rows: pd.DataFrame) -> pd.DataFrame:
        picks = selection.greedy_cover(_candidates(rows), 64, (1, 2, 3))
        return pd.DataFrame([(i, *p) for i, p in enumerate(picks)], columns=["place", "node", "budget", "gain"])

    return selection.per_scene(_cover_rows(spark, d), cover, "place long, node long, budget long, gain double").withColumn("gain", F.round("gain", 9))


def ancestor_exchange(spark, d):
    def exchange(rows: pd.DataFrame) -> pd.DataFrame:
        base = int(rows.scene.iloc[0]) * 64
        picks = {p[0] for p in selection.greedy_cover(_candidates(rows), 64, (1, 2, 3))}
        nodes = {int(n): (int(p.lo.iloc[0]) - base, int(p.hi.iloc[0]) - base, dict(zip(p["mask"].tolist(), p.phi.tolist()))) for n, p in rows.groupby("id")}
        stands = selection.ancestor_exchange({n: nodes[n] for n in picks}, nodes, 64, 3)
        return pd.DataFrame(sorted(stands.items()), columns=["node", "stand"])

    return selection.per_scene(_cover_rows(spark, d), exchange, "node long, stand long")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

M = px.MEMBERSHIPS + ", m AS (SELECT CAST(f AS BIGINT) * 1000000 + seg AS hyp, id FROM memb), hs AS (SELECT hyp, CAST(count(*) AS BIGINT) AS size FROM m GROUP BY 1)"
IOU = M + """, gt AS (SELECT p_partkey AS id, CASE WHEN CAST(floor((p_partkey + 5) / 20.0::DOUBLE) AS BIGINT) % 10 <> 9 THEN CAST(floor((p_partkey + 5) / 20.0::DOUBLE) AS BIGINT) END AS gt FROM part), gs AS (SELECT gt, count(*) AS total FROM gt WHERE gt IS NOT NULL GROUP BY 1),
it AS (SELECT gt, hyp, count(*) AS inter FROM m JOIN gt USING (id) WHERE gt IS NOT NULL GROUP BY 1, 2), ious AS (SELECT gt, hyp, CAST(inter AS DOUBLE) / (size + total - inter) AS iou FROM it JOIN hs USING (hyp) JOIN gs USING (gt))"""
HALVES = """r AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey), b AS (SELECT c_nationkey, avg(o_totalprice) AS before FROM r WHERE year(o_orderdate) < 1997 AND c_nationkey > 2 GROUP BY 1),
a AS (SELECT c_nationkey, avg(o_totalprice) AS after FROM r WHERE year(o_orderdate) >= 1997 AND c_nationkey < 22 GROUP BY 1), j AS (SELECT c_nationkey, before, after, after - coalesce(before, 0) AS delta FROM b FULL JOIN a USING (c_nationkey))"""
#: The phi of nodes in scenes of 64 parts, and the greedy cover of each scene, a pick a step.
COVER = px.EVIDENCE + f""", scored AS (SELECT lo // 64 AS scene, id, lo, hi, CAST(g AS BIGINT) * 1000000000 + seg AS track, CAST(f AS BIGINT) * 10000000000 + CAST(g AS BIGINT) * 1000000000 + seg AS mask, phi FROM (SELECT *, {IDS} FROM phis)),
val AS (SELECT scene, id, lo, hi, track, avg(phi) AS v FROM scored GROUP BY ALL),
cand AS (SELECT scene, id, lo - scene * 64 AS lo, hi - scene * 64 AS hi, map_from_entries(list(struct_pack(k := track, v := v) ORDER BY track)) AS m, row_number() OVER (PARTITION BY scene ORDER BY hi - lo DESC, id) AS place FROM val GROUP BY scene, id, lo, hi),
run AS (SELECT scene, 0 AS step, 1 AS budget, list(struct_pack(id := id, lo := lo, hi := hi, m := m, budget := 1, gain := CAST(0 AS DOUBLE))) FILTER (WHERE false) AS picks FROM cand GROUP BY scene UNION ALL
  SELECT scene, step + 1, CASE WHEN ok THEN budget ELSE budget + 1 END, CASE WHEN ok THEN list_append(coalesce(picks, []), struct_pack(id := id, lo := lo, hi := hi, m := m, budget := budget, gain := gain)) ELSE picks END
  FROM (SELECT *, gain >= 0.5 AND open AS ok, row_number() OVER (PARTITION BY scene ORDER BY gain >= 0.5 AND open DESC, round(gain, 12) DESC, place) AS n FROM (
    SELECT run.scene, step, budget, picks, id, lo, hi, m, place, list_sum(list_transform(map_keys(m), lambda t: greatest(m[t] - coalesce(list_max(list_transform(coalesce(picks, []), lambda x: x.m[t])), 0), 0))) AS gain,
      len(list_filter(coalesce(picks, []), lambda x: x.id = cand.id)) = 0 AND list_max(list_transform(range(lo, hi + 1), lambda a: len(list_filter(coalesce(picks, []), lambda x: x.lo <= a AND a <= x.hi)))) < budget AS open
    FROM run JOIN cand ON cand.scene = run.scene WHERE budget <= 3)) WHERE n = 1),
cover AS (SELECT scene, picks FROM run WHERE picks IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scene ORDER BY step DESC) = 1)"""
BLOCKS = "bl AS (SELECT l_orderkey AS i, l_suppkey % 10 AS j, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
SQL = {
    "owner_smallest_wins": f"WITH {M} SELECT id, hyp, size FROM m JOIN hs USING (hyp) QUALIFY row_number() OVER (PARTITION BY id ORDER BY size, hyp) = 1",
    "pack_offsets": f"WITH {M} SELECT hyp, size, CAST(sum(size) OVER (ORDER BY hyp) AS BIGINT) AS offset_end FROM hs",
    "membership_budget": f"WITH {M}, c AS (SELECT id, count(*) AS c FROM m GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS n_points, round(avg(c), 9) AS mean_memb, max(c) AS max_memb, CAST(sum(CAST(c > 5 AS INTEGER)) AS BIGINT) AS over_budget FROM c",
    "dense_reindex": f"WITH {M} SELECT hyp, dense_rank() OVER (PARTITION BY hyp // 1000000 ORDER BY hyp) - 1 AS dense FROM hs WHERE size >= 14",
    "instance_recall_ar": f"""WITH {IOU}, best AS (SELECT gs.gt, coalesce(max(iou), 0) AS iou FROM gs LEFT JOIN ious USING (gt) GROUP BY 1), t AS (SELECT x / 100.0::DOUBLE AS t FROM range(50, 100, 5) r(x)), rec AS (SELECT t, avg(CAST(iou >= t AS INTEGER)) AS r FROM best, t GROUP BY 1)
SELECT round((SELECT avg(r) FROM rec), 9) AS ar, round(avg(CAST(iou >= 0.5 AS INTEGER)), 9) AS r50, round(avg(CAST(iou >= 0.75 AS INTEGER)), 9) AS r75, round(avg(CAST(iou >= 0.9 AS INTEGER)), 9) AS r90, CAST(count(*) AS BIGINT) AS n_gt FROM best""",
    "gt_match_hypotheses": f"WITH {IOU}, b AS (SELECT * FROM ious QUALIFY row_number() OVER (PARTITION BY gt ORDER BY iou DESC, hyp) = 1) SELECT DISTINCT hyp FROM b WHERE iou >= 0.3",
    "seed_topk": "SELECT CAST(year(l_shipdate) AS INTEGER) AS f, CAST(row_number() OVER w AS INTEGER) AS place, l_orderkey, l_linenumber FROM lineitem WINDOW w AS (PARTITION BY year(l_shipdate) ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) QUALIFY place <= 100",
    "class_name_normalize": r"SELECT lower(trim(regexp_replace(p_type, '\s+', ' ', 'g'))) AS name, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT p_type) AS BIGINT) AS spellings FROM part GROUP BY 1",
    "default_lookup": "SELECT coalesce(c_nationkey, -1) AS class, CAST(count(*) AS BIGINT) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey GROUP BY 1",
    "before_after_dashboard": f"WITH {HALVES} SELECT c_nationkey, round(before, 4) AS before, round(after, 4) AS after, round(delta, 4) AS delta, CASE WHEN after IS NULL THEN 'missing' WHEN before IS NULL THEN 'new' WHEN after > before THEN 'up' WHEN after < before THEN 'down' ELSE 'same' END AS status FROM j",
    "comparable_mean": f"WITH {HALVES} SELECT CAST(count(*) AS BIGINT) AS n, round(avg(delta), 4) AS mean_delta FROM j WHERE before IS NOT NULL AND after IS NOT NULL",
    "timing_mean_of_ratios": "SELECT o_orderpriority, round(avg(o_totalprice / (o_custkey + 1)), 4) AS mean_ratio, round(sum(o_totalprice * o_custkey) / sum(o_custkey), 4) AS weighted, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders GROUP BY 1",
    "complete_keys_mean": "WITH p AS (SELECT c_nationkey, o_orderstatus, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT o_orderstatus, round(avg(v), 4) AS mean FROM p GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT c_nationkey) FROM p)",
    "fingerprint_manifest": "SELECT o_orderkey, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus)) AS fingerprint FROM orders",
    "completeness_check": "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(o_orderkey % 3 <> 0 AS INTEGER)) AS BIGINT) AS complete FROM orders GROUP BY 1",
    "scene_list": "SELECT printf('scene%04d_%02d', n_regionkey, n_nationkey) AS scene, CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS INTEGER) AS place FROM nation",
    "block_normal_equations": f"WITH {BLOCKS}, p AS (SELECT a.j AS i, b.j AS j, sum(a.value * b.value) AS value FROM bl a JOIN bl b USING (i) GROUP BY 1, 2) SELECT i, j, round(CASE WHEN i = j THEN value + 1 ELSE value END, 4) AS value FROM p",
    "block_vector_product": f"WITH {BLOCKS} SELECT j AS i, round(sum(value * CAST(o_custkey % 7 AS DOUBLE)), 4) AS value FROM bl JOIN orders ON o_orderkey = i GROUP BY 1",
    "block_sum_and_subset": "WITH l AS (SELECT l_partkey % 20 AS i, l_suppkey % 10 AS j, l_quantity AS v FROM lineitem), u AS (SELECT i, j, v FROM l WHERE j >= 3 UNION ALL SELECT i, j, -v FROM l WHERE i < 5) SELECT j AS i, i AS j, round(sum(v), 4) + 0.0 AS value FROM u GROUP BY 1, 2",
    "image_sizes": """WITH p AS (SELECT p_partkey, p_size * 40 + 100 AS w, CAST(p_partkey % 900 + 64 AS INTEGER) AS h FROM part), s AS (SELECT *, CAST(greatest(1, round_even(w * (512.0::DOUBLE / greatest(w, h)), 0)) AS INTEGER) AS lw, CAST(greatest(1, round_even(h * (512.0::DOUBLE / greatest(w, h)), 0)) AS INTEGER) AS lh FROM p)
SELECT p_partkey, lw, lh, round(500.0::DOUBLE * (lw / w), 6) AS fx, round(510.0::DOUBLE * (lh / h), 6) AS fy, round(w / 2 * (lw / w), 6) AS cx, round(h / 2 * (lh / h), 6) AS cy, CAST(least(trunc(3 / (lw / w)), w - 1) AS INTEGER) AS src FROM s""",
    "depth_codes": "WITH p AS (SELECT p_partkey, p_retailprice / 33 AS m FROM part), q AS (SELECT p_partkey, CAST(CASE WHEN m > 0 AND m <= 65.535 THEN round_even(m * 1000, 0) ELSE 0 END AS INTEGER) AS mm FROM p) SELECT p_partkey, mm, round(CASE WHEN mm > 0 THEN mm / 1000.0::DOUBLE ELSE 0 END, 6) AS back FROM q",
    "schur_solution": """WITH RECURSIVE a AS (SELECT l_partkey % 50 AS i, l_suppkey % 8 AS j, sum(l_quantity / 100) AS value FROM lineitem GROUP BY 1, 2),
h AS (SELECT p.j AS i, q.j AS j, sum(p.value * q.value) AS value FROM a p JOIN a q USING (i) GROUP BY 1, 2), hd AS (SELECT i, j, CASE WHEN i = j THEN value * 2 + 50 ELSE value END AS value FROM h),
cells AS (SELECT 'pose' AS k1, i AS n1, 'pose' AS k2, j AS n2, value FROM hd UNION ALL SELECT 'pose', j, 'disparity', i, value FROM a UNION ALL SELECT 'disparity', i, 'pose', j, value FROM a UNION ALL SELECT 'disparity', i, 'disparity', i, sum(value * value) + 5 FROM a GROUP BY i
  UNION ALL SELECT 'pose', i, 'right', 0, avg(value) FROM hd GROUP BY i UNION ALL SELECT 'disparity', i, 'right', 0, sum(value) FROM a GROUP BY i),
names AS (SELECT kind, i, row_number() OVER (ORDER BY kind, i) AS pos FROM (SELECT DISTINCT k1 AS kind, n1 AS i FROM cells)), places AS (SELECT * FROM names UNION ALL SELECT 'right', 0, (SELECT max(pos) + 1 FROM names)),
grid AS (SELECT p.pos AS r, q.pos AS c, coalesce(any_value(value), 0) AS value FROM names p CROSS JOIN places q LEFT JOIN cells ON k1 = p.kind AND n1 = p.i AND k2 = q.kind AND n2 = q.i GROUP BY 1, 2),
run AS (SELECT 1::BIGINT AS k, list(line ORDER BY r) AS m FROM (SELECT r, list(CAST(value AS DOUBLE) ORDER BY c) AS line FROM grid GROUP BY r) UNION ALL
  SELECT k + 1, list_transform(m, lambda line, r: CASE WHEN r = k THEN line ELSE list_transform(line, lambda x, c: x - line[k] / m[k][k] * m[k][c]) END) FROM run WHERE k <= len(m)),
last AS (SELECT m FROM run ORDER BY k DESC LIMIT 1) SELECT kind, i, round(m[pos][len(m) + 1] / m[pos][pos], 6) AS value FROM names, last""",
    "constrained_components": f"""WITH RECURSIVE {TRACKS}, both_ways AS (SELECT track, track2, iou, chunk2 FROM ious WHERE iou >= 0.8 AND chunk <> chunk2 UNION ALL SELECT track2, track, iou, chunk FROM ious WHERE iou >= 0.8 AND chunk <> chunk2),
best AS (SELECT *, row_number() OVER w AS r, lead(iou, 1, 0.0) OVER w AS nxt FROM both_ways WINDOW w AS (PARTITION BY track, chunk2 ORDER BY iou DESC, track2) QUALIFY r = 1),
links AS (SELECT a.track, a.track2, row_number() OVER (ORDER BY a.iou DESC, a.track DESC, a.track2 DESC) AS n FROM best a JOIN best b ON a.track = b.track2 AND a.track2 = b.track WHERE a.track < a.track2 AND a.iou >= 1.2 * a.nxt AND a.iou >= 1.2 * b.nxt),
ends AS (SELECT track AS t FROM links UNION SELECT track2 FROM links),
run AS (SELECT CAST(0 AS BIGINT) AS n, list(struct_pack(t := t, chunk := t // 1000000000, comp := t)) AS s FROM ends UNION ALL
  SELECT n, CASE WHEN ca = cb OR list_has_any(list_transform(list_filter(s, lambda x: x.comp = ca), lambda x: x.chunk), list_transform(list_filter(s, lambda x: x.comp = cb), lambda x: x.chunk)) THEN s
    ELSE list_transform(s, lambda x: struct_pack(t := x.t, chunk := x.chunk, comp := CASE WHEN x.comp = greatest(ca, cb) THEN least(ca, cb) ELSE x.comp END)) END
  FROM (SELECT links.n, s, list_filter(s, lambda x: x.t = links.track)[1].comp AS ca, list_filter(s, lambda x: x.t = links.track2)[1].comp AS cb FROM run JOIN links ON links.n = run.n + 1))
SELECT x.t AS track, x.comp AS component FROM (SELECT unnest(s) AS x FROM (SELECT s FROM run ORDER BY n DESC LIMIT 1))""",
    "lazy_greedy_cover": f"WITH RECURSIVE {COVER} SELECT scene, n - 1 AS place, x.id AS node, CAST(x.budget AS BIGINT) AS budget, round(x.gain, 9) AS gain FROM (SELECT scene, unnest(picks) AS x, generate_subscripts(picks, 1) AS n FROM cover)",
    "ancestor_exchange": f"""WITH RECURSIVE {COVER}, held AS (SELECT scene, id, lo - scene * 64 AS lo, hi - scene * 64 AS hi, map_from_entries(list(struct_pack(k := mask, v := phi) ORDER BY mask)) AS m, row_number() OVER (PARTITION BY scene ORDER BY lo - hi, id) AS place, count(*) OVER (PARTITION BY scene) AS many FROM scored GROUP BY scene, id, lo, hi),
swap AS (SELECT c.scene, CAST(0 AS BIGINT) AS step, list(struct_pack(id := h.id, lo := h.lo, hi := h.hi, m := h.m, mem := [h.id])) AS s FROM (SELECT scene, unnest(picks).id AS id FROM cover) c JOIN held h ON h.scene = c.scene AND h.id = c.id GROUP BY c.scene UNION ALL
  SELECT scene, step, CASE WHEN len(below) >= 2 AND list_max(list_transform(range(lo, hi + 1), lambda a: len(list_filter(beside, lambda x: x.lo <= a AND a <= x.hi)))) + 1 <= 3
    AND list_sum(list_transform(masks, lambda k: greatest(coalesce(list_max(list_transform(s, lambda x: x.m[k])), 0), 0) - greatest(coalesce(list_max(list_transform(beside, lambda x: x.m[k])), 0), coalesce(m[k], 0)))) <= 1e-12
    THEN list_append(beside, struct_pack(id := id, lo := lo, hi := hi, m := m, mem := flatten(list_transform(below, lambda x: x.mem)))) ELSE s END
  FROM (SELECT *, list_distinct(list_concat(map_keys(m), flatten(list_transform(below, lambda x: map_keys(x.m))))) AS masks FROM (
    SELECT h.scene, swap.step + 1 AS step, s, h.id, h.lo, h.hi, h.m, list_filter(s, lambda x: h.lo <= x.lo AND x.hi <= h.hi) AS below, list_filter(s, lambda x: NOT (h.lo <= x.lo AND x.hi <= h.hi)) AS beside
    FROM swap JOIN held h ON h.scene = swap.scene AND h.place = swap.step % h.many + 1 WHERE swap.step < 3 * h.many))),
last AS (SELECT scene, s FROM swap QUALIFY row_number() OVER (PARTITION BY scene ORDER BY step DESC) = 1)
SELECT scene, unnest(x.mem) AS node, x.id AS stand FROM (SELECT scene, unnest(s) AS x FROM last)""",
}
