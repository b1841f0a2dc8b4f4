"""Queries on mask and frame evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.operators import evidence as ev
from terrazzo.operators import graph
from terrazzo.operators.common import settled
from terrazzo.plans import proxies as px

NODE, MASK = ev.NODE, ev.MASK


def r(name: str, digits: int = 9):
    return F.round(name, digits).alias(name)


def _rows(spark, d) -> DataFrame:
    return ev.node_evidence(px.members(spark, d), px.leaf_i(spark, d), px.leaf_n(spark, d))


def _affinity(spark, d) -> DataFrame:
    return ev.affinity(px.part_edges(spark, d), px.leaf_i(spark, d), px.leaf_n(spark, d))


def _intervals(df: DataFrame) -> DataFrame:
    """id, lo, hi of a node; the id orders by level, then place."""
    width = F.pow(F.lit(2.0), F.col("lvl")).cast("long")
    return df.withColumns({"id": F.col("lvl") * F.lit(10**12) + F.col("node"), "lo": F.col("node") * width, "hi": (F.col("node") + 1) * width - 1})


def leaf_visible_counts(spark, d):
    return px.leaf_n(spark, d)


def leaf_claimed_counts(spark, d):
    return px.leaf_i(spark, d)


def node_evidence_best_mask(spark, d):
    return ev.best_masks(_rows(spark, d)).select(*NODE, "f", *MASK, r("iou"), r("cov"), r("pur"))


def node_mean_iou(spark, d):
    best = ev.best_masks(_rows(spark, d))
    return best.groupBy(*NODE).agg(F.round(F.avg("iou"), 9).alias("d"), F.count(F.lit(1)).alias("frames"))


def coverage_rows(spark, d):
    return ev.covering(_rows(spark, d)).select(*NODE, "f", *MASK, "i", "n", "q")


def affinity_edges(spark, d):
    return _affinity(spark, d).select("a", "b", r("num"), "w")


def must_link_edges(spark, d):
    return ev.must_link(_affinity(spark, d), 0.98, 5).select("a", "b", r("affinity"), "w")


def must_link_atoms(spark, d):
    """Contraction: must-linked parts become one atom, and the visible counts are summed again."""
    links = ev.must_link(_affinity(spark, d), 0.98, 5)
    joined = graph.components(links)
    n = px.leaf_n(spark, d).join(joined, F.col("atom") == F.col("node"), "left").select(F.coalesce("component", "atom").alias("atom"), "f", "n")
    return ev.sum_by(n, "atom", "f", value="n")


def beta_prior_gain(spark, d):
    regions = px.members(spark, d).where("lvl = 3").select("atom", F.col("node").alias("region"))
    return ev.border_gain(settled(_affinity(spark, d)), regions).select("ra", "rb", r("gain"))


def tree_rollup_evidence(spark, d):
    orders, customer, nation = (px.table(spark, d, t) for t in ("orders", "customer", "nation"))
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    rows = counts.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    out = rows.rollup("n_regionkey", "n_nationkey", "c_custkey").agg(F.sum("n").alias("n_orders"), F.sum("total").alias("total"))
    return out.select("n_regionkey", "n_nationkey", "c_custkey", "n_orders", F.round(F.col("total").cast("double"), 2).alias("total"))


def tree_interval_sums(spark, d):
    """The same sums by intervals: each leaf meets the nodes whose interval holds it, by bins."""
    nodes = _intervals(px.members(spark, d).select(*NODE).distinct())
    sums = px.leaf_n(spark, d).groupBy("atom").agg(F.sum("n").alias("n"))
    levels = F.explode(F.array(*[F.lit(x) for x in range(2, 7)]))
    binned = sums.withColumn("lvl", levels).withColumn("lo", F.floor(F.col("atom") / F.pow(F.lit(2.0), F.col("lvl"))) * F.pow(F.lit(2.0), F.col("lvl")).cast("long"))
    return nodes.join(binned.select("lvl", "lo", "n"), ["lvl", "lo"]).groupBy(*NODE, "lo", "hi").agg(F.sum("n").alias("n"))


def chain_collapse(spark, d):
    sizes = ev.sums_up(px.members(spark, d), ev.sum_by(px.leaf_n(spark, d), "atom", value="n"), value="n").withColumnRenamed("n", "size")
    return graph.collapse_chains(_intervals(sizes), 0.53).select("id", "rep")


def phi_scores(spark, d):
    return ev.phi(_rows(spark, d)).select(*NODE, "f", *MASK, r("weight"), r("phi"))


def client_phi_mean(spark, d):
    rows = _rows(spark, d)
    tracks = px.leaf_i(spark, d).select("f", *MASK).distinct().withColumn("track", F.col("g") * F.lit(10**9).cast("long") + F.col("seg"))
    eligible = ev.sums_up(px.members(spark, d), px.leaf_n(spark, d), "f", value="n")
    size = eligible.groupBy(*NODE).agg(F.sum("n").alias("size"))
    eligible = eligible.join(size, NODE).where(F.col("n") >= F.greatest(F.lit(8.0), F.col("size") * 0.05))
    return ev.client_means(ev.phi(rows), tracks, eligible).select(*NODE, "track", r("value"))


def _votes(spark, d) -> DataFrame:
    return ev.co_mask_votes(_intervals(_rows(spark, d)))


def co_mask_pairs(spark, d):
    return ev.best_votes(_votes(spark, d)).select("id", "id2", r("joins"), "frames")


def _eligible_ids(spark, d) -> DataFrame:
    return _intervals(_rows(spark, d).select(*NODE, "f").distinct()).select("id", "f")


def co_eligible_frames(spark, d):
    return ev.co_eligible(ev.best_votes(_votes(spark, d)), _eligible_ids(spark, d))


def _kn(spark, d) -> DataFrame:
    votes = ev.best_votes(_votes(spark, d))
    co = ev.co_eligible(votes, _eligible_ids(spark, d))
    return votes.join(co.hint("merge"), ["id", "id2"]).select("id", "id2", F.col("joins").alias("k"), (F.col("joins") + F.greatest(F.col("n_co") - F.col("frames"), F.lit(0))).alias("n"))


def join_llr_em(spark, d):
    pairs = settled(_kn(spark, d))  # the mixture and the costs read it
    p_s, p_d, _ = ev.mixture(pairs)
    return pairs.select("id", "id2", F.round(ev.log_likelihood_ratio(p_s, p_d), 4).alias("cost"))


def track_pair_proposals(spark, d):
    rows = ev.phi(_intervals(_rows(spark, d))).select((F.col("g") * F.lit(10**9).cast("long") + F.col("seg")).alias("track"), "id", "lo", "hi", F.round("phi", 9).alias("s"))
    return ev.track_proposals(rows, ev.best_votes(_votes(spark, d)))


def _tracks(spark, d) -> DataFrame:
    return px.memberships(spark, d).select((F.col("f") * F.lit(10**9).cast("long") + F.col("seg")).alias("track"), F.col("id").alias("atom"), F.col("f").alias("chunk"))


def set_iou_pairs(spark, d):
    return ev.set_overlaps(_tracks(spark, d)).select("track", "track2", "inter", r("iou"))


def mutual_best_links(spark, d):
    tracks = _tracks(spark, d)
    return ev.mutual_best(ev.similar_sets(tracks), tracks.select("track", "chunk").distinct()).select("track", "track2", r("iou"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k != "r"}

IDS = "CAST(lvl AS BIGINT) * 1000000000000 + node AS id, node * CAST(pow(2, lvl) AS BIGINT) AS lo, (node + 1) * CAST(pow(2, lvl) AS BIGINT) - 1 AS hi"
VOTES = px.EVIDENCE + f""",
idr AS (SELECT *, {IDS} FROM rows),
ranked AS (SELECT *, row_number() OVER (PARTITION BY f, g, seg ORDER BY pur DESC, id) AS r FROM idr QUALIFY row_number() OVER (PARTITION BY f, g, seg ORDER BY pur DESC, id) <= 100),
pairs AS (SELECT x.id AS xid, y.id AS yid, x.f, x.q, x.i + y.i AS i, x.n + y.n AS n, x.pur + y.pur AS pp FROM ranked x JOIN ranked y ON x.f = y.f AND x.g = y.g AND x.seg = y.seg AND x.r < y.r
  WHERE x.pur + y.pur >= pow(0.05, 0.5) AND NOT (x.lo <= y.lo AND y.hi <= x.hi OR y.lo <= x.lo AND x.hi <= y.hi)),
weighed AS (SELECT *, pow(CAST(i AS DOUBLE) / n, 2.0) * pow(least(pp, 1.0), 2.0) AS weight FROM pairs),
votes AS (SELECT least(xid, yid) AS id, greatest(xid, yid) AS id2, f, weight * (CAST(i AS DOUBLE) / (q + n - i)) AS vote FROM weighed WHERE weight >= 0.05),
best AS (SELECT id, id2, f, max(vote) AS vote FROM votes GROUP BY 1, 2, 3),
joined AS (SELECT id, id2, sum(vote) AS joins, CAST(count(*) AS BIGINT) AS frames FROM best GROUP BY 1, 2),
elig AS (SELECT DISTINCT id, f FROM idr),
co AS (SELECT j.id, j.id2, CAST(count(b.f) AS BIGINT) AS n_co FROM joined j LEFT JOIN elig a ON a.id = j.id LEFT JOIN elig b ON b.id = j.id2 AND b.f = a.f GROUP BY 1, 2),
kn AS (SELECT id, id2, joins AS k, joins + greatest(n_co - frames, 0) AS n FROM joined JOIN co USING (id, id2))"""
TRACKS = px.MEMBERSHIPS + """,
tracks AS (SELECT CAST(f AS BIGINT) * 1000000000 + seg AS track, f AS chunk, id AS atom FROM memb),
sizes AS (SELECT track, chunk, CAST(count(*) AS BIGINT) AS size FROM tracks GROUP BY 1, 2),
ov AS (SELECT a.track, b.track AS track2, CAST(count(*) AS BIGINT) AS inter FROM tracks a JOIN tracks b ON a.atom = b.atom AND a.track < b.track GROUP BY 1, 2),
ious AS (SELECT ov.track, ov.track2, inter, CAST(inter AS DOUBLE) / (s.size + t.size - inter) AS iou, s.chunk, t.chunk AS chunk2 FROM ov JOIN sizes s ON s.track = ov.track JOIN sizes t ON t.track = ov.track2)"""
SQL = {
    "leaf_visible_counts": f"WITH {px.LEAF_N} SELECT * FROM leaf_n",
    "leaf_claimed_counts": f"WITH {px.LEAF_I} SELECT atom, f, g, seg, cnt FROM leaf_i",
    "node_evidence_best_mask": f"WITH {px.EVIDENCE} SELECT lvl, node, f, g, seg, round(iou, 9) AS iou, round(cov, 9) AS cov, round(pur, 9) AS pur FROM rows QUALIFY row_number() OVER (PARTITION BY lvl, node, f ORDER BY iou DESC, g, seg) = 1",
    "node_mean_iou": f"WITH {px.EVIDENCE}, best AS (SELECT lvl, node, f, max(iou) AS iou FROM rows GROUP BY 1, 2, 3) SELECT lvl, node, round(avg(iou), 9) AS d, CAST(count(*) AS BIGINT) AS frames FROM best GROUP BY 1, 2",
    "coverage_rows": f"WITH {px.EVIDENCE} SELECT lvl, node, f, g, seg, i, n, q FROM rows WHERE i >= 0.5 * n",
    "affinity_edges": f"WITH {px.AFFINITY} SELECT a, b, round(num, 9) AS num, w FROM aff",
    "must_link_edges": f"WITH {px.AFFINITY} SELECT a, b, round(num / w, 9) AS affinity, w FROM aff WHERE num / w >= 0.98 AND w >= 5",
    "must_link_atoms": f"""WITH {px.AFFINITY}, ml AS (SELECT a, b FROM aff WHERE num / w >= 0.98 AND w >= 5),
chain AS (SELECT p_partkey AS atom, p_partkey - row_number() OVER (ORDER BY p_partkey) AS z, p_partkey IN (SELECT b FROM ml) AS linked FROM part),
start AS (SELECT atom, max(CASE WHEN NOT linked THEN atom END) OVER (ORDER BY atom ROWS UNBOUNDED PRECEDING) AS root FROM chain)
SELECT coalesce(root, leaf_n.atom) AS atom, f, CAST(sum(n) AS BIGINT) AS n FROM leaf_n LEFT JOIN start USING (atom) GROUP BY 1, 2""",
    "beta_prior_gain": f"""WITH {px.AFFINITY}, m AS (SELECT avg(num / w) AS mu, var_pop(num / w) + 1e-12 AS v FROM aff), k AS (SELECT mu, greatest(mu * (1 - mu) / v - 1, 1e-3) AS k FROM m),
prior AS (SELECT mu * k AS a0, (1 - mu) * k AS b0 FROM k),
border AS (SELECT CAST(floor(a / 8.0) AS BIGINT) AS ra, CAST(floor(b / 8.0) AS BIGINT) AS rb, sum(num) AS num, sum(w) AS w FROM aff WHERE floor(a / 8.0) <> floor(b / 8.0) GROUP BY 1, 2)
SELECT least(ra, rb) AS ra, greatest(ra, rb) AS rb, round((a0 + num) / (a0 + b0 + w), 9) AS gain FROM border, prior""",
    "tree_rollup_evidence": """SELECT n_regionkey, n_nationkey, c_custkey, CAST(count(*) AS BIGINT) AS n_orders, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey, c_custkey)""",
    "tree_interval_sums": f"WITH {px.LEAF_N}, {px.MEMBERS} SELECT lvl, node, node * CAST(pow(2, lvl) AS BIGINT) AS lo, (node + 1) * CAST(pow(2, lvl) AS BIGINT) - 1 AS hi, CAST(sum(n) AS BIGINT) AS n FROM members JOIN leaf_n USING (atom) GROUP BY 1, 2",
    "chain_collapse": f"""WITH RECURSIVE {px.LEAF_N}, {px.MEMBERS}, s AS (SELECT lvl, node, CAST(sum(n) AS BIGINT) AS size FROM members JOIN leaf_n USING (atom) GROUP BY 1, 2),
up AS (SELECT c.lvl, c.node FROM s c JOIN s p ON p.lvl = c.lvl + 1 AND p.node = c.node // 2 WHERE c.size >= 0.53 * p.size),
walk AS (SELECT lvl, node, lvl AS l, node AS n FROM s UNION ALL SELECT w.lvl, w.node, w.l + 1, w.n // 2 FROM walk w JOIN up ON up.lvl = w.l AND up.node = w.n)
SELECT CAST(lvl AS BIGINT) * 1000000000000 + node AS id, CAST(max(l) AS BIGINT) * 1000000000000 + arg_max(n, l) AS rep FROM walk GROUP BY lvl, node""",
    "phi_scores": f"WITH {px.EVIDENCE} SELECT lvl, node, f, g, seg, round(weight, 9) AS weight, round(phi, 9) AS phi FROM phis",
    "client_phi_mean": f"""WITH {px.EVIDENCE}, tr AS (SELECT DISTINCT f, g, seg, CAST(g AS BIGINT) * 1000000000 + seg AS track FROM leaf_i),
top AS (SELECT lvl, node, track, sum(phi) AS total FROM phis JOIN tr USING (f, g, seg) GROUP BY 1, 2, 3),
den AS (SELECT lvl, node, track, count(*) AS den FROM seen JOIN tr USING (f) GROUP BY 1, 2, 3)
SELECT lvl, node, track, round(total / greatest(coalesce(den, 0), 1), 9) AS value FROM top LEFT JOIN den USING (lvl, node, track)""",
    "co_mask_pairs": f"WITH {VOTES} SELECT id, id2, round(joins, 9) AS joins, frames FROM joined",
    "co_eligible_frames": f"WITH {VOTES} SELECT id, id2, n_co FROM co",
    "join_llr_em": f"""WITH RECURSIVE {VOTES}, kns AS (SELECT list(k ORDER BY id, id2) AS ks, list(n ORDER BY id, id2) AS ns FROM kn),
em AS (SELECT 0 AS it, 0.5::DOUBLE AS ps, 0.02::DOUBLE AS pd, 0.1::DOUBLE AS pi UNION ALL
  SELECT it + 1, least(greatest(sk / greatest(sn, 1e-9), 1e-3), 1 - 1e-3), least(greatest(dk / greatest(dn, 1e-9), 1e-4), 1 - 1e-4), least(greatest(m, 1e-12), 1 - 1e-12) FROM (
    SELECT it, avg(g) AS m, sum(g * k) AS sk, sum(g * n) AS sn, sum((1 - g) * k) AS dk, sum((1 - g) * n) AS dn FROM (
      SELECT it, k, n, 1 / (1 + exp(least(greatest((ln(1 - pi) + k * ln(pd) + (n - k) * ln(1 - pd)) - (ln(pi) + k * ln(ps) + (n - k) * ln(1 - ps)), -50), 50))) AS g
      FROM (SELECT it, ps, pd, pi, unnest(ks) AS k, unnest(ns) AS n FROM em, kns WHERE it < 50)) GROUP BY it))
SELECT id, id2, round(k * ln(greatest(ps, pd) / least(ps, pd)) + (n - k) * ln((1 - greatest(ps, pd)) / (1 - least(ps, pd))), 4) AS cost FROM kn, em WHERE it = 50""",
    "track_pair_proposals": f"""WITH {VOTES}, st AS (SELECT CAST(g AS BIGINT) * 1000000000 + seg AS track, {IDS}, max(round(phi, 9)) AS s FROM phis GROUP BY 1, 2, 3, 4),
top AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY track ORDER BY s DESC, id) <= 100)
SELECT DISTINCT x.id, y.id AS id2 FROM top x JOIN top y ON x.track = y.track AND x.id < y.id WHERE NOT (x.lo <= y.lo AND y.hi <= x.hi OR y.lo <= x.lo AND x.hi <= y.hi)
AND NOT EXISTS (SELECT 1 FROM joined j WHERE j.id = x.id AND j.id2 = y.id)""",
    "set_iou_pairs": f"WITH {TRACKS} SELECT track, track2, inter, round(iou, 9) AS iou FROM ious",
    "mutual_best_links": f"""WITH {TRACKS}, both_ways AS (SELECT track, track2, iou, chunk2 FROM ious WHERE iou >= 0.8 AND chunk <> chunk2 UNION ALL SELECT track2, track, iou, chunk FROM ious WHERE iou >= 0.8 AND chunk <> chunk2),
best AS (SELECT *, row_number() OVER w AS r, lead(iou, 1, 0.0) OVER w AS nxt FROM both_ways WINDOW w AS (PARTITION BY track, chunk2 ORDER BY iou DESC, track2) QUALIFY r = 1)
SELECT a.track, a.track2, round(a.iou, 9) AS iou FROM best a JOIN best b ON a.track = b.track2 AND a.track2 = b.track WHERE a.track < a.track2 AND a.iou >= 1.2 * a.nxt AND a.iou >= 1.2 * b.nxt""",
}
