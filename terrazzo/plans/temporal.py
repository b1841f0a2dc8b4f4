"""Queries on streams of events, and metrics over them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.functions import geometry as geo
from terrazzo.operators import metrics, poses, slam, temporal
from terrazzo.operators.spatial import distance2
from terrazzo.plans import proxies as px
from terrazzo.plans.evidence import r

HOURS = 3_600_000_000


def asof_nearest_sync(spark, d):
    rows = px.stream(spark, d)
    left, right = (rows.where(F.col("event_type") == t).select("u", "t", "id") for t in ("purchase", "click"))
    return temporal.asof_nearest(left, right, "u", 6 * HOURS)


def bracket_keyframes(spark, d):
    rows = temporal.bracket(px.stream(spark, d), "u", F.col("event_type") == "purchase")
    return rows.select("id", "left_id", "right_id", F.round(temporal.interpolated(), 6).alias("v"))


def prefix_latest(spark, d):
    """The last purchase at or before each event."""
    w = Window.partitionBy("u").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    return px.stream(spark, d).select("id", F.last(F.when(F.col("event_type") == "purchase", F.col("id")), ignorenulls=True).over(w).alias("last_id"))


def first_row_alignment(spark, d):
    """Every value relative to its user's first."""
    w = Window.partitionBy("u").orderBy("t", "id")
    return px.stream(spark, d).select("id", F.round(F.col("v") - F.first("v").over(w), 6).alias("v"))


def frame_steps(spark, d):
    w = Window.partitionBy("u").orderBy("t", "id")
    return px.stream(spark, d).select("id", (F.col("t") - F.lag("t").over(w)).alias("dt"), F.round(F.col("v") - F.lag("v").over(w), 6).alias("dv")).where("dt is not null")


def subsample_index(spark, d):
    counts = px.stream(spark, d).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    return temporal.subsample_indices(counts, 30.0, 12.0)


def subsample_timestamp(spark, d):
    """Each user's distinct times, as ns, brought down to half their median rate."""
    rows = px.stream(spark, d).select("u", (F.col("t") * 1000).alias("ns")).distinct()

    def keep(pdf: pd.DataFrame) -> pd.Series:
        gaps = pdf.ns.diff().dropna()
        return pd.Series([True] * len(pdf)) if len(pdf) < 2 else temporal.keep_ticks("ns", 0.5e9 / gaps.median())(pdf)

    return temporal.scan_groups(rows, "u", ["ns"], keep)


def motion_coreset(spark, d):
    return temporal.scan_groups(px.stream(spark, d).select("u", "t", "id", "v"), "u", ["t", "id"], temporal.keep_moved("v", 50.0)).select("id")


def keyframe_gap_filter(spark, d):
    return temporal.scan_groups(px.stream(spark, d).select("u", "t", "id", "v"), "u", ["t", "id"], temporal.keep_keyframes("v", 60.0, 4)).select("id")


def run_lengths(spark, d):
    return temporal.runs(px.stream(spark, d), "u", F.col("event_type") == "error").select("u", F.col("run").cast("long").alias("run"), "first_id", "length", "flag")


def jump_report(spark, d):
    return temporal.jumps(px.stream(spark, d), "u", 0.35, 0.9, 2.0).select("u", "n_gaps", r("threshold", 6), "n_jumps", "worst_id")


def median_rate(spark, d):
    return temporal.median_rate(px.stream(spark, d), "u").select("u", r("rate"))


def chunk_of_eight(spark, d):
    rows = temporal.chunks(px.stream(spark, d), "u", 8)
    sizes = rows.groupBy("u", "chunk").agg(F.count(F.lit(1)).alias("frames"), F.sum((F.col("event_type") == "click").cast("long")).alias("seeds"))
    return temporal.first_ids(sizes, "u", "chunk", "seeds").select("u", "chunk", "frames", "seeds", F.col("first_id").cast("long").alias("first_id"))


def factor_age_budget(spark, d):
    """Events as edges of their user; the age is the number of later events of the same type."""
    w = Window.partitionBy("u", "event_type").orderBy(F.desc("t"), F.desc("id"))
    edges = px.stream(spark, d).select("u", "id", (F.row_number().over(w) - 1).alias("age"), F.col("id").alias("index"))
    return temporal.drop_oldest(edges, "u", 6).select("id")


def voxel_running_mean(spark, d):
    rows = px.stream(spark, d).select(F.floor(F.col("t") / HOURS).alias("hour"), "v")
    return rows.groupBy("hour").agg(F.round(F.avg("v"), 6).alias("tsdf"), F.count(F.lit(1)).alias("weight"))


def scatter_reductions(spark, d):
    """Sum, product, mean, floor mean of integers, min, max and their arguments by index; ties to the lowest id."""
    rows = px.stream(spark, d)
    key = F.struct(F.col("v"), -F.col("id"))
    return rows.groupBy("u").agg(F.round(F.sum("v"), 6).alias("total"), F.round(F.product(1 + F.col("v") / 1e6), 6).alias("product"), F.round(F.avg("v"), 6).alias("mean"), F.floor(F.sum("id") / F.count("id")).alias("id_mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.min(F.struct("v", "id"))["id"].alias("argmin"), (-F.max(key)["col2"]).alias("argmax"))


def _errors(spark, d) -> DataFrame:
    """Every two events of a user as two frames of a scene: how far their values are apart."""
    rows = px.stream(spark, d).select(F.col("u").alias("scene"), F.col("id").alias("frame"), F.col("v").alias("p"), F.lit(0).alias("g"))
    return poses.frame_pairs(rows).select(F.abs(F.col("p") - F.col("p2")).alias("e"))


def pose_auc_hist(spark, d):
    return metrics.pose_auc(_errors(spark, d)).select("threshold", r("auc"))


def _pairs(spark, d) -> DataFrame:
    return px.stream(spark, d).select("u", "t", "id", F.col("v").alias("p"), (F.col("id") % 100).cast("double").alias("g"))


def ate_rmse(spark, d):
    return metrics.aligned_rmse(_pairs(spark, d), "u").select("u", r("rmse", 6))


def scale_diagnostic(spark, d):
    return metrics.scale_diagnostic(_pairs(spark, d), "u").select("u", r("scale", 6))


def psnr_by_group(spark, d):
    return px.stream(spark, d).groupBy("event_type").agg(F.round(metrics.psnr(F.avg((F.col("v") - 50) * (F.col("v") - 50))), 6).alias("psnr"))


def huber_weights(spark, d):
    return px.stream(spark, d).select("id", F.round(geo.huber((F.col("v") - 50) / 10, 1.5), 9).alias("w"))


def disparity_steps(spark, d):
    """Retraction of a disparity by a step, voided beyond 10 and kept above 1e-3."""
    return px.stream(spark, d).select("id", F.round(geo.retract_disparity(F.col("v") / 100, (F.col("id") % 25 - 12).cast("double")), 9).alias("disparity"))


def id_set_ops(spark, d):
    rows = px.stream(spark, d)
    buy, click = (rows.where(F.col("event_type") == t).select("u").distinct() for t in ("purchase", "click"))
    sets = {"union": buy.union(click).distinct(), "intersect": buy.intersect(click), "minus": buy.exceptAll(click), "reverse": click.exceptAll(buy)}
    out = None
    for name, s in sets.items():
        one = s.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("u"), F.lit(0).cast("long")).alias("total")).withColumn("op", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def neighbourhood_edges(spark, d):
    frames = temporal.chunks(px.stream(spark, d), "u", 1).select("u", F.col("chunk").alias("i"))
    return slam.neighbourhood_edges(frames, "u", 2)


def proximity_order(spark, d):
    points = px.points(spark, d).select("id", "x", "y", "z")
    step = F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)]))
    pairs = points.withColumn("s", step).withColumn("j", F.col("id") + F.col("s")).drop("s").join(points.select(F.col("id").alias("j"), *[F.col(c).alias(f"{c}2") for c in "xyz"]), "j").withColumnRenamed("id", "i")
    pairs = pairs.withColumn("dist", F.sqrt(distance2())).withColumn("grp", F.col("i") % 16)
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(*slam.proximity_order(pairs, 1_000_000)))).select("i", "j", "place")


def factor_edges(spark, d):
    """Scenes of 32 successive events of a user: values as places, proximity edges with suppression and a budget."""
    rows = temporal.chunks(px.stream(spark, d).where("u is not null"), "u", 1).select("u", F.floor(F.col("chunk") / 32).alias("part"), (F.col("chunk") % 32).alias("i"), "v")
    # at most 32 rows a scene, which lie together by user already
    scenes = rows.groupBy("u", "part").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("frames"))
    return slam.sequence_edges(scenes.select((F.col("u") * 2**20 + F.col("part")).alias("scene"), F.col("frames.v").alias("values")), 1, 20.0, 2, 200)


def merge_last_wins(spark, d):
    """The last payload of each user and type."""
    rows = px.stream(spark, d).withColumn("k", F.concat_ws("/", F.col("u").cast("string"), "event_type"))
    return poses.merge_last(rows, "k", "t").select("k", "id", r("v", 6))


def contiguous_frames(spark, d):
    return poses.reindexed(px.stream(spark, d).where("event_type <> 'error'").withColumn("o", F.struct("t", "id")), "u", "o").select("u", "id", "index")


def reprojection(spark, d):
    """Pixels and disparities from values, seen from half a unit to the left and a little ahead."""
    pose = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0.5, 0, 1, 0, 0, 0, 0, 1, -0.1, 0, 0, 0, 1)])
    rows = px.stream(spark, d).select("id", (F.col("id") % 64).cast("double").alias("u"), (F.col("u") % 48).cast("double").alias("v"), (F.abs("v") / 10 + 0.01).alias("disparity"), pose.alias("relative"))
    return poses.reproject(rows, (60.0, 60.0, 32.0, 24.0)).select("id", F.round("u2", 6).alias("u2"), F.round("v2", 6).alias("v2"), F.round("d2", 6).alias("d2"), "valid")


def frame_distance(spark, d):
    rows = px.stream(spark, d).select((F.col("u") % 20).alias("i"), ((F.col("u") / 20).cast("long") % 20).alias("j"), F.col("v").alias("full"), (F.col("v") / 2).alias("shift"), (F.col("event_type") != "error").alias("valid"))
    return slam.frame_distances(rows).select("i", "j", r("dist", 6))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

ORDERED = px.STREAM + ", o AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t, id) AS n FROM stream)"
SQL = {
    "asof_nearest_sync": f"""WITH {px.STREAM}, c AS (SELECT u, t, max(id) AS id2 FROM stream WHERE event_type = 'click' GROUP BY 1, 2)
SELECT id, id2, dt FROM (SELECT p.id, c.id2, abs(c.t - p.t) AS dt, row_number() OVER (PARTITION BY p.id ORDER BY abs(c.t - p.t), c.t DESC) AS r FROM stream p JOIN c ON c.u = p.u WHERE p.event_type = 'purchase' AND abs(c.t - p.t) <= {6 * HOURS}) WHERE r = 1""",
    "bracket_keyframes": f"""WITH {ORDERED}, k AS (SELECT * FROM o WHERE event_type = 'purchase'),
b AS (SELECT o.id, o.t, (SELECT max(n) FROM k WHERE k.u = o.u AND k.n < o.n) AS ln, (SELECT min(n) FROM k WHERE k.u = o.u AND k.n > o.n) AS rn, o.u FROM o WHERE event_type <> 'purchase')
SELECT b.id, l.id AS left_id, q.id AS right_id, round(l.v + (q.v - l.v) * ((b.t - l.t) / ((q.t - l.t) + 1e-3::DOUBLE)), 6) AS v FROM b JOIN k l ON l.u = b.u AND l.n = coalesce(ln, rn) JOIN k q ON q.u = b.u AND q.n = coalesce(rn, ln)""",
    "prefix_latest": f"WITH {px.STREAM} SELECT id, last_value(CASE WHEN event_type = 'purchase' THEN id END IGNORE NULLS) OVER (PARTITION BY u ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS last_id FROM stream",
    "first_row_alignment": f"WITH {px.STREAM} SELECT id, round(v - first_value(v) OVER (PARTITION BY u ORDER BY t, id), 6) AS v FROM stream",
    "frame_steps": f"WITH {px.STREAM}, s AS (SELECT id, t - lag(t) OVER w AS dt, round(v - lag(v) OVER w, 6) AS dv FROM stream WINDOW w AS (PARTITION BY u ORDER BY t, id)) SELECT * FROM s WHERE dt IS NOT NULL",
    "subsample_index": f"WITH {px.STREAM}, c AS (SELECT u, count(*) AS n FROM stream GROUP BY 1) SELECT u, i, CAST(floor(i * 2.5::DOUBLE + 1e-9) AS BIGINT) AS source_index FROM c, range(0, 100000) r(i) WHERE i <= n AND floor(i * 2.5::DOUBLE + 1e-9) < n",
    "motion_coreset": f"""WITH RECURSIVE {ORDERED}, w AS (SELECT u, n, id, v AS kept, true AS k FROM o WHERE n = 1 UNION ALL
SELECT o.u, o.n, o.id, CASE WHEN abs(o.v - w.kept) > 50 THEN o.v ELSE w.kept END, abs(o.v - w.kept) > 50 FROM w JOIN o ON o.u = w.u AND o.n = w.n + 1) SELECT id FROM w WHERE k""",
    "keyframe_gap_filter": f"""WITH RECURSIVE {ORDERED}, m AS (SELECT u, max(n) AS last FROM o GROUP BY 1), w AS (SELECT u, n, id, n AS kept FROM o WHERE n = 1 UNION ALL
SELECT o.u, o.n, o.id, CASE WHEN o.v > 60 OR o.n - w.kept >= 4 OR o.n = m.last THEN o.n ELSE w.kept END FROM w JOIN o ON o.u = w.u AND o.n = w.n + 1 JOIN m ON m.u = o.u) SELECT id FROM w WHERE kept = n""",
    "run_lengths": f"""WITH {px.STREAM}, f AS (SELECT *, event_type = 'error' AS flag, lag(event_type = 'error') OVER (PARTITION BY u ORDER BY t, id) AS before FROM stream),
g AS (SELECT *, CAST(sum(CASE WHEN before = flag THEN 0 ELSE 1 END) OVER (PARTITION BY u ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM f)
SELECT u, run, arg_min(id, (t, id)) AS first_id, CAST(count(*) AS BIGINT) AS length, any_value(flag) AS flag FROM g GROUP BY 1, 2""",
    "jump_report": f"""WITH {px.STREAM}, g AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY u ORDER BY t, id)) AS gap FROM stream), h AS (SELECT * FROM g WHERE gap IS NOT NULL),
b AS (SELECT u, CAST(count(*) AS BIGINT) AS n_gaps, greatest(0.35, 0.9::DOUBLE * quantile_cont(gap, 0.99), 2.0::DOUBLE * quantile_cont(gap, 0.5)) AS threshold FROM h GROUP BY 1)
SELECT u, n_gaps, round(threshold, 6) AS threshold, CAST(sum(CAST(gap > threshold AS INTEGER)) AS BIGINT) AS n_jumps, arg_max(id, (gap, -id)) AS worst_id FROM h JOIN b USING (u) GROUP BY u, n_gaps, b.threshold""",
    "median_rate": f"WITH {px.STREAM}, s AS (SELECT u, t - lag(t) OVER (PARTITION BY u ORDER BY t, id) AS step FROM stream) SELECT u, round(1e6 / quantile_cont(step::DOUBLE, 0.5), 9) AS rate FROM s WHERE step > 0 GROUP BY 1",
    "chunk_of_eight": f"""WITH {ORDERED}, c AS (SELECT u, (n - 1) // 8 AS chunk, CAST(count(*) AS BIGINT) AS frames, CAST(sum(CAST(event_type = 'click' AS INTEGER)) AS BIGINT) AS seeds FROM o GROUP BY 1, 2)
SELECT *, CAST(coalesce(sum(seeds) OVER (PARTITION BY u ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_id FROM c""",
    "factor_age_budget": f"WITH {px.STREAM}, a AS (SELECT u, id, row_number() OVER (PARTITION BY u, event_type ORDER BY t DESC, id DESC) - 1 AS age FROM stream) SELECT id FROM a QUALIFY row_number() OVER (PARTITION BY u ORDER BY age, id) <= 6",
    "voxel_running_mean": f"WITH {px.STREAM} SELECT CAST(floor(t / {HOURS}) AS BIGINT) AS hour, round(avg(v), 6) AS tsdf, CAST(count(*) AS BIGINT) AS weight FROM stream GROUP BY 1",
    "scatter_reductions": f"WITH {px.STREAM} SELECT u, round(sum(v), 6) AS total, round(product(1 + v / 1e6), 6) AS product, round(avg(v), 6) AS mean, CAST(floor(sum(id) / count(id)) AS BIGINT) AS id_mean, min(v) AS low, max(v) AS high, arg_min(id, (v, id)) AS argmin, arg_max(id, (v, -id)) AS argmax FROM stream GROUP BY 1",
    "pose_auc_hist": f"""WITH {px.STREAM}, e AS (SELECT abs(a.v - b.v) AS e FROM stream a JOIN stream b ON a.u = b.u AND a.id < b.id), t(threshold) AS (VALUES (30), (15), (5), (3)),
h AS (SELECT threshold, least(CAST(floor(e) AS INTEGER), threshold - 1) AS slot, count(*) AS c FROM e, t WHERE e <= threshold GROUP BY 1, 2), s AS (SELECT threshold, slot FROM t, range(0, 30) r(slot) WHERE slot < threshold),
c AS (SELECT s.threshold, sum(coalesce(c, 0)) OVER (PARTITION BY s.threshold ORDER BY s.slot) AS cum FROM s LEFT JOIN h ON h.threshold = s.threshold AND h.slot = s.slot)
SELECT threshold, round(avg(cum / (SELECT count(*) FROM e)), 9) AS auc FROM c GROUP BY 1""",
    "ate_rmse": f"WITH {px.STREAM} SELECT u, round(sqrt(var_pop(v - CAST(id % 100 AS DOUBLE))), 6) AS rmse FROM stream GROUP BY 1",
    "scale_diagnostic": f"""WITH {px.STREAM}, c AS (SELECT u, v - first_value(v) OVER w AS p, CAST(id % 100 AS DOUBLE) - first_value(CAST(id % 100 AS DOUBLE)) OVER w AS g FROM stream WINDOW w AS (PARTITION BY u ORDER BY t, id))
SELECT u, round(CASE WHEN sum(p * p) > 0 THEN sum(p * g) / sum(p * p) END, 6) AS scale FROM c GROUP BY 1""",
    "psnr_by_group": f"WITH {px.STREAM} SELECT event_type, round(20 * log10(255 / sqrt(avg((v - 50) * (v - 50)))), 6) AS psnr FROM stream GROUP BY 1",
    "huber_weights": f"WITH {px.STREAM} SELECT id, round(CASE WHEN abs((v - 50) / 10) <= 1.5 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE / abs((v - 50) / 10) END, 9) AS w FROM stream",
    "disparity_steps": f"WITH {px.STREAM} SELECT id, round(greatest(v / 100 + CASE WHEN abs(id % 25 - 12) > 10 THEN 0 ELSE id % 25 - 12 END, 1e-3), 9) AS disparity FROM stream",
    "id_set_ops": """WITH p AS (SELECT DISTINCT user_id AS u FROM events WHERE event_type = 'purchase'), c AS (SELECT DISTINCT user_id AS u FROM events WHERE event_type = 'click'),
s AS (SELECT 'union' AS op, u FROM (SELECT u FROM p UNION SELECT u FROM c) UNION ALL SELECT 'intersect', u FROM (SELECT u FROM p INTERSECT SELECT u FROM c) UNION ALL SELECT 'minus', u FROM (SELECT u FROM p EXCEPT SELECT u FROM c) UNION ALL SELECT 'reverse', u FROM (SELECT u FROM c EXCEPT SELECT u FROM p)),
n(op) AS (VALUES ('union'), ('intersect'), ('minus'), ('reverse')) SELECT n.op, CAST(count(u) AS BIGINT) AS n, CAST(coalesce(sum(u), 0) AS BIGINT) AS total FROM n LEFT JOIN s ON s.op = n.op GROUP BY 1""",
    "neighbourhood_edges": f"WITH {ORDERED} SELECT a.u, a.n - 1 AS i, b.n - 1 AS j FROM o a JOIN o b ON a.u = b.u AND b.n - a.n BETWEEN -2 AND 2 AND a.n <> b.n",
    "proximity_order": f"""WITH {px.POINTS}, e AS (SELECT p.id AS i, q.id AS j, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS dist FROM points p JOIN points q ON q.id - p.id BETWEEN 1 AND 3)
SELECT i, j, CAST(row_number() OVER (PARTITION BY i % 16 ORDER BY round_even(dist / 1e-3::DOUBLE, 0), i * 1000000 + j) AS INTEGER) AS place FROM e""",
    "merge_last_wins": f"WITH {px.STREAM} SELECT concat_ws('/', CAST(u AS VARCHAR), event_type) AS k, arg_max(id, (t, id)) AS id, round(arg_max(v, (t, id)), 6) AS v FROM stream GROUP BY 1",
    "contiguous_frames": f"WITH {px.STREAM} SELECT u, id, row_number() OVER (PARTITION BY u ORDER BY t, id) - 1 AS index FROM stream WHERE event_type <> 'error'",
    "reprojection": f"""WITH {px.STREAM}, p AS (SELECT id, (CAST(id % 64 AS DOUBLE) - 32) / 60 AS x, (CAST(u % 48 AS DOUBLE) - 24) / 60 AS y, abs(v) / 10 + 0.01 AS d FROM stream), m AS (SELECT id, x + 0.5 * d AS x, y, 1 - 0.1 * d AS z, d FROM p), s AS (SELECT *, CASE WHEN z < 0.1 THEN 1.0::DOUBLE ELSE z END AS q FROM m)
SELECT id, round(60 * (x / q) + 32, 6) AS u2, round(60 * (y / q) + 24, 6) AS v2, round(d / q, 6) AS d2, z > 0.1 AS valid FROM s""",
    "frame_distance": f"""WITH {px.STREAM}, f AS (SELECT u % 20 AS i, (u // 20) % 20 AS j, event_type <> 'error' AS ok, 0.3::DOUBLE * v + 0.7::DOUBLE * (v / 2) AS flow FROM stream),
g AS (SELECT i, j, CASE WHEN avg(CAST(ok AS DOUBLE)) < 0.75 THEN 1000.0 ELSE avg(CASE WHEN ok THEN flow END) END AS d FROM f GROUP BY 1, 2) SELECT g.i, g.j, round((g.d + coalesce(h.d, g.d)) / 2, 6) AS dist FROM g LEFT JOIN g h ON h.i = g.j AND h.j = g.i""",
    "subsample_timestamp": f"""WITH RECURSIVE {px.STREAM}, s AS (SELECT DISTINCT u, t * 1000 AS ns FROM stream), gaps AS (SELECT u, ns - lag(ns) OVER (PARTITION BY u ORDER BY ns) AS gap FROM s),
g AS (SELECT u, list(ns ORDER BY ns) AS ts, 1e9::DOUBLE / (0.5e9::DOUBLE / any_value(mid)) AS period FROM s JOIN (SELECT u, median(gap) AS mid FROM gaps GROUP BY u) USING (u) GROUP BY u),
run AS (SELECT u, 0 AS pos, 1 AS nxt, ts[1] + period AS tick FROM g UNION ALL
  SELECT u, pick, pick + 1, tick + period FROM (SELECT u, tick, period, CASE WHEN tick - ts[n] <= ts[n + 1] - tick AND n - 1 > pos THEN n - 1 ELSE n END AS pick
    FROM (SELECT *, greatest(nxt, len(list_filter(ts, lambda x: x < tick))) AS n FROM run JOIN g USING (u) WHERE tick <= ts[len(ts)] + 1e-6) WHERE n < len(ts)))
SELECT u, ts[pos + 1] AS ns FROM run JOIN g USING (u)""",
    "factor_edges": f"""WITH RECURSIVE {px.STREAM}, c AS (SELECT u, row_number() OVER (PARTITION BY u ORDER BY t, id) - 1 AS c, v FROM stream), f AS (SELECT u * 1048576 + c // 32 AS scene, c % 32 AS i, v FROM c), n AS (SELECT scene, max(i) + 1 AS n FROM f GROUP BY 1 HAVING n > 1),
forced AS (SELECT p.scene, p.i, q.i AS j FROM f p JOIN f q ON q.scene = p.scene AND q.i < p.i AND q.i >= p.i - 2),
cand AS (SELECT p.scene, p.i, q.i AS j, row_number() OVER (PARTITION BY p.scene ORDER BY round_even(abs(p.v - q.v) / 0.001::DOUBLE, 0), p.i * n + q.i) AS place FROM f p JOIN f q ON q.scene = p.scene AND q.i <= p.i - 1 JOIN n ON n.scene = p.scene WHERE abs(p.v - q.v) <= 20),
run AS (SELECT scene, CAST(0 AS BIGINT) AS place, CAST([] AS STRUCT(i BIGINT, j BIGINT)[]) AS taken, (SELECT count(*) FROM forced WHERE forced.scene = n.scene) AS edges FROM n UNION ALL
  SELECT scene, place, CASE WHEN free THEN list_append(taken, struct_pack(i := i, j := j)) ELSE taken END, edges + CAST(free AS BIGINT)
  FROM (SELECT run.scene, cand.place, taken, edges, i, j, i - j > 2 AND len(list_filter(taken, lambda x: abs(x.i - i) + abs(x.j - j) <= greatest(least(abs(x.i - x.j) - 2, 2), 0))) = 0 AS free
    FROM run JOIN cand ON cand.scene = run.scene AND cand.place = run.place + 1 WHERE 2 * edges <= 200)),
final AS (SELECT scene, taken FROM run QUALIFY row_number() OVER (PARTITION BY scene ORDER BY place DESC) = 1), kept AS (SELECT * FROM forced UNION ALL SELECT scene, x.i, x.j FROM (SELECT scene, unnest(taken) AS x FROM final))
SELECT scene, i, j FROM kept UNION ALL SELECT scene, j, i FROM kept""",
}
