"""Queries on points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.functions import geometry as geo
from terrazzo.operators import graph, metrics, semantic, spatial
from terrazzo.operators import surface as surf
from terrazzo.operators.selection import contact_colors, per_scene
from terrazzo.plans import proxies as px
from terrazzo.plans.evidence import r

VOXEL = 0.1
CAP = 2.5 * VOXEL * math.sqrt(3)


def voxel_occupancy(spark, d):
    return spatial.occupancy(px.points(spark, d), VOXEL).select("gx", "gy", "gz", r("cx"), r("cy"), r("cz"))


def voxel_downsample(spark, d):
    return spatial.downsample(px.points(spark, d), VOXEL).select("gx", "gy", "gz", r("x"), r("y"), r("z"), "n")


def block_index(spark, d):
    """Voxel, its block of 8 and its place in the block, for negative voxels too."""
    cells = spatial.with_cell(px.points(spark, d), 0.01).select("id", "gx")
    b, i = geo.block("gx", 8)
    return cells.select("id", "gx", b.alias("block"), i.cast("long").alias("inside"))


def cell_seeds(spark, d):
    return spatial.seeds(px.points(spark, d), VOXEL)


def _edges(spark, d) -> DataFrame:
    return spatial.knn_edges(px.points(spark, d), 4, CAP)


def knn_edges(spark, d):
    return _edges(spark, d).select("lo", "hi", r("dist"))


def edge_costs(spark, d):
    return spatial.edge_costs(_edges(spark, d), px.points(spark, d)).select("lo", "hi", r("cost"))


def nearest_seed_assignment(spark, d):
    points = px.points(spark, d)
    return spatial.shortest_to_seeds(spatial.edge_costs(_edges(spark, d), points), spatial.seeds(points, 2 * VOXEL), points, width=4 * VOXEL).select("id", "seed", r("cost"))


def atom_adjacency(spark, d):
    cells = spatial.with_cell(px.points(spark, d), VOXEL)
    atoms = cells.join(spatial.seeds(px.points(spark, d), VOXEL).withColumnRenamed("id", "atom"), ["gx", "gy", "gz"]).select("id", "atom")
    return spatial.adjacency(_edges(spark, d), atoms)


def component_labels(spark, d):
    return graph.components(spatial.links_within(px.points(spark, d), 0.08)).select("node", "component")


def _split(spark, d) -> tuple[DataFrame, DataFrame]:
    points = px.points(spark, d)
    return points.where("id % 2 = 1"), points.where("id % 2 = 0")


def nearest_gt_transfer(spark, d):
    pred, truth = _split(spark, d)
    found = spatial.nearest(pred, truth, 1, 0.1)
    return found.agg(*[F.round(F.percentile("dist", F.lit(p / 100)), 9).alias(f"p{p}") for p in (50, 90, 99)], F.count(F.lit(1)).alias("n"))


def majority_vote_labels(spark, d):
    pred, truth = _split(spark, d)
    return spatial.majority_vote(spatial.knn(pred, truth, 5, 0.2), truth)


def bidirectional_nn(spark, d):
    return metrics.reconstruction(*_split(spark, d)).select(r("acc"), r("comp"), r("overall"))


def aabb_crop(spark, d):
    pred, truth = _split(spark, d)
    return spatial.crop(pred, truth.where("label < 3"), 0.01).select("id")


def zbuffer_splat(spark, d):
    pixels = px.points(spark, d).withColumns({"px": geo.voxel("x", 0.05), "py": geo.voxel("y", 0.05)})
    return spatial.splat(pixels).select("px", "py", r("z"), "id")


def point_discs(spark, d):
    pixels = px.points(spark, d).withColumns({"px": geo.voxel("x", 0.02).cast("int"), "py": geo.voxel("y", 0.02).cast("int"), "z": F.col("z") + 1})
    return spatial.splat(spatial.discs(pixels, 0.02, 100.0, 3)).select("px", "py", r("z"), "id")


def kabsch_alignment(spark, d):
    points = px.points(spark, d).select("x", "y", "z")
    turned = points.select("x", "y", "z", (-F.col("y") + 2).alias("x2"), (F.col("x") - 3).alias("y2"), (F.col("z") + 4).alias("z2"))
    rot, shift, scale = metrics.kabsch(turned, True)
    return spark.createDataFrame([(f"r{i}{j}", float(rot[i, j])) for i in range(3) for j in range(3)] + [(f"t{i}", float(shift[i])) for i in range(3)] + [("scale", float(scale))], "name string, value double").withColumn("value", F.round("value", 6) + 0.0)


def contact_coloring(spark, d):
    """Instances are the labels; they touch where a point's near neighbour has another label. A scene
    is a block of 64 labels."""
    points = px.points(spark, d)
    owner = points.select("id", "label")
    scene = lambda c: F.floor(F.col(c) / 64)
    touching = spatial.knn(points, points, 16, 0.15, False).join(owner, "id").join(owner.select(F.col("id").alias("id2"), F.col("label").alias("label2")), "id2").where("label <> label2").select(F.least("label", "label2").alias("a"), F.greatest("label", "label2").alias("b")).distinct()
    rows = owner.select("label").distinct().select(F.col("label").alias("a"), F.lit(-1).alias("b")).union(touching.where(scene("a") == scene("b"))).withColumn("scene", scene("a"))

    def color(pdf):
        import pandas as pd

        found = contact_colors(pdf.a[pdf.b < 0].tolist(), {(a, b) for a, b in zip(pdf.a, pdf.b) if b >= 0})
        return pd.DataFrame({"instance": list(found), "color": list(found.values())})

    return per_scene(rows, color, "instance long, color long")


def _views(spark, d) -> DataFrame:
    """Each point before three cameras that look along z from (0, 0, -1 - k), with a depth to compare."""
    cameras = F.explode(F.array(*[F.lit(k) for k in range(3)]))
    seen = px.points(spark, d).withColumn("f", cameras)
    pose = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)], -1.0 - F.col("f"), *[F.lit(float(v)) for v in (0, 0, 0, 1)])
    seen = seen.withColumn("pose", pose)
    x, y, z = geo.world_to_camera("x", "y", "z", "pose")
    seen = seen.withColumns({"xc": x, "yc": y, "zc": z})
    u, v = geo.project("xc", "yc", "zc", 60.0, 60.0, 16.0, 16.0)
    return seen.withColumns({"u": u, "v": v})


def projection(spark, d):
    return _views(spark, d).select("id", "f", r("xc"), r("yc"), r("zc"), r("u"), r("v"))


def visible_points(spark, d):
    seen = _views(spark, d)
    pixel = seen.withColumns({"pu": F.col("u").cast("long"), "pv": F.col("v").cast("long")})
    depth = pixel.where("u >= 0 and v >= 0").groupBy("f", "pu", "pv").agg(F.min("zc").alias("measured"))
    joined = pixel.join(depth, ["f", "pu", "pv"])
    return joined.where(geo.visible("u", "v", "zc", "measured", 32, 32, 0.05)).select("id", "f", "pu", "pv")


def unprojection(spark, d):
    seen = _views(spark, d)
    x, y, z = geo.unproject("u", "v", "zc", 60.0, 60.0, 16.0, 16.0)
    back = seen.withColumns({"bx": x, "by": y, "bz": z})
    wx, wy, wz = geo.apply_pose("bx", "by", "bz", "pose")
    return back.select("id", "f", F.round(wx, 6).alias("x"), F.round(wy, 6).alias("y"), F.round(wz, 6).alias("z"))


def disparity_roundtrip(spark, d):
    seen = _views(spark, d).withColumn("disp", 1 / F.col("zc"))
    x, y, z, w = geo.unproject_disparity("u", "v", "disp", 60.0, 60.0, 16.0, 16.0)
    again = seen.withColumns({"hx": x, "hy": y, "hz": z})
    u, v, dd = geo.project_homogeneous("hx", "hy", "hz", "disp", 60.0, 60.0, 16.0, 16.0)
    return again.select("id", "f", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"), F.round(dd, 9).alias("d"))


def view_weights(spark, d):
    return _views(spark, d).select("id", "f", F.round(geo.view_weight("nx", "ny", "nz", "xc", "yc", "zc"), 9).alias("w"), geo.feature_cell("u", 32).alias("cell"))


def tsdf_fusion(spark, d):
    return surf.fuse(_tsdf_samples(spark, d)).select("gx", "gy", "gz", r("tsdf"), "weight")


def _tsdf_samples(spark, d) -> DataFrame:
    """Voxels before and behind each observed point, with the point as the depth that they see."""
    return surf.samples(_views(spark, d).where("zc > 0.1").select("id", "f", "x", "y", F.col("z").alias("depth_z"), "zc", "u", "v"), VOXEL, 0.15, 60.0, 60.0, 16.0, 16.0)


def surface_cells(spark, d):
    return surf.surface_points(surf.fuse(_tsdf_samples(spark, d)), VOXEL).select("gx", "gy", "gz", r("x", 6), r("y", 6), r("z", 6), r("nx", 6), r("ny", 6), r("nz", 6))


def weighted_vector_mean(spark, d):
    return semantic.weighted_mean(px.points(spark, d), "label", 1 + F.col("id") % 3).select("label", "dim", r("value", 6))


def _membership(spark, d) -> DataFrame:
    points = px.points(spark, d)
    return points.select("id", F.col("label").cast("long").alias("hyp")).union(points.where("id % 11 <> 5").select("id", (100 + F.col("id") % 7).alias("hyp")))


def hypothesis_pool(spark, d):
    return semantic.pool(px.points(spark, d), _membership(spark, d)).select("hyp", "dim", r("value", 6))


def overlap_field(spark, d):
    members = _membership(spark, d)
    return semantic.overlap(semantic.pool(px.points(spark, d), members), members).select("id", "dim", r("value", 6))


def _texts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Label centroids as queries, centroids of id % 4 as the negatives, and the points' vectors."""
    points = px.points(spark, d)
    long = semantic.long_form(points, keys=("id", "label"))
    return long.groupBy(F.col("label").alias("query"), "dim").agg(F.avg("value").alias("value")), long.groupBy((F.col("id") % 4).alias("query"), "dim").agg(F.avg("value").alias("value")), long


def text_scores(spark, d):
    queries, negatives, field = _texts(spark, d)
    return semantic.text_scores(semantic.cosines(field, queries), semantic.cosines(field, negatives)).select("id", "query", r("score", 6))


def semantic_top1(spark, d):
    queries, _, field = _texts(spark, d)
    best = semantic.top_label(semantic.cosines(field, queries))
    return best.join(px.points(spark, d).select("id", "label"), "id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("query") == F.col("label")).cast("long")).alias("n_correct"))


def principal_colors(spark, d):
    return semantic.principal_colors(px.points(spark, d)).select("id", r("c0", 4), r("c1", 4), r("c2", 4))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

CELLS = px.POINTS + ", cells AS (SELECT *, CAST(floor(x / 0.1) AS BIGINT) AS gx, CAST(floor(y / 0.1) AS BIGINT) AS gy, CAST(floor(z / 0.1) AS BIGINT) AS gz FROM points)"
DIST = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))"
KNN = px.POINTS + f""", near AS (SELECT p.id, q.id AS id2, {DIST} AS dist FROM points p JOIN points q ON p.id <> q.id WHERE {DIST} <= {CAP!r}),
knn AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, id2) <= 4),
edges AS (SELECT least(id, id2) AS lo, greatest(id, id2) AS hi, min(dist) AS dist FROM knn GROUP BY 1, 2)"""
SEEDS = CELLS + """, mids AS (SELECT gx, gy, gz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM cells GROUP BY 1, 2, 3),
seeds AS (SELECT gx, gy, gz, id FROM (SELECT cells.*, round((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz), 9) AS d FROM cells JOIN mids USING (gx, gy, gz)) QUALIFY row_number() OVER (PARTITION BY gx, gy, gz ORDER BY d, id) = 1)"""
NN = px.POINTS + f""", nn AS (SELECT p.id, q.id AS id2, {DIST} AS dist FROM points p, points q WHERE p.id % 2 = 1 AND q.id % 2 = 0),
pred AS (SELECT id, min(dist) AS dist FROM nn GROUP BY 1), gt AS (SELECT id2, min(dist) AS dist FROM nn GROUP BY 1)"""
VIEWS = px.POINTS + ", views AS (SELECT id, f, x AS xc, y AS yc, z + 1 + f AS zc, x, y, z, 60 * x / (z + 1 + f) + 16 AS u, 60 * y / (z + 1 + f) + 16 AS v, a / sqrt(a * a + b * b + c * c) AS nx, b / sqrt(a * a + b * b + c * c) AS ny, c / sqrt(a * a + b * b + c * c) AS nz FROM points, range(3) r(f))"
COS = px.LONG + """, cq AS (SELECT label AS query, dim, avg(value) AS q FROM long GROUP BY 1, 2), cn AS (SELECT id % 4 AS query, dim, avg(value) AS q FROM long GROUP BY 1, 2),
n1 AS (SELECT id, greatest(sqrt(sum(value * value)), 1e-8) AS n FROM long GROUP BY 1),
cosq AS (SELECT id, query, sum(value * q) / any_value(n1.n) / greatest(sqrt(sum(q * q)), 1e-8) AS cos FROM long JOIN cq USING (dim) JOIN n1 USING (id) GROUP BY 1, 2),
cosn AS (SELECT id, query, sum(value * q) / any_value(n1.n) / greatest(sqrt(sum(q * q)), 1e-8) AS cos FROM long JOIN cn USING (dim) JOIN n1 USING (id) GROUP BY 1, 2)"""
MEMB = px.LONG + ", memb AS (SELECT id, CAST(label AS BIGINT) AS hyp FROM points UNION ALL SELECT id, 100 + id % 7 FROM points WHERE id % 11 <> 5), pooled AS (SELECT hyp, dim, avg(value) AS value FROM memb JOIN long USING (id) GROUP BY 1, 2)"
SQL = {
    "voxel_occupancy": f"WITH {CELLS} SELECT DISTINCT gx, gy, gz, round((gx + 0.5::DOUBLE) * 0.1, 9) AS cx, round((gy + 0.5::DOUBLE) * 0.1, 9) AS cy, round((gz + 0.5::DOUBLE) * 0.1, 9) AS cz FROM cells",
    "voxel_downsample": f"WITH {CELLS} SELECT gx, gy, gz, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, CAST(count(*) AS BIGINT) AS n FROM cells GROUP BY 1, 2, 3",
    "block_index": f"WITH {px.POINTS}, g AS (SELECT id, CAST(floor(x / 0.01) AS BIGINT) AS gx FROM points) SELECT id, gx, CAST(floor(gx / 8.0::DOUBLE) AS BIGINT) AS block, ((gx % 8) + 8) % 8 AS inside FROM g",
    "cell_seeds": f"WITH {SEEDS} SELECT * FROM seeds",
    "knn_edges": f"WITH {KNN} SELECT lo, hi, round(dist, 9) AS dist FROM edges",
    "edge_costs": f"WITH {KNN}, nr AS (SELECT id, a / sqrt(a * a + b * b + c * c) AS nx, b / sqrt(a * a + b * b + c * c) AS ny, c / sqrt(a * a + b * b + c * c) AS nz FROM points) SELECT lo, hi, round(dist * (1 + 4.0::DOUBLE * (1 - abs(i.nx * j.nx + i.ny * j.ny + i.nz * j.nz))), 9) AS cost FROM edges JOIN nr i ON i.id = lo JOIN nr j ON j.id = hi",
    "atom_adjacency": f"WITH {KNN}, {SEEDS.removeprefix(px.POINTS + ', ')}, atoms AS (SELECT cells.id, seeds.id AS atom FROM cells JOIN seeds USING (gx, gy, gz)) SELECT least(i.atom, j.atom) AS a, greatest(i.atom, j.atom) AS b, CAST(count(*) AS BIGINT) AS cross_edges FROM edges JOIN atoms i ON i.id = lo JOIN atoms j ON j.id = hi WHERE i.atom <> j.atom GROUP BY 1, 2",
    "component_labels": f"""WITH RECURSIVE {px.POINTS}, e AS (SELECT p.id AS u, q.id AS v FROM points p JOIN points q ON p.id <> q.id WHERE {DIST} <= 0.08), reach AS (SELECT DISTINCT u AS node, u AS seen FROM e UNION SELECT node, v FROM reach JOIN e ON e.u = seen) SELECT node, min(seen) AS component FROM reach GROUP BY 1""",
    "nearest_gt_transfer": f"WITH {NN} SELECT round(quantile_cont(dist, 0.5), 9) AS p50, round(quantile_cont(dist, 0.9), 9) AS p90, round(quantile_cont(dist, 0.99), 9) AS p99, CAST(count(*) AS BIGINT) AS n FROM pred",
    "majority_vote_labels": f"""WITH {NN}, k AS (SELECT id, id2, row_number() OVER (PARTITION BY id ORDER BY dist, id2) AS r FROM nn WHERE dist <= 0.2 QUALIFY r <= 5),
votes AS (SELECT k.id, points.label, CAST(count(*) AS BIGINT) AS votes, min(r) AS r FROM k JOIN points ON points.id = k.id2 GROUP BY 1, 2) SELECT id, label, votes FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, r) = 1""",
    "bidirectional_nn": f"WITH {NN}, s AS (SELECT (SELECT avg(dist * dist) FROM pred) AS acc, (SELECT avg(dist * dist) FROM gt) AS comp) SELECT round(acc, 9) AS acc, round(comp, 9) AS comp, round((acc + comp) / 2, 9) AS overall FROM s",
    "aabb_crop": f"WITH {px.POINTS}, box AS (SELECT min(x) - 0.01 AS ax, max(x) + 0.01 AS bx, min(y) - 0.01 AS ay, max(y) + 0.01 AS by_, min(z) - 0.01 AS az, max(z) + 0.01 AS bz FROM points WHERE id % 2 = 0 AND label < 3) SELECT id FROM points, box WHERE id % 2 = 1 AND x BETWEEN ax AND bx AND y BETWEEN ay AND by_ AND z BETWEEN az AND bz",
    "zbuffer_splat": f"WITH {px.POINTS}, p AS (SELECT id, z, CAST(floor(x / 0.05) AS BIGINT) AS px, CAST(floor(y / 0.05) AS BIGINT) AS py FROM points), f AS (SELECT px, py, min(z) AS front FROM p GROUP BY 1, 2) SELECT px, py, round(front, 9) AS z, min(id) AS id FROM p JOIN f USING (px, py) WHERE z <= front + 1e-6 GROUP BY px, py, front",
    "point_discs": f"""WITH {px.POINTS}, p AS (SELECT id, z + 1 AS z, CAST(floor(x / 0.02) AS INTEGER) AS px, CAST(floor(y / 0.02) AS INTEGER) AS py, CAST(least(ceil(1.0 / (z + 1)), 3) AS INTEGER) AS rad FROM points WHERE z + 1 > 0),
o AS (SELECT id, z, px + du AS px, py + dv AS py FROM p, range(-3, 4) a(du), range(-3, 4) b(dv) WHERE du * du + dv * dv <= rad * rad AND abs(du) <= rad AND abs(dv) <= rad), f AS (SELECT px, py, min(z) AS front FROM o GROUP BY 1, 2)
SELECT CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, round(front, 9) AS z, min(id) AS id FROM o JOIN f USING (px, py) WHERE z <= front + 1e-6 GROUP BY o.px, o.py, front""",
    "projection": f"WITH {VIEWS} SELECT id, CAST(f AS INTEGER) AS f, round(xc, 9) AS xc, round(yc, 9) AS yc, round(zc, 9) AS zc, round(CASE WHEN zc > 0.001 THEN u END, 9) AS u, round(CASE WHEN zc > 0.001 THEN v END, 9) AS v FROM views",
    "visible_points": f"WITH {VIEWS}, p AS (SELECT id, f, u, v, zc, CAST(trunc(u) AS BIGINT) AS pu, CAST(trunc(v) AS BIGINT) AS pv FROM views WHERE zc > 0.001), dep AS (SELECT f, pu, pv, min(zc) AS m FROM p WHERE u >= 0 AND v >= 0 GROUP BY 1, 2, 3) SELECT id, CAST(f AS INTEGER) AS f, pu, pv FROM p JOIN dep USING (f, pu, pv) WHERE u >= 0 AND u < 32 AND v >= 0 AND v < 32 AND m > 0.001 AND abs(zc - m) <= 0.05",
    "unprojection": f"WITH {VIEWS} SELECT id, CAST(f AS INTEGER) AS f, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM views",
    "disparity_roundtrip": f"WITH {VIEWS} SELECT id, CAST(f AS INTEGER) AS f, round(u, 6) AS u, round(v, 6) AS v, round(1 / zc, 9) AS d FROM views",
    "view_weights": f"WITH {VIEWS} SELECT id, CAST(f AS INTEGER) AS f, round(greatest(1 / zc * least(abs((nx * xc + ny * yc + nz * zc) / zc), 1.0), 1e-6), 9) AS w, CAST(least(greatest(trunc(u / 32 * 24), 0), 23) AS INTEGER) AS cell FROM views",
    "weighted_vector_mean": f"WITH {px.LONG} SELECT label, dim, round(sum((1 + id % 3) * value) / sum(1 + id % 3), 6) AS value FROM long GROUP BY 1, 2",
    "hypothesis_pool": f"WITH {MEMB} SELECT hyp, dim, round(value, 6) AS value FROM pooled",
    "overlap_field": f"WITH {MEMB} SELECT id, dim, round(avg(value), 6) AS value FROM memb JOIN pooled USING (hyp) GROUP BY 1, 2",
    "text_scores": f"WITH {COS}, rest AS (SELECT id, sum(exp(cos / 0.5)) AS rest FROM cosn GROUP BY 1) SELECT id, query, round(exp(cos / 0.5) / (exp(cos / 0.5) + rest), 6) AS score FROM cosq JOIN rest USING (id)",
    "semantic_top1": f"WITH {COS}, best AS (SELECT id, query FROM cosq QUALIFY row_number() OVER (PARTITION BY id ORDER BY cos DESC, query) = 1) SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(query = label AS INTEGER)) AS BIGINT) AS n_correct FROM best JOIN points USING (id) GROUP BY 1",
    "kabsch_alignment": f"""WITH {px.POINTS}, a AS (SELECT x, y, z, unnest([1, 2, 3]) AS i, unnest([-y + 2, x - 3, z + 4]) AS w FROM points),
m AS (SELECT i, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(w) AS mw, covar_pop(x, w) AS b1, covar_pop(y, w) AS b2, covar_pop(z, w) AS b3, var_pop(x) AS a, covar_pop(x, y) AS b, covar_pop(x, z) AS c, var_pop(y) AS d, covar_pop(y, z) AS e, var_pop(z) AS f FROM a GROUP BY 1),
n AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM m),
fit AS (SELECT *, (b1 * (d * f - e * e) + b2 * (c * e - b * f) + b3 * (b * e - c * d)) / det AS r1, (b1 * (c * e - b * f) + b2 * (a * f - c * c) + b3 * (b * c - a * e)) / det AS r2, (b1 * (b * e - c * d) + b2 * (b * c - a * e) + b3 * (a * d - b * b)) / det AS r3 FROM n),
k AS (SELECT p.r1 * (q.r2 * s.r3 - q.r3 * s.r2) - p.r2 * (q.r1 * s.r3 - q.r3 * s.r1) + p.r3 * (q.r1 * s.r2 - q.r2 * s.r1) AS cube FROM fit p, fit q, fit s WHERE p.i = 1 AND q.i = 2 AND s.i = 3),
found AS (SELECT 'r' || (i - 1) || j AS name, [r1, r2, r3][j + 1] / cbrt(cube) AS value FROM fit, k, range(3) t(j) UNION ALL SELECT 't' || (i - 1), mw - r1 * mx - r2 * my - r3 * mz FROM fit UNION ALL SELECT 'scale', cbrt(cube) FROM k)
SELECT name, round(value, 6) + 0.0 AS value FROM found""",
    "tsdf_fusion": f"""WITH {VIEWS}, cells AS (SELECT CAST(floor(x / 0.1) AS BIGINT) AS gx, CAST(floor(y / 0.1) AS BIGINT) AS gy, CAST(floor(z / 0.1) AS BIGINT) + dz AS gz, z, zc, u, v FROM views, range(-2, 3) r(dz) WHERE zc > 0.1),
seen AS (SELECT *, zc + ((gz + 0.5::DOUBLE) * 0.1::DOUBLE - z) AS cz FROM cells WHERE u BETWEEN 0.0001 AND 31.9999 AND v BETWEEN 0.0001 AND 31.9999),
far AS (SELECT gx, gy, gz, (zc - cz) * sqrt((u - 16) / 60 * ((u - 16) / 60) + (v - 16) / 60 * ((v - 16) / 60) + 1) AS sdf FROM seen WHERE cz > 0)
SELECT gx, gy, gz, round(avg(least(1.0::DOUBLE, sdf / 0.15::DOUBLE)), 9) AS tsdf, CAST(count(*) AS DOUBLE) AS weight FROM far WHERE sdf > -0.15::DOUBLE GROUP BY 1, 2, 3""",
    "nearest_seed_assignment": f"""WITH RECURSIVE {KNN}, nr AS (SELECT id, a / sqrt(a * a + b * b + c * c) AS nx, b / sqrt(a * a + b * b + c * c) AS ny, c / sqrt(a * a + b * b + c * c) AS nz FROM points),
costs AS (SELECT lo, hi, dist * (1 + 4.0::DOUBLE * (1 - abs(i.nx * j.nx + i.ny * j.ny + i.nz * j.nz))) AS cost FROM edges JOIN nr i ON i.id = lo JOIN nr j ON j.id = hi), ways AS MATERIALIZED (SELECT lo AS a, hi AS b, cost FROM costs UNION ALL SELECT hi, lo, cost FROM costs),
{SEEDS.removeprefix(px.POINTS + ', ').replace(' / 0.1)', ' / 0.2)')},
found(id, seed, total) USING KEY (id) AS (SELECT id, id, 0.0::DOUBLE FROM seeds UNION
  SELECT step.id, step.best.seed, step.best.total FROM (SELECT b AS id, min(struct_pack(total := total + cost, seed := seed)) AS best FROM found JOIN ways ON found.id = a GROUP BY b) step LEFT JOIN recurring.found known ON known.id = step.id
  WHERE known.id IS NULL OR step.best.total < known.total OR step.best.total = known.total AND step.best.seed < known.seed)
SELECT points.id, coalesce(seed, points.id) AS seed, round(coalesce(total, 0.0::DOUBLE), 9) AS cost FROM points LEFT JOIN found ON found.id = points.id""",
    "contact_coloring": f"""WITH RECURSIVE {px.POINTS}, near AS (SELECT p.id, q.id AS id2, p.label, q.label AS label2 FROM points p JOIN points q ON p.id <> q.id WHERE {DIST} <= 0.15 QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {DIST}, q.id) <= 16),
touch AS (SELECT DISTINCT label AS a, label2 AS b FROM near WHERE label // 64 = label2 // 64 AND label <> label2), ways AS (SELECT a, b FROM touch UNION SELECT b, a FROM touch),
inst AS (SELECT label // 64 AS scene, label, coalesce(n, []) AS around, row_number() OVER (PARTITION BY label // 64 ORDER BY len(coalesce(n, [])) DESC, label) AS place FROM (SELECT DISTINCT label FROM points) LEFT JOIN (SELECT a AS label, list(b) AS n FROM ways GROUP BY a) USING (label)),
hue AS (SELECT k, (k % 12) / 12.0::DOUBLE * 6.0 AS h, CASE WHEN k < 12 THEN 0.92::DOUBLE ELSE 0.68::DOUBLE END AS s, CASE WHEN k < 12 THEN 1.0::DOUBLE ELSE 0.78::DOUBLE END AS v FROM range(24) r(k)),
hsv AS (SELECT k, CAST(floor(h) AS INTEGER) % 6 AS i, v, v * (1 - s) AS p, v * (1 - s * (h - floor(h))) AS q, v * (1 - s * (1 - (h - floor(h)))) AS t FROM hue),
rgb AS (SELECT k, list_transform([[v, t, p], [q, v, p], [p, v, t], [p, q, v], [t, p, v], [v, p, q]][i + 1], lambda x: floor(x * 255)) AS c FROM hsv),
apart AS (SELECT a.k, list((a.c[1] - b.c[1]) ** 2 + (a.c[2] - b.c[2]) ** 2 + (a.c[3] - b.c[3]) ** 2 ORDER BY b.k) AS d FROM rgb a, rgb b GROUP BY a.k),
run AS (SELECT scene, CAST(0 AS BIGINT) AS place, CAST([] AS STRUCT(label BIGINT, k BIGINT)[]) AS done FROM inst GROUP BY scene UNION ALL
  SELECT scene, place, list_append(done, struct_pack(label := label, k := k)) FROM (SELECT inst.scene, inst.place, done, label, k, row_number() OVER (PARTITION BY inst.scene
    ORDER BY coalesce(list_min(list_transform(list_filter(done, lambda x: list_contains(around, x.label)), lambda x: d[x.k + 1])), 1e9) DESC, len(list_filter(done, lambda x: x.k = apart.k)), k) AS n
    FROM run JOIN inst ON inst.scene = run.scene AND inst.place = run.place + 1 CROSS JOIN apart) WHERE n = 1)
SELECT CAST(scene AS BIGINT) AS scene, CAST(x.label AS BIGINT) AS instance, x.k AS color FROM (SELECT scene, unnest(done) AS x FROM run QUALIFY row_number() OVER (PARTITION BY scene ORDER BY place DESC) = 1)""",
}
