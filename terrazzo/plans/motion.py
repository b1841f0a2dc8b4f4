"""Queries over camera motion: infill, extrapolation and bundle adjustment.

Poses are made of the events: a frame of a user turns by value / 160 about one of three axes (by the
event's number) and stands at (value / 50, id % 7 / 3, id % 5 / 4); t is its place in the stream.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrazzo.functions import se3
from terrazzo.operators import adjust, correlation, motion
from terrazzo.plans import proxies as px

AXES = ((1, 2, 2), (2, -1, 2), (2, 2, -1))  # over 3


def posed(spark, d):
    """u, id, t, key, v: frames with poses."""
    half = F.col("v") / 320
    axis = F.array(*[F.array(*[F.lit(x / 3) for x in a]) for a in AXES])[(F.col("id") % 3).cast("int")]
    pose = F.array(F.col("v") / 50, (F.col("id") % 7) / 3, (F.col("id") % 5) / 4, *[axis[k] * F.sin(half) for k in range(3)], F.cos(half))
    n = F.row_number().over(Window.partitionBy("u").orderBy("t", "id"))
    return px.stream(spark, d).select("u", "id", n.cast("long").alias("t"), (F.col("event_type") == "purchase").alias("key"), pose.alias("v"))


def _numbers(poses):
    return poses.select("id", *[F.round(F.col("pose")[k], 6).alias(f"p{k}") for k in range(7)])


def pose_infill(spark, d):
    """Every frame's pose, from the purchases as keyframes."""
    return _numbers(motion.infilled(posed(spark, d), "u", F.col("key")))


def pose_extrapolation(spark, d):
    """The pose that each frame would start from."""
    return _numbers(motion.extrapolated(posed(spark, d), "u"))


#: Tangents of the true poses of a scene's four frames, and what the start of the last two is off by.
MOTION = ((0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0.2, 0.02, 0.01, 0.01, -0.03, 0.02), (0.38, -0.05, 0.04, -0.02, -0.05, 0.01), (0.55, 0.03, -0.06, 0.03, -0.06, -0.02))
OFF = ((0.02, -0.01, 0.015, 0.004, -0.006, 0.008), (-0.015, 0.02, 0.01, -0.008, 0.005, -0.006))
FOCAL, CENTRE = (60.0, 62.0), (20.0, 16.0)


def _tangent(values):
    return F.array(*[F.lit(float(x)) for x in values])


def seen_scene(spark, d):
    """poses, points and factors of a scene a label: each embedding is a pixel of frame id % 4, with an inverse
    depth of 0.4 + 0.3 z that is given one tenth too large or small, and is seen in the other three frames."""
    given = px.points(spark, d).where("label is not null").select(F.col("label").alias("scene"), (F.col("id") % 4).alias("frame"), F.col("id").alias("pixel"), (CENTRE[0] + FOCAL[0] * F.col("x")).alias("u"), (CENTRE[1] + FOCAL[1] * F.col("y")).alias("v"), (0.4 + 0.3 * F.col("z")).alias("true"))
    none = F.lit(None).cast("double")
    points = given.select("scene", "frame", "pixel", "u", "v", (F.col("true") * (1 + F.when(F.col("pixel") % 8 < 4, 0.1).otherwise(-0.1))).alias("disparity"), none.alias("sensor"), none.alias("sensor_weight"), "true")
    table = F.array(*[se3.exp(_tangent(m)) for m in MOTION])
    other = given.withColumn("j", F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)]))).where("j <> frame")
    between = se3.product(table[F.col("j").cast("int")], se3.inverse(table[F.col("frame").cast("int")]))
    ray = F.array((F.col("u") - CENTRE[0]) / FOCAL[0] / F.col("true"), (F.col("v") - CENTRE[1]) / FOCAL[1] / F.col("true"), 1 / F.col("true"))
    at = other.select("scene", F.col("frame").alias("i"), "j", "pixel", se3.act(between, ray).alias("p")).where(F.col("p")[2] > 0.1)
    factors = at.select("scene", "i", "j", "pixel", (FOCAL[0] * F.col("p")[0] / F.col("p")[2] + CENTRE[0]).alias("tu"), (FOCAL[1] * F.col("p")[1] / F.col("p")[2] + CENTRE[1]).alias("tv"), F.lit(1.0).alias("wu"), F.lit(1.0).alias("wv"))
    starts = F.array(*[se3.exp(_tangent(m)) if k < 2 else se3.product(se3.exp(_tangent(OFF[k - 2])), se3.exp(_tangent(m))) for k, m in enumerate(MOTION)])
    scenes = given.select("scene").distinct()
    poses = scenes.select("scene", F.posexplode(starts).alias("frame", "pose")).select("scene", F.col("frame").cast("long").alias("frame"), "pose", (F.col("frame") < 2).alias("fixed"))
    cameras = scenes.select("scene", *[F.lit(x).alias(n) for n, x in zip(("fx", "fy", "cx", "cy"), FOCAL + CENTRE)])
    return poses, points, factors, cameras


def bundle_adjustment(spark, d):
    """Each frame's pose as a tangent, and how many of its pixels have come to their true inverse depth."""
    poses, points, factors, cameras = seen_scene(spark, d)
    done = adjust.bundle_adjustment(poses, points.drop("true"), factors, cameras, rounds=12, stop=1e-9, damping=adjust.Damping(1e-8, 1e-10, 1e-8, 1e-10))
    close = (F.abs(F.col("disparity") - F.col("true")) < 1e-3).cast("long")
    right = done.points.join(points.select("scene", "frame", "pixel", "true"), ["scene", "frame", "pixel"]).groupBy("scene", "frame").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum(close).alias("n_close"))
    turned = done.poses.select("scene", "frame", se3.log(F.col("pose")).alias("x"))
    return turned.join(right, ["scene", "frame"]).select("scene", "frame", *[(F.round(F.col("x")[k], 3) + 0.0).alias(f"x{k}") for k in range(6)], "n_pixels", "n_close")


def correlation_lookup(spark, d):
    """Each label's embeddings as a feature map eight cells wide, looked up in the next label's at two levels."""
    n = F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1
    features = px.points(spark, d).where("label is not null").select(F.lit(0).alias("scene"), F.col("label").cast("long").alias("frame"), n.alias("n"), F.col("e").cast("array<double>").alias("f")).select("scene", "frame", F.floor(F.col("n") / 8).alias("y"), (F.col("n") % 8).cast("long").alias("x"), "f")
    asked = features.select("scene", F.col("frame").alias("i"), (F.col("frame") + 1).alias("j"), "y", "x", (F.col("x") + 0.25).alias("u"), (F.col("y") - 0.5).alias("v"))
    found = correlation.lookup(features, asked, levels=2, radius=1)
    return found.select("i", "y", "x", "level", *[(F.round(F.col("window")[k], 6) + 0.0).alias(f"w{k}") for k in range(9)])


def _turned(q, v):
    """SQL of v turned by q, as lists of names."""
    x, y, z, w = q
    c = [f"({y} * {v[2]} - {z} * {v[1]})", f"({z} * {v[0]} - {x} * {v[2]})", f"({x} * {v[1]} - {y} * {v[0]})"]
    return [f"({v[0]} + 2 * ({w} * {c[0]} + {y} * {c[2]} - {z} * {c[1]}))", f"({v[1]} + 2 * ({w} * {c[1]} + {z} * {c[0]} - {x} * {c[2]}))", f"({v[2]} + 2 * ({w} * {c[2]} + {x} * {c[1]} - {y} * {c[0]}))"]


def _times(a, b):
    return [f"({a[3]} * {b[k]} + {b[3]} * {a[k]} + {a[(k + 1) % 3]} * {b[(k + 2) % 3]} - {a[(k + 2) % 3]} * {b[(k + 1) % 3]})" for k in range(3)] + [f"({a[3]} * {b[3]} - {a[0]} * {b[0]} - {a[1]} * {b[1]} - {a[2]} * {b[2]})"]


def _named(exprs, name):
    return ", ".join(f"{e} AS {name}{k}" for k, e in enumerate(exprs))


def _of(name, first, last):
    return [f"{name}{k}" for k in range(first, last)]


def _cross(a, b):
    return [f"({a[(k + 1) % 3]} * {b[(k + 2) % 3]} - {a[(k + 2) % 3]} * {b[(k + 1) % 3]})" for k in range(3)]


def _moved(source: str, share: str) -> str:
    """CTEs after one with the poses l0..l6, r0..r6: the pose at `share` of the way, as p0..p6."""
    back = [f"-l{k}" for k in (3, 4, 5)] + ["l6"]
    phi, tau = _of("g", 0, 3), _of("d", 0, 3)
    return f"""s1 AS (SELECT *, {_named([f"-{e}" for e in _turned(back, _of("l", 0, 3))], "i")}, {_named(_times(_of("r", 3, 7), back), "q")} FROM {source}),
s2 AS (SELECT *, {_named([f"r{k} + {e}" for k, e in enumerate(_turned(_of("r", 3, 7), _of("i", 0, 3)))], "d")}, CASE WHEN q3 < 0 THEN -1 ELSE 1 END AS sign, sqrt(q0 * q0 + q1 * q1 + q2 * q2) AS sine FROM s1),
s3 AS (SELECT *, atan2(sine, sign * q3) AS half FROM s2),
s4 AS (SELECT *, sign * CASE WHEN sine < 1e-9 THEN 2 ELSE 2 * half / sine END AS scale, CASE WHEN sine < 1e-4 THEN 1.0::DOUBLE / 12 + half * half / 180 ELSE (1 - half * sign * q3 / sine) / (4 * half * half) END AS c FROM s3),
s5 AS (SELECT *, {_named([f"q{k} * scale" for k in range(3)], "g")} FROM s4),
s6 AS (SELECT *, {_named(_cross(phi, tau), "x")} FROM s5), s7 AS (SELECT *, {_named(_cross(phi, _of("x", 0, 3)), "y")} FROM s6),
s8 AS (SELECT *, {_named([f"({share}) * (d{k} - x{k} / 2 + c * y{k})" for k in range(3)], "t")}, {_named([f"({share}) * g{k}" for k in range(3)], "f")} FROM s7),
s9 AS (SELECT *, sqrt(f0 * f0 + f1 * f1 + f2 * f2) AS a, {_named(_cross(_of("f", 0, 3), _of("t", 0, 3)), "m")} FROM s8),
s10 AS (SELECT *, CASE WHEN a < 1e-9 THEN 0.5::DOUBLE ELSE sin(a / 2) / a END AS h, CASE WHEN a < 1e-2 THEN 1.0::DOUBLE / 6 - a * a / 120 ELSE (a - sin(a)) / (a * a * a) END AS e, {_named(_cross(_of("f", 0, 3), _of("m", 0, 3)), "n")} FROM s9),
s11 AS (SELECT *, {_named([f"t{k} + 2 * h * h * m{k} + e * n{k}" for k in range(3)] + [f"f{k} * h" for k in range(3)] + ["cos(a / 2)"], "e")} FROM s10),
moved AS (SELECT *, {_named([f"e{k} + {v}" for k, v in enumerate(_turned(_of("e", 3, 7), _of("l", 0, 3)))] + _times(_of("e", 3, 7), _of("l", 3, 7)), "p")} FROM s11)"""


_AXIS = [f"(CASE id % 3 WHEN 0 THEN {AXES[0][k]} WHEN 1 THEN {AXES[1][k]} ELSE {AXES[2][k]} END) / 3.0::DOUBLE" for k in range(3)]
_POSE = ["v / 50", "(id % 7) / 3.0::DOUBLE", "(id % 5) / 4.0::DOUBLE"] + [f"{a} * sin(v / 320)" for a in _AXIS] + ["cos(v / 320)"]
POSED = f"{px.STREAM}, posed AS (SELECT u, id, row_number() OVER (PARTITION BY u ORDER BY t, id) AS n, event_type = 'purchase' AS key, {_named(_POSE, 'v')} FROM stream)"
_BOTH = ", ".join(f"l.v{k} AS l{k}, r.v{k} AS r{k}" for k in range(7))
_OUT = ", ".join(f"round(p{k}, 6) AS p{k}" for k in range(7))

QUERIES = {f.__name__: f for f in (pose_infill, pose_extrapolation, bundle_adjustment, correlation_lookup)}
SQL = {
    "pose_infill": f"""WITH {POSED}, b AS (SELECT o.u, o.id, o.n, (SELECT max(n) FROM posed k WHERE key AND k.u = o.u AND k.n < o.n) AS ln, (SELECT min(n) FROM posed k WHERE key AND k.u = o.u AND k.n > o.n) AS rn FROM posed o WHERE NOT key),
pair AS (SELECT b.id, CAST(b.n - l.n AS DOUBLE) / (r.n - l.n + 1e-3::DOUBLE) AS share, {_BOTH} FROM b JOIN posed l ON l.u = b.u AND l.n = coalesce(ln, rn) JOIN posed r ON r.u = b.u AND r.n = coalesce(rn, ln)), {_moved("pair", "share")}
SELECT id, {_OUT} FROM moved UNION ALL SELECT id, {", ".join(f"round(v{k}, 6) AS p{k}" for k in range(7))} FROM posed WHERE key""",
    "correlation_lookup": f"""WITH n AS (SELECT label AS i, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS f FROM embeddings WHERE label IS NOT NULL),
f0 AS (SELECT i, n // 8 AS y, n % 8 AS x, f FROM n), parts AS (SELECT i, y // 2 AS y, x // 2 AS x, k, avg(f[k]) AS v FROM f0, range(1, 65) r(k) GROUP BY ALL HAVING count(*) = 4),
cells AS (SELECT i, 0 AS level, y, x, f FROM f0 UNION ALL SELECT i, 1, y, x, list(v ORDER BY k) FROM parts GROUP BY i, y, x),
asked AS (SELECT i, y, x, f, level, (x + 0.25::DOUBLE) / pow(2, level) AS u, (y - 0.5::DOUBLE) / pow(2, level) AS v FROM f0, range(2) r(level)),
taps AS (SELECT a.i, a.y, a.x, a.level, a.f, di, dj, CAST(floor(u) AS BIGINT) + di + p AS cx, CAST(floor(v) AS BIGINT) + dj + q AS cy, CASE p WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE q WHEN 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END AS weight
  FROM asked a, range(-1, 2) a1(di), range(-1, 2) a2(dj), range(2) a3(p), range(2) a4(q)),
looked AS (SELECT t.i, t.y, t.x, t.level, di, dj, sum(weight * coalesce(list_dot_product(t.f, c.f), 0) / 16) AS v FROM taps t LEFT JOIN cells c ON c.i = t.i + 1 AND c.level = t.level AND c.x = cx AND c.y = cy GROUP BY ALL),
w AS (SELECT i, y, x, level, list(v ORDER BY di, dj) AS w FROM looked GROUP BY ALL)
SELECT CAST(i AS BIGINT) AS i, y, x, CAST(level AS INTEGER) AS level, {", ".join(f"round(w[{k + 1}], 6) + 0.0 AS w{k}" for k in range(9))} FROM w""",
    # without noise, what is seen fixes every pose and inverse depth
    "bundle_adjustment": "WITH m(frame, x0, x1, x2, x3, x4, x5) AS (VALUES " + ", ".join(f"({k}, " + ", ".join(f"{x}::DOUBLE" for x in m) + ")" for k, m in enumerate(MOTION)) + """)
SELECT label AS scene, CAST(frame AS BIGINT) AS frame, x0, x1, x2, x3, x4, x5, count(*) AS n_pixels, count(*) AS n_close FROM embeddings JOIN m ON frame = vec_id % 4 WHERE label IS NOT NULL GROUP BY ALL""",
    # the last step moved on by half of itself is one and a half of it from the pose before
    "pose_extrapolation": f"""WITH {POSED}, pair AS (SELECT o.id, {_BOTH} FROM posed o JOIN posed l ON l.u = o.u AND l.n = o.n - 2 JOIN posed r ON r.u = o.u AND r.n = o.n - 1), {_moved("pair", "1.5::DOUBLE")}
SELECT id, {_OUT} FROM moved""",
}
