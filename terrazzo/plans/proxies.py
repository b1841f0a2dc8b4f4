"""Stand-ins for scene relations, built from the given tables.

evidence: an observation is a lineitem row, its atom the part, its frame the ship year; a mask is
floor((part + year - 1995) / width) at two widths; a node is floor(part / 2^level), levels 2 to 6.
points: the embeddings (place = elements 1-3, normal = elements 4-6 at unit length).
stream: the events of each user by (t, id), times in microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.operators.common import micros
from terrazzo.operators.evidence import count_by

#: (granularity, width) of the masks.
WIDTHS = ((0, 16), (1, 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("atom"), F.year("l_shipdate").cast("int").alias("f")).where("atom is not null and f is not null")  # the same filters in every branch, so their counts are shuffled once


def masked(obs: DataFrame) -> DataFrame:
    """atom, f, g, seg: every observation under the masks that hold it."""
    grains = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(w).alias("w")) for g, w in WIDTHS]))
    rest = [c for c in obs.columns if c not in ("atom", "f")]
    return obs.withColumn("m", grains).select("atom", "f", F.col("m.g").alias("g"), F.floor((F.col("atom") + (F.col("f") - 1995)) / F.col("m.w")).alias("seg"), *rest)


def leaf_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by(observations(spark, sf_dir), "atom", "f", name="n")


def leaf_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted per atom and frame first, then laid under the masks: the explode sees groups, not rows."""
    return masked(leaf_n(spark, sf_dir)).withColumnRenamed("n", "cnt")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lvl, node, atom: every tree node above a part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("atom"), F.explode(F.array(*[F.lit(x) for x in range(2, 7)])).alias("lvl")).select("lvl", F.floor(F.col("atom") / F.pow(F.lit(2.0), F.col("lvl"))).alias("node"), "atom")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"))
    return part.join(part.select((F.col("a") - 1).alias("a")), "a", "left_semi").select("a", (F.col("a") + 1).alias("b"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, seg, id: the points of each hypothesis at the finer width."""
    return masked(observations(spark, sf_dir)).where("g = 0").select("f", "seg", F.col("atom").alias("id")).distinct()


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.col("embedding")[k].cast("double")
    size = F.sqrt(e(3) * e(3) + e(4) * e(4) + e(5) * e(5))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), (e(3) / size).alias("nx"), (e(4) / size).alias("ny"), (e(5) / size).alias("nz"), "label", F.col("embedding").alias("e"))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), micros("ts").alias("t"), F.col("event_id").alias("id"), "event_type", F.col("value").alias("v"))


#: The same stand-ins as SQL, to go after WITH.
OBS = "obs AS (SELECT l_partkey AS atom, CAST(year(l_shipdate) AS INTEGER) AS f FROM lineitem)"
LEAF_N = OBS + ", leaf_n AS (SELECT atom, f, CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY 1, 2)"
LEAF_I = LEAF_N + ", grains(g, w) AS (VALUES (0, 16), (1, 64)), leaf_i AS (SELECT atom, f, g, CAST(floor((atom + (f - 1995)) / w) AS BIGINT) AS seg, n AS cnt FROM leaf_n, grains)"
MEMBERS = "members AS (SELECT CAST(lvl AS INTEGER) AS lvl, CAST(floor(p_partkey / pow(2, lvl)) AS BIGINT) AS node, p_partkey AS atom FROM part, range(2, 7) r(lvl))"
EVIDENCE = LEAF_I + ", " + MEMBERS + """,
node_n AS (SELECT lvl, node, f, CAST(sum(n) AS BIGINT) AS n FROM members JOIN leaf_n USING (atom) GROUP BY 1, 2, 3),
node_size AS (SELECT lvl, node, CAST(sum(n) AS BIGINT) AS size FROM node_n GROUP BY 1, 2),
seen AS (SELECT node_n.*, size FROM node_n JOIN node_size USING (lvl, node) WHERE n >= greatest(8.0::DOUBLE, 0.05::DOUBLE * size)),
node_i AS (SELECT lvl, node, f, g, seg, CAST(sum(cnt) AS BIGINT) AS i FROM members JOIN leaf_i USING (atom) GROUP BY ALL),
mask_q AS (SELECT f, g, seg, CAST(sum(cnt) AS BIGINT) AS q FROM leaf_i GROUP BY ALL),
rows AS (SELECT *, CAST(i AS DOUBLE) / (q + n - i) AS iou, CAST(i AS DOUBLE) / n AS cov, CAST(i AS DOUBLE) / q AS pur FROM node_i JOIN seen USING (lvl, node, f) JOIN mask_q USING (f, g, seg)),
phis AS (SELECT *, pow(cov, 2.0) * pow(pur, 2.0) AS weight, pow(cov, 2.0) * pow(pur, 2.0) * iou AS phi FROM rows WHERE pow(cov, 2.0) * pow(pur, 2.0) >= 0.05)"""
AFFINITY = LEAF_I + """,
edges AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)),
share AS (SELECT atom, f, g, seg, CAST(cnt AS DOUBLE) / n AS x FROM leaf_i JOIN leaf_n USING (atom, f)),
sig AS (SELECT atom, f, g, seg, x / sqrt(sum(x * x) OVER w) * sqrt(least(max(x) OVER w, 1.0)) AS s FROM share WINDOW w AS (PARTITION BY atom, f)),
nums AS (SELECT a, b, sum(sa.s * sb.s) AS num FROM edges JOIN sig sa ON sa.atom = a JOIN sig sb ON sb.atom = b AND sb.f = sa.f AND sb.g = sa.g AND sb.seg = sa.seg GROUP BY 1, 2),
claimed AS (SELECT DISTINCT atom, f, 1 AS m FROM leaf_i),
seen AS (SELECT atom, f, m FROM leaf_n LEFT JOIN claimed USING (atom, f)),
ws AS (SELECT a, b, CAST(count(*) AS BIGINT) AS w FROM edges JOIN seen sa ON sa.atom = a JOIN seen sb ON sb.atom = b AND sb.f = sa.f WHERE sa.m IS NOT NULL OR sb.m IS NOT NULL GROUP BY 1, 2),
aff AS (SELECT a, b, num, w FROM nums JOIN ws USING (a, b) WHERE num > 0 AND w > 0)"""
MEMBERSHIPS = LEAF_I + ", memb AS (SELECT DISTINCT f, seg, atom AS id FROM leaf_i WHERE g = 0)"
POINTS = "points AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS a, CAST(embedding[5] AS DOUBLE) AS b, CAST(embedding[6] AS DOUBLE) AS c, label, embedding AS e FROM embeddings)"
STREAM = "stream AS (SELECT user_id AS u, epoch_us(ts) AS t, event_id AS id, event_type, value AS v FROM events)"
LONG = POINTS + ", long AS (SELECT id, label, CAST(dim - 1 AS INTEGER) AS dim, CAST(e[dim] AS DOUBLE) AS value FROM points, range(1, 65) r(dim) WHERE len(list_filter(e, lambda q: q <> 0)) > 0)"
