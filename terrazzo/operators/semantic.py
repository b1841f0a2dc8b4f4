"""Descriptor fields: weighted fusion, pooling over hypotheses, overlap, text scores, labels.

Vectors are summed element by element in long form (id, dim, value), which aggregates partially
before its shuffle whatever the vectors' length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazzo.functions.vectors import observed
from terrazzo.operators.common import first_in


def long_form(points: DataFrame, vector: str = "e", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, dim, value of every observed vector (a vector of zeros is unobserved)."""
    return points.where(observed(F.col(vector))).select(*keys, F.posexplode(vector).alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


def weighted_mean(points: DataFrame, key: str, weight: Column, vector: str = "e") -> DataFrame:
    """key, dim, value: sum of weighted vectors over the sum of weights."""
    rows = points.where(observed(F.col(vector))).select(key, weight.cast("double").alias("w"), F.posexplode(vector).alias("dim", "value"))
    return rows.groupBy(key, "dim").agg((F.sum(F.col("w") * F.col("value").cast("double")) / F.sum("w")).alias("value"))


def pool(points: DataFrame, membership: DataFrame, vector: str = "e") -> DataFrame:
    """hyp, dim, value: mean over a hypothesis' observed points; none observed, no row."""
    held = membership.join(points.where(observed(F.col(vector))).select("id", vector), "id")  # whole vectors are shuffled, not their elements
    return held.select("hyp", F.posexplode(vector).alias("dim", "value")).groupBy("hyp", "dim").agg(F.avg(F.col("value").cast("double")).alias("value"))


def overlap(pooled: DataFrame, membership: DataFrame) -> DataFrame:
    """id, dim, value: mean over the pooled hypotheses that hold a point; uncovered, no row.

    Points in the same hypotheses have the same mean, which is taken once for each such set and not for each point.
    """
    held = membership.groupBy("id").agg(F.sort_array(F.collect_list("hyp")).alias("hyps"))
    means = held.select("hyps").distinct().withColumn("hyp", F.explode("hyps")).join(pooled, "hyp").groupBy("hyps", "dim").agg(F.avg("value").alias("value"))
    return held.join(means, "hyps").select("id", "dim", "value")


def cosines(field: DataFrame, queries: DataFrame, floor: float = 1e-8) -> DataFrame:
    """id, query, cos of long vectors; queries is a small table and is joined by dimension."""
    dots = field.join(queries.select("query", "dim", F.col("value").alias("q")), "dim").groupBy("id", "query").agg(F.sum(F.col("value") * F.col("q")).alias("dot"))
    one = field.groupBy("id").agg(F.greatest(F.sqrt(F.sum(F.col("value") * F.col("value"))), F.lit(floor)).alias("n1"))
    two = queries.groupBy("query").agg(F.greatest(F.sqrt(F.sum(F.col("value") * F.col("value"))), F.lit(floor)).alias("n2"))
    return dots.join(one, "id").join(two, "query").select("id", "query", (F.col("dot") / F.col("n1") / F.col("n2")).alias("cos"))


def text_scores(scores: DataFrame, negatives: DataFrame, temperature: float = 0.5) -> DataFrame:
    """id, query, score: softmax of a query against the negatives alone; queries don't compete."""
    rest = negatives.groupBy("id").agg(F.sum(F.exp(F.col("cos") / temperature)).alias("rest"))
    mine = F.exp(F.col("cos") / temperature)
    return scores.join(rest, "id").select("id", "query", (mine / (mine + F.col("rest"))).alias("score"))


def top_label(scores: DataFrame) -> DataFrame:
    """id, query: the query of greatest cosine, the first if tied."""
    return first_in(scores, ["id"], [F.desc("cos"), "query"]).select("id", "query")


def moments(field: DataFrame, vector: str = "e") -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean and covariance of vectors of one length.

    Each task adds up products of its rows; what is shuffled is a row of the matrix for each task, and
    only the matrix comes to the driver.
    """

    def add(batches):
        total = None
        for batch in batches:
            lists = batch.column(0)
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64) if len(lists) else None
            if x is None:
                continue
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["k", "sums"])

    def together(table: pa.Table) -> pa.Table:
        sums = np.stack(table["sums"].to_pylist()).sum(axis=0)
        return pa.table({"k": pa.array([table["k"][0].as_py()], pa.int64()), "sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    parts = field.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(add, "k long, sums array<double>")
    rows = parts.groupBy("k").applyInArrow(together, "k long, sums array<double>").orderBy("k").collect()  # a row a dimension
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    whole = np.array([r.sums for r in rows])
    n, mean = int(whole[0, 0]), whole[0, 1:] / whole[0, 0]
    return n, mean, whole[1:, 1:] / n - np.outer(mean, mean)


def principal_colors(field: DataFrame, vector: str = "e", most: int = 100_000, seed: int = 0) -> DataFrame:
    """id, c0, c1, c2: three principal components, scaled to 0..1 by their 1st and 99th percentile.

    The components and percentiles come from a sample of at most about `most` vectors, which stays on
    the executors; every row is projected. Unobserved rows have none.
    """
    rows = field.where(observed(F.col(vector)))
    share = min(1.0, most / max(1, rows.count()))
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000)
    n, mean, covariance = moments(chosen, vector)
    if not n:
        return rows.select("id", *[F.lit(None).cast("double").alias(f"c{k}") for k in range(3)])
    axes = np.linalg.eigh(covariance)[1].T[::-1][:3]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]

    def along(axis: np.ndarray) -> Column:
        weights = F.array(*[F.lit(float(x)) for x in axis])
        return F.aggregate(F.zip_with(F.col(vector), weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) - float(mean @ axis)

    # of the sample, so the buffers are bounded
    ends = chosen.select(*[along(axis).alias(f"c{k}") for k, axis in enumerate(axes)]).agg(*[F.percentile(f"c{k}", F.array(F.lit(0.01), F.lit(0.99))) for k in range(len(axes))]).first()
    scaled = [(along(axis) - float(low)) / max(float(high - low), 1e-12) for axis, (low, high) in zip(axes, ends)]
    return rows.select("id", *[F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)).alias(f"c{k}") for k, c in enumerate(scaled)])
