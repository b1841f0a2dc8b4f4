"""Evaluation metrics as aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.operators.common import first_in
from terrazzo.operators.spatial import nearest


def pose_auc(errors: DataFrame, thresholds: tuple[int, ...] = (30, 15, 5, 3)) -> DataFrame:
    """threshold, auc of errors(e): mean over 1-degree bins of the cumulative share of pairs.

    An error equal to the threshold falls in the last bin; empty bins count. Each threshold's
    histogram is one aggregate over the errors binned once.
    """
    spark = errors.sparkSession
    whole = errors.select(F.floor("e").alias("bin"), (F.col("e") == F.floor("e")).alias("exact")).groupBy("bin", "exact").agg(F.count(F.lit(1)).alias("c"))
    spine = spark.createDataFrame([(t, b) for t in thresholds for b in range(t)], "threshold int, slot int")
    total = whole.agg(F.sum("c").alias("total"))
    hits = whole.crossJoin(F.broadcast(spine.select("threshold").distinct())).where((F.col("bin") < F.col("threshold")) | ((F.col("bin") == F.col("threshold")) & F.col("exact")))
    hits = hits.groupBy("threshold", F.least("bin", F.col("threshold") - 1).cast("int").alias("slot")).agg(F.sum("c").alias("c"))
    w = Window.partitionBy("threshold").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    filled = spine.join(hits, ["threshold", "slot"], "left").withColumn("cum", F.sum(F.coalesce("c", F.lit(0))).over(w))
    return filled.crossJoin(F.broadcast(total)).groupBy("threshold").agg(F.avg(F.col("cum") / F.col("total")).alias("auc"))


def aligned_rmse(pairs: DataFrame, key: str) -> DataFrame:
    """key, rmse of p against g after the best translation."""
    return pairs.groupBy(key).agg(F.sqrt(F.var_pop(F.col("p") - F.col("g"))).alias("rmse"))


def scale_diagnostic(pairs: DataFrame, key: str) -> DataFrame:
    """key, scale: sum p g / sum p p about the first row; null where undefined. pairs(key, t, id, p, g)."""
    w = Window.partitionBy(key).orderBy("t", "id")
    p, g = F.col("p") - F.first("p").over(w), F.col("g") - F.first("g").over(w)
    sums = pairs.select(key, p.alias("p"), g.alias("g")).groupBy(key).agg(F.sum(F.col("p") * F.col("g")).alias("pg"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    return sums.select(key, F.when(F.col("pp") > 0, F.col("pg") / F.when(F.col("pp") > 0, F.col("pp"))).alias("scale"))


def kabsch(pairs: DataFrame, with_scale: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, translation and scale that map (x, y, z) onto (x2, y2, z2) best.

    Sixteen sums come to the driver, however many pairs there are.
    """
    names = ("x", "y", "z")
    sums = pairs.agg(F.count(F.lit(1)), *[F.avg(c) for c in names], *[F.avg(f"{c}2") for c in names], *[F.avg(F.col(a) * F.col(f"{b}2")) for a in names for b in names], F.avg(sum((F.col(c) * F.col(c) for c in names), F.lit(0.0)))).first()
    if not sums[0]:
        raise ValueError("no pairs to align")
    a, b = np.array(sums[1:4]), np.array(sums[4:7])
    cov = np.array(sums[7:16]).reshape(3, 3) - np.outer(a, b)
    u, s, vt = np.linalg.svd(cov)
    flip = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
    r = vt.T @ flip @ u.T
    scale = float((s * np.diag(flip)).sum() / max(sums[16] - a @ a, 1e-12)) if with_scale else 1.0
    return r, b - scale * r @ a, scale


def reconstruction(pred: DataFrame, truth: DataFrame, radius: float = 0.1) -> DataFrame:
    """One row: accuracy, completeness (mean squared nearest distances) and their mean; inf if empty."""
    inf = F.lit(math.inf)
    acc, comp = (nearest(a, b, 1, radius).agg(F.coalesce(F.avg(F.col("dist") * F.col("dist")), inf).alias(n)) for a, b, n in ((pred, truth, "acc"), (truth, pred, "comp")))
    return acc.crossJoin(comp).withColumn("overall", (F.col("acc") + F.col("comp")) / 2)  # one row each


def instance_ious(membership: DataFrame, labels: DataFrame) -> DataFrame:
    """gt, hyp, iou of all pairs that share a point.

    labels(id, gt): null gt is no instance, but such points still count in a hypothesis' size.
    """
    size = membership.groupBy("hyp").agg(F.count(F.lit(1)).alias("size"))
    truth = labels.where("gt is not null")
    total = truth.groupBy("gt").agg(F.count(F.lit(1)).alias("total"))
    inter = membership.join(truth, "id").groupBy("gt", "hyp").agg(F.count(F.lit(1)).alias("inter"))
    return inter.join(size, "hyp").join(total, "gt").select("gt", "hyp", (F.col("inter").cast("double") / (F.col("size") + F.col("total") - F.col("inter"))).alias("iou"))


def average_recall(ious: DataFrame, labels: DataFrame, thresholds: tuple[float, ...] = tuple(x / 100 for x in range(50, 100, 5))) -> DataFrame:
    """One row: ar, r50, r75, r90, n_gt from each instance's best IoU over all hypotheses."""
    best = labels.where("gt is not null").select("gt").distinct().join(ious.groupBy("gt").agg(F.max("iou").alias("iou")), "gt", "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))
    recall = {t: F.avg((F.col("iou") >= t).cast("double")) for t in {*thresholds, 0.5, 0.75, 0.9}}
    ar = sum((recall[t] for t in thresholds), F.lit(0.0)) / len(thresholds)
    return best.agg(ar.alias("ar"), recall[0.5].alias("r50"), recall[0.75].alias("r75"), recall[0.9].alias("r90"), F.count(F.lit(1)).alias("n_gt"))


def matched_hypotheses(ious: DataFrame, least: float = 0.3) -> DataFrame:
    """hyp: the first best hypothesis of each instance that reaches the bound, each once."""
    return first_in(ious, ["gt"], [F.desc("iou"), "hyp"]).where(F.col("iou") >= least).select("hyp").distinct()


def membership_stats(membership: DataFrame, budget: int) -> DataFrame:
    """One row: points covered, mean and most memberships, points over the budget."""
    per = membership.groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.count(F.lit(1)).alias("n_points"), F.avg("c").alias("mean_memb"), F.max("c").alias("max_memb"), F.sum((F.col("c") > budget).cast("long")).alias("over_budget"))


def psnr(mse: Column, most: float = 255.0) -> Column:
    """20 log10(most / sqrt(mse)), inf at 0."""
    return F.when(mse > 0, 20 * F.log10(F.lit(most) / F.sqrt(F.when(mse > 0, mse)))).otherwise(F.lit(math.inf))


def ssim(a: np.ndarray, b: np.ndarray, most: float = 1.0, window: int = 11, sigma: float = 1.5) -> float:
    """Mean structural similarity of two images, per channel, Gaussian window."""
    x = np.arange(window) - window // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()

    def blur(image: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            image = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, image)
        return image

    a, b = np.atleast_3d(a).astype(float), np.atleast_3d(b).astype(float)
    out = []
    for c in range(a.shape[2]):
        x, y = a[..., c], b[..., c]
        mx, my = blur(x), blur(y)
        vx, vy, xy = blur(x * x) - mx * mx, blur(y * y) - my * my, blur(x * y) - mx * my
        c1, c2 = (0.01 * most) ** 2, (0.03 * most) ** 2
        out.append((((2 * mx * my + c1) * (2 * xy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())
    return float(np.mean(out))


def dashboard(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, before, after, delta, status of every scene of either side; a missing before counts 0."""
    both = before.select(key, F.col("value").alias("before")).join(after.select(key, F.col("value").alias("after")), key, "full_outer")
    status = F.when(F.col("after").isNull(), "missing").when(F.col("before").isNull(), "new").when(F.col("after") > F.col("before"), "up").when(F.col("after") < F.col("before"), "down").otherwise("same")
    return both.withColumns({"delta": F.col("after") - F.coalesce("before", F.lit(0.0)), "status": status})
