"""Camera motion between keyframes, on poses as arrays of 7 doubles (see functions.se3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrazzo.functions import se3
from terrazzo.operators import temporal


def infilled(frames: DataFrame, key: str, is_key: Column, eps: float = 1e-3) -> DataFrame:
    """key, id, pose of every frame of frames(key, id, t, v = pose): keyframes keep theirs, the others
    get the pose at constant velocity between the keyframes around them; `eps` is added to the gap.

    Before the first and after the last keyframe its pose holds. A key without keyframes has no rows.
    """
    between = temporal.bracket(frames, key, is_key)
    share = (F.col("t") - F.col("lt")) / ((F.col("rt") - F.col("lt")) + eps)
    filled = between.select(key, "id", se3.interpolate(F.col("lv"), F.col("rv"), share).alias("pose"))
    return frames.where(is_key).select(key, "id", F.col("v").alias("pose")).unionByName(filled)


def extrapolated(frames: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """key, id, pose that each frame starts from: the pose before it, moved on by a share of the step
    that led there. The first two frames of a key have no such pose."""
    w = Window.partitionBy(key).orderBy("t", "id")
    rows = frames.select(key, "id", F.lag("v", 2).over(w).alias("before"), F.lag("v").over(w).alias("last"))
    return rows.where("before is not null and last is not null").select(key, "id", se3.extrapolate(F.col("before"), F.col("last"), share).alias("pose"))
