"""Correlation lookups between the feature maps of frames, without the volume of all pairs.

The average of a volume's cells is the correlation with the average of the features, so the levels of
the pyramid are pooled features. They are made tile by tile (a tile is 2^(levels - 1) cells or a multiple
wide, so no cell of a level spans two). For the lookups each level's cells are dealt into tiles with a
halo as wide as the window reaches; a lookup meets the one tile that its centre lies in, and only the
dot products that its window asks for are computed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 16
#: What products are divided by.
SCALE = 16.0
#: Lookups of a tile that are computed together.
TOGETHER = 512


def pooled(features: DataFrame, levels: int = 4) -> DataFrame:
    """scene, frame, level, y, x, f of features(scene, frame, y, x, f) and of their averages over 2 x 2
    cells, level by level; a cell without all four parts is left out, as odd borders are."""
    size = 1 << max(levels - 1, 4)
    kind = features.schema["scene"].dataType.simpleString()

    def pool(rows: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = rows.y.min() // size * size, rows.x.min() // size * size
        f = np.stack(rows.f.to_numpy()).astype(float)
        cells, held = np.zeros((size, size, f.shape[1])), np.zeros((size, size), bool)
        cells[rows.y - y0, rows.x - x0], held[rows.y - y0, rows.x - x0] = f, True
        out = []
        for level in range(levels):
            if level:
                n = len(cells) // 2
                cells = cells.reshape(n, 2, n, 2, -1).mean(axis=(1, 3))
                held = held.reshape(n, 2, n, 2).all(axis=(1, 3))
            y, x = np.nonzero(held)
            out.append(pd.DataFrame({"scene": rows.scene.iloc[0], "frame": rows.frame.iloc[0], "level": level, "y": y + (y0 >> level), "x": x + (x0 >> level), "f": list(cells[y, x])}))
        return pd.concat(out)

    tiled = features.select("scene", F.col("frame").cast("long").alias("frame"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("f").cast("array<double>").alias("f"))
    return tiled.groupBy("scene", "frame", F.floor(F.col("y") / size), F.floor(F.col("x") / size)).applyInPandas(pool, f"scene {kind}, frame long, level int, y long, x long, f array<double>")


def _windows(radius: int, tile: int, scale: float):
    side = 2 * radius + 1

    def look(key, cells: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["scene", "i", "j", "y", "x", "level", "window"]
        if not len(asked):
            return pd.DataFrame([], columns=names)
        scene, j, level, ty, tx = key
        halo = radius + 1
        width = tile + 2 * halo + 1
        one = np.stack(asked.f.to_numpy()).astype(float)
        maps = np.zeros((width, width, one.shape[1]))
        y0, x0 = ty * tile - halo, tx * tile - halo
        if len(cells):
            maps[cells.y - y0, cells.x - x0] = np.stack(cells.f.to_numpy())
        u, v = asked.u.to_numpy() / 2**level, asked.v.to_numpy() / 2**level
        left, top = np.floor(u).astype(int), np.floor(v).astype(int)
        grid = np.arange(-radius, radius + 2)
        windows = []
        for k in range(0, len(asked), TOGETHER):
            part = slice(k, k + TOGETHER)
            near = maps[(top[part] - y0)[:, None, None] + grid[None, :, None], (left[part] - x0)[:, None, None] + grid[None, None, :]]
            dots = np.einsum("nabc,nc->nab", near, one[part]) / scale
            a, b = (u - left)[part, None, None], (v - top)[part, None, None]
            rows = dots[:, :-1] * (1 - b) + dots[:, 1:] * b
            windows += list((rows[:, :, :-1] * (1 - a) + rows[:, :, 1:] * a).transpose(0, 2, 1).reshape(len(dots), side * side))
        return pd.DataFrame({"scene": scene, "i": asked.i, "j": j, "y": asked.y, "x": asked.x, "level": level, "window": windows})

    return look


def lookup(features: DataFrame, asked: DataFrame, levels: int = 4, radius: int = 3, tile: int = TILE, scale: float = SCALE) -> DataFrame:
    """scene, i, j, y, x, level, window: for each of asked(scene, i, j, y, x, u, v), bilinear samples around
    (u, v) / 2^level of the products of the cell (y, x) of frame i with frame j over `scale`, (2 radius + 1)^2
    of them, columns first (all places down one, then the next); each of the four cells of a sample that
    lies outside frame j counts 0.

    Lookups without their cell, or with a null or non-finite place, are left out.
    """
    kind = features.schema["scene"].dataType.simpleString()
    every = pooled(features, levels)
    halo = radius + 1
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo - 1) / tile), F.floor((F.col(c) + halo) / tile)))
    cells = every.withColumn("ty", span("y")).withColumn("tx", span("x")).select("scene", F.col("frame").alias("j"), "level", "ty", "tx", "y", "x", "f")
    own = features.select("scene", F.col("frame").cast("long").alias("i"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("f").cast("array<double>").alias("f"))
    finite = "u is not null and v is not null and abs(u) < double('Infinity') and abs(v) < double('Infinity')"
    centre = lambda c: F.floor(F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))) / tile).cast("long")
    wanted = asked.where(finite).select("scene", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")).join(own, ["scene", "i", "y", "x"])
    wanted = wanted.withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(levels)]))).withColumns({"ty": centre("v"), "tx": centre("u")})
    keys = ["scene", "j", "level", "ty", "tx"]
    # a tile without a lookup isn't read, nor one of a frame that isn't there
    used = cells.join(wanted.select(*keys).distinct(), keys, "left_semi")
    return used.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(_windows(radius, tile, scale), f"scene {kind}, i long, j long, y long, x long, level int, window array<double>")
