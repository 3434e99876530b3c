"""Neighbourhood operators on pixels (i, j, v): the edge-clamped 3x3 median.

Pixels are dealt to square tiles once, with a halo as wide as the number of
passes: a pixel near a border is copied to the tiles around.  In a tile, a pass
is two windows, along rows and along columns, which both agree with the tile
partitioning, so passes cost local sorts and no further shuffle.  What a halo's
outer rim gets wrong moves in by one pixel a pass and never reaches the tile.
At the image's own border no neighbour exists and the pixel stands in for it.

Images are dense; values must not be null or NaN.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import median_of
from ..session import cut


def with_halo(pixels: DataFrame, tile: int, halo: int) -> DataFrame:
    """pixels plus ti, tj: a copy for each tile that needs the pixel."""
    if not 0 <= halo <= tile:
        raise ValueError("the halo must not be wider than a tile")

    def tiles(c: str):
        first, last = F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)
        return F.sequence(F.greatest(first, F.lit(0)).cast("int"), last.cast("int"))

    # tiles beyond the image only hold halo rows, and these are dropped with the rest
    return pixels.withColumn("ti", F.explode(tiles("i"))).withColumn("tj", F.explode(tiles("j")))


def without_halo(df: DataFrame, tile: int) -> DataFrame:
    home = (F.floor(F.col("i") / tile) == F.col("ti")) & (F.floor(F.col("j") / tile) == F.col("tj"))
    return df.where(home).drop("ti", "tj")


def _pass(tiled: DataFrame) -> DataFrame:
    across, down = Window.partitionBy("ti", "tj", "i").orderBy("j"), Window.partitionBy("ti", "tj", "j").orderBy("i")
    v = F.col("v")
    rows = tiled.withColumn("r", F.array(F.coalesce(F.lag(v).over(across), v), v, F.coalesce(F.lead(v).over(across), v)))
    r = F.col("r")
    near = rows.withColumns({"a": F.coalesce(F.lag(r).over(down), r), "b": F.coalesce(F.lead(r).over(down), r)})
    nine = [F.col(c)[k] for c in ("a", "r", "b") for k in range(3)]
    return near.withColumn("v", median_of(nine)).drop("r", "a", "b")


def median_3x3(pixels: DataFrame, iterations: int = 1, tile: int = 128, passes_per_shuffle: int = 8, offset: int = 0, step: int = 1) -> DataFrame:
    """(i, j, v) after ``iterations`` passes; every pass sees the whole one before.

    ``offset`` and ``step`` choose the rows that are returned: offset, offset +
    step and so on.
    """
    out = pixels.select("i", "j", "v")
    left = iterations
    while left:
        now = min(left, passes_per_shuffle, tile)
        tiled = with_halo(out, tile, now).repartition("ti", "tj")
        for _ in range(now):
            tiled = _pass(tiled)
        out, left = without_halo(tiled, tile), left - now
        if left:
            out = cut(out)
    return out if step == 1 and offset == 0 else out.where((F.col("i") >= offset) & ((F.col("i") - offset) % step == 0))


def fetch_clamped(pixels: DataFrame, di: int, dj: int, height: int, width: int, out: str = "near") -> DataFrame:
    """pixels plus the value at (i + di, j + dj), taken from the nearest edge."""
    at = pixels.withColumns({"ni": F.greatest(F.lit(0), F.least(F.lit(height - 1), F.col("i") + di)), "nj": F.greatest(F.lit(0), F.least(F.lit(width - 1), F.col("j") + dj))})
    source = pixels.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("v").alias(out))
    return at.join(source, ["ni", "nj"], "left").drop("ni", "nj")


def numpy_median(image: np.ndarray, iterations: int = 1) -> np.ndarray:
    """The same filter on a dense array, for tests."""
    for _ in range(iterations):
        p = np.pad(image, 1, mode="edge")
        h, w = image.shape
        image = np.median(np.stack([p[a : a + h, b : b + w] for a in range(3) for b in range(3)]), axis=0).astype(image.dtype)
    return image
