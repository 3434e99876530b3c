"""Connected regions of foreground pixels (x, y, v), v > 0.

Labels start as the linear index y*w + x, background has the sentinel w*h, and a
region's final label is its smallest index.  Null and NaN pixels are background.
Tiles are labelled on their own (whole-array steps over one tile's pixels in one
task, bounded by the tile's size); only links between tile-local labels across
tile borders go through the distributed components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .graph import components, hook


def foreground(v: Column) -> Column:
    return F.coalesce((v > 0) & ~F.isnan(v), F.lit(False))


def initial_label(width: int, height: int) -> Column:
    return F.when(foreground(F.col("v")), F.col("y").cast("long") * width + F.col("x")).otherwise(F.lit(width * height).cast("long"))


def clamped_label(labels: DataFrame, dx: int, dy: int, width: int, height: int) -> DataFrame:
    """labels plus ``near``: the label at (x + dx, y + dy), the sentinel outside."""
    source = labels.select((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("label").alias("near"))
    return labels.join(source, ["x", "y"], "left").withColumn("near", F.coalesce("near", F.lit(width * height).cast("long")))


def _steps(connectivity: int) -> list[tuple[int, int]]:
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    return [(1, 0), (0, 1)] if connectivity == 4 else [(1, 0), (0, 1), (1, 1), (-1, 1)]


def _label_tile(part: pd.DataFrame, steps: list[tuple[int, int]]) -> pd.DataFrame:
    """The smallest label of each region of one tile."""
    label = part["label"].to_numpy().copy()
    at = np.flatnonzero(label >= 0)
    x, y = part["x"].to_numpy()[at], part["y"].to_numpy()[at]
    if not len(at):
        return part
    x, y = x - x.min() + 1, y - y.min() + 1
    order = np.argsort(label[at], kind="stable")  # so that positions rank as labels do
    x, y = x[order], y[order]
    grid = np.full((y.max() + 2, x.max() + 2), -1)
    grid[y, x] = np.arange(len(at))
    a, b = (np.concatenate(c) for c in zip(*((np.arange(len(at)), grid[y + dy, x + dx]) for dx, dy in steps)))
    a, b = a[b >= 0], b[b >= 0]
    up = hook(a, b, len(at))
    label[at[order]] = label[at][order][up]
    return part.assign(label=label)


def label_regions(pixels: DataFrame, width: int, height: int | None = None, connectivity: int = 4, tile: int = 256) -> DataFrame:
    """(x, y, v, label) for every pixel; ``height`` defaults to what the pixels
    have."""
    steps = _steps(connectivity)
    index = F.when(foreground(F.col("v")), F.col("y").cast("long") * width + F.col("x")).otherwise(F.lit(-1).cast("long"))
    cells = pixels.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("v").cast("double").alias("v"), index.alias("label"), F.floor(F.col("x") / tile).cast("int").alias("tx"), F.floor(F.col("y") / tile).cast("int").alias("ty"))
    local = cut(cells.groupBy("tx", "ty").applyInPandas(lambda part: _label_tile(part, steps), "x int, y int, v double, label long, tx int, ty int"))
    if height is None:
        height = (local.agg(F.max("y")).first()[0] or 0) + 1

    # links between tiles: pixels on a tile's rim meet the neighbours across
    rim = local.where(((F.col("x") % tile).isin(0, tile - 1) | (F.col("y") % tile).isin(0, tile - 1)) & (F.col("label") >= 0)).select("x", "y", "label", "tx", "ty")
    moved = rim.select("label", "tx", "ty", F.inline(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps])))
    there = rim.select("x", "y", F.col("label").alias("other"), F.col("tx").alias("ux"), F.col("ty").alias("uy"))
    links = moved.join(there, ["x", "y"]).where("(tx <> ux or ty <> uy) and label <> other").select(F.col("label").alias("a"), F.col("other").alias("b")).distinct()
    links = cut(links)
    if not links.isEmpty():
        final = components(links).select(F.col("node").alias("label"), F.col("label").alias("final"))
        local = local.join(final, "label", "left").withColumn("label", F.coalesce("final", "label"))
    return local.select("x", "y", "v", F.when(F.col("label") < 0, F.lit(width * height).cast("long")).otherwise(F.col("label")).alias("label"))
