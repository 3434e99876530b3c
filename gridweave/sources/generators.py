"""Generated inputs.  Random ones are seeded, so a re-run gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def coords(spark: SparkSession, centre: complex = -0.575 - 0.575j, width: float = 0.0025, count: int = 4000) -> DataFrame:
    """(i, j, re, im): a square of the complex plane; rows vary im, columns re."""
    step = width / (count - 1) if count > 1 else 0.0
    at = lambda k, mid: (F.lit(mid - width / 2) + k * F.lit(step)).cast("float")
    cells = spark.range(count * count).select(F.floor(F.col("id") / count).cast("int").alias("i"), (F.col("id") % count).cast("int").alias("j"))
    return cells.select("i", "j", at(F.col("j"), centre.real).alias("re"), at(F.col("i"), centre.imag).alias("im"))


def uniform(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(idx, x): 32-bit floats in [0, 1)."""
    return spark.range(n).select(F.col("id").alias("idx"), F.rand(seed).cast("float").alias("x"))


def balls(spark: SparkSession, n: int, radius: float, seed: int = 0, hole: float = 0.25, speed: float = 0.25) -> DataFrame:
    """(id, x, y, vx, vy) outside of a round hole in the middle.

    Rejection without resampling: positions are drawn in rounds from the same
    distribution, each point takes its first one outside the hole.
    """
    tries = 24
    lo, span = radius, 1 - 2 * radius
    at = lambda k: F.array(F.lit(lo) + F.rand(seed + 2 * k) * span, F.lit(lo) + F.rand(seed + 2 * k + 1) * span)
    drawn = spark.range(n).select("id", F.array(*map(at, range(tries))).alias("p"), (F.rand(seed - 1) * 2 * speed - speed).cast("float").alias("vx"), (F.rand(seed - 2) * 2 * speed - speed).cast("float").alias("vy"))
    out = lambda q: F.sqrt((q[0] - 0.5) * (q[0] - 0.5) + (q[1] - 0.5) * (q[1] - 0.5)) >= hole
    first = F.coalesce(F.get(F.filter("p", out), 0), F.array(F.lit(lo), F.lit(lo)))
    return drawn.withColumn("q", first).select("id", F.col("q")[0].cast("float").alias("x"), F.col("q")[1].cast("float").alias("y"), "vx", "vy")


def moves(spark: SparkSession, n: int, cells: int = 1000, seed: int = 0, spread: int | None = None) -> DataFrame:
    """(seq, src, dest): uniform, or dest within ``spread`` of src on the ring."""
    draw = lambda s, m: F.floor(F.rand(s) * m).cast("int")
    out = spark.range(n).select(F.col("id").alias("seq"), draw(seed, cells).alias("src"), draw(seed + 1, cells if spread is None else 2 * spread + 1).alias("d"))
    dest = F.col("d") if spread is None else F.pmod(F.col("src") + F.col("d") - spread, F.lit(cells))
    return out.select("seq", "src", dest.cast("int").alias("dest"))


def counters(spark: SparkSession, n: int = 1000) -> DataFrame:
    """(cell, n) with n = cell."""
    return spark.range(n).select(F.col("id").cast("int").alias("cell"), F.col("id").cast("long").alias("n"))


def jobs(spark: SparkSession, n: int = 10) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("job"))


def ball_radius_spacing(radius: float) -> float:
    """The side of a cell that holds one ball: radius / sqrt 2."""
    return radius / math.sqrt(2)
