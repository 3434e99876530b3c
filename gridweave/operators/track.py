"""Series: exponential smoothing, blind prediction, Kalman filtering, frame rates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold


def ema(df: DataFrame, key: str, order: list[str], value: str, rate: float = 0.1) -> DataFrame:
    """(key, n, ema): the last value of s = (1 - rate) s + rate x, from s = x first.

    The recurrence is linear, so it is a weighted sum by distance from the end:
    a sort by key and an aggregate, without leaving Spark's own expressions.
    """
    rows = df.where(F.col(value).isNotNull())
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    ranked = rows.select(key, F.col(value).cast("double").alias("_x"), back.alias("_k"))
    kept = F.pow(F.lit(1 - rate), F.col("_k") - 1) * F.col("_x")
    return ranked.groupBy(key).agg(F.count("*").alias("n"), (rate * F.sum(kept) + (1 - rate) * F.max_by(kept, "_k")).alias("ema"))


def kalman_scalar(df: DataFrame, key: str, order: list[str], value: str, q: float = 1e-2, r: float = 1.0, p0: float = 1.0) -> DataFrame:
    """(key, n, m, p): a random-walk state seen directly, from m = first value.

    Gains do not depend on the values, so m is a sum of them by weights that the
    place in the series gives: a sort by key and an aggregate.  The variance goes
    p -> (r p + r q) / (p + q + r); ``scale`` is the denominators' product after i
    values over the i-th power of the larger eigenvalue of that map, and
    ``part`` the gain times that.
    """
    if not (q >= 0 and r > 0 and p0 >= 0):
        raise ValueError("q and p0 must not be negative, r must be positive")
    root = math.sqrt(q * (q + 4 * r))
    fall = 2 * r / (q + 2 * r + root)
    c = (p0 + q + r - r * fall) / root if root else 1.0

    def scale(i: Column) -> Column:
        return c + (1 - c) * F.pow(F.lit(fall), 2 * i) if root else 1 + i * (p0 / r)

    def part(i: Column) -> Column:
        return c * (root - q) / (2 * r) - (1 - c) * (root + q) / (2 * r) * F.pow(F.lit(fall), 2 * i) if root else F.lit(p0 / r)

    place = Window.partitionBy(key).orderBy(*order, value)
    count = F.count("*").over(place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    rows = rows.select(key, F.col(value).cast("double").alias("_x"), (F.row_number().over(place) - 1).alias("_i"), count.alias("_n"))
    i, end = F.col("_i"), F.col("n") - 1
    weight = F.when(i == 0, 1.0).otherwise(part(i)) * F.pow(F.lit(fall), F.col("_n") - 1 - i)
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(weight * F.col("_x")).alias("m"))
    return out.select(key, "n", (F.col("m") / scale(end)).alias("m"), (r * part(end) / scale(end)).alias("p"))


def motion(dt: float, drag: float = 0.0) -> np.ndarray:
    """Transition of (x, y, z, vx, vy, vz) over one step."""
    a = np.eye(6)
    a[:3, 3:] = dt * np.eye(3)
    a[3:, 3:] *= 1 - drag * dt
    return a


def predict(df: DataFrame, key: str, steps: int, dt: float = 0.01, gravity: float = 9.81, drag: float = 0.0) -> DataFrame:
    """(key, k, x, y, z, vx, vy, vz): blind propagation s = A s + a of each
    row's state, k = 0 .. steps - 1."""
    names = ("x", "y", "z", "vx", "vy", "vz")
    state = lambda c: F.struct(*[c[n].alias(n) for n in names])

    def go(s: Column) -> Column:
        out = [(s[p] + dt * s["v" + p]).alias(p) for p in "xyz"]
        out += [(s[v] * (1 - drag * dt) - (gravity * dt if v == "vz" else 0.0)).alias(v) for v in ("vx", "vy", "vz")]
        return F.struct(*out)

    first = F.struct(*[F.col(n).cast("double").alias(n) for n in names])
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps - 1)), F.array(first), lambda acc, _: F.concat(acc, F.array(state(go(F.element_at(acc, -1)))))) if steps > 1 else F.array(first)
    return df.select(key, F.posexplode(path).alias("k", "s")).select(key, "k", "s.*")


def kalman_track(df: DataFrame, key: str, initial: list[float], dt: float = 0.01, gravity: float = 9.81, drag: float = 0.0, process: tuple[float, float, float] = (0.25, 0.25, 0.1), gains: tuple[float, float, float] = (1.0, 5.0, 5.0), noise: float = 1.0, p0: float = 0.01) -> DataFrame:
    """(key, k, x, y, z, vx, vy, vz): filtered states of measurements
    (key, k, mx, my, mz), in the order of k.

    State: position and velocity.  Process noise enters the velocities,
    measurements see positions times ``gains``; row k = 0 holds ``initial``.
    """
    a, push = motion(dt, drag), np.zeros(6)
    push[5] = -gravity * dt
    b = np.zeros((6, 6))
    b[3:, 3:] = np.diag(np.square(process))
    c = np.zeros((3, 6))
    c[:, :3] = np.diag(gains)
    r = noise * np.eye(3)

    def step(state: tuple | None, row: tuple) -> tuple:
        if state is None:
            return int(row[0]), np.array(initial, float), p0 * np.eye(6)
        _, s, p = state
        s, p = a @ s + push, a @ p @ a.T + b
        if None not in row[1:]:
            gain = p @ c.T @ np.linalg.inv(c @ p @ c.T + r)
            s, p = s + gain @ (np.array(row[1:], float) - c @ s), (np.eye(6) - gain @ c) @ p
        return int(row[0]), s, p

    shape = f"{key} long, k int, x double, y double, z double, vx double, vy double, vz double"
    return fold(df, [key], ["k"], ["k", "mx", "my", "mz"], shape, lambda key: None, step, lambda key, s: [], each=lambda key, s, row: (*key, s[0], *map(float, s[1])))


def frame_rates(df: DataFrame, key: str, order: list[str], seconds: str, bucket: float = 1 / 30) -> DataFrame:
    """(key, bucket, frames, elapsed, rate): frames are gathered until their
    time exceeds ``bucket``, then a new bucket starts; an unfinished last bucket
    gives no row."""

    def step(state: tuple, row: tuple) -> tuple:
        number, frames, elapsed, done = state
        if done is not None:
            number, frames, elapsed = number + 1, 0, 0.0
        frames, elapsed = frames + 1, elapsed + float(row[0] or 0.0)
        return number, frames, elapsed, frames / elapsed if elapsed > bucket else None

    out = fold(df, [key], order, [seconds], f"{key} long, bucket long, frames long, elapsed double, rate double", lambda k: (0, 0, 0.0, None), step, lambda k, s: [], each=lambda k, s, row: (*k, *s))
    return out.where("rate is not null")
