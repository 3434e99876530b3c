"""Balls in the unit square (id, x, y, vx, vy): pairs, collisions and steps.

Pairs come from a grid with cells of two radii: a ball meets the balls of its
own cell and, so that each pair is found once, of half of the cells around.  It
is an equi-join on cells, never a comparison of all with all.

The step is order-free: all velocity changes are taken from the state before
and summed by ball, so that it runs in parallel.  ``exact_step`` applies pairs
as if one after another, in the order of ids, in one task; the two differ where
a ball is in several collisions at once, and no equality is claimed.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import cut

HALF = [(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]
#: In ``exact_step``: balls looked up, candidates compared and pairs applied at a time.
ROWS, CANDIDATES, PAIRS = 1 << 16, 1 << 17, 1 << 23


def pairs(balls: DataFrame, radius: float, columns: tuple[str, ...] = ()) -> DataFrame:
    """(id1, id2) of overlapping balls with id1 < id2, and both balls'
    x, y and ``columns`` with the suffixes 1 and 2."""
    names = ("id", "x", "y", *columns)
    side = 2.0 * radius
    cell = lambda c: F.floor(F.col(c) / F.lit(side)).cast("long")
    left = balls.select(*[F.col(c).alias(f"{c}a") for c in names], cell("x").alias("gx"), cell("y").alias("gy"))
    near = F.array(*[F.struct((cell("x") + dx).alias("gx"), (cell("y") + dy).alias("gy"), F.lit(k == 0).alias("own")) for k, (dx, dy) in enumerate(HALF)])
    right = balls.select(*[F.col(c).alias(f"{c}b") for c in names], F.inline(near))
    met = left.join(right, ["gx", "gy"]).where((~F.col("own") & (F.col("ida") != F.col("idb"))) | (F.col("ida") < F.col("idb")))
    met = met.where(S.overlapping(*[F.col(c) for c in ("xa", "ya", "xb", "yb")], radius))
    first = F.col("ida") < F.col("idb")
    return met.select(*[F.when(first, F.col(f"{c}{p}")).otherwise(F.col(f"{c}{q}")).alias(f"{c}{k}") for k, p, q in ((1, "a", "b"), (2, "b", "a")) for c in names])


def pairs_by_theta(balls: DataFrame, radius: float) -> DataFrame:
    """The same pairs by comparing all with all; for small tests of ``pairs``."""
    a = balls.select(F.col("id").alias("id1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = balls.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = S.overlapping(*map(F.col, ("x1", "y1", "x2", "y2")), radius)
    return a.join(b, (F.col("id1") < F.col("id2")) & near).select("id1", "id2")


def velocity_changes(met: DataFrame, strength: float = 1e-5) -> DataFrame:
    """(id, dvx, dvy): one row for each ball of each overlapping pair.

    Pairs that do not move apart exchange the velocity along the line of
    centres; every pair pushes its second ball away.
    """
    c = {k: F.col(k) for k in ("x1", "y1", "x2", "y2", "vx1", "vy1", "vx2", "vy2")}
    hit = F.when(~S.moving_apart(**c), S.collide(**c))
    push = S.separation(c["x1"], c["y1"], c["x2"], c["y2"], strength)
    zero = F.lit(0.0)
    hx, hy = F.coalesce(hit["dx"], zero), F.coalesce(hit["dy"], zero)
    return met.select(F.inline(F.array(
        F.struct(F.col("id1").alias("id"), (-hx).alias("dvx"), (-hy).alias("dvy")),
        F.struct(F.col("id2").alias("id"), (hx + push["dx"]).alias("dvx"), (hy + push["dy"]).alias("dvy")),
    )))


def step(balls: DataFrame, radius: float, t: float, strength: float = 1e-5) -> DataFrame:
    """Walls, then pairs (all from the same state), then positions."""
    at = balls.select("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "vx", "vy")])
    at = at.withColumns({"vx": S.wall_bounce(F.col("x"), F.col("vx"), radius), "vy": S.wall_bounce(F.col("y"), F.col("vy"), radius)})
    change = velocity_changes(pairs(at, radius, ("vx", "vy")), strength).groupBy("id").agg(F.sum("dvx").alias("dvx"), F.sum("dvy").alias("dvy"))
    new = at.join(change, "id", "left").withColumns({"vx": F.col("vx") + F.coalesce("dvx", F.lit(0.0)), "vy": F.col("vy") + F.coalesce("dvy", F.lit(0.0))})
    return new.select("id", S.advance(F.col("x"), F.col("vx"), t).alias("x"), S.advance(F.col("y"), F.col("vy"), t).alias("y"), "vx", "vy")


def simulate(balls: DataFrame, radius: float, t: float, steps: int, adapt: float = 0.0, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """``steps`` steps; each state is written before the next.  The first step
    takes ``t``; each later one moves by ``adapt`` towards the seconds that the
    step before it took by ``clock`` (0: all steps are alike)."""
    for _ in range(steps):
        start = clock()
        balls = cut(step(balls, radius, t))
        t = (1 - adapt) * t + adapt * (clock() - start)
    return balls


def _cells(at: np.ndarray) -> np.ndarray:
    """The numbers of cells along one axis, with gaps of empty ones cut to one."""
    taken, back = np.unique(at, return_inverse=True)
    return np.concatenate(([0.0], np.cumsum(np.minimum(np.diff(taken), 2)))).astype(np.int64)[back]


def _overlaps(x: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, m) with k < m of all overlapping balls, in chunks; a k's pairs are all
    in one chunk, and chunks come by k."""
    cell = np.floor(x / (2 * radius * (1 + 1e-9)))  # a rounded quotient must not part balls that just overlap
    placed = np.flatnonzero(np.isfinite(cell).all(axis=1))
    n = len(placed)
    if not n:
        return
    gx, gy = _cells(cell[placed, 0]), _cells(cell[placed, 1])
    width = gy.max() + 3
    code = gx * width + gy
    around = np.array([da * width + db for da in (-1, 0, 1) for db in (-1, 0, 1)])
    codes, own = np.unique(code, return_inverse=True)
    members = np.argsort(own, kind="stable")
    keys = own[members] * n + members
    last = np.append(np.searchsorted(own[members], np.arange(len(codes)), side="right"), n)
    x, y = x[placed].T.copy()
    xs, ys = x[members], y[members]
    for a in range(0, n, ROWS):
        k = np.arange(a, min(n, a + ROWS))
        wanted = code[k, None] + around
        near = np.searchsorted(codes, wanted)
        near[codes[np.minimum(near, len(codes) - 1)] != wanted] = len(codes)
        begin = np.searchsorted(keys, near * n + k[:, None], side="right")
        count = last[near] - begin
        upto = np.append(0, np.cumsum(count.sum(axis=1)))
        row = 0
        while row < len(k):
            to = max(row + 1, int(np.searchsorted(upto, upto[row] + CANDIDATES, side="right")) - 1)
            many, each = count[row:to].ravel(), count[row:to].sum(axis=1)
            at = np.arange(upto[to] - upto[row]) + np.repeat(begin[row:to].ravel() - (np.cumsum(many) - many), many)
            dx, dy = np.repeat(x[k[row:to]], each) - xs[at], np.repeat(y[k[row:to]], each) - ys[at]
            met = np.flatnonzero(dx * dx + dy * dy < 4 * radius * radius)
            yield placed[np.repeat(k[row:to], each)[met]], placed[members[at[met]]]
            row = to


def _collide(links: list[np.ndarray], x: np.ndarray, v: np.ndarray, strength: float) -> None:
    """Change ``v`` by pairs (k, m) in their order.

    ``links`` has k << 32 | m and m << 32 | k of each pair, and is emptied.  A
    ball meets others by their ids, so a pair's turn has come when each of its
    balls has the other as its next.  Such pairs share no ball, and are done at
    once.
    """
    n = len(x)
    other = np.concatenate((*links, (np.arange(n) << 32) | n))  # a ball's list ends with n
    links.clear()
    other.sort()
    other &= (1 << 32) - 1
    at = np.append(0, np.flatnonzero(other == n)[:-1] + 1)
    after = np.append(other[at], -1)
    seen = np.empty(n, np.int64)
    k = np.flatnonzero((after[after[:n]] == np.arange(n)) & (np.arange(n) < after[:n]))
    (px, py), (vx, vy) = x.T.copy(), v.T.copy()
    while len(k):
        m = after.take(k)
        dx, dy = px.take(k) - px.take(m), py.take(k) - py.take(m)
        ax, ay, bx, by = vx.take(k), vy.take(k), vx.take(m), vy.take(m)
        gap, along = dx * dx + dy * dy, dx * (ax - bx) + dy * (ay - by)
        hit = np.fmin(along, 0.0) / np.maximum(gap, 5e-324)  # 0 if they move apart or lie on one point
        cx, cy = hit * dx, hit * dy
        vx[k], vy[k] = ax - cx, ay - cy
        vx[m], vy[m] = bx + cx - strength * dx, by + cy - strength * dy
        moved = np.concatenate((k, m))
        to = at.take(moved) + 1
        at[moved] = to
        to = other.take(to)
        after[moved] = to
        ready = np.flatnonzero(after.take(to) == moved)
        k = np.minimum(moved.take(ready), to.take(ready))
        seen[k] = ready  # a pair found from both of its balls counts once
        k = k[seen.take(k) == ready]
    v[:, 0], v[:, 1] = vx, vy


@np.errstate(all="ignore")
def _exact(part: pd.DataFrame, radius: float, t: float, strength: float) -> pd.DataFrame:
    part = part.sort_values(["id", "x", "y", "vx", "vy"], ignore_index=True)
    x, v = part[["x", "y"]].to_numpy(float), part[["vx", "vy"]].to_numpy(float)
    flip = ((x < radius) & (v < 0)) | ((x > 1 - radius) & (v > 0))
    v[flip] = -v[flip]
    links: list[np.ndarray] = []
    held = 0
    for k, m in _overlaps(x, radius):
        links += [(k << 32) | m, (m << 32) | k]
        held += len(k)
        if held >= PAIRS:
            _collide(links, x, v, strength)
            held = 0
    if held:
        _collide(links, x, v, strength)
    x = x + v * t
    return part.assign(x=x[:, 0], y=x[:, 1], vx=v[:, 0], vy=v[:, 1])


def exact_step(balls: DataFrame, radius: float, t: float, strength: float = 1e-5) -> DataFrame:
    """One step with pairs in the order of ids, each seeing the ones before.

    All balls are one group in one task, as the meaning demands: it holds the
    balls and some millions of pairs at a time.  Its work grows with the number
    of pairs; for more of them use ``step``.
    """
    shape = "id long, x double, y double, vx double, vy double"
    rows = balls.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "vx", "vy")])
    return rows.groupBy().applyInPandas(lambda part: _exact(part, radius, t, strength), shape)


def occupancy(balls: DataFrame, radius: float) -> DataFrame:
    """(gx, gy, id): the ball of the largest id in each occupied cell of side
    radius / sqrt 2; the dense grid is never made."""
    s = radius / math.sqrt(2)
    cells = balls.select(S.grid_cell(F.col("x"), s).alias("gx"), S.grid_cell(F.col("y"), s).alias("gy"), "id")
    return cells.groupBy("gx", "gy").agg(F.max("id").alias("id"))


def by_location(balls: DataFrame, radius: float) -> DataFrame:
    """Rows in Z order of their cells, range-partitioned: near balls, near rows."""
    s = radius / math.sqrt(2)
    z = S.z_order(S.grid_cell(F.col("x"), s), S.grid_cell(F.col("y"), s))
    return balls.withColumn("z", z).orderBy("z", "id").drop("z")


def without_hole(balls: DataFrame, hole: float = 0.25) -> DataFrame:
    """Balls outside of the round hole in the middle."""
    return balls.where(~(S.distance(F.col("x"), F.col("y")) < hole))
