"""Element-wise expressions on columns.

All stay inside Spark's generated code.  Where 32-bit floats are the contract,
results that Spark widens to double are cast back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def col(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def magnitude_squared(re: Column, im: Column) -> Column:
    """|z|^2, in double."""
    re, im = re.cast("double"), im.cast("double")
    return re * re + im * im


def ceil_div(a: Number, b: Number) -> Column:
    return F.ceil(col(a) / col(b)).cast("long")


def round_up(a: Number, b: Number) -> Column:
    """The next multiple of ``b``."""
    return ceil_div(a, b) * col(b)


def log_intensity(c: Column, shifted: bool = True) -> Column:
    """log(c + 1), or log(c) with null where c is not positive."""
    return F.log1p(c) if shifted else F.when(c > 0, F.ln(c))


def wrap(x: Column, n: int) -> Column:
    """Position on a ring of n places."""
    return F.pmod(x, F.lit(n))


def distance(x: Column, y: Column, cx: float = 0.5, cy: float = 0.5) -> Column:
    dx, dy = x - F.lit(cx), y - F.lit(cy)
    return F.sqrt(dx * dx + dy * dy)


def grid_cell(pos: Column, spacing: float) -> Column:
    """The cell of a coordinate; null where there is none."""
    return F.floor(pos / F.lit(float(spacing))).cast("int")


def grid_size(spacing: float) -> int:
    return int(1 / spacing + 1)


def overlapping(x1: Column, y1: Column, x2: Column, y2: Column, radius: float) -> Column:
    """Centres closer than two radii; strict."""
    dx, dy = x1 - x2, y1 - y2
    return dx * dx + dy * dy < F.lit(4.0 * radius * radius)


def moving_apart(x1, y1, x2, y2, vx1, vy1, vx2, vy2) -> Column:
    return (x2 - x1) * (vx2 - vx1) + (y2 - y1) * (vy2 - vy1) > 0


def collide(x1, y1, x2, y2, vx1, vy1, vx2, vy2) -> Column:
    """What an elastic collision of equal masses takes from v1 and gives to v2:
    (dx, dy); null where the centres coincide."""
    dx, dy = x1 - x2, y1 - y2
    along = F.try_divide((vx1 - vx2) * dx + (vy1 - vy2) * dy, dx * dx + dy * dy)
    return F.struct((along * dx).alias("dx"), (along * dy).alias("dy"))


def separation(x1, y1, x2, y2, strength: float = 1e-5) -> Column:
    """The push that every overlapping pair gives its second member."""
    return F.struct((strength * (x2 - x1)).alias("dx"), (strength * (y2 - y1)).alias("dy"))


def wall_bounce(x: Column, v: Column, radius: float) -> Column:
    """The velocity after the walls at 0 and 1, for one axis."""
    return F.when(((x < radius) & (v < 0)) | ((x > 1 - radius) & (v > 0)), -v).otherwise(v)


def advance(x: Column, v: Column, t: float) -> Column:
    return x + v * F.lit(t)


def masked_sqrt(x: Column, limit: float = 2.0) -> Column:
    """sqrt(x) as a 32-bit float, 0 where it exceeds the limit."""
    root = F.sqrt(x).cast("float")
    return F.when(root <= F.lit(limit).cast("float"), root).otherwise(F.lit(0.0).cast("float"))


def median_of(values: Sequence[Column]) -> Column:
    """The middle of an odd number of values, none of them null or NaN."""
    return F.array_sort(F.array(*values))[len(values) // 2]


def z_order(x: Column, y: Column, bits: int = 16) -> Column:
    """Interleaved bits of two non-negative cell numbers: a locality order."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for k, c in enumerate((x, y)):
            bit = F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1))
            out = out + F.shiftleft(bit, 2 * b + k)
    return out
