"""Vector-lane algebra: arrays of eight 32-bit floats, lane 0 first.

Masks are arrays of booleans.  Comparisons are ordered: false where either side
is NaN.  A null array gives null.  Every lane-wise operation ``f`` has a form on
single lanes, ``f.lane``: where registers are made into rows of lanes first
(``rows``), operations on lanes compile into the stage, and no array is built
for a result.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 8


def lanewise(f: Callable[..., Column]) -> Callable[..., Column]:
    """The form on arrays of an operation on one to three lanes."""
    n = len(inspect.signature(f).parameters)

    def on_arrays(*registers: Column) -> Column:
        if n == 1:
            return F.transform(registers[0], lambda x: f(x))
        if n == 2:
            return F.zip_with(*registers, lambda x, y: f(x, y))
        a, b, c = registers
        return F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c")), lambda x: f(x["a"], x["b"], x["c"]))

    on_arrays.lane, on_arrays.__doc__, on_arrays.__name__ = f, f.__doc__, f.__name__
    return on_arrays


def rows(df: DataFrame, keep: tuple[str, ...], **registers: Column) -> DataFrame:
    """``keep``, lane and a column for each register: a row for each lane."""
    out = df.select(*keep, F.posexplode(F.arrays_zip(*[c.alias(k) for k, c in registers.items()])).alias("lane", "_l"))
    return out.select(*keep, "lane", *[F.col(f"_l.{k}").alias(k) for k in registers])


def splat(v: Column, n: int = LANES) -> Column:
    return F.array_repeat(v.cast("float"), n)


def make(*high_first: Column) -> Column:
    """Lanes from arguments in the order of registers: the highest lane first."""
    return F.array(*[v.cast("float") for v in reversed(high_first)])


def _float(x: Column) -> Column:
    return x.cast("float")


@lanewise
def add(x: Column, y: Column) -> Column:
    return _float(x + y)


@lanewise
def sub(x: Column, y: Column) -> Column:
    return _float(x - y)


@lanewise
def mul(x: Column, y: Column) -> Column:
    return _float(x * y)


@lanewise
def div(x: Column, y: Column) -> Column:
    """Null where the divisor is zero."""
    return _float(F.try_divide(x, y))


@lanewise
def sqrt(x: Column) -> Column:
    return _float(F.sqrt(x))


@lanewise
def fmadd(x: Column, y: Column, z: Column) -> Column:
    """x * y + z, rounded after each step."""
    return _float(_float(x * y) + z)


@lanewise
def fmsub(x: Column, y: Column, z: Column) -> Column:
    """x * y - z, rounded after each step."""
    return _float(_float(x * y) - z)


def _ordered(x: Column, y: Column) -> Column:
    return ~F.isnan(x) & ~F.isnan(y)


@lanewise
def less_than(x: Column, y: Column) -> Column:
    return (x < y) & _ordered(x, y)


@lanewise
def greater_than(x: Column, y: Column) -> Column:
    return (x > y) & _ordered(x, y)


@lanewise
def bitwise_and(v: Column, mask: Column) -> Column:
    """The value where the mask holds, else 0."""
    return _float(F.when(mask, v).otherwise(0.0))


@lanewise
def bitwise_andnot(mask: Column, v: Column) -> Column:
    """The value where the mask does not hold, else 0."""
    return _float(F.when(mask, 0.0).otherwise(v))


def negative(x: Column) -> Column:
    """Is the sign set?  -0.0 included; NaN counts as positive."""
    return (x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-")))  # only zeros are written out


def signs(v: Column, n: int = LANES) -> Column:
    """Bit k is set where lane k of n is negative."""
    bits = [F.when(negative(F.get(v, F.lit(k))), 1 << k).otherwise(0) for k in range(n)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return F.when(v.isNotNull(), total)


def store(v: Column) -> Column:
    """Lanes as rows: explodes to (lane, x)."""
    return F.posexplode(v)
