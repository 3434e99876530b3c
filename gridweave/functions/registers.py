"""The wider register families: blends, rounding, horizontal sums, permutes.

Registers are arrays; ``half`` is the lanes of one 128-bit half.  Only value
semantics are offered: reinterpreting bits has no column form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lanes import lanewise


def addsub_lane(x: Column, y: Column, lane: Column) -> Column:
    return F.when(lane % 2 == 0, x - y).otherwise(x + y)


def addsub(a: Column, b: Column) -> Column:
    """Even lanes subtract, odd lanes add."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, k: addsub_lane(x["a"], x["b"], k))


def _horizontal(a: Column, b: Column, n: int, half: int, sign: int) -> Column:
    out = []
    for h in range(0, n, half):
        for side in (a, b):
            out += [side[h + k] + side[h + k + 1] if sign > 0 else side[h + k] - side[h + k + 1] for k in range(0, half, 2)]
    return F.array(*out)


def hadd(a: Column, b: Column, n: int = 8, half: int = 4) -> Column:
    return _horizontal(a, b, n, half, 1)


def hsub(a: Column, b: Column, n: int = 8, half: int = 4) -> Column:
    return _horizontal(a, b, n, half, -1)


def dot(a: Column, b: Column, selector: int, n: int = 8, half: int = 4) -> Column:
    """Masked dot product of each half: high bits of the selector choose lanes
    that enter, low bits lanes that receive the sum."""
    out = []
    for h in range(0, n, half):
        total = F.lit(0.0).cast("float")
        for k in range(half):
            if selector >> (4 + k) & 1:
                total = total + a[h + k] * b[h + k]
        out += [total if selector >> k & 1 else F.lit(0.0).cast("float") for k in range(half)]
    return F.array(*out)


@lanewise
def least_of(x: Column, y: Column) -> Column:
    """x < y ? x : y, so y where either is NaN."""
    return F.when((x < y) & ~F.isnan(y), x).otherwise(y)


@lanewise
def greatest_of(x: Column, y: Column) -> Column:
    return F.when((x > y) & ~F.isnan(x), x).otherwise(y)


def bits(a: Column, b: Column, op: str) -> Column:
    """and, or, xor or andnot of whole-number lanes."""
    return F.zip_with(a, b, bits_lane(op))


def bits_lane(op: str) -> Callable[[Column, Column], Column]:
    return {"and": lambda x, y: x.bitwiseAND(y), "or": lambda x, y: x.bitwiseOR(y), "xor": lambda x, y: x.bitwiseXOR(y), "andnot": lambda x, y: F.bitwise_not(x).bitwiseAND(y)}[op]


@lanewise
def blend(x: Column, y: Column, mask: Column) -> Column:
    """y where the mask holds, else x."""
    return F.when(mask, y).otherwise(x)


def rounded(a: Column, mode: str = "nearest") -> Column:
    """nearest (half to even), up, down or zero."""
    return F.transform(a, rounded_lane(mode))


def rounded_lane(mode: str) -> Callable[[Column], Column]:
    f = {"nearest": F.rint, "up": F.ceil, "down": F.floor, "zero": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))}[mode]
    return lambda x: f(x).cast("double")


def reciprocal(a: Column) -> Column:
    return F.transform(a, lambda x: F.try_divide(F.lit(1.0), x))


def reciprocal_sqrt(a: Column) -> Column:
    return F.transform(a, lambda x: F.try_divide(F.lit(1.0), F.sqrt(x)))


def compare(a: Column, b: Column, predicate: str) -> Column:
    """eq, lt, le, neq, nlt, nle, ord or unord; the n-forms hold on NaN."""
    return F.zip_with(a, b, compare_lane(predicate))


def compare_lane(predicate: str) -> Callable[[Column, Column], Column]:
    either = lambda x, y: F.isnan(x) | F.isnan(y)
    return {
        "eq": lambda x, y: (x == y) & ~either(x, y), "lt": lambda x, y: (x < y) & ~either(x, y), "le": lambda x, y: (x <= y) & ~either(x, y), "unord": either,
        "neq": lambda x, y: (x != y) | either(x, y), "nlt": lambda x, y: ~(x < y) | either(x, y), "nle": lambda x, y: ~(x <= y) | either(x, y), "ord": lambda x, y: ~either(x, y),
    }[predicate]


def test(a: Column, b: Column, kind: str) -> Column:
    """Whole-vector tests of masks: z (no common lane), c (b within a), nzc (neither)."""
    z = ~F.exists(F.zip_with(a, b, lambda x, y: x & y), lambda x: x)
    c = ~F.exists(F.zip_with(a, b, lambda x, y: ~x & y), lambda x: x)
    return {"z": z, "c": c, "nzc": ~z & ~c}[kind]


def convert_lane(x: Column, to: str, truncate: bool = False) -> Column:
    return F.rint(x).cast("int") if to == "int" and not truncate else x.cast(to)


def convert(a: Column, to: str, truncate: bool = False) -> Column:
    """Lane type conversion; to int it rounds half to even or truncates."""
    return F.transform(a, lambda x: convert_lane(x, to, truncate))


def filled(v: Column, n: int, kind: str = "float") -> Column:
    return F.array_repeat(v.cast(kind), n)


@lanewise
def masked_load(x: Column, mask: Column) -> Column:
    return F.when(mask, x).otherwise(F.lit(0).cast("float"))


def masked_store(old: Column, new: Column, mask: Column) -> Column:
    """Lanes without mask keep what was there."""
    return blend(old, new, mask)


def permute(a: Column, picks: Column) -> Column:
    return F.transform(picks, lambda k: F.get(a, k))


def permute_halves(a: Column, b: Column, control: int, half: int = 4) -> Column:
    """Each half of the result: 0, 1 of a; 2, 3 (0, 1 of b); bit 3 clears it."""
    halves = [F.slice(a, 1, half), F.slice(a, half + 1, half), F.slice(b, 1, half), F.slice(b, half + 1, half)]
    pick = lambda c: F.transform(halves[0], lambda x: F.lit(0.0).cast("float")) if c & 8 else halves[c & 3]
    return F.concat(pick(control & 15), pick(control >> 4))


def unpack(a: Column, b: Column, high: bool, n: int = 8, half: int = 4) -> Column:
    out = []
    for h in range(0, n, half):
        start = h + (half // 2 if high else 0)
        for k in range(start, start + half // 2):
            out += [a[k], b[k]]
    return F.array(*out)


def duplicate(a: Column, odd: bool) -> Column:
    """Every even (or odd) lane twice."""
    return F.transform(a, lambda x, k: F.get(a, (k - k % 2 + int(odd)).cast("int")))


def extract_half(a: Column, which: int, half: int = 4) -> Column:
    return F.slice(a, which * half + 1, half)


def insert_half(a: Column, part: Column, which: int, half: int = 4) -> Column:
    return F.concat(part, F.slice(a, half + 1, half)) if which == 0 else F.concat(F.slice(a, 1, half), part)
