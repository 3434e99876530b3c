"""Reductions: per partition, strided, blocked, tree, and the small aggregates.

Sums run as Spark's partial and final aggregation; the strided and blocked forms
keep the intermediate level by group as a result of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def sum_physical_partitions(df: DataFrame, value: str = "v") -> DataFrame:
    """(part, total): a row for each physical partition; empty ones give 0.
    Whole numbers are summed as such, others as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyspark import TaskContext

        total = 0
        for b in batches:
            total += pc.sum(b.column(0)).as_py() or 0
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "total": [total]}, schema=pa.schema([("part", pa.int32()), ("total", pa.int64() if kind == "long" else pa.float64())]))

    kind = "long" if isinstance(df.schema[value].dataType, IntegralType) else "double"
    return df.select(F.col(value).cast(kind).alias("v")).mapInArrow(run, f"part int, total {kind}")


def sum_partitions(df: DataFrame, part: Column, n: int, value: Column) -> DataFrame:
    """(part, total) for logical partitions 0..n-1; empty ones give 0."""
    sums = df.groupBy(part.cast("int").alias("part")).agg(F.sum(value).alias("s"))
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("part")).join(sums, "part", "left").select("part", F.coalesce("s", F.lit(0)).alias("total"))


def sum_strided(df: DataFrame, groups: int, idx: str = "idx", value: str = "x") -> DataFrame:
    """(g, total): worker g sums rows g, g + G, g + 2G, ..."""
    return df.groupBy((F.col(idx) % groups).cast("int").alias("g")).agg(F.sum(F.col(value).cast("double")).alias("total"))


def sum_blocked(df: DataFrame, groups: int, n: int, idx: str = "idx", value: str = "x") -> DataFrame:
    """(g, total): worker g sums rows g*k up to (g+1)*k, with k = ceil(n / G)."""
    k = -(-n // groups)
    return df.groupBy(F.floor(F.col(idx) / max(k, 1)).cast("int").alias("g")).agg(F.sum(F.col(value).cast("double")).alias("total"))


def sum_tree(df: DataFrame, fan_in: int = 2, idx: str = "idx", value: str = "x", levels: int | None = None, n: int | None = None) -> DataFrame:
    """(g, total) after ``levels`` rounds in which ``fan_in`` neighbours merge.

    Merging by rounds or at once gives the same groups, so it is one aggregate
    on idx div fan_in^levels; levels default to what leaves one row.
    """
    if levels is None:
        n = df.count() if n is None else n
        levels = 0
        while fan_in**levels < n:
            levels += 1
    width = fan_in**levels
    return df.groupBy(F.floor(F.col(idx) / width).cast("long").alias("g")).agg(F.sum(F.col(value).cast("double")).alias("total"))


def tree_levels(parts: DataFrame, groups: int) -> DataFrame:
    """(level, slot, total): how the partials (g, total) of ``groups`` workers, a
    power of two, merge in a tree.  At each level the upper half of the slots is
    added to the lower one, so slot i of level l sums the partials with
    g % (groups >> l) = i; a slot without partials is 0."""
    if groups < 1 or groups & (groups - 1):
        raise ValueError("the number of workers must be a power of two")
    height = groups.bit_length() - 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(height))).alias("level")
    slot = F.col("g") % F.call_function("shiftright", F.lit(groups), F.col("level"))
    sums = parts.select("g", "total", levels).groupBy("level", slot.cast("int").alias("slot")).agg(F.sum("total").alias("total"))
    slots = parts.sparkSession.range(1).select(levels).select("level", F.explode(F.sequence(F.lit(0), F.call_function("shiftright", F.lit(groups), F.col("level")) - 1)).alias("slot"))
    return slots.join(sums, ["level", "slot"], "left").select("level", "slot", F.coalesce("total", F.lit(0.0)).alias("total"))


def relative_error(parts: DataFrame, whole: DataFrame, value: str = "x") -> float:
    """|sum of partials - sum of rows| / |sum of rows|; two numbers reach the driver."""
    a = parts.agg(F.sum("total")).first()[0] or 0.0
    b = whole.agg(F.sum(F.col(value).cast("double"))).first()[0] or 0.0
    return abs(a - b) / abs(b) if b else abs(a - b)


def extents(pixels: DataFrame) -> DataFrame:
    """(height, width) of sparse pixels."""
    return pixels.agg((F.max("i") + 1).alias("height"), (F.max("j") + 1).alias("width"))


def count_labels(labels: DataFrame, sentinel: Column) -> DataFrame:
    """The number of distinct labels besides the background's."""
    return labels.agg(F.count_distinct(F.when(F.col("label") != sentinel, F.col("label"))).alias("regions"))


def best(times: DataFrame, value: str = "seconds") -> DataFrame:
    """The configuration with the least value; ties go to the least configuration."""
    names = [c for c in times.columns if c != value]
    top = times.agg(F.min(F.struct(value, *names)).alias("b"))
    return top.select(*[f"b.{c}" for c in (*names, value)])


def scatter(points: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """One value for each cell: that of the largest ``order``, then of the largest value."""
    return points.groupBy(*key).agg(F.max(F.struct(order, value)).alias("m")).select(*key, F.col(f"m.{value}").alias(value))


def sweep(spark: SparkSession, **choices: list) -> DataFrame:
    """Every combination of the given parameters (small by nature)."""
    out = None
    for name, values in choices.items():
        col = F.explode(F.array(*map(F.lit, values))).alias(name)
        out = spark.range(1).select(col) if out is None else out.select("*", col)
    return out
