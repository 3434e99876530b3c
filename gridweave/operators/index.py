"""Global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

_BITS = 33  # of monotonically_increasing_id, below the partition number


def with_index(df: DataFrame, name: str = "idx") -> DataFrame:
    """Number rows from 0 in partition order: two passes, no shuffle.

    What the driver gets is a count for each partition.  ``df`` must deal its
    rows to partitions alike in both passes (a file scan or a cut result does).
    """
    return counted(df, name)[0]


def counted(df: DataFrame, name: str = "idx") -> tuple[DataFrame, int]:
    """``with_index``, and how many rows there are."""
    tagged = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", _BITS)
    counts = {r[0]: r[1] for r in tagged.groupBy(part.alias("p")).count().collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p], total = total, total + counts[p]
    if not starts:
        return tagged.withColumn(name, F.col("_id")).drop("_id"), 0
    table = F.create_map(*[F.lit(x) for p in starts for x in (p, starts[p])])
    return tagged.withColumn(name, F.element_at(table, part) + F.col("_id") - F.shiftleft(part, _BITS)).drop("_id"), total


def index_by(df: DataFrame, *keys: str, name: str = "idx") -> DataFrame:
    """Number rows in the order of ``keys`` by a range-partitioned sort."""
    return counted_by(df, *keys, name=name)[0]


def counted_by(df: DataFrame, *keys: str, name: str = "idx") -> tuple[DataFrame, int]:
    """``index_by``, and how many rows there are."""
    return counted(cut(df.orderBy(*keys)), name)
