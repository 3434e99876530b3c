"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..session import cut as cut
from ..session import remove as remove

#: ASCII white space as the contracts list it: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir."""
    return checkpoint_dir(spark).rstrip("/")


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, with underscores before those that ``columns`` has already."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, for broadcast if it was counted to have ``rows`` rows at most;
    larger ones are joined as Spark sees fit.  ``df`` must be a cut or cheap."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def few_rows_a_batch(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Bound what a Python worker holds of whole texts: batches of ``rows``
    rows, unless the session asks for less.  Returns ``df``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= rows:
        conf.set(key, str(rows))
    return df
