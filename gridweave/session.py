"""Sessions and lineage cuts."""

from __future__ import annotations

import gc
import re
import tempfile
from itertools import count

from pyspark.sql import DataFrame, SparkSession

#: Cuts between two collections.
RELEASE = 8
_cuts = count(1)


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; settings given as a_b_c name a.b.c.
    Checkpoints go when their tables are no longer referenced."""
    builder = SparkSession.builder.appName("gridweave").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only on a local master, where one process does all the work, is an unset one
    replaced by a temporary folder.  On a cluster it must be set: files in a
    machine's own folder are missing on the other machines.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path and re.fullmatch(r"local(\[.*\])?", context.master):
        path = tempfile.mkdtemp(prefix="gridweave-")
    if not path:
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Loops need it so that plans stay short and a lost executor costs a re-read.
    Now and then the driver's garbage is collected, for Spark deletes the shuffle
    files of tables that are gone only then.
    """
    checkpoint_dir(df.sparkSession)
    if next(_cuts) % RELEASE == 0:
        gc.collect()
        df.sparkSession._jvm.System.gc()
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
