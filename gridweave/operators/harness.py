"""Ordered parallel maps, timing and tuning runs."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Timer:
    """``with Timer() as t: ...`` then ``t.interval`` in seconds."""

    interval = 0.0

    def __enter__(self) -> Timer:
        self._from = time.perf_counter()
        return self

    def __exit__(self, *_: object) -> None:
        self.interval = time.perf_counter() - self._from


def ordered_map(df: DataFrame, key: str, value: str, f: Callable[[float], float], workers: int | None = None) -> DataFrame:
    """(key, result): a Python function over all rows, in the order of ``key``."""
    rows = df.select(F.col(key), F.col(value).alias("_v"))
    rows = rows.repartition(workers) if workers else rows

    def run(values: pd.Series) -> pd.Series:
        return values.map(f).astype(float)

    return rows.select(key, F.pandas_udf(run, "double")("_v").alias("result")).orderBy(key)


def timed(action: Callable[[], object], repeats: int = 1) -> float:
    """The least wall time of an action over some runs."""
    best = float("inf")
    for _ in range(repeats):
        with Timer() as t:
            action()
        best = min(best, t.interval)
    return best


def tune(spark: SparkSession, kinds: dict[str, Callable[[int, int], object]], groups: list[int], workers: list[int]) -> DataFrame:
    """(kind, workgroups, workers, seconds) for every configuration."""
    rows = [(k, g, w, timed(lambda: f(g, w))) for k, f in kinds.items() for g in groups for w in workers]
    return spark.createDataFrame(rows, "kind string, workgroups int, workers int, seconds double")


def speed_up(serial: float, parallel: float) -> float:
    return serial / parallel


def busy_work(seconds: float) -> Callable[[float], float]:
    """A job that only takes time, for tests of parallel maps."""

    def run(job: float) -> float:
        time.sleep(seconds)
        return job

    return run


def metrics(spark: SparkSession, **values: float) -> DataFrame:
    """(metric, value) rows for reports."""
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(values.items())], "metric string, value double")
