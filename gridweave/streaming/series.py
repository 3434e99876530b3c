"""Streaming forms of the series operators.

State lives in Spark's state store, one small record a key, so that a stream
may run without end and recover from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def _stateful(stream: DataFrame, key: str, order: str, value: str, out: str, memory: str, start: Callable[[float], tuple], step: Callable[[tuple, float], tuple]) -> DataFrame:
    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        rows = pd.concat(list(parts), ignore_index=True).dropna(subset=[value]).sort_values(order, kind="stable")
        got = []
        for at, v in zip(rows[order], rows[value]):
            now = start(float(v)) if now is None else step(tuple(now), float(v))
            got.append((k[0], at, *now))
        if now is not None:
            state.update(tuple(now))
        yield pd.DataFrame(got, columns=[x.strip().split(" ")[0] for x in out.split(",")])

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(run, out, memory, "append", "NoTimeout")


def ema(stream: DataFrame, key: str, order: str, value: str, rate: float = 0.1) -> DataFrame:
    """(key, order, ema) for each row: s = (1 - rate) s + rate x.

    Rows of one trigger are taken in ``order``; later triggers follow.
    """
    kinds = dict(stream.dtypes)
    return _stateful(stream, key, order, value, f"{key} {kinds[key]}, {order} {kinds[order]}, ema double", "s double", lambda v: (v,), lambda s, v: ((1 - rate) * s[0] + rate * v,))


def kalman_scalar(stream: DataFrame, key: str, order: str, value: str, q: float = 1e-2, r: float = 1.0, p0: float = 1.0) -> DataFrame:
    """(key, order, m, p) for each row of a random-walk state seen directly."""
    kinds = dict(stream.dtypes)

    def step(s: tuple, z: float) -> tuple:
        p = s[1] + q
        gain = p / (p + r)
        return s[0] + gain * (z - s[0]), (1 - gain) * p

    return _stateful(stream, key, order, value, f"{key} {kinds[key]}, {order} {kinds[order]}, m double, p double", "m double, p double", lambda v: (v, p0), step)


def rate_by_window(stream: DataFrame, ts: str, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(start, frames): frames in tumbling event-time windows; rows that come
    later than ``late`` behind the watermark are dropped, as in any such stream."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("frames")).select(F.col("window.start").alias("start"), "frames")
