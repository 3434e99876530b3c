"""Order-dependent folds over sorted groups.

Some operators are sequential by meaning: the next state depends on the last.
Rows are dealt by group, sorted within, and streamed through a state; a task
holds a batch and the states of the group at hand, so a group of any length
needs no more memory (the sort spills).  Different groups run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def fold(df: DataFrame, keys: list[str], order: list[str], values: list[str], schema: str, start: Callable[[tuple], Any], step: Callable[[Any, tuple], Any], finish: Callable[[tuple, Any], list[tuple]], each: Callable[[tuple, Any, tuple], tuple] | None = None) -> DataFrame:
    """Fold ``values`` of each group in ``order``.

    start(key) gives the state, step(state, values) the next one; finish(key,
    state) gives the group's rows, or ``each(key, state, values)`` one for every
    input row.  Rows that tie in ``order`` are taken by their values.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    width = len(keys)
    rows = df.select(*keys, *order, *[v for v in values if v not in order])
    rows = rows.repartition(*keys) if keys else rows.coalesce(1)
    rows = rows.sortWithinPartitions(*keys, *order, *[v for v in values if v not in order])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, begun = None, None, False
        for part in parts:
            out: list[tuple] = []
            columns = [part[c].astype(object).where(part[c].notna(), None).tolist() if part[c].dtype.kind not in "iu" else part[c].tolist() for c in (*keys, *values)]
            for row in zip(*columns):
                key, value = row[:width], row[width:]
                if not begun or key != now:
                    if begun and each is None:
                        out += finish(now, state)
                    now, state, begun = key, start(key), True
                state = step(state, value)
                if each is not None:
                    out.append(each(key, state, value))
            yield pd.DataFrame(out, columns=names)
        if begun and each is None:
            yield pd.DataFrame(finish(now, state), columns=names)

    return rows.mapInPandas(run, schema)
