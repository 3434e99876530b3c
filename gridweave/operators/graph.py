"""Connected components of links, by minimum labels with hooking and shortcuts.

Few links (counted to be ``FEW`` at most, 16 bytes each) are one task's work, by
whole-array steps.  More go round by round over Spark's tables: each round joins
links with labels on nodes, never on a component's label, but for the shortcut,
whose sides are both plain tables so that AQE can split a label that many nodes
share.  Rounds are written to the shared folder; the driver sees one sum a round.
Both ways give the same labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Links that one task labels: 8 MB, and some times that while it works.
FEW = 500_000


def hook(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of nodes 0 .. n-1 over links a - b:
    labels hook to smaller ones and are shortened, for all links at once, until
    none changes."""
    up = np.arange(n)
    while True:
        low = np.minimum(up[a], up[b])
        new = up.copy()
        np.minimum.at(new, up[a], low)
        np.minimum.at(new, up[b], low)
        while not np.array_equal(new, shorter := new[new]):
            new = shorter
        if np.array_equal(new, up):
            return up
        up = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if parts:
            a, b = (np.concatenate(c) for c in zip(*parts))
            nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            up = hook(at[: len(a)], at[len(a) :], len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[up])], names=["node", "label"])

    return cut(edges.coalesce(1).mapInArrow(run, "node long, label long"))


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (a, b).

    Nodes are whole numbers; every node of a link is in the result.  Links with a
    null end are left out.
    """
    edges = cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null"))
    if edges.limit(FEW + 1).count() <= FEW:
        return _in_one_task(edges)
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    state = lambda df: df.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    before = state(labels)
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        own = cut(labels.join(near, "node"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        # a node takes the least of its neighbours' labels and its label's label, and hooks its label there too
        moved = own.join(up, "label").select(F.inline(F.array(
            F.struct(F.col("node").alias("node"), F.least("low", "above", "label").alias("label")),
            F.struct(F.col("label").alias("node"), F.least("low", "above").alias("label")),
        )))
        labels = cut(moved.groupBy("node").agg(F.min("label").alias("label")))
        after = state(labels)
        if after == before:
            return labels
        before = after
    raise RuntimeError("components do not settle")
