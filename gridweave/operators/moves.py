"""Guarded counter transfers: in order, a move takes one from its source cell, if
that is not empty, and puts it into its destination.

The order matters, so the exact operator is a fold.  Cells that moves connect
depend on each other; groups (column ``grp``) do not, and run in parallel.
Without a group column all moves are one sequence in one task, streamed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import fold
from .graph import components


def guarded_moves(counts: DataFrame, moves: DataFrame, repeat: int = 1) -> DataFrame:
    """(grp, cell, n) after ``repeat`` rounds of all moves (seq, src, dest).

    ``counts`` is (cell, n) and ``moves`` (seq, src, dest), both with or without
    grp.  Cells without moves keep what they had; moves between cells that
    ``counts`` lacks find them empty.
    """
    grouped = "grp" in moves.columns
    start = counts if "grp" in counts.columns else counts.withColumn("grp", F.lit(0).cast("long"))
    steps = moves if grouped else moves.withColumn("grp", F.lit(0).cast("long"))
    put = start.select("grp", F.lit(-1).alias("rep"), F.col("cell").cast("long").alias("seq"), F.col("cell").alias("src"), F.col("cell").alias("dest"), F.col("n").cast("long").alias("n"))
    rounds = F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))) if repeat else F.explode(F.array().cast("array<int>"))
    do = steps.select("grp", rounds.alias("rep"), F.col("seq").cast("long").alias("seq"), "src", "dest", F.lit(None).cast("long").alias("n"))
    if repeat == 0:
        return start.select("grp", "cell", F.col("n").cast("long").alias("n"))

    def step(cells: dict[int, int], row: tuple) -> dict[int, int]:
        src, dest, n = row
        if n is not None:
            cells[src] = cells.get(src, 0) + int(n)
        elif cells.get(src, 0) > 0:
            cells[dest] = cells.get(dest, 0) + 1
            cells[src] -= 1
        return cells

    rows = put.unionByName(do)
    return fold(rows, ["grp"], ["rep", "seq"], ["src", "dest", "n"], "grp long, cell int, n long", lambda key: {}, step, lambda key, cells: [(key[0], c, n) for c, n in cells.items()])


def independent_groups(moves: DataFrame) -> DataFrame:
    """moves plus grp: the smallest cell that its cells are connected with.

    Moves of different groups never touch a common cell, so that they can be
    folded side by side with the same result.
    """
    links = moves.select(F.col("src").cast("long").alias("a"), F.col("dest").cast("long").alias("b")).distinct()
    groups = components(links).select(F.col("node").cast("int").alias("src"), F.col("label").alias("grp"))
    return moves.join(groups, "src")
