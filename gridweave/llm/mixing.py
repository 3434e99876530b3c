"""Mixing sources to target weights: hierarchical budgeting.

Weights go down a domain - language - source tree.  Every node gets its share of
its parent's budget; a node that cannot fill its share (its subtree has too few
tokens, even over ``max_epochs`` epochs) keeps what it has, and the shortage
goes to its siblings by weight.  Only what all the siblings together cannot take
stays with the parent's siblings: since a node's capacity is that of its
subtree, filling level by level from the top does just that.

Budgets are tables of Spark's, a row for each node.  Siblings share a budget by
one level: each gets min(capacity, level x weight).  The level is found on sums
by ranges of capacity / weight, then on the ratios of the one range it lies in,
so that no task sorts all children of a node.

A leaf's budget is then drawn as a prefix of its seeded epochs: epoch e is the
leaf's rows in the order of a hash of (seed, e, doc_id, text); full epochs
come first, and the last one is cut at the budget, within a row if need be.  No
leaf is sorted whole: rows fall into hash-range buckets, token sums by bucket
(summed on the map side) give the bucket in which the budget ends, rows of
earlier buckets are taken as they are, and only rows of that one bucket are
ranked.  A source with a third of all rows is so spread over all tasks.

The driver gets two sums and no row of a leaf; tables of leaves are broadcast
only if counted to have ``BROADCAST_LEAVES`` rows at most.

Defined cases: null text has no tokens, and rows without tokens are never drawn;
null lang or source is a leaf of its own (shown as null); a leaf without weight
gets ``default_weight``; identical rows are drawn alike, as they tie in
every order (at a budget's end, as many of them as it takes); very long texts
are counted whole and count as one row.  An empty table gives no rows.  Extra
columns of the input are kept, whatever their names, but those that the operator
adds (domain, epoch, tokens, taken) replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small

LEAF = ("d", "l", "s")
#: A leaf's row of plan is under 200 bytes, so a broadcast table is under 10 MB.
BROADCAST_LEAVES = 50_000
#: Ranges to an octave of capacity / weight.
RANGES = 64


@dataclass(frozen=True)
class Weights:
    """Weights by path: (domain,), (domain, lang) and (domain, lang, source)."""

    by_path: Mapping[tuple, float] = field(default_factory=dict)
    default_weight: float = 1.0

    def __post_init__(self) -> None:
        for path, w in (*self.by_path.items(), ("default", self.default_weight)):
            if not 0 <= float(w) < float("inf"):
                raise ValueError(f"weight of {path} must be finite and not negative: {w}")

    def on(self, nodes: DataFrame, depth: int) -> DataFrame:
        """``nodes`` (a row for each path of that length) plus their weight w."""
        rows = [(*k, float(w)) for k, w in self.by_path.items() if len(k) == depth]
        if not rows:
            return nodes.withColumn("w", F.lit(float(self.default_weight)))
        table = nodes.sparkSession.createDataFrame(rows, ", ".join(f"{c} string" for c in LEAF[:depth]) + ", w double")
        return _join(nodes, table, LEAF[:depth], "left").withColumn("w", F.coalesce("w", F.lit(float(self.default_weight))))


def _join(df: DataFrame, table: DataFrame, on: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join by keys that may be null; the table's other columns are added."""
    other = table.withColumnsRenamed({c: f"{c}_" for c in on})
    met = F.lit(True)
    for c in on:
        met = met & df[c].eqNullSafe(other[f"{c}_"])
    return df.join(other, met, how).drop(*[f"{c}_" for c in on])


def _levels(rows: DataFrame, parent: tuple[str, ...], at: str) -> DataFrame:
    """The first of ``rows`` (sums ``cap`` and ``w`` by ``at``; the range's
    largest ratio ``hi``; what there is to share, ``have``; how much lower
    rows took, ``low``, and weigh with all above, ``above``) that is not filled:
    parent, at, level."""
    order = Window.partitionBy(*parent).orderBy(at)
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumns({"low": F.col("low") + below, "above": F.col("above") + weight})
    rows = rows.withColumn("level", (F.col("have") - F.col("low")) / F.col("above")).where("level <= hi")
    return rows.groupBy(*parent).agg(F.min(F.struct(at, "level", "low", "above", "have", "w")).alias("m")).select(*parent, "m.*")


def fill(nodes: DataFrame, parent: tuple[str, ...]) -> DataFrame:
    """``nodes`` (weight w, capacity cap, parent's budget b) plus ``got``: each
    gets min(cap, level x w), with the one level that spends the budget, or all
    capacities if they are less."""
    nodes = nodes.withColumn("ratio", F.when((F.col("w") > 0) & (F.col("cap") > 0), F.col("cap") / F.col("w")))
    able = nodes.where("ratio is not null").withColumn("range", F.floor(F.log2("ratio") * RANGES))
    ranges = able.groupBy(*parent, "range").agg(F.sum("cap").alias("cap"), F.sum("w").alias("w"), F.max("ratio").alias("hi"), F.first("b").alias("b"))
    every = Window.partitionBy(*parent)
    ranges = ranges.withColumns({"have": F.least("b", F.sum("cap").over(every)), "low": F.lit(0.0), "above": F.lit(0.0)})
    edge = _levels(ranges, parent, "range").select(*parent, "range", "have", "low", (F.col("above") - F.col("w")).alias("above"))
    keys = (*parent, "range")
    inner = _join(able, small(cut(edge), BROADCAST_LEAVES), keys).groupBy(*keys, "ratio").agg(F.sum("cap").alias("cap"), F.sum("w").alias("w"), F.first("have").alias("have"), F.first("low").alias("low"), F.first("above").alias("above"))
    level = _levels(inner.withColumn("hi", F.col("ratio")), parent, "ratio").select(*parent, "level")
    got = F.when(F.col("ratio").isNull(), 0.0).otherwise(F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))))
    return cut(_join(nodes, small(cut(level), BROADCAST_LEAVES), parent, "left").withColumn("got", F.greatest(got, F.lit(0.0))).drop("ratio", "level"))


def leaf_budgets(leaves: DataFrame, weights: Weights, total: float, max_epochs: int) -> DataFrame:
    """``leaves`` (d, l, s, size, a row for each) plus ``budget``: whole tokens,
    rounded down."""
    tree = {3: weights.on(leaves.select(*LEAF, (F.col("size") * max_epochs).cast("double").alias("cap")), 3)}
    for depth in (2, 1):
        # what a subtree can take, from the leaves up; a branch of weight 0 takes nothing
        room = tree[depth + 1].groupBy(*LEAF[:depth]).agg(F.sum(F.when(F.col("w") > 0, F.col("cap")).otherwise(0.0)).alias("cap"))
        tree[depth] = cut(weights.on(room, depth))
    above = tree[1].withColumns({"b": F.lit(float(total)), "top": F.lit(0)})
    got = fill(above, ("top",)).select("d", F.col("got").alias("b"))
    for depth in (2, 3):
        keys = LEAF[: depth - 1]
        got = fill(_join(tree[depth], small(got, BROADCAST_LEAVES), keys), keys).select(*LEAF[:depth], F.col("got").alias("b"))
    budget = F.least(F.floor(F.col("b") + 1e-6), F.col("size") * max_epochs).cast("long")
    return _join(leaves, small(got, BROADCAST_LEAVES), LEAF).withColumn("budget", budget).drop("b")


def order_key(seed: int, epoch: Column, digest: Column, doc_id: Column | None = None) -> Column:
    """60 bits of MD5 over seed, epoch, doc_id and the text's MD5: the place of
    a row in an epoch."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce((F.col("doc_id") if doc_id is None else doc_id).cast("string"), F.lit("")), digest)
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, domain: Column, weights: Weights = Weights(), total_tokens: int | None = None, share: float = 0.5, seed: int = 17, max_epochs: int = 4, rows_per_bucket: int = 20_000, tokens: Column | None = None) -> DataFrame:
    """The drawn rows: the columns of ``docs`` plus domain, epoch, tokens and
    taken (tokens drawn from the row: fewer than tokens where the budget ends).

    ``total_tokens`` defaults to ``share`` of all tokens.  A row drawn in several
    epochs comes once for each.
    """
    made = ("domain", "epoch", "tokens", "taken")
    keep = [c for c in docs.columns if c.lower() not in made]
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long") if tokens is None else tokens.cast("long")
    # the input's own columns travel as one, so that no name meets one of these
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), domain.cast("string").alias("d"), F.col("lang").cast("string").alias("l"), F.col("source").cast("string").alias("s"), n.alias("n")).where("n > 0")

    # one pass over the texts; what follows reads narrow rows
    narrow = cut(named.select(F.col("row.doc_id").alias("doc_id"), *LEAF, "n", F.md5("row.text").alias("t")))
    leaves = cut(narrow.groupBy(*LEAF).agg(F.sum("n").alias("size"), F.count("*").alias("rows")))
    whole, most = leaves.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    total = whole * share if total_tokens is None else total_tokens
    plan = leaf_budgets(leaves, weights, total, max_epochs).where("budget > 0")
    plan = cut(plan.select(*LEAF, F.expr("budget div size").cast("int").alias("full"), F.expr("budget % size").alias("rest")))
    buckets = max(64, most // rows_per_bucket)

    # the bucket, then the row, in which each leaf's budget ends
    part = _with_leaf(narrow, plan.where("rest > 0")).withColumn("h", order_key(seed, F.col("full"), F.col("t")))
    part = part.withColumn("b", F.floor(F.shiftright("h", 28) * buckets / 2**32).cast("int"))
    ends = _ends(part.groupBy(*LEAF, "b").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"), F.count("*").alias("k")), "b")
    edge = _with_leaf(part.drop("rest"), cut(ends.select(*LEAF, F.col("b").alias("end"), "rest"))).where("b = end")
    last = _ends(edge.groupBy(*LEAF, "h").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"), F.count("*").alias("k")), "h")
    last = cut(last.select(*LEAF, F.col("h").alias("end"), F.col("rest").alias("left"), "k"))

    drawn = _with_leaf(named, cut(_join(plan.drop("rest"), last, LEAF, "left")))
    drawn = drawn.withColumn("h", order_key(seed, F.col("full"), F.md5("row.text"), F.col("row.doc_id")))
    none = F.array().cast("array<struct<epoch:int,taken:bigint>>")
    turn = lambda e, t: F.struct(e.alias("epoch"), t.cast("long").alias("taken"))
    turns = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0), F.col("full") - 1), lambda e: turn(e, F.col("n")))).otherwise(none)
    ended = F.when(F.col("h") < F.col("end"), F.array(turn(F.col("full"), F.col("n"))))
    ended = ended.when((F.col("h") == F.col("end")) & (F.col("k") == 1), F.array(turn(F.col("full"), F.col("left")))).otherwise(none)
    shape = ["row.*", F.col("d").alias("domain"), "epoch", F.col("n").alias("tokens"), "taken"]
    out = drawn.select("row", "d", "n", F.inline(F.concat(turns, ended))).select(*shape)
    if not last.where("k > 1").isEmpty():  # equal rows at the very end of a budget
        out = out.unionByName(_tied(drawn.where("h = end and k > 1")).select(*shape))
    return out


def _ends(sums: DataFrame, at: str) -> DataFrame:
    """Of sums by leaf and ``at``, the one in which the ``rest`` ends; ``rest``
    becomes what it takes of it."""
    to = F.sum("n").over(Window.partitionBy(*LEAF).orderBy(at))
    return sums.withColumn("to", to).where("to - n < rest and to >= rest").withColumn("rest", F.expr("rest - to + n"))


def _tied(rows: DataFrame) -> DataFrame:
    """Rows that tie at the end of a budget: as many as it takes, the last one in
    part.  They are numbered by leaf and partition, with each partition's first
    number from counts, as one row may be repeated without bound."""
    rows = cut(rows.select("row", *LEAF, "n", "full", "left")).withColumn("p", F.spark_partition_id())
    counts = cut(rows.groupBy(*LEAF, "p").agg(F.sum("n").alias("sum")))
    order = Window.partitionBy(*LEAF).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("sum").over(order), F.lit(0))).drop("sum")
    own = Window.partitionBy(*LEAF, "p").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = _join(rows, starts, (*LEAF, "p")).withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(own), F.lit(0)))
    return rows.where("before < left").select("row", "d", "n", F.col("full").alias("epoch"), F.expr("least(n, left - before)").alias("taken"))


def prefix(text: Column, words: Column) -> Column:
    """The text up to the end of its n-th word."""
    size = lambda xs: F.aggregate(F.slice(xs, F.lit(1), F.greatest(words, F.lit(1)).cast("int")), F.lit(0), lambda a, x: a + F.length(x))
    return F.substring(text, F.lit(1), size(F.split(text, WORD, -1)) + size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))


def _with_leaf(df: DataFrame, table: DataFrame) -> DataFrame:
    """Join a table with a row for each leaf: broadcast if it is small, else
    AQE deals the join and splits hot leaves."""
    return _join(df, small(table, BROADCAST_LEAVES), LEAF)
