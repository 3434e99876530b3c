"""Near-copies by Jaccard similarity of word-shingle sets.

Sets.  A text's set holds the XXH64 (seed 42) of its lower-cased shingles of
``words_per_shingle`` words, split as in ``simhash``; rows with the same set are
one node, whose key is a hash of the sorted set.

Candidates.  Each node has BANDS keys, each of ROWS minimum hashes over its set;
two nodes of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS:
0.9996 at 0.8, more above.  That is the only step that is not exact.  (64-bit
SimHash distances cannot stand in for it: 0.8 lies at about 10 bits, up to 16,
for which no index over 64 bits is selective.  Fingerprints do prune candidates:
``near`` is asked of both sides' before their sets are compared.)

Checks.  A candidate pair is linked if the Jaccard similarity of the two whole
sets, counted, is ``jaccard`` or more; components are those of all candidate
pairs.  They are found in three steps, so that a group of near copies costs rows
in proportion to its size, not to its pairs:

1. In each key all members are held against a leader.  Members that are one
   component by then need no further check against each other.
2. In keys that still have several components, shingles that no other open node
   has are counted: of two nodes with n and m shingles of which others have at
   most p and q, min(p, q) at most are common.  Members that by this bound
   cannot be similar enough to any other of the key go; the rest are held against
   the one with the least share of such shingles, the most central.
3. What may still be linked across components, by the bound, is checked pair by
   pair, each pair under its first common key.

Defined cases: null, empty and blank texts have the empty set and are one node;
texts of fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import cut

BANDS, ROWS = 20, 5
#: Eight bytes each, so a broadcast table of sets is under 2 MB.
BROADCAST_HASHES = 200_000
BLOCK = 2048
_random = np.random.default_rng(42)
_XOR, _ODD = (_random.integers(0, 2**64, BANDS * ROWS, np.uint64) for _ in range(2))
_ODD |= np.uint64(1)


def shingle_set(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """The sorted hashes of the text's distinct shingles."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    k = min(words_per_shingle, len(words))
    shingles = map(b" ".join, zip(*(words[j : len(words) - k + 1 + j] for j in range(k))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band; none for the empty set."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(low, ((hashes[i : i + BLOCK, None] ^ _XOR) * _ODD).min(axis=0), out=low)
    return [xxhash.xxh64_intdigest(part.tobytes(), band) - 2**63 for band, part in enumerate(low.reshape(BANDS, ROWS))]


def nodes(text: Column, words_per_shingle: int, fingerprint: Callable[[np.ndarray], int]) -> Column:
    """(fp, n, sim, bands): the set's key, size, fingerprint and band keys."""
    kind = pa.struct([("fp", pa.int64()), ("n", pa.int32()), ("sim", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            hashes = shingle_set(t.as_py(), words_per_shingle)
            out.append({"fp": xxhash.xxh64_intdigest(hashes.tobytes(), 42) - 2**63, "n": len(hashes), "sim": fingerprint(hashes), "bands": band_keys(hashes)})
        return pa.array(out, kind)

    return F.arrow_udf(run, "fp long, n int, sim long, bands array<long>")(text)


def sets(text: Column, words_per_shingle: int) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py(), words_per_shingle).view(np.int64) for t in texts], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")(text)


def _checked(pairs: DataFrame, whole: DataFrame, jaccard: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sets in ``whole`` (fp, s) are similar enough."""
    pairs = cut(pairs.repartition("a", "b"))  # by pair: a hot key's are in few partitions
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    met = cut(whole.join(wanted, "fp"))
    hashes = met.agg(F.coalesce(F.sum(F.size("s")), F.lit(0))).first()[0]
    met = F.broadcast(met) if hashes <= BROADCAST_HASHES else met
    side = lambda c: met.select(F.col("fp").alias(c), F.col("s").alias(f"s{c}"))
    both = F.array(F.size(F.array_intersect("sa", "sb")))  # as a lambda's argument it is evaluated once
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return cut(rows.where(F.exists(both, lambda n: n / (F.size("sa") + F.size("sb") - n) >= jaccard)).select("a", "b"))


def _merged(own: DataFrame, more: DataFrame) -> DataFrame:
    """Labels (fp, label) after links (a, b) between fps: components of the graph
    whose nodes are the components so far."""
    side = lambda c: own.select(F.col("fp").alias(c), F.col("label").alias(f"l{c}"))
    joined = components(more.join(side("a"), "a").join(side("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    joined = joined.select(F.col("node").alias("label"), F.col("label").alias("low"))
    return cut(own.join(joined, "label", "left").select("fp", F.coalesce("low", "label").alias("label")))


def _open(rows: DataFrame) -> DataFrame:
    """The rows (of a cut, or cheap) of keys that have several labels."""
    keys = cut(rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least")).where("lo < hi").select("key", "least"))
    return cut(rows.join(keys, "key"))


def _central(left: DataFrame, whole: DataFrame, jaccard: float) -> DataFrame:
    """Open rows that may be similar to another of their key, with p: how many
    of their shingles are in any other open node."""
    alone = whole.join(left.select("fp").distinct(), "fp").select("fp", F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("k"), F.min("fp").alias("fp")).where("k = 1")
    alone = cut(alone.groupBy("fp").agg(F.count("*").alias("u")))
    left = left.join(alone, "fp", "left").withColumn("p", F.col("n") - F.coalesce("u", F.lit(0)))
    return _open(cut(left).where(_bound(F.col("n"), F.col("least"), F.col("p")) >= jaccard).select("key", "fp", "n", "sim", "p", "label"))


def _bound(n: Column, m: Column, p: Column) -> Column:
    """The largest similarity of sets of n and m that share p at most."""
    return p / (n + F.greatest(m, p) - p)


def labels(keyed: DataFrame, texts: Callable[[DataFrame], DataFrame], near: Callable[[Column, Column], Column], words_per_shingle: int, jaccard: float) -> DataFrame:
    """(node, label): the component, over all candidate pairs of ``jaccard`` or
    more, of each node that has any.

    ``keyed`` has fp, n, sim and bands, a row for each node; ``texts`` gives fp
    and text for a table of the fps that are wanted; ``near`` of two ``sim`` says
    whether sets may be as similar.
    """
    c = F.col
    may = (c("fp") != c("fp2")) & (F.least("n", "n2") / F.greatest("n", "n2") >= jaccard) & near(c("sim"), c("sim2"))
    pair = (F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b"))
    rows = keyed.select("fp", "n", "sim", F.explode("bands").alias("key"))
    # a table of its own, so that AQE can split what a hot key's join reads
    many = cut(rows.groupBy("key").agg(F.count("*").alias("k"), F.min(F.struct(F.xxhash64("fp", "key").alias("h"), "fp", "n", "sim")).alias("lead")).where("k > 1"))
    shared = cut(rows.join(many, "key").select("key", "fp", "n", "sim", c("lead.fp").alias("fp2"), c("lead.n").alias("n2"), c("lead.sim").alias("sim2")))
    whole = cut(texts(shared.select("fp").distinct()).select("fp", sets(c("text"), words_per_shingle).alias("s")).dropDuplicates(["fp"]))
    found = components(_checked(shared.where(may).select(*pair).distinct(), whole, jaccard)).withColumnRenamed("node", "fp")
    names = lambda own: own.select(c("fp").alias("node"), "label")

    left = _open(cut(shared.join(found, "fp", "left").select("key", "fp", "n", "sim", F.coalesce("label", "fp").alias("label"))))
    if left.isEmpty():
        return names(found)
    every = cut(found.unionByName(left.select("fp", "label")).distinct())
    left = _central(left, whole, jaccard)
    lead = cut(left.groupBy("key").agg(F.min(F.struct(((c("n") - c("p")) / c("n")).alias("r"), F.xxhash64("fp", "key").alias("h"), "fp", "n", "sim", "p", "label")).alias("lead")))
    may = may & (c("label") != c("label2")) & (_bound(c("n"), c("n2"), F.least("p", "p2")) >= jaccard)
    carried = ("fp", "n", "sim", "p", "label")
    met = left.join(lead, "key").select(*carried, *[c(f"lead.{x}").alias(f"{x}2") for x in carried])
    more = _checked(met.where(may).select(*pair).distinct(), whole, jaccard)
    if not more.isEmpty():
        every = _merged(every, more)

    # fewer nodes are open now, so more shingles are in one of them alone
    left = _central(_open(cut(left.select("key", "fp", "n", "sim").join(every, "fp"))), whole, jaccard)
    own = cut(left.select("fp").distinct().join(keyed, "fp").select("fp", "bands"))
    left = cut(left.join(own, "fp").select("key", *carried, "bands"))
    other = left.select("key", *[c(x).alias(f"{x}2") for x in (*carried, "bands")])
    first = F.get(F.filter(F.zip_with("bands", "bands2", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), 0) == c("key")
    more = _checked(left.join(other, "key").where((c("fp") < c("fp2")) & may & first).select(*pair), whole, jaccard)
    return names(every if more.isEmpty() else _merged(every, more))
