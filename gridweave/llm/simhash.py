"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprints.  64 bits over the XXH64 (seed 42) of lower-cased word shingles; a
bit is set if it is set in over half of them.  One pass, Arrow batches.

Candidates (``links``).  A fingerprint is a ring of tau + 2 segments (four of 16
bits for tau = 2).  By the pigeonring principle two fingerprints within tau bits
have a start from which every chain of consecutive segments differs in at most
floor(length x tau / segments) bits: 0, 1 and 1 for chains of 1, 2 and 3.  So
the first segment is equal, and of the next two one is equal and the other
differs in a bit at most.  All three chains are required before any pair
exists: a fingerprint probes, from each start, with its first three segments and
with those that differ in one bit of the second or third, and meets the
fingerprints that have just these 48 bits.  Only such pairs get the full Hamming
check.  Before that, fingerprints that share no two segments with any other are
left out by counting.  There is one way for keys of all sizes: rows grow with
the number of distinct fingerprints (4 x 33 probes each at most), and a key's
pairs with the fingerprints around 48 common bits, not with documents.

Components.  Minimum labels with hooking and shortcuts over the links, written
to the shared folder after each round; nothing but two sums reaches the driver.

Only distinct fingerprints are linked; documents get their component by a join
at the end, whose hot keys AQE splits (no aggregate stands between).

``one_of_each_similar`` links texts by Jaccard similarity of shingle sets (see
``shingle_sets``, which says why 64 bits cannot be the index there); pigeonring
chains over SimHash fingerprints and their Hamming distance prune its candidates
before sets are compared.

Defined cases: null and empty texts have fingerprint zero, linked like any
other; texts of fewer words than a shingle are one shingle; very long texts are
hashed whole, by blocks; a null doc_id keeps its row and gets the smallest
doc_id of its component (null if there is none); repeated rows come once for
each (``one_of_each``: once); other columns are ignored (``one_of_each``: kept,
whatever their names); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations, repeat
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import shingle_sets
from .common import cut, few_rows_a_batch, fresh, small

SEGMENTS, SEGMENT_BITS, MAX_DISTANCE = 4, 16, 2
BLOCK = 255 * 64
#: Rows of two numbers, so a broadcast table is under 10 MB.
SMALL = 100_000


def _majority(counts: np.ndarray, n: int) -> int:
    packed = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(packed.view(np.int64)[0])


def _add(counts: np.ndarray, hashes: np.ndarray) -> None:
    """Count each bit's ones."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for j in range(0, len(hashes), 255):  # so that a byte holds the sum
        counts += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint (signed) of shingle hashes; zero for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        _add(counts, hashes[i : i + BLOCK])
    return _majority(counts, len(hashes))


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        m = min(BLOCK, n - i)
        shingles = map(b" ".join, zip(*(words[i + j : i + j + m] for j in range(k))))
        _add(counts, np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, m))
    return _majority(counts, n)


def fingerprints(text: Column, words_per_shingle: int = 3) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), words_per_shingle) for t in texts], pa.int64())

    return F.arrow_udf(run, "long")(text)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _segment(x: Column, i: int, bits: int = SEGMENT_BITS) -> Column:
    return F.shiftrightunsigned(x, bits * i).bitwiseAND(F.lit((1 << bits) - 1))


def pigeonring(a: Column, b: Column, max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS) -> Column:
    """Is there a start from which no chain of fewer than all segments exceeds
    its budget?  True for all pairs within ``max_distance`` bits."""
    diff = a.bitwiseXOR(b)
    parts = [F.bit_count(_segment(diff, i, 64 // segments)) for i in range(segments)]
    starts = []
    for start in range(segments):
        sums, ok = F.lit(0), F.lit(True)
        for length in range(1, segments):
            sums = sums + parts[(start + length - 1) % segments]
            ok = ok & (sums <= length * max_distance // segments)
        starts.append(ok)
    return reduce(or_, starts)


def _chain(fp: Column, start: int) -> Column:
    """The 48 bits of three segments from ``start`` on, and the start."""
    key = F.lit(start << 3 * SEGMENT_BITS).cast("long")
    for j in range(3):
        key = key + F.shiftleft(_segment(fp, (start + j) % SEGMENTS), SEGMENT_BITS * j)
    return key


def _equal_pairs(fp: Column) -> Column:
    """A row for each two segments: their bits, and the probes of the chains
    that begin with one of them and hold the other (start, segment that may
    differ in a bit: 1 or 2)."""
    out = []
    for k, (i, j) in enumerate(combinations(range(SEGMENTS), 2)):
        pair = F.shiftleft(F.lit(k).cast("long"), 2 * SEGMENT_BITS) + F.shiftleft(_segment(fp, i), SEGMENT_BITS) + _segment(fp, j)
        ways = [(a, 2 if (b - a) % SEGMENTS == 1 else 1) for a, b in ((i, j), (j, i)) if (b - a) % SEGMENTS in (1, 2)]
        out.append(F.struct(pair.alias("pair"), F.array(*[F.struct(_chain(fp, a).alias("key"), F.lit(s).alias("segment")) for a, s in ways]).alias("ways")))
    return F.array(*out)


def candidates(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column ``fp``) that pass
    the chains of one, two and three segments from some start."""
    paired = fps.select("fp", F.inline(_equal_pairs(F.col("fp"))))
    # a table of its own, so that AQE can split what a hot key's join reads
    sizes = cut(paired.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1").select("pair"))
    shared = cut(paired.join(sizes, "pair").select("fp", F.inline("ways")))
    flips = F.transform(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda b: F.col("key").bitwiseXOR(_bit(b + F.col("segment") * SEGMENT_BITS)))
    probes = shared.select(F.col("fp").alias("a"), F.explode(F.concat(F.array("key"), flips)).alias("key"))
    there = shared.select(F.col("fp").alias("b"), "key").distinct()
    return probes.join(there, "key").where("a < b").select("a", "b")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between all distinct fingerprints (column ``fp``) within two
    bits."""
    return candidates(fps).where(distance(F.col("a"), F.col("b")) <= MAX_DISTANCE).distinct()


def funnel(fps: DataFrame) -> DataFrame:
    """How many pairs have two equal segments (an upper bound: pairs with more
    count again), pass the chains, and are within two bits."""
    paired = fps.select(F.explode(_equal_pairs(F.col("fp")).getField("pair")).alias("pair")).groupBy("pair").count()
    before = paired.agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0)).alias("equal_segments"))
    passed = cut(candidates(fps).distinct())
    return before.crossJoin(passed.agg(F.count("*").alias("chains"), F.count_if(distance(F.col("a"), F.col("b")) <= MAX_DISTANCE).alias("links")))


def _bit(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), b)


def _components_of(rows: DataFrame, first: Column, label_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, low): the least ``first`` of each fingerprint's component; ``rows``
    has fp and what ``first`` needs, ``label_of`` labels a table of fps."""
    fps = cut(rows.groupBy("fp").agg(F.min(first).alias("first")))
    label = label_of(fps)
    linked = cut(fps.join(label.withColumnRenamed("node", "fp"), "fp"))
    lows = cut(linked.groupBy("label").agg(F.min("first").alias("low")))
    found = linked.join(lows, "label").select("fp", "low")
    return cut(fps.join(found, "fp", "left").select("fp", F.coalesce("low", "first").alias("low")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row."""
    rows = cut(few_rows_a_batch(docs).select("doc_id", fingerprints(F.col("text")).alias("fp")))
    whole = _components_of(rows, F.col("doc_id"), lambda fps: components(links(fps))).withColumnRenamed("low", "component_id")
    # a hot fingerprint's rows are split by AQE: both sides are plain exchanges
    return rows.join(whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id
    (null last), then of the smallest text hash.  Columns stay the same."""
    rows = cut(few_rows_a_batch(docs).select(*_row(), fingerprints(F.col("text"), words_per_shingle).alias("fp")))
    return _one_of_each(docs, rows, lambda fps: components(links(fps)))


def one_of_each_similar(docs: DataFrame, words_per_shingle: int = 5, jaccard: float = 0.8, max_distance: int = 20) -> DataFrame:
    """Like one_of_each, for components of texts whose sets of shingles have a
    Jaccard similarity of ``jaccard`` or more (``shingle_sets``); candidates of
    more than ``max_distance`` SimHash bits are not compared."""
    node = shingle_sets.nodes(F.col("text"), words_per_shingle, of_hashes)
    rows = cut(few_rows_a_batch(docs).select(*_row(), node.alias("node")).select("id", "t", "node.*"))
    keyed = cut(rows.groupBy("fp").agg(F.min(F.struct("id", "t")).alias("at"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bands").alias("bands")))
    near = lambda a, b: pigeonring(a, b, max_distance) & (distance(a, b) <= max_distance)

    def texts(wanted: DataFrame) -> DataFrame:
        at = small(cut(keyed.join(wanted, "fp").select("fp", "at.*")), SMALL)
        own = docs.select(*_row(), "text")
        return own.join(at, own["id"].eqNullSafe(at["id"]) & (own["t"] == at["t"])).select("fp", "text")

    return _one_of_each(docs, rows, lambda _: shingle_sets.labels(keyed, texts, near, words_per_shingle, jaccard))


def _row() -> tuple[Column, Column]:
    return F.col("doc_id").alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("t")


def _one_of_each(docs: DataFrame, rows: DataFrame, label_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    who = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("t").alias("t"))
    low = _components_of(rows, who, label_of)
    judged = cut(rows.join(low, "fp").groupBy("id", "t").agg(F.count("*").alias("n"), F.min(who == F.col("low")).alias("stays")))
    i, t = fresh(docs.columns, "id", "t")
    keyed = docs.withColumns(dict(zip((i, t), _row())))
    on = lambda other: keyed[i].eqNullSafe(other["id"]) & (keyed[t] == other["t"])
    gone = small(cut(judged.where("not stays or n > 1").select("id", "t")), SMALL)
    kept = keyed.join(gone, on(gone), "left_anti").select(*docs.columns)
    again = judged.where("stays and n > 1")
    if not again.isEmpty():  # the same row several times
        twice = keyed.join(again, on(again), "left_semi").dropDuplicates([i, t]).select(*docs.columns)
        kept = kept.unionByName(twice)
    return kept
