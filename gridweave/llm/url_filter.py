"""URL filter: prefix rules plus a Bloom filter cascade for a host blocklist.

Method.  A listed key is a domain; it covers the host itself and every
subdomain, so a host is judged by the set of its dot suffixes.  The cascade
(levels L0, L1, ...) is built against the corpus's complete key universe, that
is every suffix of every host in the table (of no more labels than a key has):

* L0 encodes the listed keys; the universe keys outside the list that L0
  accepts are its false positives;
* L1 encodes those false positives; the listed keys that L1 accepts go on;
* L2 encodes these, and so on until a level has no false positive.

The first level that rejects a key settles it: even levels hold listed keys, so
a rejection there means "not listed"; odd levels hold unlisted ones, so a
rejection there means "listed".  For keys of the universe the answer is exact,
and judging a URL needs no join.  Everything is DataFrame code; only the filter
words, whose number is bounded by ``max_words``, pass through the driver.
Lists too long for that bound are dealt to several cascades by key hash
(``shards``), each inside the bound, so there is no list that drops out.

Defined cases: a null URL or one without ``://`` has an empty host and path,
fits no rule and is allowed unless the empty key is listed (it cannot be).  Ties
between rules cannot occur (the longest of host + path wins; equal lengths are
settled by list order).  An empty table or list gives no blocks.  Repeated rows
are judged one by one; very long URLs and hosts of very many labels are judged
whole, in time linear in their length, since only as many labels are asked for as
the longest key has; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: The default blocklist: every first word, a hyphen, every last word, a number
#: from 1 to 9 or none, under each of the suffixes (106,200 names).
FIRST = (
    "adult bad bargain best bet big bonus bulk buy cash casino cheap click cool coupon crypto daily deal discount easy extra fake fast free fun gold great hot instant jackpot "
    "junk keno link lotto lucky luxury mega mobile money new online palace poker power prize quick real rich royal secret sexy shady spam super top traffic true ultra vegas").split()
LAST = (
    "ads bargains bets bingo bonus buys cams cash casino chat click clicks club coins credit dates deals diet direct downloads farm games gifts girls hub jackpot links list loans lotto "
    "mail market meds money news offers outlet pills play poker portal prizes promo rewards rx sales seo shop slots spins spot store system tickets traders traffic videos win x zone").split()
SUFFIXES = ("example.com", "example.net", "example.org")


def default_list(spark: SparkSession) -> DataFrame:
    """The default blocklist as a table of keys."""
    each = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    rows = spark.range(1).select(each(FIRST).alias("a")).select("a", each(LAST).alias("b")).select("a", "b", each(("", *map(str, range(1, 10)))).alias("n"))
    return rows.select("a", "b", "n", each(SUFFIXES).alias("t")).select(F.concat("a", F.lit("-"), "b", "n", F.lit("."), "t").alias("key"))


def host_path(url: Column) -> tuple[Column, Column]:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return ascii_lower(host), path


def suffixes(host: Column, depth: int) -> Column:
    """The domain suffixes of a host of ``depth`` labels at most: a.b.c ->
    [a.b.c, b.c, c]; none for ''."""
    last = F.split(F.substring_index(host, ".", -depth), r"\.")
    n = F.size(last)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(last, i, n - i + 1), "."))
    )


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]


def _positions(key: Column, depth: int, bits: int, hashes: int) -> list[Column]:
    """Double hashing; the depth seeds each level anew."""
    a, b = F.xxhash64(key, F.lit(2 * depth)), F.xxhash64(key, F.lit(2 * depth + 1))
    return [F.pmod(F.shiftright(a, 1) + F.lit(i) * F.shiftright(b, 6), F.lit(bits).cast("long")) for i in range(hashes)]


def _in_level(key: Column, depth: int, level: Level) -> Column:
    words = F.lit(np.array(level.words, dtype=np.int64))
    hit = F.lit(True)
    for p in _positions(key, depth, level.bits, level.hashes):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        hit = hit & (F.getbit(word, (p % 64).cast("int")) == 1)
    return hit


def _encode(keys: DataFrame, depth: int, n: int, rate: float) -> Level:
    """One filter over ``n`` keys: positions are OR-ed into 64-bit words by an
    aggregate (partial on the map side), of which at most bits/64 exist."""
    rate = min(0.5, max(rate, 2.0**-24))
    bits = 64 * max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(bits / n * math.log(2))) if n else 1
    hashes = min(hashes, 24)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), depth, bits, hashes))).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
    out = [0] * (bits // 64)
    for w, v in words.collect():  # at most bits / 64 rows, bounded by max_words
        out[w] = v
    return Level(bits, hashes, tuple(out))


class Cascade:
    """Exact membership in a list, for keys of the universe it was built on."""

    def __init__(self, levels: Sequence[Sequence[Level]]):
        self.shards = [list(x) for x in levels]

    def contains(self, key: Column) -> Column:
        out = F.lit(False)
        for s, levels in enumerate(self.shards):
            mine = F.lit(True) if len(self.shards) == 1 else F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(len(self.shards))) == s
            answer = F.lit(len(levels) % 2 == 1)  # accepted by every level
            for depth in reversed(range(len(levels))):
                answer = F.when(~_in_level(key, depth, levels[depth]), F.lit(depth % 2 == 1)).otherwise(answer)
            out = out | (mine & answer) if levels else out
        return out

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, max_words: int = 65536, max_depth: int = 64) -> Cascade:
        """``listed`` and ``universe`` each have one string column ``key``.

        Listed keys outside the universe cannot be asked for, and are left out.
        """
        listed = listed.where("key is not null").select("key").distinct()
        universe = universe.where("key is not null").select("key").distinct()
        inside = universe.join(listed.withColumn("listed", F.lit(True)), "key", "left")
        inside = cut(inside.select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
        total, n = inside.agg(F.count("*"), F.coalesce(F.sum(F.col("listed").cast("long")), F.lit(0))).first()
        if not n:
            return cls([])
        worst = math.ceil(n * 24 / math.log(2) / 64) + 1
        shards = math.ceil(worst / max_words)
        levels = []
        for s in range(shards):
            part = inside if shards == 1 else inside.where(F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(shards)) == s)
            levels.append(cls._levels(part, total - n, max_depth))
        return cls(levels)

    @staticmethod
    def _levels(part: DataFrame, others: int, max_depth: int) -> list[Level]:
        """Only the keys still undecided go from level to level."""
        levels: list[Level] = []
        held = part.where("listed")
        rest = part.where("not listed")
        n = held.count()
        while n:
            depth = len(levels)
            if depth == max_depth:
                raise RuntimeError("the cascade does not end; raise max_depth")
            rate = n * math.sqrt(0.5) / max(1, others) if depth == 0 else 0.5
            level = _encode(held, depth, n, rate)
            levels.append(level)
            wrong = rest.where(_in_level(F.col("key"), depth, level))
            held, rest = wrong, held
            n = others = held.count()
        return levels


def judge(pages: DataFrame, listed: DataFrame | Sequence[str] | None = None, rules: Sequence[tuple[str, str, str]] = RULES, max_words: int = 65536) -> DataFrame:
    """page_id, url, host, path, rule, listed, verdict for each row of ``pages``.

    ``listed`` (keys, or a table with a column ``key``) defaults to
    ``default_list``.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    if listed is None:
        listed = default_list(spark)
    elif not isinstance(listed, DataFrame):
        listed = spark.range(1).select(F.explode(F.array(*map(F.lit, listed)).cast("array<string>")).alias("key"))
    # no suffix of more labels than the longest key can be listed
    depth = listed.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 1
    universe = rows.select("host").distinct().select(F.explode(suffixes(F.col("host"), depth)).alias("key"))
    cascade = Cascade.build(listed, universe, max_words)
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest last, so that it is asked first
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    hit = F.exists(suffixes(F.col("host"), depth), cascade.contains)
    rows = rows.withColumns({"rule": rule, "listed": hit})
    return rows.withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")))
