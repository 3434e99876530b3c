"""Secret scan: three base patterns and character Markov models.

Base patterns (assign, access, hex) give spans as the contract defines them.
The method adds spans: runs of secret characters (at least ``min_length``) that
overlap no base span are scored by two first-order character models, one of
random strings and one of ordinary identifiers, both trained by counting letter
pairs in labelled samples (Laplace-smoothed).  The log-likelihood ratio of a
run, per transition and in whole thousandths, must reach ``threshold``.

Everything is DataFrame code.  Matches with positions come from splitting a text
by a pattern: the pieces between and the matches themselves alternate, and their
lengths add up to offsets.  Training is an aggregate over pairs of a fixed
alphabet (65 x 65 cells at most), which is what the driver gets; the table of
whole-number ratios goes into the plan as a literal.

Defined cases: null and empty texts have no matches; a match of several kinds
counts for each base kind, but runs that touch a base span are not added again;
texts with line breaks, and characters outside of the BMP, count by code point;
very long texts are scanned whole, in time linear in text and matches (but for
one step a block of 256 matches); repeated rows are scanned one by one; other
columns are kept, whatever their names (``scan`` replaces those it adds); an
empty table gives no rows; with no samples of one label, that model is uniform.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the greedy AKIA[A-Z0-9]+ of 20 or more characters
HEX = r"[0-9a-f]{24,}"  # the greedy [0-9a-f]+ of 24 or more characters
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Parts of ordinary identifiers and words, for the default labelled samples.
PARTS = (
    "get set user name count total index value file path line text page list item node tree hash table order event date time stamp start end first last next previous parent child left right width height size length "
    "config option default system service client server request response message error warning handle process thread queue buffer stream reader writer parser token string number boolean array object record field column "
    "the of and to in is that for it with as was his they this from have not are but what all were when your said there each which their will other about many then them these some her would make like him into has look "
    "more write see could people than water been call who its now find long down day did come made may part ing ed er es tion able ible ment ness less ful ous ive al ly re un dis th he an on at or en nd st nt ti ou ha ea wh sh "
    "der die und den von zu das mit sich des auf dem nicht ein eine als auch werden aus hat dass sie nach wird bei ung heit keit lich isch sch ver ge be er ach au ie ei te pf tz ber zer ent "
    "de la le et les un une que est pour qui dans par plus pas au sur ne se ce il avec eau eux oi ai ou ier eur que aux elle pa tre ment vi che "
    "el los las del por con una su para como sus ser entre cion sta do es ez ja rr ll ga bo go ar os ue ie qu"
).split()
#: Spans by code point, end exclusive.
Spans = "array<struct<start:int,end:int>>"
Found = "array<struct<start:int,end:int,text:string>>"
#: Matches whose offsets are summed at a time.
BLOCK = 256
#: Characters to a piece of a text that is cut up.
PIECE = 4096


def _parts(xs: Column) -> Column:
    """An array in slices of BLOCK.  ``xs`` must be a column, not an expression:
    what a lambda refers to is evaluated for each element."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / BLOCK), F.lit(0)).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))


def with_matches(df: DataFrame, name: str, pattern: str, group: int = 0, min_group: int = 0) -> DataFrame:
    """``df`` (with ``text``, not null) plus ``name``: start, end (code points,
    end exclusive) and text of the leftmost non-overlapping matches; those whose
    ``group`` is too short are dropped.

    Offsets are sums over the pieces between matches and the matches, in blocks,
    as an array that grows is copied with each step.
    """
    pieces = F.transform(F.split("text", pattern, -1), lambda x: F.length(x))
    found = [F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(c) for g, c in ((0, "found"), (group, "value"))]
    some = F.arrays_zip(pieces.alias("gap"), *found)  # one piece more than matches
    df = df.withColumn("z", F.when(F.rlike("text", F.lit(pattern)), some).otherwise(F.array().cast("array<struct<gap:int,found:string,value:string>>")))
    df = df.withColumn("blocks", _parts(F.col("z"))).drop("z")
    size = lambda x: x["gap"] + F.coalesce(F.length(x["found"]), F.lit(0))
    lengths = F.transform("blocks", lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + size(x)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    offsets = F.aggregate(lengths, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def step(acc: Column, x: Column) -> Column:
        first, end = acc["at"] + x["gap"], acc["at"] + size(x)
        span = F.struct(first.alias("start"), end.alias("end"), x["found"].alias("text"))
        keep = x["found"].isNotNull() & (F.length(x["value"]) >= min_group)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def in_block(block: Column, offset: Column) -> Column:
        return F.aggregate(block, F.struct(offset.alias("at"), F.array().cast(Found).alias("out")), step, lambda acc: acc["out"])

    return df.withColumn(name, F.flatten(F.zip_with("blocks", offsets, in_block))).drop("blocks")


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def labelled_samples(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """The default samples (text, label): random strings of several alphabets,
    and identifiers and words put together from PARTS."""
    ids = spark.range(rows)
    bit = lambda k: F.sha2(F.concat_ws(":", F.lit(k), "id"), 256)
    strings = F.when(F.col("id") % 4 == 0, F.substring(bit(1), 1, 40)).otherwise(F.regexp_replace(F.base64(F.unhex(bit(2))), "=", ""))
    strings = F.when(F.col("id") % 4 == 1, F.upper(F.regexp_replace(strings, "[+/]", "X"))).otherwise(strings)
    parts = F.array(*map(F.lit, PARTS))
    pick = lambda k: F.get(parts, (F.conv(F.substring(bit(10 + k), 1, 8), 16, 10).cast("long") % len(PARTS)).cast("int"))
    names = F.when(F.col("id") % 3 == 0, F.concat_ws("_", *map(pick, range(4)))).when(F.col("id") % 3 == 1, F.concat(*[F.initcap(pick(k)) for k in range(5)])).otherwise(F.concat(*map(pick, range(6))))
    return ids.select(strings.alias("text"), F.lit(1).alias("label")).unionByName(ids.select(names.alias("text"), F.lit(0).alias("label")))


def train(samples: DataFrame, smoothing: float = 1.0) -> list[int]:
    """Log-likelihood ratios (random over ordinary) of every pair of the
    alphabet, in whole thousandths, row by row."""
    k = len(ALPHABET)
    code = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    chars = F.split(F.col("text"), "")
    pairs = F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.struct(code(F.element_at(chars, i)).alias("a"), code(F.element_at(chars, i + 1)).alias("b")))
    rows = samples.where("text is not null and label is not null").select("label", "text").where(F.length("text") > 1)
    rows = rows.select("label", F.inline(pairs)).where("a >= 0 and b >= 0").groupBy("label", "a", "b").count()
    counts = np.full((2, k, k), float(smoothing))
    for label, a, b, n in rows.collect():  # at most 2 x k x k rows
        counts[int(label > 0), a, b] += n
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return [int(round(x)) for x in (1000 * (logs[1] - logs[0])).ravel()]


def ratio(run: Column, table: list[int]) -> Column:
    """Mean log-likelihood ratio per transition, in whole thousandths."""
    k = len(ALPHABET)
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    lookup = F.lit(np.array(table, dtype=np.int32))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        return F.struct(c.alias("last"), F.when((acc["last"] >= 0) & (c >= 0), acc["sum"] + F.get(lookup, acc["last"] * k + c)).otherwise(acc["sum"]).alias("sum"))

    return F.floor(F.aggregate(codes, start, step, lambda acc: acc["sum"]) / F.greatest(F.length(run) - 1, F.lit(1)))


def _found(docs: DataFrame, samples: DataFrame | None, min_length: int, threshold: int) -> DataFrame:
    """row (the input's columns), text (not null) and KINDS."""
    table = train(labelled_samples(docs.sparkSession) if samples is None else samples)
    # the input's own columns travel as one, so that no name meets one of these
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    for kind, pattern, group, least in (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 0), ("hex", HEX, 0, 0)):
        out = with_matches(out, kind, pattern, group, least).withColumn(kind, _bare(F.col(kind)))
    out = with_matches(out, "runs", f"[A-Za-z0-9+/_=-]{{{min_length},}}")
    likely = F.filter("runs", lambda s: ratio(s["text"], table) >= threshold)
    out = out.withColumn("likely", likely).withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    out = out.withColumn("near", F.transform(_parts(F.col("base")), lambda xs: F.struct(F.array_min(xs["start"]).alias("start"), F.array_max(xs["end"]).alias("end"), xs.alias("spans"))))
    meets = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    free = F.filter("likely", lambda s: ~F.exists("near", lambda block: F.coalesce(meets(s, block), F.lit(False)) & F.exists(block["spans"], lambda b: meets(s, b))))
    return out.withColumn("markov", F.when(F.size("base") > 0, _bare(free)).otherwise(_bare(F.col("likely")))).select("row", "text", *KINDS)


def scan(docs: DataFrame, samples: DataFrame | None = None, min_length: int = 20, threshold: int = 500) -> DataFrame:
    """``docs`` plus the arrays assign, access, hex and markov of (start, end).

    Columns of these names in the input are replaced.
    """
    keep = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in KINDS]
    return _found(docs, samples, min_length, threshold).select(*keep, *KINDS)


def span_list(kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""

    def named(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("name")))

    return F.array_join(F.transform(F.array_sort(F.concat(*map(named, range(len(kinds)), kinds))), lambda s: s["name"]), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", samples: DataFrame | None = None, min_length: int = 20, threshold: int = 500) -> DataFrame:
    """``docs`` with every span, overlapping ones merged, replaced by ``mark``.

    Columns stay the same; n_chars, if there, follows the new text.  Texts are
    cut from pieces of PIECE characters, so that time is linear in a text and its
    spans."""
    found = _found(docs, samples, min_length, threshold)
    found = found.withColumn("spans", F.array_sort(F.concat(*KINDS))).drop(*KINDS)
    hit = F.size("spans") > 0
    found = found.withColumn("pieces", F.when(hit, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    found = found.withColumn("blocks", _parts(F.col("spans")))
    found = found.withColumn("highs", F.transform("blocks", lambda xs: F.array_max(xs["end"])))
    zero = F.lit(0)
    before = lambda xs, i: F.coalesce(F.array_max(F.slice(xs, F.lit(1), i)), zero)
    # each span with the end of all spans before it
    in_block = lambda xs, i: F.transform(xs, lambda s, j: F.struct(F.greatest(before(F.col("highs"), i), before(xs["end"], j)).alias("at"), s["start"].alias("start")))
    found = found.withColumn("cuts", F.filter(F.flatten(F.transform("blocks", in_block)), lambda s: s["start"] >= s["at"]))
    piece = lambda k: F.coalesce(F.get(F.col("pieces"), k), F.lit(""))

    def between(a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        far = F.concat(F.substring(piece(first), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(F.col("pieces"), first + 2, F.greatest(last - first - 1, zero)), ""), F.substring(piece(last), F.lit(1), b % PIECE))
        return F.when(first == last, F.substring(piece(first), a % PIECE + 1, b - a)).otherwise(far)

    clean = F.concat(F.array_join(F.transform("cuts", lambda s: F.concat(between(s["at"], s["start"]), F.lit(mark))), ""), between(F.array_max("highs"), F.length("text")))
    found = found.withColumn("new", F.when(hit, clean)).select("row", "new")
    out = []
    for c in docs.columns:
        own = F.col(f"row.`{c}`")
        if c == "text":
            own = F.coalesce("new", own)
        elif c == "n_chars":
            own = F.coalesce(F.length("new").cast(docs.schema[c].dataType), own)
        out.append(own.alias(c))
    return found.select(*out)
