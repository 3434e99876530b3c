"""Quality rules by distribution divergence.

Two histograms of a document, its character classes and its share of the
language's common words, are compared with the language's reference by
Jensen-Shannon distance (base 2, so 0 to 1).  References are sums over all
documents of the language.  Short documents give noisy histograms, so each
distance counts only from a minimum length on (``min_chars``, ``min_words``),
and limits have a slack over the root of the length (``class_slack / sqrt(chars)``
and ``word_slack / sqrt(n_words)``), as sampling noise falls with it.

One Arrow pass turns texts into narrow rows of counts, which go to the shared
folder; references (one for each known language) are a partial aggregate of
those, and a second pass over the narrow rows computes distances by the batch.  Rows of other or null languages are compared with every reference
and judged by the nearest.

Defined cases: null and empty texts have no words and so fail the base rule; a
language without rows has no reference and is skipped; with no reference at all
only the base rule judges; repeated rows are judged one by one; very long texts
are counted whole, in a worker's memory; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, few_rows_a_batch

#: Common words by language.
COMMON = {
    "en": "the of and to in is was that for it as with be by on not he this are or from at which but have an had they you were their one all we can her has there been if more when will would who so no".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou comme mais cette ont été leur nous ses être fait elle on deux même tout".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy".split(),
}
CLASSES = ("upper", "lower", "digit", "space", "stop", "symbol", "other", "wide")
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_STOP = b".,;:!?'\"()-"
_SYMBOL = b"#*$%&|<>"
_CONT = bytes(range(128, 192))
_LEAD = bytes(range(192, 256))
_ALL = sorted({w for v in COMMON.values() for w in v})
_AT = {w.encode(): i for i, w in enumerate(_ALL)}
_EDGE = b".,;:!?'\"()"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<bigint>, common array<bigint>"


def _without(data: bytes, gone: bytes) -> int:
    return len(data) - len(data.translate(None, gone))


def repeat_words(seq: list[bytes], size: int = 5) -> int:
    """Words that lie in a window found twice or more."""
    n = len(seq) - size + 1
    if n < 2:
        return 0
    first: dict[tuple, int] = {}
    again = []
    for i, w in enumerate(zip(*(seq[j:] for j in range(size)))):
        j = first.setdefault(w, i)
        if j != i:
            again.append((j, i))
    if not again:
        return 0
    starts = sorted(set(chain.from_iterable(again)))
    total, end = 0, 0
    for s in starts:
        total += s + size - max(s, end)
        end = s + size
    return total


def dup_lines(data: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in data.split(b"\n"):
        if line.strip():
            if line in seen:
                n += 1
            seen.add(line)
    return n


def counts(text: str | None) -> dict:
    data = (text or "").encode("utf-8")
    seq = data.split()
    chars = len(data) - _without(data, _CONT)
    per = {"upper": _without(data, _UPPER), "lower": _without(data, _LOWER), "digit": _without(data, _DIGIT), "space": _without(data, _SPACE), "stop": _without(data, _STOP), "symbol": _without(data, _SYMBOL), "wide": _without(data, _LEAD)}
    per["other"] = chars - sum(per.values())
    common = [0] * len(_ALL)
    for w in data.lower().split():
        i = _AT.get(w)
        if i is None:
            i = _AT.get(w.strip(_EDGE))
        if i is not None:
            common[i] += 1
    return {"n_words": len(seq), "word_chars": chars - per["space"], "n_symbols": per["symbol"], "n_dup_lines": dup_lines(data), "n_repeat_words": repeat_words(seq), "classes": [per[c] for c in CLASSES], "common": common}


def count_texts(text: Column) -> Column:
    kind = pa.struct([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [(n, pa.list_(pa.int64())) for n in ("classes", "common")])

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([counts(t.as_py()) for t in texts], kind)

    return F.arrow_udf(run, f"struct<{COUNTS.replace(' long', ':bigint').replace(' array', ':array')}>")(text)


def js_distance(hist: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of rows of counts to a reference (shares); NaN
    for empty rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = hist / hist.sum(axis=1, keepdims=True)
        m = (p + reference) / 2
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        right = np.where(reference > 0, reference * np.log2(reference / m), 0.0).sum(axis=1)
        return np.where(hist.sum(axis=1) > 0, np.sqrt(np.maximum(0.0, (left + right) / 2)), np.nan)


def words_of(lang: str, common: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """The language's common words, and all other words as the last class."""
    own = common[:, [_AT[w.encode()] for w in COMMON[lang]]]
    return np.column_stack((own, n_words - own.sum(axis=1)))


def distances(lang: Column, counted: Column, refs: dict[str, tuple[list[float], list[float]]]) -> Column:
    """(class_distance, word_distance) to the row's language or, where that is
    not known, to the nearest; null without words or references."""
    kind = pa.struct([("class_distance", pa.float64()), ("word_distance", pa.float64())])

    def run(langs: pa.Array, rows: pa.Array) -> pa.Array:
        n = len(rows)
        own = np.array([g if g in refs else "" for g in langs.to_pylist()], dtype=object)
        table = lambda c: rows.field(c).flatten().to_numpy().reshape(n, -1)
        classes, common, n_words = table("classes"), table("common"), rows.field("n_words").to_numpy()
        out = []
        for which, hist in ((0, lambda g: classes), (1, lambda g: words_of(g, common, n_words))):
            far = np.full(n, np.nan)
            for g, ref in refs.items():
                mine = own == g
                other = own == ""
                at = np.flatnonzero(mine | other)
                d = js_distance(hist(g)[at], np.array(ref[which]))
                far[at] = np.where(mine[at], d, np.fmin(far[at], d))
            out.append(pa.array(far, pa.float64(), mask=np.isnan(far)))
        return pa.StructArray.from_arrays(out, fields=list(kind))

    return F.arrow_udf(run, "struct<class_distance:double,word_distance:double>").asNondeterministic()(lang, counted)


def references(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Class and word shares by language, over all rows (``lang``, ``c``)."""
    sums = [F.sum(F.get("c.classes", F.lit(i))) for i in range(len(CLASSES))] + [F.sum(F.get("c.common", F.lit(i))) for i in range(len(_ALL))] + [F.sum("c.n_words")]
    out = {}
    for row in rows.where(F.col("lang").isin(list(COMMON))).groupBy("lang").agg(*sums).collect():  # a row for each known language
        lang, classes, common, n = row[0], row[1 : 1 + len(CLASSES)], row[1 + len(CLASSES) : -1], row[-1]
        if n:
            own = [common[_AT[w.encode()]] for w in COMMON[lang]]
            own.append(n - sum(own))
            out[lang] = ([x / sum(classes) for x in classes], [x / n for x in own])
    return out


def judge(docs: DataFrame, max_class_distance: float = 0.25, class_slack: float = 1.0, max_word_distance: float = 0.22, word_slack: float = 1.0, min_chars: int = 200, min_words: int = 50) -> DataFrame:
    """doc_id, lang, the base counts, both distances, base_failed and kept."""
    rows = cut(few_rows_a_batch(docs).select("doc_id", "lang", count_texts(F.col("text")).alias("c")))
    refs = references(rows)
    n, repeated = F.col("c.n_words"), F.col("c.n_repeat_words")
    out = rows.withColumn("d", distances(F.col("lang"), F.col("c"), refs))
    out = out.withColumns({"class_distance": F.col("d.class_distance"), "word_distance": F.col("d.word_distance"), "base_failed": (n < 10) | (100 * repeated > 20 * n)})
    chars = F.aggregate("c.classes", F.lit(0).cast("long"), lambda a, x: a + x)
    odd_class = (chars >= min_chars) & (F.col("class_distance") > max_class_distance + class_slack / F.sqrt(F.greatest(chars, F.lit(1))))
    odd_word = (n >= min_words) & (F.col("word_distance") > max_word_distance + word_slack / F.sqrt(F.greatest(n, F.lit(1))))
    kept = ~(F.col("base_failed") | F.coalesce(odd_class, F.lit(False)) | F.coalesce(odd_word, F.lit(False)))
    return out.select("doc_id", "lang", "c.n_words", "c.word_chars", "c.n_symbols", "c.n_dup_lines", "c.n_repeat_words", "class_distance", "word_distance", "base_failed", kept.alias("kept"))
