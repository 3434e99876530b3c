"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins; the model is a sum of lookup tables,
one for each feature and one for each of a few pairs, learnt by cyclic
boosting: round after round, each feature in turn gets a shallow tree on the
current logistic gradients, which is added to its table at a small rate.  Pairs
are then ranked by how much one tree on their 2-D residuals gains, and boosted
the same way.  A score is a sum of table entries, gathered for whole batches.

Learning takes a bounded sample: the ``max_fit_rows`` labelled rows of lowest
hash of doc_id.  Their features (that many short rows at most) are collected to
the driver, where the model of a few thousand numbers is fitted; documents are
never collected or shuffled.

Defined cases: null and empty texts score as an empty text; null labels or ids
are not learnt from; of several labels for a doc_id the lowest counts; labels of
one class only give that class's smoothed share as every score, and none at all
gives 0.5; repeated rows are scored one by one; very long texts are scored whole,
in a worker's memory; extra columns are kept, whatever their names, and one
called score or predicted is replaced.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_rows_a_batch
from .divergence import _AT as COMMON_AT

FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "bangs", "pipes", "stops", "wide", "other", "distinct_words", "top_word", "distinct_pairs", "common", "dup_lines", "words_per_line", "capitals")
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_LEAD = bytes(range(192, 256))
_CONT = bytes(range(128, 192))
_ALNUM = _UPPER + bytes(range(97, 123)) + _DIGIT


def features(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8")
    count = lambda gone: len(data) - len(data.translate(None, gone))
    seq = data.split()
    n, size = len(seq), max(1, len(data))
    if not n:
        return [0.0] * len(FEATURES)
    tally: dict[bytes, int] = {}
    for w in seq:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    common = sum(c for w, c in tally.items() if w.lower().strip(b".,;:!?") in COMMON_AT)
    wide = count(_LEAD)
    chars = len(data) - count(_CONT)
    space = count(b" \t\n\x0b\x0c\r")
    return [
        math.log1p(n), (chars - space) / n, count(b"#*$%&<>") / size, count(_UPPER) / size, count(_DIGIT) / size, count(b"!?") / n, count(b"|") / n, count(b".") / n, wide / size,
        (chars - space - wide - count(_ALNUM)) / size, len(tally) / n, max(tally.values()) / n, len(set(zip(seq, seq[1:]))) / max(1, n - 1), common / n, 1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), sum(1 for w in tally if w[:1].isupper()) / len(tally),
    ]


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        if self.edges and len(x):
            b = self.bins(x)
            for i, t in enumerate(self.tables):
                out += t[b[:, i]]
            for (i, j), t in zip(self.pairs, self.pair_tables):
                out += t[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """The step of a tree with so many leaves over ordered bins."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    for _ in range(leaves - 1):
        best, at = 1e-12, None
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            k = np.arange(a + 1, b)
            gain = _gain(cg[k] - cg[a], ch[k] - ch[a], l2) + _gain(cg[b] - cg[k], ch[b] - ch[k], l2) - _gain(cg[b] - cg[a], ch[b] - ch[a], l2)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, at = gain[i], int(k[i])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each of two features: gain and step."""
    cg, ch = np.zeros(np.add(g.shape, 1)), np.zeros(np.add(h.shape, 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c: np.ndarray) -> list[np.ndarray]:
        a = c[1:-1, 1:-1]
        top, left = c[1:-1, -1:] - a, c[-1:, 1:-1] - a
        return [a, top, left, c[-1, -1] - a - top - left]

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gs, hs = parts(cg), parts(ch)
    gain = sum(_gain(x, y, l2) for x, y in zip(gs, hs)) - _gain(cg[-1, -1], ch[-1, -1], l2)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = [x[i, j] / (y[i, j] + l2) for x, y in zip(gs, hs)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = step
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, leaves: int = 3, max_bins: int = 32, max_pairs: int = 6, pair_rounds: int = 60, l2: float = 1.0) -> Model:
    """Cyclic boosting of the features' tables, then of the best pairs'."""
    n = len(y)
    if not n:
        return Model()
    share = (y.sum() + 0.5) / (n + 1)
    if y.min() == y.max():
        return Model(math.log(share / (1 - share)))
    model = Model(math.log(share / (1 - share)))
    model.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, max_bins + 1)[1:-1])) for i in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(k) for k in sizes]
    raw = np.full(n, model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, k in enumerate(sizes):
            g, h = gradients()
            step = rate * _tree(np.bincount(b[:, i], g, k), np.bincount(b[:, i], h, k), leaves, l2)
            model.tables[i] += step
            raw += step[b[:, i]]
    flat = {(i, j): b[:, i] * sizes[j] + b[:, j] for i, j in combinations(range(len(sizes)), 2)}
    grid = lambda v, ij: np.bincount(flat[ij], v, sizes[ij[0]] * sizes[ij[1]]).reshape(sizes[ij[0]], sizes[ij[1]])
    g, h = gradients()
    ranked = sorted(flat, key=lambda ij: (-_quadrants(grid(g, ij), grid(h, ij), l2)[0], ij))
    model.pairs = ranked[:max_pairs]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, ij in enumerate(model.pairs):
            g, h = gradients()
            step = rate * _quadrants(grid(g, ij), grid(h, ij), l2)[1]
            model.pair_tables[k] += step
            raw += step.ravel()[flat[ij]]
    return model


def held_out(doc_id: Column) -> Column:
    """The third of the ids that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_fit_rows: int = 8192, **options) -> Model:
    """Fit on the ``max_fit_rows`` learnable labels of lowest hash of doc_id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(target).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_rows)
    kind = pa.list_(pa.float64())

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()) for t in texts], kind)

    # the sample's size is fixed, so it can be broadcast; its features are as many rows
    rows = few_rows_a_batch(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", F.arrow_udf(run, "array<double>")("text").alias("x"))
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], dtype=float), **options)


def _scores(model: Model) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py()) for t in texts], dtype=float).reshape(-1, len(FEATURES))
        return pa.array(model.score(x), pa.float64())

    return F.arrow_udf(run, "double").asNondeterministic()("text")  # not to be evaluated once for each use


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus score (0 to 1) and predicted (1 from 0.5 on)."""
    out = few_rows_a_batch(docs).withColumn("score", _scores(model))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are predicted 1; columns stay the same."""
    return few_rows_a_batch(docs).where(_scores(model) >= 0.5)
