"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the normalised words of all test items.  Training
words stream through it: from a state, a known word follows a transition or
falls back along suffix links, and the length of the longest match that ends at
each word is tracked.  Where that length reaches a window (``window`` words, or
a whole item that is shorter), the window's words are hit.  Runs of words that
no item has, or that are too short to hold any window, cannot move the
automaton to a reportable length and are skipped by arithmetic on word ids.

``strip`` removes hit spans of at least ``max_span`` words and drops documents
whose hit share exceeds ``max_coverage``.

Automata hold about ``max_words`` item words each (an item alone may be longer):
items are dealt to them by hash, executors build them, and they are kept as a
table in the shared folder.  The driver passes on one at a time, and a worker
holds one.  With one automaton, documents are scanned in a single pass without
a shuffle; with more, there is a pass for each, of which only the rows of hit
documents are kept, merged, and joined to the documents at the end.

Defined cases: null or empty text has no words and no hits; items without words
are ignored; equal items each count; items with a null id hit words like any
other but are left out of the items; repeated rows are judged one by one; very
long texts are scanned whole, in one pass over their words; other columns are
kept, whatever their names (``matches`` replaces one that has the name of its
result); no items means no hits; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, few_rows_a_batch, fresh, small

#: Bytes that separate words (all ASCII but 0-9, A-Z, a-z) become spaces; A-Z become a-z.
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _KEEP else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPANS = "array<struct<start:int,end:int>>"
RESULT = f"struct<n_words:bigint,n_hit:bigint,items:array<bigint>,spans:{SPANS}>"
KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
#: The words as a Java pattern, for counting them alone.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Hit documents' rows are under a kilobyte as a rule, so a broadcast is under 10 MB.
BROADCAST_HITS = 10_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences, with what windows end where."""

    def __init__(self, items: Iterable[tuple[int | None, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        runs = []
        for item, seq in items:
            if seq:
                runs.append((item, [self.ids.setdefault(w, len(self.ids) + 1) for w in seq]))
        for _, run in runs:
            last = 0
            for w in run:
                last = self._add(last, w)
        self.shortest = min([window, *(len(r) for _, r in runs)])
        #: state -> items with a full window there; state -> {length: items} for short items
        self.full: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, set[int]]] = {}
        for item, run in runs:
            state = length = 0
            for i, w in enumerate(run):
                state, length = self.step(state, length, w)
                if len(run) >= window and i + 1 >= window:
                    self.full.setdefault(self.back(state, window), set()).add(item)
            if len(run) < window:
                self.short.setdefault(self.back(state, len(run)), {}).setdefault(len(run), set()).add(item)
        #: the states above which a short item may end
        self.has_short = bool(self.short)

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.length) - 1

    def _add(self, last: int, w: int) -> int:
        """Extend by one word; states of earlier sequences are shared."""
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        nxt = self.next[state]
        while w not in nxt:
            state = self.link[state]
            if state < 0:
                return 0, 0
            nxt, length = self.next[state], self.length[state]
        return nxt[w], length + 1

    def back(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (word numbers, end exclusive, merged) and the items hit."""
        n = len(seq)
        if n < self.shortest:
            return [], set()
        got = np.fromiter(map(self.ids.get, seq, _zeros(n)), np.int32, n)
        known = np.flatnonzero(np.diff(np.concatenate(([0], (got != 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for begin, end in zip(known[::2], known[1::2]):
            if end - begin < self.shortest:
                continue
            self._scan_run(got[begin:end].tolist(), int(begin), spans, items)
        return spans, items

    def _scan_run(self, run: list[int], base: int, spans: list, items: set) -> None:
        state = length = 0
        step, window = self.step, self.window
        for i, w in enumerate(run):
            state, length = step(state, length, w)
            if length < self.shortest:
                continue
            hit = 0
            if length >= window:
                at = self.back(state, window)
                if at in self.full:
                    items |= self.full[at]
                    hit = window
            if self.has_short:
                at = state
                while at > 0 and self.length[at] >= self.shortest:
                    for size, those in self.short.get(at, {}).items():
                        if size <= length:
                            items |= those
                            hit = max(hit, size)
                    at = self.link[at]
            if hit:
                end = base + i + 1
                start = end - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, end))


def _zeros(n: int) -> Iterator[int]:
    from itertools import repeat

    return repeat(0, n)


def automata(items: DataFrame, window: int = 10, max_words: int = 200_000) -> DataFrame:
    """(shard, machine): pickled automata of about ``max_words`` words each."""
    rows = items.select("item_id", "text").where(F.regexp_count("text", F.lit(WORDS)) > 0).distinct()
    total = rows.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORDS))), F.lit(0))).first()[0]
    shards = max(1, -(-total // max_words))

    def build(part: pa.Table) -> pa.Table:
        machine = Automaton([(i.as_py(), words(t.as_py())) for i, t in zip(part["item_id"], part["text"])], window)
        return pa.table({"shard": pa.array([part["shard"][0].as_py()], pa.int32()), "machine": pa.array([pickle.dumps(machine)], pa.binary())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int"))
    return cut(dealt.groupBy("shard").applyInArrow(build, "shard int, machine binary"))


class _Machine:
    """An automaton that a worker loads once."""

    loaded: tuple[str, Automaton] | None = None

    def __init__(self, shared: Broadcast):
        self.shared, self.name = shared, uuid.uuid4().hex

    def get(self) -> Automaton:
        now = _Machine.loaded
        if now is None or now[0] != self.name:
            _Machine.loaded = None  # the one before goes first
            _Machine.loaded = now = (self.name, pickle.loads(self.shared.value))
        return now[1]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _row(seq: list[bytes], machine: Automaton) -> dict:
    spans, items = machine.scan(seq)
    spans = _merge(spans)
    return {"n_words": len(seq), "n_hit": sum(b - a for a, b in spans), "items": sorted(items - {None}), "spans": [{"start": a, "end": b} for a, b in spans]}


def _scan(machine: _Machine) -> Callable[[Column], Column]:
    def run(texts: pa.Array) -> pa.Array:
        m = machine.get()
        return pa.array([_row(words(t.as_py()), m) for t in texts], KIND)

    # not deterministic to the optimiser, so that no filter or projection runs the scan anew
    return F.arrow_udf(run, RESULT).asNondeterministic()


def _machines(docs: DataFrame, items: DataFrame, window: int, max_words: int) -> Iterator[_Machine]:
    """One after the other; empty automata for no items."""
    context = docs.sparkSession.sparkContext
    table = automata(items, window, max_words)
    for shard in sorted(r[0] for r in table.select("shard").collect()) or [None]:
        data = pickle.dumps(Automaton([], window)) if shard is None else bytes(table.where(F.col("shard") == shard).first()["machine"])
        yield _Machine(context.broadcast(data))


def _several(docs: DataFrame, machines: Iterator[_Machine], column: str) -> DataFrame:
    """``matches`` by a pass for each automaton."""
    hits = []
    row = {"i": F.col("doc_id"), "t": F.xxhash64("text")}
    for m in machines:
        found = few_rows_a_batch(docs).select(*[v.alias(k) for k, v in row.items()], _scan(m)("text").alias("leak")).where("leak.n_hit > 0")
        hits.append(cut(found.dropDuplicates(["i", "t"])))
        m.shared.unpersist()
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    every = every.groupBy("i", "t").agg(F.flatten(F.collect_list("leak.spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("leak.items")))).alias("items"))

    def merge(spans: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b} for a, b in _merge([(x["start"], x["end"]) for x in s.as_py()])] for s in spans], KIND["spans"].type)

    every = small(cut(every.withColumn("spans", F.arrow_udf(merge, SPANS)("spans"))), BROADCAST_HITS)
    names = fresh([*docs.columns, column], "i", "t", "hit_i", "hit_t", "hit_spans", "hit_items")
    i, t, hi, ht, spans, found = names
    keyed = docs.withColumns({i: row["i"], t: row["t"]})
    every = every.select(F.col("i").alias(hi), F.col("t").alias(ht), F.col("spans").alias(spans), F.col("items").alias(found))
    out = keyed.join(every, F.col(i).eqNullSafe(F.col(hi)) & (F.col(t) == F.col(ht)), "left")
    n_hit = F.aggregate(F.coalesce(spans, F.array().cast(SPANS)), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    leak = F.struct(
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce(found, F.array().cast("array<bigint>")).alias("items"), F.coalesce(spans, F.array().cast(SPANS)).alias("spans"))
    return out.withColumn(column, leak).drop(*names)


def matches(docs: DataFrame, items: DataFrame, window: int = 10, max_words: int = 200_000, column: str = "leak") -> DataFrame:
    """``docs`` plus a struct column: n_words, n_hit, items (sorted ids), spans
    (word numbers, end exclusive, merged)."""
    machines = _machines(docs, items, window, max_words)
    first, second = next(machines), next(machines, None)
    if second is None:
        return few_rows_a_batch(docs).withColumn(column, _scan(first)(F.col("text")))
    return _several(docs, (m for part in ((first, second), machines) for m in part), column)


def digest(items: Column) -> Column:
    """SHA-256 of the ids, sorted as strings, comma-joined."""
    return F.sha2(F.array_join(F.array_sort(items.cast("array<string>")), ","), 256)


def _cut(text: str | None, spans: list[dict], max_span: int) -> str | None:
    """Remove the spans (by word number) of at least ``max_span`` words."""
    gone = [(s["start"], s["end"]) for s in spans if s["end"] - s["start"] >= max_span]
    if not gone or text is None:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in gone:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join(out) + text[last:]


def strip(docs: DataFrame, items: DataFrame, window: int = 10, max_span: int = 10, max_coverage: float = 0.5, max_words: int = 200_000) -> DataFrame:
    """``docs`` without contaminated spans; documents of which more than
    ``max_coverage`` is hit are dropped.  Columns stay the same; n_chars, if
    there, is that of the new text.  Spans of short items (under ``max_span``
    words) stay."""
    machines = _machines(docs, items, window, max_words)
    first, second = next(machines), next(machines, None)
    (leak,) = fresh(docs.columns, "leak")
    kind = pa.struct([("text", pa.string()), ("n_hit", pa.int64()), ("n_words", pa.int64())])
    clean = "struct<text:string,n_hit:bigint,n_words:bigint>"
    few_rows_a_batch(docs)
    if second is None:  # scan and cut in one Python pass

        def run(texts: pa.Array) -> pa.Array:
            m = first.get()
            out = []
            for t in texts:
                text = t.as_py()
                r = _row(words(text), m)
                out.append({"text": _cut(text, r["spans"], max_span), "n_hit": r["n_hit"], "n_words": r["n_words"]})
            return pa.array(out, kind)

        found = docs.withColumn(leak, F.arrow_udf(run, clean).asNondeterministic()("text"))
    else:

        def run_cut(texts: pa.Array, leaks: pa.Array) -> pa.Array:
            rows = zip(texts, leaks.to_pylist())
            return pa.array([{"text": _cut(t.as_py(), r["spans"], max_span), "n_hit": r["n_hit"], "n_words": r["n_words"]} for t, r in rows], kind)

        met = _several(docs, (m for part in ((first, second), machines) for m in part), leak)
        found = met.withColumn(leak, F.arrow_udf(run_cut, clean).asNondeterministic()("text", leak))
    found = found.where(F.coalesce(F.col(f"{leak}.n_hit") <= max_coverage * F.col(f"{leak}.n_words"), F.lit(True)))
    new = {"text": F.col(f"{leak}.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(f"{leak}.n_hit") > 0, F.length(f"{leak}.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
