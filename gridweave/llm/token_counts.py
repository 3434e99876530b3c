"""Edit-aware token counts.

A text is cut into pre-tokens by the tokenizer's pattern, and token counts of
pre-tokens add up to the text's.  Each document keeps a segment tree: leaves are
blocks of pre-tokens (their lengths and counts), inner nodes sums of characters
and tokens.  For an edit the tree is descended by offset to the touched region;
the text is cut anew from a boundary far enough before it (past the white space
that touches the edit, and four more characters: no pre-token that ends before
that looks at what changed) until a new boundary meets an old one behind the
edit; only these pre-tokens are encoded again, and the sums above their blocks
are updated.

``build`` makes a table of documents with their trees, to be kept wherever the
caller writes it (as Parquet, say); ``apply`` takes such a table and edits, and
gives the same table after the edits, without encoding a whole text.  So a second
and a third round of edits cost what they touch.

Counts are exact: the result equals a full recount of the edited text.

Defined cases: null and empty texts have no tokens; edits of null or empty lists
change nothing; offsets are code points of the text before the round's edits, are
clamped to it, and edits may come in any order but must not overlap (of
overlapping ones the later is clamped to the end of the earlier); a null
replacement is empty; repeated rows are counted one by one; very long texts are
one tree each, in a worker's memory whole; other columns are kept by ``build``
and ``apply``, whatever their names (columns called tree or edited are
replaced); an empty table gives no rows.  The vocabulary is a file that every
worker can read; its path is a parameter.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_rows_a_batch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that goes with that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of which a worker remembers the count.
REMEMBERED = 200_000
#: Longest look beyond a pre-token's end, but for white space.
REACH = 4
EDITS = "array<struct<start:int,end:int,text:string>>"


class Encoder:
    def __init__(self, path: str, pattern: str = PATTERN):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.token_bytes[i] = len(token)

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sizes (characters) and token counts of all pre-tokens of a text.

        The text is encoded at once; as no token crosses a pre-token boundary,
        byte offsets tell how many tokens each pre-token has.
        """
        pieces = self.cut.findall(text)
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        ends = np.cumsum(sizes)
        if not text.isascii():
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            ends = np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))[ends - 1]
        ids = self.encoding.encode_to_numpy(text, disallowed_special=())
        upto = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends, side="right")
        return sizes, np.diff(upto, prepend=0)

    def counts(self, pieces: Sequence[str]) -> list[int]:
        """Tokens of each pre-token."""
        known = self.known
        out = list(map(known.get, pieces))
        if None in out:
            if len(known) > REMEMBERED:
                known.clear()
            encode = self.encoding.encode_ordinary
            for i, n in enumerate(out):
                if n is None:
                    piece = pieces[i]
                    n = known.get(piece)
                    if n is None:
                        n = len(encode(piece))
                        if len(piece) <= 64:
                            known[piece] = n
                    out[i] = n
        return out


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    return Encoder(path, pattern)


class Document:
    """A text, its pre-tokens in blocks, and a tree of sums over the blocks."""

    def __init__(self, text: str, enc: Encoder, block: int = 64):
        self.enc, self.block, self.text = enc, block, text
        self.encoded = 0
        self._build(*enc.whole(text))

    @classmethod
    def load(cls, text: str, tree: dict, enc: Encoder) -> Document:
        """The document that ``store`` kept: nothing is encoded."""
        doc = cls.__new__(cls)
        doc.enc, doc.block, doc.text, doc.encoded = enc, tree["block"], text, 0
        ends = np.cumsum(np.frombuffer(tree["leaves"], np.int32))
        doc.sizes = np.split(np.frombuffer(tree["sizes"], np.int32).astype(np.int64), ends[:-1])
        doc.tokens = np.split(np.frombuffer(tree["tokens"], np.int32).astype(np.int64), ends[:-1])
        doc.width = tree["width"]
        doc.sums = np.frombuffer(tree["sums"], np.int64).reshape(2, -1).copy()
        return doc

    def store(self) -> dict:
        """The tree as plain arrays: pre-tokens to a leaf, their lengths and
        counts, the nodes' sums."""
        flat = lambda parts: np.concatenate(parts).astype(np.int32).tobytes()
        return {"block": self.block, "width": self.width, "leaves": np.array([len(x) for x in self.sizes], np.int32).tobytes(), "sizes": flat(self.sizes), "tokens": flat(self.tokens), "sums": self.sums.tobytes(), "n_pretokens": self.n_pretokens, "n_tokens": self.n_tokens}

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = len(pieces)
        self.encoded += n
        return np.fromiter(map(len, pieces), np.int64, n), np.fromiter(self.enc.counts(pieces), np.int64, n)

    def _build(self, sizes: np.ndarray, tokens: np.ndarray) -> None:
        starts = np.arange(0, max(1, len(sizes)), self.block)
        self.sizes = [sizes[i : i + self.block] for i in starts]
        self.tokens = [tokens[i : i + self.block] for i in starts]
        self.width = 1 << (len(starts) - 1).bit_length()
        #: node k has the children 2k and 2k + 1; row 0 sums characters, row 1 tokens
        self.sums = np.zeros((2, 2 * self.width), np.int64)
        if len(sizes):
            self.sums[:, self.width : self.width + len(starts)] = np.add.reduceat(sizes, starts), np.add.reduceat(tokens, starts)
        low = self.width
        while low > 1:
            level = self.sums[:, low : 2 * low]
            self.sums[:, low // 2 : low] = level[:, ::2] + level[:, 1::2]
            low //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def n_pretokens(self) -> int:
        return sum(map(len, self.sizes))

    def _find(self, offset: int) -> tuple[int, int]:
        """The block that holds a character, and where the block starts."""
        node, base, sums = 1, 0, self.sums[0]
        while node < self.width:
            node *= 2
            if offset - base >= sums[node] and sums[node + 1]:
                base += int(sums[node])
                node += 1
        return node - self.width, base

    def _set(self, k: int, sizes: np.ndarray, tokens: np.ndarray) -> None:
        self.sizes[k], self.tokens[k] = sizes, tokens
        node = k + self.width
        self.sums[:, node] = sizes.sum(), tokens.sum()
        while node > 1:
            node //= 2
            self.sums[:, node] = self.sums[:, 2 * node] + self.sums[:, 2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]."""
        old = self.text
        start = max(0, min(start, len(old)))
        end = max(start, min(end, len(old)))
        quiet = start
        while quiet and old[quiet - 1].isspace():
            quiet -= 1
        first, base = self._find(max(0, quiet - REACH))
        bounds = base + np.concatenate(([0], np.cumsum(self.sizes[first])))
        keep = max(0, int(np.searchsorted(bounds, quiet - REACH, side="right")) - 1)
        at = int(bounds[keep]) if quiet > REACH else 0
        if quiet <= REACH:
            first = base = keep = 0
        self.text = text = old[:start] + new + old[end:]
        shift = len(new) - (end - start)
        # old boundaries behind the edit, block by block as they are needed
        last, here = self._find(min(end, max(0, len(old) - 1)))
        marks = here + np.concatenate(([0], np.cumsum(self.sizes[last])))
        pieces, pos, stop = [], at, None
        while pos < len(text):
            m = self.enc.cut.match(text, pos)
            if m is None or m.end() == pos:  # a pattern that covers every character has no such case
                pos += 1
                continue
            pieces.append(m[0])
            pos = m.end()
            was = pos - shift
            if was < end or pos < start + len(new):
                continue
            while last + 1 < len(self.sizes) and was > marks[-1]:
                last += 1
                marks = marks[-1] + np.concatenate(([0], np.cumsum(self.sizes[last])))
            i = int(np.searchsorted(marks, was))
            if i < len(marks) and marks[i] == was:
                stop = i
                break
        sizes, tokens = self._encode(pieces)
        if stop is None:  # the end of the text
            last, stop = len(self.sizes) - 1, len(self.sizes[-1])
        head, tail = (self.sizes[first][:keep], self.tokens[first][:keep]), (self.sizes[last][stop:], self.tokens[last][stop:])
        none = np.zeros(0, np.int64)
        for k in range(first + 1, last + 1):
            self._set(k, none, none)
        self._set(first, np.concatenate((head[0], sizes, tail[0])), np.concatenate((head[1], tokens, tail[1])))
        if len(self.sizes[first]) > 8 * self.block:
            self._build(np.concatenate(self.sizes), np.concatenate(self.tokens))


def ordered(edits: Sequence[dict] | None, length: int) -> list[tuple[int, int, str]]:
    """Edits by offset, clamped to the text and to each other."""
    out, free = [], 0
    for e in sorted((e for e in edits or () if e and e["start"] is not None and e["end"] is not None), key=lambda e: (e["start"], e["end"])):
        start = min(max(e["start"], free), length)
        end = min(max(e["end"], start), length)
        out.append((start, end, e["text"] or ""))
        free = end
    return out


TREE = pa.struct([("block", pa.int32()), ("width", pa.int32()), ("leaves", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary()), ("sums", pa.binary()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])
TREE_SQL = "struct<block:int,width:int,leaves:binary,sizes:binary,tokens:binary,sums:binary,n_pretokens:bigint,n_tokens:bigint>"


def build(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, block: int = 64) -> DataFrame:
    """``docs`` plus ``tree``: each text is encoded, once."""

    def run(texts: pa.Array) -> pa.Array:
        enc = encoder(vocabulary, pattern)
        return pa.array([Document(t.as_py() or "", enc, block).store() for t in texts], TREE)

    return few_rows_a_batch(docs).withColumn("tree", F.arrow_udf(run, TREE_SQL).asNondeterministic()("text"))


def apply(trees: DataFrame, edits: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``trees`` after ``edits`` (an array of start, end, text): text and tree
    are new, ``edited`` is how many pre-tokens were encoded for it."""
    kind = pa.struct([("text", pa.string()), ("tree", TREE), ("edited", pa.int64())])

    def run(texts: pa.Array, kept: pa.Array, changes: pa.Array) -> pa.Array:
        enc = encoder(vocabulary, pattern)
        out = []
        for t, tree, change in zip(texts, kept, changes):
            text = t.as_py()
            doc = Document.load(text or "", tree.as_py(), enc)
            todo = ordered(change.as_py(), len(doc.text))
            for start, end, new in reversed(todo):  # from the end, so that offsets hold
                doc.edit(start, end, new)
            out.append({"text": doc.text if todo or text is not None else None, "tree": doc.store(), "edited": doc.encoded})
        return pa.array(out, kind)

    udf = F.arrow_udf(run, f"struct<text:string,tree:{TREE_SQL},edited:bigint>").asNondeterministic()
    new = few_rows_a_batch(trees).withColumn("edited", udf(F.col("text"), F.col("tree"), edits.cast(EDITS)))
    return new.withColumns({"text": F.col("edited.text"), "tree": F.col("edited.tree"), "edited": F.col("edited.edited")})
