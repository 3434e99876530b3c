"""Main text of a page by line-block distribution.

Markup is stripped to lines (a block element or <br> ends a line).  A line weighs
its characters outside of links (headings: all of them); lines of elements that
never hold the article (menus, footers, forms and so on) weigh nothing, lines
inside <article> or <main> ``ARTICLE`` times as much.

Over the lines a window of ``window`` lines slides and sums the weights.  A block
runs from where the sums surge (rise from zero over the page's threshold) to
where they dive (fall to zero: ``window`` lines in a row without weight).  The
threshold comes from the page's own distribution: ``share`` of the sum around
which half of the page's text lies, ``surge`` at most.  Text between surge and
dive points is kept.  What the sums cannot tell is then mended by place:

* of blocks inside and outside of <article> / <main> the heavier side stays, and
  an article with a block is kept whole;
* otherwise the deepest element that holds ``MOST`` of the kept text is kept
  whole (between its first and last block only, if it is half links);
* a block too low to surge stays if only lines of no weight that belong to menus,
  adverts and the like part it from kept text.

Elements that never hold the article are told by tag, role, or class or id: a
name counts if all its parts are known (``cookie-notice``, ``site-header``; not
``no-sidebar`` or ``article-header``).  An element that holds an <h1>, <article>
or <main> and most of the page's text is none of them, whatever its name.

Time is linear in the page's length: tags are matched once, close tags without
partner cost one look-up, and an unclosed raw element (<script>, <noscript>)
hides only the text up to the next tag.

Defined cases: null and empty html give an empty text; html without any tag is
one line of text; very long pages and lines are taken whole; unclosed elements
end with the page; repeated rows are extracted one by one; columns other than
page_id, url and html are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of a character inside <article> or <main>, against one elsewhere.
ARTICLE = 16
#: The part of the kept text that makes an element the article's container.
MOST = 0.8

# quotes count only after "="; possessive, so that no input is tried in two ways
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/<>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^<>])*+)(?:>|(?=<)|\Z)", re.S)
_NEXT = re.compile(r"<[/!A-Za-z]")
_RAW = frozenset("script style noscript template textarea title svg math iframe object select option canvas video audio head".split())
_BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEAF = _HEADING | frozenset("p li dt dd pre figcaption legend summary tr td th tbody thead tfoot".split())
_CHROME = frozenset("nav aside footer form menu button dialog label fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert toolbar".split())
#: Parts of class and id names that mark what is not the article.
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer foot masthead topbar header "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "widget widgets pagination pager copyright legal disclaimer search form toolbar hidden skip outbrain taboola".split())
_REPLIES = frozenset("comment comments replies reply respond disqus".split())
#: Parts that say nothing alone, but may stand next to the others.
_PLAIN = frozenset("site page main top bottom left right upper lower box area list section wrapper wrap container block bar inner outer links link buttons button items item posts post group primary secondary global row col column panel unit slot text msg message the my js".split())
_ATTR = re.compile(r"([A-Za-z_:-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
_FLAG = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)


def _name_kind(value: str) -> str:
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name)]
        known = [p for p in parts if p in _NOISE or p in _REPLIES]
        if known and all(p in _PLAIN or p in known for p in parts):
            return "replies" if any(p in _REPLIES for p in known) else "named"
    return ""


def _kind(tag: str, attrs: str, inside: bool) -> str:
    """"" for what may hold the article, else why it never does: hard (hidden),
    tag, named (class or id) or replies.  A <header> that heads an article is
    part of it."""
    if tag in ("html", "body"):
        return ""
    found = "tag" if tag in _CHROME or tag == "header" and not inside else ""
    if not attrs or attrs.isspace():
        return found
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "style" and _HIDDEN.search(value) or name == "aria-hidden" and value.lower() == "true":
            return "hard"
        if name == "role" and value.lower() in _ROLES:
            found = found or "tag"
        if name in ("class", "id") and tag not in ("article", "main"):
            kind = _name_kind(value)
            if kind and not (inside and "header" in value.lower()):
                found = "replies" if kind == "replies" else found or kind
    return "hard" if _FLAG.search(re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*')", "=", attrs)) else found


class Page:
    """Lines, and the elements that hold them, in page order."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.plain: list[int] = []  # characters outside of links
        self.holder: list[int] = []  # the innermost element
        #: elements: tag, parent, kind, has an h1 / article / main in it, first line, end
        self.tag, self.parent, self.kind, self.headed = ["html"], [-1], [""], [False]
        self.first, self.last = [0], [0]
        self._read(page)

    def _open(self, tag: str, kind: str, parent: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.kind.append(kind)
        self.headed.append(False)
        self.first.append(len(self.text))
        self.last.append(len(self.text))
        return len(self.tag) - 1

    def _read(self, page: str) -> None:
        stack, depth, unclosed = [0], defaultdict(int), set()
        parts: list[str] = []
        linked: list[str] = []
        link = heading = False
        link_at = articles = 0

        def end() -> None:
            text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
            if text:
                away = len(" ".join(entities.unescape("".join(linked)).split())) if linked and not heading else 0
                self.text.append(text)
                self.plain.append(max(0, len(text) - away))
                self.holder.append(stack[-1])
            parts.clear()
            linked.clear()

        def leave() -> None:
            nonlocal articles, link
            e = stack.pop()
            depth[self.tag[e]] -= 1
            articles -= self.tag[e] in ("article", "main")
            self.last[e] = len(self.text)
            link = link and len(stack) >= link_at

        at = 0
        for m in iter(lambda: _TAG.search(page, at), None):
            text = page[at : m.start()]
            if text:
                parts.append(text)
                if link:
                    linked.append(text)
            at = m.end()
            close, tag = m[1], (m[2] or "").lower()
            if not tag:
                continue
            if tag in _RAW and not close:
                stop = None
                if tag not in unclosed and not (m[3].rstrip().endswith("/") and tag in ("svg", "math", "object", "iframe")):
                    stop = re.compile(rf"</{tag}(?![A-Za-z0-9])[^>]*+(?:>|\Z)", re.I).search(page, at)
                    if not stop:
                        unclosed.add(tag)
                if stop:
                    at = stop.end()
                elif tag != "head":
                    nxt = _NEXT.search(page, at)
                    at = nxt.start() if nxt else len(page)
                continue
            if tag == "a":
                link, link_at = not close, len(stack)
                continue
            block = tag in _BLOCK
            if block:
                end()
                heading = tag in _HEADING and not close
            if tag in _VOID or tag in _RAW or tag in ("html", "body"):
                continue
            if close:
                if depth[tag] and (block or self.tag[stack[-1]] == tag):
                    while self.tag[stack[-1]] != tag:
                        leave()
                    leave()
                continue
            if block:  # a paragraph ends where the next block starts
                while len(stack) > 1 and (self.tag[stack[-1]] == "p" or self.tag[stack[-1]] not in _BLOCK):
                    leave()
            kind = _kind(tag, m[3], articles > 0)
            if block or kind or self.tag[stack[-1]] not in _BLOCK and len(stack) > 1:
                stack.append(self._open(tag, kind, stack[-1]))
                depth[tag] += 1
                articles += tag in ("article", "main")
                if tag in ("article", "main", "h1"):
                    for e in reversed(stack):
                        if self.headed[e]:
                            break
                        self.headed[e] = True
        tail = page[at:]
        if tail:
            parts.append(tail)
            if link:
                linked.append(tail)
        end()
        while stack:
            leave()

    def _sums(self, per_line: list[int]) -> list[int]:
        out = [0] * len(self.tag)
        for e, n in zip(self.holder, per_line):
            out[e] += n
        for e in range(len(out) - 1, 0, -1):  # children come after their parents
            out[self.parent[e]] += out[e]
        return out

    def judge(self) -> tuple[list[bool], list[int]]:
        """For each line: is it in an element that never holds the article; and
        the outermost <article> or <main> around it, or -1."""
        plain = self._sums(self.plain)
        away, home = [False] * len(self.tag), [-1] * len(self.tag)
        for e in range(1, len(self.tag)):
            p, kind = self.parent[e], self.kind[e]
            if kind in ("tag", "named") and self.headed[e] and 2 * plain[e] > plain[0] and self.tag[e] not in ("nav", "footer"):
                kind = ""
            away[e] = away[p] or kind != ""
            home[e] = home[p] if home[p] >= 0 else e if self.tag[e] in ("article", "main") and not away[e] else -1
        return [away[e] for e in self.holder], [home[e] for e in self.holder]

    def container(self, kept: list[bool], weights: list[int]) -> int:
        """The deepest element, other than the page and single paragraphs, that
        holds MOST of the kept weight; 0 if there is none."""
        sums = self._sums([w if k else 0 for w, k in zip(weights, kept)])
        return max((e for e in range(1, len(sums)) if sums[e] >= MOST * sums[0] > 0 and self.tag[e] not in _LEAF), default=0)


def threshold(weights: list[int], window: int, surge: float, share: float) -> float:
    """``share`` of the window sum around which half of the weight lies."""
    sums = window_sums(weights, window)
    half, run = sum(weights) / 2, 0
    for s, w in sorted(zip(sums, weights)):
        run += w
        if run >= half:
            return min(surge, share * s)
    return 0.0


def window_sums(weights: list[int], window: int) -> list[int]:
    """For each line, the sum from it over ``window`` lines."""
    out, run = [0] * len(weights), 0
    for i in range(len(weights) - 1, -1, -1):
        run += weights[i] - (weights[i + window] if i + window < len(weights) else 0)
        out[i] = run
    return out


def blocks(weights: list[int], window: int, limit: float) -> list[tuple[int, int, bool]]:
    """(first line, end, surges): stretches of lines, from a line with weight to
    a line with weight, over which window sums stay above zero."""
    sums = window_sums(weights, window)
    out, i, n = [], 0, len(weights)
    while i < n:
        if sums[i] <= 0:
            i += 1
            continue
        j, high = i, 0
        while j < n and sums[j] > 0:
            high = max(high, sums[j])
            j += 1
        first = next(k for k in range(i, j) if weights[k])
        last = next(k for k in range(j - 1, i - 1, -1) if weights[k]) + 1
        out.append((first, last, high > limit))
        i = j
    return out


def main_text(page: str | None, window: int = 3, surge: float = 120, share: float = 0.25) -> str:
    """The article's lines, joined by line feeds."""
    tree = Page(page or "")
    away, home = tree.judge()
    n = len(away)
    weights = [0 if a else w * (ARTICLE if h >= 0 else 1) for w, a, h in zip(tree.plain, away, home)]
    kept = [False] * n
    limit = threshold(weights, window, surge, share)
    found = blocks(weights, window, limit)
    for first, last, surges in found:
        if surges:
            kept[first:last] = [not a for a in away[first:last]]
    inside = sum(w for w, k, h in zip(weights, kept, home) if k and h >= 0)
    if inside and 2 * inside >= sum(w for w, k in zip(weights, kept) if k):
        whole = {h for h, k, w in zip(home, kept, weights) if k and w}
        kept = [h >= 0 and h in whole and not a for h, a in zip(home, away)]
    else:
        kept = [k and h < 0 for k, h in zip(kept, home)]
        top = tree.container(kept, weights)
        if top:
            first, last = tree.first[top], tree.last[top]
            mine = [k for k in range(first, last) if not away[k]]
            if 2 * sum(tree.plain[k] for k in mine) < sum(len(tree.text[k]) for k in mine):
                sure = [k for k in mine if kept[k]]
                mine = [k for k in mine if sure[0] <= k <= sure[-1]] if sure else []
            for k in mine:
                kept[k] = True
        for runs in (found, [*reversed(found)]):  # low blocks next to kept ones, with only menus, adverts and the like between
            near = None
            for first, last, surges in runs:
                if not kept[first] and near is not None and all(away[k] for k in range(min(near, last), max(near, first))):
                    kept[first:last] = [not a for a in away[first:last]]
                near = (last if runs is found else first) if kept[first] else None
    return "\n".join(x for x, k in zip(tree.text, kept) if k)


def texts(page: Column, window: int = 3, surge: float = 120, share: float = 0.25) -> Column:
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py(), window, surge, share) for p in pages], pa.string())

    return F.arrow_udf(run, "string").asNondeterministic()(page)


def extract(pages: DataFrame, window: int = 3, surge: float = 120, share: float = 0.25) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each page."""
    rows = pages.select("page_id", "url", texts(F.col("html"), window, surge, share).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
