"""Line-block distribution: the sums against a slow version, and pages on which
they, not the tags, decide."""

import random
import time

import duckdb
import pytest

from gridweave.llm import html_main as h

L = "A sentence of about ninety characters that goes on and on for as long as it has to, and more."


def slow_blocks(weights, window, limit):
    """Every stretch of lines whose own window sums are all above zero, found
    by trying all first and last lines."""
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    out = []
    for i in range(n):
        for j in range(i + 1, n + 1):
            whole = all(sums[i:j]) and (i == 0 or not sums[i - 1]) and (j == n or not sums[j])
            if whole:
                lines = [k for k in range(i, j) if weights[k]]
                out.append((lines[0], lines[-1] + 1, max(sums[i:j]) > limit))
    return out


def test_blocks_equal_a_slow_version():
    rng = random.Random(1)
    for _ in range(400):
        weights = [rng.choice([0, 0, 0, 5, 40, 300]) for _ in range(rng.randint(0, 30))]
        window, limit = rng.randint(1, 5), rng.choice([0, 30, 120])
        assert h.blocks(weights, window, limit) == slow_blocks(weights, window, limit)
        assert h.window_sums(weights, window) == [sum(weights[i : i + window]) for i in range(len(weights))]


def test_the_window_decides_what_is_kept():
    links = "<p><a href=x>link</a></p>"
    page = f"<body><p>{L}</p><p>{L}</p>{links * 3}<p>© a note</p>{links * 5}<p>another note"
    assert h.main_text(page, window=1).count("\n") == h.main_text(page, window=3).count("\n") == 1
    assert h.main_text(page, window=4).endswith("link\n© a note") and "another" not in h.main_text(page, window=4)
    assert h.main_text(page, window=3, share=0).endswith("another note")


def test_pages_without_article_give_the_same_text():
    rows = duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (page,) in rows:
        want = h.main_text(page)
        assert page is None or want
        for tag in ("div", "section", "p"):
            assert h.main_text(page and page.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>")) == want


@pytest.mark.parametrize("page, want", [
    (f"<article><p>{L}</p><div class='ad'>Buy</div><p>The end.</p></article>", f"{L}\nThe end."),
    (f"<div id='page' class='site no-sidebar'><nav>x</nav><p>{L}</p></div>", L),
    (f"<article><div class=article-header><h1>T</h1></div><p>{L}</p></article>", f"T\n{L}"),
    ("<article><h1>Title</h1><p><a>one</a></p><p><a>two</a></p></article>", "Title\none\ntwo"),
    (f"<p title=O'Brien>{L} It's fine</p><p>{L}</p>", f"{L} It's fine\n{L}"),
    (f"<noscript>x<p>{L}</p><object>y<p>{L}</p><textarea>z<p>{L}</p>", f"{L}\n{L}\n{L}"),
    (f"<form id=aspnet><h1>Head</h1><p>{L}</p></form><form>Send us your mail address, please, as soon as you can</form>", f"Head\n{L}"),
    (f"<div class='siteHeader'>Name of the site</div><div class=text><p>{L}</p></div><div class='cookie-notice'>{L}</div>", L),
    (f"<main><p>{L}</p></main><section class=comments><article><h1>Re:</h1><p>{L * 9}</p></article></section>", L),
    (f"<article><p>{L}</p></article><div>A few words of the site's own</div>", L),
    (f"<div><article><a href=x>Teaser</a> of it</article></div><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul><div><p>{L * 3}</p><p>{L * 3}</p></div>", f"{L * 3}\n{L * 3}"),
    (f"<div><p>{L}</p><p>{L}</p><b><div>in bold</b></div><p>{L}</p></div>", f"{L}\n{L}\nin bold\n{L}"),
    (f"<div style='display: none'>{L}</div><div hidden>{L}</div><p data-x='hidden'>{L}", L),
    ("<nav><p>only a menu</p></nav>", ""), ("<div class=ad>Buy now</div>", ""),
])
def test_pages(page, want):
    assert h.main_text(page) == want


@pytest.mark.parametrize("page", [
    "</b>" * 100_000, "<div>" * 50_000 + "</b>" * 50_000, "<noscript>" * 50_000, "<a title='" * 50_000, "<p class=ad>" * 50_000,
    "<span class=ad>" * 30_000 + "</i></a>" * 30_000, "<div><h1>a</h1>" * 20_000, '="' * 100_000, "<!--" * 60_000, "<p>word</p>" * 50_000,
])
def test_time_is_linear(page):
    start = time.perf_counter()
    h.main_text(page)
    assert time.perf_counter() - start < 2
