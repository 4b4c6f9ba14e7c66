"""HTML extraction: layouts that the labelled table doesn't hold, the tables' pages, broken and odd pages."""

from __future__ import annotations

import html as h
import re
import time

import pytest

from folio.llm import html

LONG = " ".join(f"word{i}" for i in range(70)) + "."
MORE = "Another paragraph, " + " ".join(f"term{i}" for i in range(45)) + "."
TITLE = "A title of some words"
CHROME = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li></ul></nav>'
BODY = f"<h1>{TITLE}</h1><p>{LONG}</p><p>{MORE}</p>"
WANT = f"{TITLE}\n\n{LONG}\n\n{MORE}"


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout has-sidebar"><article>{BODY}</article></div>',
        f'<div class="page with-sidebar"><article>{BODY}</article></div>',
        f'<div class="content search-enabled"><article>{BODY}</article></div>',
        f'<div class="post share-count-3"><article>{BODY}</article></div>',
        f'<div class="reader-content"><article>{BODY}</article></div>',
        f"<article><header><h1>{TITLE}</h1></header><p>{LONG}</p><p>{MORE}</p></article>",
        f"<div>{BODY}</div>",
        f'<div class="page-with-sidebar"><div id="text">{BODY}</div></div>',
        f'<article>{BODY}<div class="share-buttons"><a href="#">Tweet</a> this</div></article>',
        f'<article>{BODY}</article><section class="comments"><h2>Comments</h2><div class="comment"><p>{MORE}</p></div></section>',
        f"<main>{BODY}<aside><p>{LONG}</p></aside></main>",
        f'<form action="/x"><div>{BODY}</div></form>',
        f'<a href="/"><div>A card that is a link</div></a><article>{BODY}</article>',
        f'<article><h1>{TITLE}</h1><p>{LONG}<script>if (a < b) "</p>"</script><style>p {{}}</style><!-- <p>no --></p><p>{MORE}</article>',
        f'<article><h1 title="a > b">{TITLE}</h1><p>{LONG.replace(" ", " &#32;&#10;", 3)}<p>{MORE}</article>',
    ],
)
def test_layouts(page):
    for start, end in (("", ""), (CHROME, "<footer>&copy; 2024 Some Company</footer>")):
        assert html.main_text(f"<html><body>{start}{page}{end}</body></html>") == WANT


def test_labelled_table_is_learnt_and_carries_over():
    x, y = html.labelled()
    tree = html.tree()
    assert sum(html.classify(tree, f.tolist()) != v for f, v in zip(x, y, strict=True)) <= 2
    right = total = 0
    layouts = html.LAYOUTS.strip().splitlines()
    for k in range(len(layouts)):  # each layout judged by a tree that hasn't seen it
        left = html.LAYOUTS
        try:
            html.LAYOUTS = "\n".join(layouts[:k] + layouts[k + 1 :])
            other = html.grow(*html.labelled())
            html.LAYOUTS = layouts[k]
            fx, fy = html.labelled()
        finally:
            html.LAYOUTS = left
        right, total = right + sum(html.classify(other, f.tolist()) == v for f, v in zip(fx, fy, strict=True)), total + len(fy)
    assert right / total > 0.9


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html.extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        want = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", "\n"))).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert r.text == "\n\n".join(b for b in want if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize("bit", ["<a b ", '<a b="', "<p title='", "<svg>", "<script", "<!--", "<div>", "</script ", "<a href=x>", "&amp", "< ", '<p class="a" "', "</b>", "<table><tr>"])
def test_broken_markup_takes_linear_time(bit):
    for start in ("", "<script>", "<p>text "):
        began = time.perf_counter()
        html.main_text(start + bit * (1_000_000 // len(bit)))
        assert time.perf_counter() - began < 6


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "no markup at all but some words that stand alone"), (4, "<"), (5, "<p"), (5, "<p"), (None, f"<p>{LONG}"), (6, f"<article><p>{LONG * 3000}</article>"), (7, "<!-- never ends"), (8, "<script>never ends")]
    df = spark.createDataFrame([(*r, "mine", 5, "here") for r in rows], "page_id long, html string, text string, n_chars int, url string")
    out = html.extract(df)
    assert out.columns == ["page_id", "html", "url", "text", "n_chars"]
    got = sorted(((r.page_id or 0, r.text) for r in out.collect()), key=str)
    assert len(got) == len(rows)
    by = dict(got)
    assert by[1] == by[2] == by[4] == by[7] == by[8] == "" and by[0] == LONG and by[6] == LONG * 3000
    assert html.extract(df.limit(0)).count() == 0
