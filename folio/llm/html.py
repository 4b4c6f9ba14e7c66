"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into a flat list of text blocks. Each is described by its word count and link density,
those of the blocks before and after it, and the elements it stands in; a decision tree, grown here
from the labelled blocks of the layouts below, tells content from boilerplate. No feature decides
alone: what a class name hints at counts less the more of the page's words its element holds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FEATURES = "words link words_before link_before words_after link_after frame hint share article page_article heading".split()

#: The labelled table: page layouts as they are in use, +n being n words of content and -n of boilerplate.
LAYOUTS = """
<nav><ul><li><a>-1</a><li><a>-1</a><li><a>-2</a></ul></nav><div class=ad>-8</div><article><h1>+7</h1><p>+80<p>+60</article><footer>-9</footer>
<nav><a>-1</a><a>-1</a></nav><div class=ad>-40</div><article><h1>+4</h1><p>+1</p><p>+2</p></article><footer>-14 <a>-2</a></footer>
<header><a>-2</a><nav><ul><li><a>-1</a><li><a>-1</a></ul></nav></header><main><article><header><h1>+9</h1><p>+20</header><p>+90<h2>+3</h2><p>+45<ul><li>+6<li>+3<li>+12</ul><p>+30 <a>+4</a></article></main><aside><h3>-3</h3><p>-30</aside><footer><p>-12</footer>
<div class="header"><a>-1</a></div><div class="layout has-sidebar"><article><p>+120<p>+70</article><div class="sidebar"><h3>-2</h3><ul><li><a>-6</a><li><a>-7</a></ul><p>-25</div></div><div class=footer>-8</div>
<div id=cookie-notice><p>-30 <a>-2</a></div><article><h1>+8</h1><div class=share><a>-1</a><a>-1</a></div><p>+60<div class=ad-slot>-12</div><p>+55<p>+4</article><section id=comments><h3>-2</h3><div class=comment><p>-40</div><div class=comment><p>-75</div><form><p>-4</form></section>
<article><h1>+6</h1><p>+30<p>+35<div class=related-posts><h3>-2</h3><a>-7</a><a>-9</a></div><div class=comments><p>-60<p>-90<p>-20<p>-44</div></article>
<main><h1>+5</h1><p>+18<pre>+30</pre><p>+9<table><tr><td>+2<td>+5<tr><td>+1<td>+8</table></main><footer><a>-1</a><a>-2</a></footer>
<article><h1>+3</h1><blockquote>+15</blockquote><p><a>+5</a></p><p>+14 <a>+10</a></p></article><div>-9</div><div>-30</div><div><a>-4</a></div>
<div class=popup>-20</div><article><h2>+6</h2><p>+3<p>+100</article><article class=comment><p>-35</article><article class=comment><p>-12</article>
<div id=main><h1>+7</h1><p>+50<p>+22 <a>+3</a></div><div class=promo><p>-28</div><div class=newsletter><p>-16</div>
<nav><a>-1</a></nav><main><section><h2>+2</h2><p>+25</section><section><h2>+4</h2><p>+40</section></main><div class=disclaimer><p>-70</div>
<div class="page with-sidebar"><article><p>+200</article></div>
<aside><article><h3>-5</h3><p>-18</article></aside><article><h1>+8</h1><p>+64<p>+1<p>+2<p>+90</article>
<div><p>+100</div>
<p>+45
<div>+30</div>
<div><p>+90<p>+70<p>+120</div>
<div><p>+60</div><div><p>+50</div><div><p>+22</div><div><p>+35</div>
<div><h1>+6</h1><p>+80<p>+45<p>+30 <a>+3</a></div><div>-6</div>
<h1>+4</h1><p>+22<p>+50<h2>+3</h2><p>+30<h2>+5</h2><p>+60<p>+18
<ul><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul><h1>+9</h1><div>+70</div><div>+9</div><div>+40</div><div>+4</div><div>+55</div><div>-5</div>
<div class=menu><a>-1</a><a>-1</a></div><div class=content><h2>+5</h2><p>+35<p>+80<p>+20</div><div class=comments><p>-30<p>-50</div><div class=footer>-7</div>
<div class=nav><a>-1</a><a>-2</a></div><div class=text><p>+25<p>+30</div><div id=comments><p>-80<p>-120<p>-40<p>-60</div>
<form><div><a>-1</a><a>-1</a></div><div><h1>+5</h1><p>+60<p>+90</div><div>-6</div></form>
<div class="content search-enabled"><p>+75<p>+50</div><div class=search><form>-3</form></div>
<table><tr><td><a>-1</a><br><a>-2</a><td><h1>+4</h1>+90<p>+40<td class=sidebar>-30</table><div>-7</div>
<div><a>-2</a></div><div><a>-1</a></div><div><a>-2</a></div><div>+65</div><div>+40</div><div><a>-7</a></div><div><a>-5</a></div><div>-4</div>
<div class=banner>-10</div><div><h1>+5</h1><div>+40</div><div class=advert>-25</div><div>+60</div><div class=share><a>-1</a><a>-1</a></div></div>
<div><h3>-3</h3><a>-5</a><a>-6</a><a>-4</a></div><div><h1>+8</h1><p>+33<p>+47</div><div><h3>-2</h3><a>-8</a><a>-6</a></div>
<div>-2</div><div>-3</div><div><p>+40 <a>+4</a><p>+60 <a>+12</a></div><div>-9</div><div><a>-2</a> -2</div>
<div><a>-12</a></div><div><a>-25</a> -4</div><div><a>-30</a> -6</div><div><h2>+6</h2><p>+55<p>+48</div>
<nav><a>-1</a></nav><article><h1>+2</h1><p>+60<p>+3</article>
<article><h1>+1</h1><p>+9</article>
<article><p>+2<p>+1<p>+4</article>
<main><h1>+3</h1><p>+12<p>+1<ul><li>+1<li>+2<li>+1</ul></main>
<article><h1>+5</h1><p>+30<p><a>+6</a></article>
<div class=post><h2>+1</h2><p>+40<h2>+2</h2><p>+5<p>+55<p>+6</div><div>-4</div>
<div><a>-1</a> <a>-1</a></div><h1>+2</h1><p>+48<p>+51<div>-1</div>
<div><h1>+1</h1><p>+30<h2>+2</h2><p>+28<h2>+1</h2><p>+44</div><div><h3>-1</h3><a>-4</a><a>-3</a></div>
<div><h1>+3</h1><p>+20<p>+6<p>+31<p>+9<p>+24</div>
<article><h1>+5</h1><p>+30 <a>+4</a><h2>+4</h2><p>+40 <a>+6</a><p>+6<p>+20 <a>+3</a><h2>+3</h2><p>+12 <a>+2</a></article><footer>-3 <a>-1</a></footer>
<div><h1>+6</h1><p>+35 <a>+4</a><h2>+5</h2><p>+44 <a>+5</a><h2>+3</h2><p>+28 <a>+3</a><p>+26</div>
<div class=search><h1>+5</h1><p>+70<p>+45</div>
<nav><a>-1</a></nav><div class=share><p>+50<p>+70<p>+30</div><footer>-6</footer>
<article><h1>+6</h1><p>+70<p>+40<div class=share-buttons><a>-1</a> -1</div><p>+33<p><a>+5</a><p>+25<div class=related><a>-6</a><a>-8</a></div></article>
<main><h1>+4</h1><p>+55<div class=social><a>-1</a><a>-1</a></div><p>+28<ul><li><a>+3</a><li><a>+4</a></ul><p>+30<div class=pager><a>-2</a> <a>-2</a></div></main><footer>-8</footer>
<div class=alert>-15</div><div class=sidebar><p>-45<p>-30</div><div class=entry-text><p>+85<p>+40</div><div class=copyright>-20</div>
"""

#: Elements whose content is raw text or not of the page, those that are closed where they stand if nothing closes
#: them, and those that frame a page.
RAW = frozenset("script style title noscript template iframe textarea".split())
UNSEEN = frozenset("object svg math canvas select datalist audio video option".split())
FRAME = frozenset("nav header footer aside menu dialog button fieldset".split())
#: Elements that don't end a block; all others do.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that nothing is closed by, or whose end is often left out: they aren't containers.
LEAVES = frozenset("p li dt dd tr td th html body head option".split())
#: Words of class, id and role that hint at boilerplate if they end a name, or begin it before a word of PARTS.
BOILER_WORDS = frozenset(
    "ad adbox ads adsense adslot adunit advert adverts advertisement advertising alert alerts announcement banner breadcrumb breadcrumbs colophon "
    "comment commentlist comments complementary consent contentinfo cookie cookies copyright disclaimer disqus foot footer gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup privacy promo promoted rail recommended related replies "
    "reply search sharing share sidebar signup skip social sponsor sponsored subscribe teaser teasers toolbar topbar widget widgets".split()
)
PARTS = frozenset(
    "area articles bar block body bottom box buttons card cards column container content entry form group holder icons inner item items label left link links list "
    "main message panel posts region right row section slot stories text thread title top unit wrap wrapper zone".split()
)
#: Words of names that tell what an element has or is like, not what it is.
STATES = frozenset("has with without no is not hide hides show shows can use uses enable".split())
ARTICLE_WORDS = frozenset("article articlebody entry post main".split())

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
#: To the end of a tag, quoted values as wholes; possessive, so that no text is read twice.
_TAIL = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+""")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


@dataclass
class Block:
    text: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    frame: bool = False
    hint: int = -1  # the outermost element that hints at boilerplate, by its number
    article: bool = False
    heading: bool = False


@dataclass(frozen=True)
class Place:
    """What holds for all that stands in an element."""

    name: str = ""
    frame: bool = False
    hint: int = -1
    article: bool = False


class _Page:
    """Reads markup once, from left to right; what isn't found after a place isn't sought again."""

    def __init__(self, html: str):
        self.html = html
        self.out: list[Block] = []
        self.now = Block()
        self.stack = [Place()]
        self.open: Counter[str] = Counter()
        self.hints, self.link, self.heading = 0, -1, False  # link: depth of the stack where a link was opened
        self.unclosed: set[str] = set()

    def close(self, place: Place | None = None) -> None:
        if self.now.text:
            self.out.append(self.now)
        p = place or self.stack[-1]
        self.now = Block(frame=p.frame, hint=p.hint, article=p.article, heading=self.heading)

    def add(self, text: str) -> None:
        if text:
            self.now.text.append(text)
            if self.link >= 0:
                self.now.linked.append(text)

    def read(self) -> list[Block]:
        html, at, end = self.html, 0, len(self.html)
        while at < end:
            lt = html.find("<", at)
            if lt < 0 or lt + 1 >= end:
                self.add(html[at:])
                break
            self.add(html[at:lt])
            m = _NAME.match(html, lt + 1)
            if m is None:
                at = self.marked(lt)
                continue
            tail = _TAIL.match(html, m.end())
            if tail.end() >= end:
                break  # a tag that never ends takes the rest, as browsers have it
            at = tail.end() + 1
            name = m.group(1).lower()
            if html[lt + 1] == "/":
                self.ends(name)
            elif name in RAW or name in UNSEEN:
                at = self.skipped(name, at, tail.group().endswith("/"))
            else:
                self.starts(name, tail.group())
        self.close()
        return self.out

    def marked(self, lt: int) -> int:
        """Behind a comment or declaration; a '<' that opens nothing is text."""
        html = self.html
        if html.startswith("<!--", lt):
            to = html.find("-->", lt + 2)
            return to + 3 if to >= 0 else len(html)
        if html[lt + 1] in "!?/":
            to = html.find(">", lt)
            return to + 1 if to >= 0 else len(html)
        self.add("<")
        return lt + 1

    def skipped(self, name: str, at: int, closed: bool) -> int:
        if name not in INLINE:
            self.close()
        if closed and name in UNSEEN or name in self.unclosed:
            return at
        m = _closing(name).search(self.html, at)
        if m is None:
            self.unclosed.add(name)
            return len(self.html) if name in RAW else at
        tail = _TAIL.match(self.html, m.end()).end()
        return tail + 1

    def ends(self, name: str) -> None:
        if name == "a":
            self.link = -1
        elif name not in INLINE:
            self.heading = False
            if self.open[name]:
                while True:
                    gone = self.stack.pop().name
                    self.open[gone] -= 1
                    if gone == name:
                        break
                if len(self.stack) < self.link:
                    self.link = -1  # a link left open ends with the element it stands in
            self.close()

    def starts(self, name: str, attributes: str) -> None:
        if name == "a":
            self.link = len(self.stack)
        if name in INLINE or name in VOID:
            if name == "br":
                self.add("\n")
            elif name not in INLINE:
                self.close()
            return
        up = self.stack[-1]
        boiler, main = _hints(attributes) if attributes else (False, False)
        article, hint, frame = up.article, up.hint, up.frame
        if name in ("article", "main") or main:
            article = True
            hint = hint if up.article else -1  # an article isn't what the page around it hints at
        frame |= name in FRAME and not (name == "header" and article)
        if (boiler or name == "form") and hint < 0:
            hint, self.hints = self.hints, self.hints + 1
        self.heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        place = Place(name, frame, hint, article)
        if name not in LEAVES:
            self.stack.append(place)
            self.open[name] += 1
        self.close(place)


@lru_cache(maxsize=64)
def _closing(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)


@lru_cache(maxsize=4096)
def _hints(attributes: str) -> tuple[bool, bool]:
    """Do the names of an element hint at boilerplate, at the article?"""
    names = [[w for w in _SPLIT.split(n) if w] for m in _ATTRIBUTE.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split()]
    names = [n for n in names if n and not STATES.intersection(n)]
    boiler = any(n[-1] in BOILER_WORDS or (n[0] in BOILER_WORDS and n[-1] in PARTS) for n in names)
    return boiler, any(len(n) == 1 and n[0] in ARTICLE_WORDS for n in names)


def blocks(html: str) -> list[tuple[str, list[float]]]:
    """Text and features of the blocks of a page, in its order; reads it once."""
    texts = [(" ".join(unescape("".join(b.text)).split()), b) for b in _Page(html).read()]
    texts = [(t, b) for t, b in texts if t]
    page_article = float(any(b.article for _, b in texts))
    counts = [float(t.count(" ") + 1) for t, _ in texts]
    density = [min(1.0, len("".join("".join(b.linked).split())) / max(1, len("".join("".join(b.text).split())))) for _, b in texts]
    n, held = len(texts), Counter()
    for c, (_, b) in zip(counts, texts, strict=True):
        held[b.hint] += c
    total = sum(counts)
    return [
        (
            t,
            [counts[i], density[i], counts[i - 1] if i else 0.0, density[i - 1] if i else 0.0,
             counts[i + 1] if i + 1 < n else 0.0, density[i + 1] if i + 1 < n else 0.0,
             float(b.frame), float(b.hint >= 0), held[b.hint] / total if b.hint >= 0 else 0.0, float(b.article), page_article, float(b.heading)],
        )
        for i, (t, b) in enumerate(texts)
    ]


@dataclass
class Node:
    label: int
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p) * len(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node:
    """A CART tree by Gini impurity; ties go to the first feature and the lowest cut."""
    node = Node(int(2 * y.sum() >= len(y)))
    if depth == 0 or y.min() == y.max():
        return node
    best = (_gini(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            impurity = _gini(y[low]) + _gini(y[~low])
            if impurity < best[0] - 1e-9:
                best = (impurity, f, float(cut))
    if best[1] < 0:
        return node
    low = x[:, best[1]] < best[2]
    node.feature, node.cut = best[1], best[2]
    node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The features of the blocks of LAYOUTS, and 1 for content."""
    rows = []
    for layout in LAYOUTS.strip().splitlines():
        page = re.sub(r"([+-])(\d+)", lambda m: " ".join(["good" if m[1] == "+" else "poor"] * int(m[2])), layout)
        rows += [(f, int("poor" not in t)) for t, f in blocks(page)]
    return np.array([f for f, _ in rows]), np.array([y for _, y in rows])


@lru_cache(maxsize=1)
def tree() -> Node:
    return grow(*labelled())


def classify(node: Node, features: list[float]) -> int:
    while node.feature >= 0:
        node = node.low if features[node.feature] < node.cut else node.high
    return node.label


def main_text(html: str | None) -> str:
    """Content blocks, each with single spaces and trimmed, joined by an empty line."""
    t = tree()
    return "\n\n".join(text for text, f in blocks(html or "") if classify(t, f))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add the main text of each page and its number of code points, n_chars.

    A null or empty page, or one without content, has an empty text. Broken markup is read as far as
    it goes: an unclosed comment, script, style or tag ends with the page. Pages of any length are read whole, in time
    linear in it. Columns of the names added are replaced, others stay; repeated rows give equal texts; a table without
    rows gives none. No shuffle.
    """
    base = pages.drop(text_col, "n_chars")
    at, names = base.columns.index(html_col), [*base.columns, text_col, "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                b = batch.slice(i, 500)
                texts = [main_text(h) for h in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    added = [T.StructField(text_col, T.StringType()), T.StructField("n_chars", T.LongType())]
    return base.mapInArrow(run, T.StructType([*base.schema.fields, *added]))
