"""Main text of web pages: flat blocks with word counts and link densities of neighbours, classified by a decision tree.

A page falls into blocks at its block tags. Each has a few numbers: its words, its link density, the same of the block
before and after, and where it stands (inside a container of page furniture, inside one of content, heading or not).
A decision tree learned from the small labelled table below keeps a block or not; the text is the kept blocks in page
order. The table is the labelled blocks of `LABELLED`, a few short invented pages of different make; its size is fixed.

Defined results: a null or empty page, or one without a kept block, gives an empty text; tags that are not closed or
not opened are put up with, and only raw text (scripts and the like) reaches to the end of the page if not closed; character references are decoded; white space in a block becomes one space; blocks are
joined by one line break; nothing is cut; repeated rows are treated each; an empty table gives an empty result; extra
columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from schemaloom.llm.tables import pieces

# What may stand in a tag; the bound on its parts keeps broken quotes from being read again and again.
ATTRIBUTES = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+'){0,200}+"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>{ATTRIBUTES})>"
    r"|</?[a-zA-Z!?][^<>]*+>?|(?P<text>[^<]++|<)",
    re.S | re.I,
)
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table
    tbody td tfoot th thead tr ul""".split()
)
#: Elements whose content is no text of the page, and that reach to the end of the page if they are not closed.
RAW = "script style template noscript iframe textarea title".split()
_BLOCK_TAG = rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])"
_OUTER = r"<(?:foreignobject|annotation-xml)(?=[\s>])"
#: Others whose content is no text, and what ends them besides their end tag; without any end only the tag is left out.
ENDED_BY = {
    "svg": _BLOCK_TAG,
    "math": _BLOCK_TAG,
    "option": rf"</?(?:option|optgroup|datalist|select)(?=[\s/>])|{_BLOCK_TAG}",
    "select": r"<(?:select|textarea|input)(?=[\s/>])",
    "button": r"<button(?=[\s/>])",
    "object": None,
    "canvas": None,
}
_ENDS = {
    x: re.compile(rf"(?P<own></{x}(?=[\s/>])[^>]*+>)" + (f"|{more}" if more else ""), re.I)
    for x, more in {**dict.fromkeys(RAW), **ENDED_BY}.items()
}
#: In these, content of the page's own kind may stand, which does not end them.
_MIXED = {x: re.compile(rf"(?P<own></{x}(?=[\s/>])[^>]*+>)", re.I) for x in ("svg", "math")}
_MIXES = re.compile(_OUTER, re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that a new one of the same kind ends.
CLOSED_BY_NEXT = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset".split())
CONTENT = frozenset(("article", "main"))
FURNITURE_NAMES = frozenset(
    """ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs byline comment comments
    commentlist consent cookie cookies copyright disqus disclaimer feedback footer gdpr header legal login masthead menu
    meta modal nav navbar navigation newsletter notice notices notification pagination pager popup popover promo promoted
    related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toc
    toolbar topbar widget widgets""".split()
)
CONTENT_NAMES = frozenset("article articlebody content entry main maincontent post postbody story text".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words by which a name tells what a page has or lacks, not what the element is.
LAYOUT = frozenset("and has hide is no not show with without".split())
#: How far a tag marks what is below it as furniture: by a mere word in a name, or in itself.
WEAK, STRONG = 1, 2
ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
ARTICLE = re.compile(r"<article(?=[\s/>])", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: bool
    content: bool
    heading: bool
    mark: str | None = None  # the label in a labelled page


def _by_name(name: str, whole: str) -> int:
    """Whether a class or id of an element marks furniture."""
    if name in ("html", "body", "main"):  # theirs tell about the page
        return 0
    if whole.lower() in FURNITURE_NAMES:
        return STRONG
    parts = {x.lower() for x in NAME_PART.findall(whole)}
    return WEAK if name != "article" and parts & FURNITURE_NAMES and not parts & LAYOUT else 0


def _place(name: str, rest: str) -> tuple[int, bool, str | None]:
    """How far a tag opens a container of furniture, whether it opens one of content, and its label."""
    furniture, content, mark, named = STRONG if name in FURNITURE else 0, name in CONTENT, None, False
    by_name = 0
    if rest:
        for key, *values in ATTRIBUTE.findall(rest):
            key, value = key.lower(), next(filter(None, values), "")
            if key in ("class", "id"):
                for whole in value.split():
                    by_name = max(by_name, _by_name(name, whole))
                    named |= whole.lower().replace("-", "").replace("_", "") in CONTENT_NAMES
            elif key == "role":
                furniture = max(furniture, STRONG * (value.lower() in FURNITURE_ROLES))
                content |= value.lower() in ("main", "article")
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                furniture = STRONG
            elif key == "data-keep":
                mark = value
    if not (name == "article" and named):  # class='post social' of an article lists its tags
        furniture = max(furniture, by_name)
    return furniture, (content or named) and not furniture, mark


def _is_furniture(stack: list[tuple[str, int, bool, str | None]], only: bool) -> bool:
    """Furniture above; main and a page's only article stand inside no furniture that only a word of a name tells of."""
    found = 0
    for name, furniture, _, _ in stack:
        if found == WEAK and not furniture and (name == "main" or only and name == "article"):
            found = 0
        found = max(found, furniture)
    return found > 0


def _tokens(html: str) -> Iterator[re.Match]:
    """Comments, tags and texts of a page, without silent elements."""
    at, endless = 0, set()

    def end_of(expression: re.Pattern, start: int, stop: int = -1) -> re.Match | None:
        if expression in endless:  # no place is searched twice in vain
            return None
        found = expression.search(html, start, stop if stop >= 0 else len(html))
        if found is None and stop < 0:
            endless.add(expression)
        return found

    while token := TOKEN.match(html, at):
        at = token.end()
        name = (token["name"] or "").lower()
        if token["end"] or name not in _ENDS:
            yield token
        elif name not in _MIXED or not token["rest"].endswith("/"):  # a closed svg or math is over
            end = end_of(_ENDS[name], at)
            if end and name in _MIXED and not end["own"] and _MIXES.search(html, at, end.start()):
                end = end_of(_MIXED[name], at) or end
            if end:
                at = end.end() if end["own"] else end.start()
            elif name not in ENDED_BY:
                return


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order; those without a word are left out."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, str | None]] = []
    only = len(ARTICLE.findall(html)) == 1
    parts: list[str] = []
    linked: list[str] = []
    links = 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            words = unescape("".join(parts)).split()
            if words:
                inside = len(unescape("".join(linked)).split())
                heading = any(len(x[0]) == 2 and x[0][0] == "h" and x[0][1].isdigit() for x in stack)
                marks = [x[3] for x in stack if x[3]]
                places = (_is_furniture(stack, only), any(x[2] for x in stack))
                out.append(Block(" ".join(words), len(words), inside, *places, heading, marks[-1] if marks else None))
            parts, linked = [], []

    for token in _tokens(html):
        text = token["text"]
        if text is not None:
            parts.append(text)
            if links:
                linked.append(text)
            continue
        if token["name"] is None:
            continue
        name, closing, rest = token["name"].lower(), bool(token["end"]), token["rest"]
        if name == "br":
            parts.append(" ")
            linked.append(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        block = name in BLOCK
        if block:
            close()
            links = 0
        if closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                del stack[at:]
            continue
        if name in VOID:
            continue
        if block:
            while stack and name in CLOSED_BY_NEXT.get(stack[-1][0], ()):
                stack.pop()
            if name in ("p", *CLOSED_BY_NEXT):  # inline tags left open don't keep a paragraph open
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK), None)
                if at is not None and name in CLOSED_BY_NEXT.get(stack[at][0], ()):
                    del stack[at:]
            if name in CONTENT:  # furniture that was never closed ends here
                while stack and stack[-1][0] in ("nav", "header", "footer", "p", "ul", "li"):
                    stack.pop()
        if block or rest:
            stack.append((name, *_place(name, rest)))
    close()
    return out


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "content", "heading")


def features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES per block; beyond the page's ends are blocks without words or links."""
    rows = [(b.words, b.linked / b.words) for b in found]
    near = [(0, 0.0), *rows, (0, 0.0)]
    return np.array(
        [
            (*rows[i], *near[i], *near[i + 2], float(b.furniture), float(b.content), float(b.heading))
            for i, b in enumerate(found)
        ],
        np.float64,
    ).reshape(-1, len(FEATURES))


#: Pages with labels, learned from as they stand: data-keep="1" is main text, data-keep="0" is not.
LABELLED = (
    """<nav data-keep="0"><ul><li><a href="/">Home</a><li><a href="/n">News of the day</a></ul></nav><article data-keep="1">
    <h1>How bees find their way</h1><p>Bees look at the sun and at the light around it, and they remember hedges.</p>
    <p>So they do.</p><p>Read <a href="/x">the study on bees</a> for what was measured in the summer of that year.</p>
    <ul><li>clover</li><li>heather in late summer</li></ul></article><footer data-keep="0"><p>All rights reserved.</p></footer>""",
    """<header data-keep="0"><h1>The Daily Paper</h1><p>News since 1901, every morning at your door</p></header><main data-keep="1">
    <h2>River rises</h2><p>After a week of rain the river stood two metres above its usual level on Monday.</p><p>No one was hurt.</p>
    <aside data-keep="0"><p>Weather: more rain is expected over the next four days in all of the north.</p></aside>
    <p>Work on the dam goes on.</p><div class="related" data-keep="0"><a href="/a">Dam closed for repairs</a></div></main>""",
    """<div class="cookie-notice" data-keep="0"><p>We use cookies to make this site better for you and for our partners.</p></div>
    <div id="menu" data-keep="0"><a href="/1">One</a> <a href="/2">Two</a></div><div id="content" data-keep="1"><h1>Bread</h1>
    <p>Mix flour, water and salt, wait for a night, then fold the dough four times and bake it hot.</p><p>Let it cool.</p></div>
    <div class="comments" data-keep="0"><h3>Comments</h3><p>I have tried this with rye and it came out very well, thank you so much!</p>
    <p>Nice.</p></div><div class="sidebar" data-keep="0"><p>About the author, who bakes and writes in a small town by the sea.</p></div>""",
    """<div data-keep="0"><a href="/">Start</a></div><div data-keep="0"><a href="/f">Forum</a> <a href="/w">Wiki</a></div><div data-keep="1">
    <p>The old mill was built of stone in the year after the great fire, and it worked until the war came to the valley.</p>
    <p>Its wheel is lost.</p><p>Today the building houses a school with some forty children from the villages around it.</p></div>
    <div data-keep="0"><a href="/imprint">Imprint</a></div><div data-keep="0">Contact</div>""",
    """<table><tr><td data-keep="0"><a href="/p">Products</a></td><td data-keep="0"><a href="/s">Support pages</a></td></tr><tr><td data-keep="1">
    <p>To set the clock, hold the left button until the hours blink, then turn the wheel and press it once more.</p>
    <p>A long press turns the alarm off for one day only, and the display shows a small bell with a line through it.</p></td></tr></table>
    <form data-keep="0"><p>Sign up for our letter and hear of new offers before all others do, once a week at most.</p></form>""",
    """<article data-keep="1"><h1>Short note</h1><p>Gone fishing.</p></article><div class="ad" data-keep="0">Buy two lamps and get one more
    for nothing, this week only in all of our shops.</div><footer data-keep="0">&copy; somebody, somewhere, all of it made by hand.</footer>""",
    """<div class="ad" data-keep="0">Cheap flights to the sun.</div><article data-keep="1"><p><a href="/whole">The whole report can be read here</a></p>
    <blockquote>We did what we could.</blockquote><pre>x = 1</pre><div class="share" data-keep="0">Share this</div></article>
    <section class="comments" data-keep="0"><article><p>First! What a fine report this is, I shall read it to my children.</p></article></section>""",
    """<p data-keep="0">Menu</p><p data-keep="0"><a href="/l">Log in</a></p><p data-keep="1">Two hundred people came to the square to hear the
    band play the songs that their parents had danced to when the square was still a field.</p><p data-keep="1">Some sang along with it.</p>
    <p data-keep="1">When the rain began nobody left, and the band played on under the roof of the market hall until it was night.</p>
    <p data-keep="0"><a href="/older">Older posts</a></p><p data-keep="0">Top</p>""",
    """<div data-keep="0"><a href="/1">How to choose a good bicycle for the city</a></div><div data-keep="0"><a href="/2">Ten quiet
    places by the lake</a> <a href="/3">and how to get there by train</a></div><div data-keep="1"><p>The lake is fed by two small rivers and
    never freezes, so that swans stay here all winter long.</p><p>In March they leave, as they have always done, for the north.</p></div>
    <div data-keep="0"><a href="/4">What swans eat in winter and where they find it</a></div>""",
    """<article data-keep="1"><p>Closed today.</p></article>""",
    """<body class="single has-sidebar comments-open"><div id="header-and-content"><article class="post tag-lakes social" data-keep="1"><h1>Ferry</h1>
    <p>The ferry crosses the lake twice a day and takes no cars, only people with their bicycles and dogs.</p><p>It is old.</p></article>
    <div class="widget-area" data-keep="0"><p>Boats for sale, new and old, at the yard behind the harbour.</p></div></div></body>""",
    """<main data-keep="1">No entries.</main>""",
    """<article data-keep="1"><h1>Notes</h1><p>See <a href="/n">the notes of last spring</a></p><p>More soon.</p></article>""",
    """<p data-keep="1">There is only this one paragraph on the page, written in haste before the train left the station at noon.</p>""",
    """<nav data-keep="0"><a href="/">Home</a></nav><div data-keep="1"><p>The bridge was opened in spring by the mayor, who walked across
    it first with all the children of the town.</p><p>It has carried the road to the coast ever since, though it was built for carts.</p></div>""",
    """<div data-keep="0">Today: sunny</div><div data-keep="0">Lost and found</div><div data-keep="1"><p>Three keys were handed in last week
    at the desk in the hall, where they wait for whoever lost them.</p></div><div data-keep="0">Print</div><div data-keep="0">Send to a friend</div>""",
)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features and label of each marked block."""
    rows, labels = [], []
    for page in LABELLED:
        found = blocks(page)
        rows.append(features(found)[[i for i, b in enumerate(found) if b.mark]])
        labels += [b.mark == "1" for b in found if b.mark]
    return np.concatenate(rows), np.array(labels, bool)


Tree = tuple  # (share,) of a leaf, or (feature, threshold, tree below, tree above)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6) -> Tree:
    """A decision tree by Gini impurity; of equally good splits the one on the later feature, where a block stands."""
    share = float(labels.mean()) if len(labels) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best: tuple[float, int, float] | None = None
    for f in range(rows.shape[1] - 1, -1, -1):
        values = np.unique(rows[:, f])
        for cut in ((values[:-1] + values[1:]) / 2).tolist():
            low = rows[:, f] < cut
            a, b = labels[low], labels[~low]
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0] - 1e-9:
                best = (float(impurity), f, cut)
    if best is None:
        return (share,)
    low = rows[:, best[1]] < best[2]
    return best[1], best[2], grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


@cache
def model() -> Tree:
    return grow(*labelled())


def keeps(tree: Tree, row: np.ndarray) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree[0] >= 0.5


def main_text(html: str, tree: Tree) -> str:
    found = blocks(html)
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if keeps(tree, row))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages without html, with the main text."""
    kept, tree = [c for c in pages.columns if c not in (html, text)], model()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, html):
                made = pa.array([main_text(x or "", tree) for x in batch.column(html).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], [*kept, text])

    return pages.select(*kept, html).mapInArrow(each, pages.select(*kept).schema.add(text, "string"))
