"""Main text against the article's markup, on invented pages of other make, and for odd input."""

import html as references
import random
import re

import pytest
from tests_llm_paths import SF_DIR

from schemaloom.llm import html_text, queries_pages


def article(page):
    found = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", found[1] if found else "")
    texts = (" ".join(references.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts)
    return "\n".join(x for x in texts if x)


def test_op10(spark, duck):
    rows = duck.execute("select page_id, url, html from pages").fetchall()
    got = queries_pages.op10_html_text(spark, SF_DIR)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(i, u, article(h), len(article(h))) for i, u, h in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def text_of(page):
    return html_text.main_text(page, html_text.model())


def test_tree_learns_its_table():
    rows, labels = html_text.labelled()
    assert 40 < len(labels) < 200
    assert all(html_text.keeps(html_text.model(), r) == y for r, y in zip(rows, labels, strict=True))


def test_held_out_pages():
    """Each labelled page is judged by a tree learned from the others."""
    right = total = 0
    for left_out in html_text.LABELLED:
        rows, labels = [], []
        for page in html_text.LABELLED:
            if page != left_out:
                found = html_text.blocks(page)
                rows += [r for r, b in zip(html_text.features(found), found, strict=True) if b.mark]
                labels += [b.mark == "1" for b in found if b.mark]
        tree = html_text.grow(html_text.np.array(rows), html_text.np.array(labels))
        found = html_text.blocks(left_out)
        told = [(html_text.keeps(tree, r), b.mark == "1") for r, b in zip(html_text.features(found), found, strict=True) if b.mark]
        right, total = right + sum(a == b for a, b in told), total + len(told)
    assert right / total > 0.85


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("   ", ""),
        ("<article><p>a&amp;b &lt;i&gt; &#233; &hellip;</p><p>x\n\t y<br>z</p></article>", "a&b <i> é …\nx y z"),
        ("<article><p>one<p><b>two<p>three</b> four</article><footer>no no no", "one\ntwo\nthree four"),
        ("<article><h1>T</h1><p title='a > b'>in<script>var x='</p>';</script>side</p><!-- <p>not</p> --></article>", "T\ninside"),
        ("<body><nav><a href=x>m</a><article><p>kept</p></article>", "kept"),
        ("<article><p>t</p><div class='comments'><p>not this comment here</p></div></article>", "t"),
        ("<main><header><p>top of it all</p></header><p>body</p><aside>side</aside><form><p>form</p></form></main>", "body"),
        ("<article><p>5 < 6 and 7 > 2 <3</p></article>", "5 < 6 and 7 > 2 <3"),
        ("<ARTICLE><P>Upper</P></ARTICLE><style>p{}", "Upper"),
        ("<div class=sidebar><p>one two three four five six seven eight nine</p></div>", ""),
    ],
)
def test_pages_of_other_make(page, text):
    assert text_of(page) == text


def test_odd_rows(spark):
    long_text = " ".join(random.Random(1).choice(("word", "other", "thing")) for _ in range(60_000))
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (None, "v", f"<article><p>{long_text}</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r.text for r in html_text.extract(pages).collect()}
    assert got == {(1, None): "", (2, "u"): "", (None, "v"): long_text}
    assert html_text.extract(pages).count() == 4 and html_text.extract(pages.limit(0)).collect() == []


def test_time_is_linear_in_broken_markup():
    for page in ("<p title=\"" * 20_000, "<" * 100_000, "<b " * 50_000, "<!--" * 50_000, "<script>" * 5000, "<a href='" * 20_000):
        text_of(page)


@pytest.mark.parametrize(
    "silent",
    [
        '<svg class="i"/>',
        '<svg class="i"><path d="M0"/><title>icon</title></svg>',
        '<svg class="i"><path d="M0">',
        "<svg><foreignObject><div>no</div></foreignObject></svg >",
        "<math/>",
        "<svg-icon></svg-icon>",
        "<button-group></button-group><title-bar></title-bar><select-menu></select-menu>",
        "<datalist id=d><option value=a>one<option value=b>two</datalist>",
        "<select><option>one<option>two</select>",
        "<option>one",
        "<button>no<button>no</button>",
        "<canvas>",
        "<script>'<p>no</p>'</script\n>",
    ],
)
def test_silent_elements_end(silent):
    assert text_of(f"<article><p>a</p>{silent}<p>all the rest</p></article>") == "a\nall the rest"


def test_silent_time_is_linear():
    for tag in ("<svg>", "<svg/>", "<button>", "<option>", "<canvas>", "<select>", "<svg><foreignObject>", "<svg><foreignObject><p>"):
        text_of(tag * 20_000)


@pytest.mark.parametrize(
    "opened",
    [
        "<body class='single has-sidebar'><article>",
        "<html class='no-sidebar'><body class='social search'><main class='with-header'>",
        "<body><div id='header-and-content'><article>",
        "<body><article class='post tags-x social'>",
        "<body><div class='social-layout'><main>",
        "<body><div class='page-with-sidebar widget-wrap'><article class='tags-x'>",
        "<body class='no-sidebar'><div id='header-and-content'><div id='content'>",
    ],
)
def test_names_of_the_whole_page_are_no_furniture(opened):
    text = "<p>The ferry crosses the lake twice a day and takes no cars.</p><p>It is old.</p>"
    furniture = "<div class='sidebar-widget'><p>Boats for sale, new and old, at the yard behind the harbour.</p></div>"
    assert text_of(opened + text + furniture) == "The ferry crosses the lake twice a day and takes no cars.\nIt is old."


def test_furniture_stays_furniture():
    text = "<article><p>The ferry crosses the lake twice a day.</p></article>"
    for made in ("<section class='comments'><article><p>{}</p></article></section>", "<div class='related-posts'><article><p>{}</p></article></div>"):
        assert text_of(text + made.format("I took it last week and the view was very fine")) == "The ferry crosses the lake twice a day."
