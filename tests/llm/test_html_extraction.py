import itertools
import random
import re
import time

import pytest

from skyledger.llm import html_extraction as h
from skyledger.llm import html_layouts, queries


@pytest.fixture(scope="module")
def model(spark):
    return h.train(spark).value


def one(model, source):
    return h.extract_pages([source], model)[0]


def test_unseen_layouts(model):
    lost = extra = total = 0
    for seed in range(50_000, 50_150):
        source = html_layouts._Writer(seed).page()
        page = h.Page(source, marked=True)
        want = page.text([m == 1 for m in page.marks]).split("\n")
        got = one(model, re.sub(r' data-mark="\d"', "", source)).split("\n")
        total, lost, extra = total + len(want), lost + len(set(want) - set(got)), extra + len(set(got) - set(want))
    assert lost < 0.02 * total and extra < 0.02 * total


PARTS = "".join(f"<p>Paragraph number {i} of the article, with enough words to read well. It ends here.</p>" for i in range(6))


def test_page_parts(model):
    source = (
        "<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>"
        '<header class="site-header"><p>The Site</p></header><nav><ul><li><a href="/">Home</a></li><li><a href="/a">News</a></li></ul></nav>'
        '<div class="cookie-banner">We use cookies to improve the site. Accept them all.</div><!-- ad --><div class="ad">Buy it now.</div>'
        f"<article><h1>A &lt;title&gt; &eacute;</h1>{PARTS}</article>"
        '<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/b">Other story</a></li></ul></aside>'
        '<section class="comments"><h2>Comments</h2><div class="comment"><p>I liked it very much. Thanks to the writer for this.</p></div></section>'
        '<form class="newsletter"><label>Your mail</label><input type="text"><button>Go</button></form>'
        "<footer>&copy; The Site &middot; All rights.</footer></body></html>")
    lines = one(model, source).split("\n")
    assert lines[0] == "A <title> é" and len(lines) == 7 and all(line.startswith("Paragraph") for line in lines[1:])


def test_broken_markup_is_read_as_browsers_do():
    page = h.Page("<article><p><b>One\n two<br>three<p>four</b> five<li>a<li>b</p>c<table><tr><td>d<td>e<tr><td>f</table>g</article>< 5 & <p>x")
    text = page.text([True] * len(page.tags))
    assert text.split("\n") == ["One two three", "four five", "a", "b", "c", "d", "e", "f", "g", "< 5 &", "x"]
    assert h.Page("<script>never closed <p>x").text([True]) == ""
    assert h.Page('<p title="a > b" class=\'c\'>kept</p><!-- <p>no</p> -->').text([True, True]) == "kept"


def lines_of(source):
    page = h.Page(source)
    return page.text([True] * len(page.tags)).split("\n")


def test_elements_whose_names_begin_like_dropped_ones():
    for name in ("svg-icon", "video-player", "title-card", "select-box"):
        assert lines_of(f"<article><p>One <{name}></{name}> two.</p><p>Three.</p></article><script>x</script>") == ["One two.", "Three."]
    assert lines_of("<p>a <svg><title>t</title><style>s</style>u</svg>b</p><SCRIPT>'</style>'</script >c") == ["a b", "c"]


def test_embedded_elements_keep_their_text():
    assert lines_of("<p>The sum <math><mi>x</mi></math> is small.</p>") == ["The sum x is small."]
    assert lines_of("<article><object data=x><p>One.</p></object><noscript><p>Two.</p></noscript><p>Three.</p></article>") == [
        "One.", "Two.", "Three."]


def test_head_without_its_end():
    assert lines_of("<html><head><title>T</title><meta charset=utf-8><link href=x><p>One.</p><p>Two.</p>") == ["One.", "Two."]
    assert lines_of("<head><meta name=a> Plain text.") == ["Plain text."]
    assert lines_of("<head><noscript><link href=x></noscript><style>s</style></head><body><p>One.</p>") == ["One."]


def test_no_text_is_kept_inside_a_dropped_block():
    page = h.Page("<div><p>a</p><div><p>b</p></div></div><p>c</p>")
    kept = page.decode(h.np.array([1.0, 0.5, 2.0, -9.0, 3.0, 1.0]))
    assert kept == [True, True, True, False, False, True] and page.text(kept) == "a\nc"


def test_edges(spark, model):
    shared = spark.sparkContext.broadcast(model)
    rows = spark.createDataFrame([(1, None, "u"), (None, "", "v"), (2, "<nav><a href=x>y</a></nav>", None), (2, "plain " * 20_000, "w")],
                                 "page_id long, html string, text string")
    out = h.extract(rows, shared).collect()
    assert len(out) == 4 and sorted(r["text"] for r in out)[:2] == ["", ""]
    assert h.extract(rows.limit(0), shared).count() == 0
    assert h.Page("<div>" * 3000 + "deep").features().shape[0] == 3001


def test_query(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in queries.op1_html_extraction(spark, "/root/testdata/sf0.01").collect():
        article = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S).group(1)
        blocks = re.split("</?(?:p|h1)>", article)
        plain = [" ".join(h.html.unescape(re.sub("<[^>]*>", " ", b.replace("<b>", "").replace("</b>", ""))).split()) for b in blocks]
        assert r["text"] == "\n".join(filter(None, plain)) and r["n_chars"] == len(r["text"])


def test_attributes_of_real_pages_mark_nothing(model):
    for value in ("x", "", "1.5", "0", "1"):
        source = f'<article data-mark="{value}"><h1>Title of it</h1>{PARTS}</article><p data-mark={value}></p>'
        page = h.Page(source)
        assert page.marks == [None] * len(page.tags)
        assert one(model, source) == one(model, source.replace("data-mark", "data-any"))


HOSTILE = {
    "unfinished raw elements": lambda n: "<script " * (n // 8),
    "unfinished links": lambda n: "<a " * (n // 3),
    "unmatched paragraph ends": lambda n: "<div>" * (n // 9) + "</p>" * (n // 9),
    "unmatched inline ends": lambda n: "<b>" * (n // 7) + "</i>" * (n // 7),
    "inline ends of an outer block": lambda n: "<i><div>" + "<b>" * (n // 7) + "</i>" * (n // 7),
    "quotes that hide every end": lambda n: '<a ">" ' * (n // 7) + "'",
    "quotes left open": lambda n: "<a \" '" * (n // 6) + ">",
    "items in deep blocks": lambda n: "<ul>" + "<div>" * (n // 12) + "<li></b>" * (n // 12),
    "paragraphs in open markup": lambda n: "<b>" * (n // 10) + "<p></p>" * (n // 10),
    "raw elements without an end": lambda n: "<script>" + "</script " * (n // 9),
    "attributes without values": lambda n: "<div " + "class   " * (n // 8) + "><p>x</p>",
    "comments": lambda n: "<!--" * (n // 4),
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_time_grows_with_the_page(kind):
    source = HOSTILE[kind](1_000_000)
    started = time.process_time()
    page = h.Page(source)
    page.text([True] * len(page.tags))
    assert time.process_time() - started < 4  # measured: at most about a second


def test_decoding_is_the_best_of_all_kept_sets():
    draw = random.Random(8)
    for _ in range(150):
        page = h.Page("")
        size = draw.randint(1, 9)
        page.parents = [-1] + [draw.randrange(i) for i in range(1, size)]
        odds = [draw.uniform(-3, 3) for _ in range(size)]
        allowed = [kept for kept in itertools.product([False, True], repeat=size)
                   if all(kept[page.parents[i]] or not kept[i] for i in range(1, size))]
        best = max(allowed, key=lambda kept: sum(o for o, k in zip(odds, kept) if k))
        assert page.decode(h.np.array(odds)) == list(best)
