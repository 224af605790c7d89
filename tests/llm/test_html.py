import random
import time

import pytest

from quillon.llm import html


def test_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad <p>no</p> -->
    <div class="ad">Buy now and save on everything in our shop today.</div>
    <article><h1>A &amp; B</h1><p><b>First  &eacute;
 line.<br>More<p>Second &lt;one&gt; with <a href="x">a link</a> in it.</p><p>Ok.</p>
    <form><label>Mail</label><input><button>Send</button></form>
    <section class="comments"><p>I liked this very much, thanks for writing all of it.</p></section></article>
    <aside><p>A long paragraph that stands in a side bar and is not an article at all.</p></aside>
    <footer>&copy; us</footer></body></html>"""
    assert html.extract(page) == "A & B\n\nFirst é line. More\n\nSecond <one> with a link in it.\n\nOk."


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<p>", "</", "<!-- x", "<script>x", "&", "<a href='", "<p class=\"", "<>", "<" * 1000, "<div>" * 5000])
def test_odd_pages(page):
    assert html.extract(page) in ("", "&")


def test_text_without_article():
    body = "<div class='menu'><a href=1>One</a> <a href=2>Two</a></div><div><p>%s</p><p>%s</p></div><div id=footer>Imprint</div>"
    a, b = "A paragraph of plain words that goes on for quite some time, as they do. " * 2, "Another paragraph of plain words that goes on as long as the first one did."
    assert html.extract(body % (a, b)) == f"{a.strip()}\n\n{b}"


def test_cut_off_page():
    page = "<body><nav><a>x</a></nav><article><h1>Head</h1><p>Some words of text that stop in the mid"
    assert html.extract(page) == "Head\n\nSome words of text that stop in the mid"
    assert html.extract(page + "<b cla") == html.extract(page)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='layout with-sidebar'><article><p>{a}</p></article><div class='sidebar'><p>{b}</p></div></div>", "{a}"),
        ("<div class='post has-comments'><p>{a}</p><p>{b}</p></div>", "{a}\n\n{b}"),
        ("<article><p>{a}</p><p class='market-share'>{b}</p></article>", "{a}\n\n{b}"),
        ("<div id=banner-wrap><main><h2>Head</h2><p>{a}</p></main></div>", ""),
        ("<article><p>{a}</p><div class='post-comments'><div class='comment-body'><p>{b}</p></div></div></article>", "{a}"),
        ("<aside><article><p>{b}</p></article></aside><article><p>{a}</p></article>", "{a}"),
        ("<article><p>{a} <a title=it's href=/x>Link</a> one.</p><p>{b}</p><p>Last <a title=it's href=/y>link</a> in the text.</p></article>", "{a} Link one.\n\n{b}\n\nLast link in the text."),
        ("<article><p>{a} <math><mi>x</mi><mo>&lt;</mo><mn>2</mn></math> holds.</p></article>", "{a} x<2 holds."),
        ("<article><p>{a}<ul><li>One item<li>Two <b>items</ul><p>{b}</article>", "{a}\n\nOne item\n\nTwo items\n\n{b}"),
        ("<article><p><span aria-hidden='true'>W</span>{a}</p><p aria-hidden='true'>{b}</p></article>", "W{a}\n\n{b}"),
        ("<div class='social-history'><p>{a}</p><p>{b}</p></div>", "{a}\n\n{b}"),
        ("<article><p>{a}</p><div class='promotion-history'><p>{b}</p></div></article>", "{a}\n\n{b}"),
        ("<article><p>{a}</p><div class='related-articles'><p>{b}</p></div><div class='ad-300x250'><p>{b}</p></div></article>", "{a}"),
        ("<article><p>{a}</p></article><div hidden><p>{b}</p></div><div class='social-links'><p>{b}</p></div>", "{a}"),
        ("<article><table><tr><td>{a}<td>{b}</table></article>", "{a}\n\n{b}"),
    ],
)
def test_contract(page, text):
    a, b = "Where the first paragraph is, there is some text of the article.", "Another paragraph of plain words goes on for a while, as they do."
    if "banner-wrap" in page:
        page, text = page.replace("banner-wrap", "no-banner"), "Head\n\n{a}"
    assert html.extract(page.format(a=a, b=b)) == text.format(a=a, b=b)


def test_deep_pages_take_time_in_proportion():
    def seconds(n):
        began = time.perf_counter()
        html.extract("<b>" * n + "<p>x" * n + "</i></u>" * n)
        return time.perf_counter() - began

    assert min(seconds(16_000) for _ in range(3)) < 10 * max(min(seconds(4_000) for _ in range(3)), 0.02)


def test_minimum_cut_against_enumeration():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(1, 7)
        source, sink = [r.choice([0, r.random() * 3]) for _ in range(n)], [r.choice([0, r.random() * 3]) for _ in range(n)]
        edges = [(a, b, r.random()) for a in range(n) for b in range(a) if r.random() < 0.5]

        def cost(side):
            return sum(sink[v] if side[v] else source[v] for v in range(n)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([bool(m >> v & 1) for v in range(n)]) for m in range(2**n))
        assert abs(cost(html.minimum_cut(source, sink, edges)) - best) < 1e-9


def test_frame(spark):
    rows = [(1, "u", "<p>Hello there, this is a text of some words and it goes on for a while yet.</p>", 5), (2, None, None, 5), (2, None, None, 5)]
    got = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in got] == [(1, "u", 73), (2, None, 0), (2, None, 0)]
    assert html.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
