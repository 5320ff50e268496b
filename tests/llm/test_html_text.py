import random
import time

import pytest

from stepframe.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>Site title</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="page-header"><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home page</a></li><li><a href="/x">About this site</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad box">Buy now, only today</div>
%s<aside>See also these things</aside><div id="comments"><p>First! I read it all and liked the whole of it very much indeed.</p></div><form><p>Subscribe here</p></form><footer>&copy; example</footer></body></html>"""
BODY = """<h1>The &amp; title</h1><p><b>One  two
three four five six seven.<br>eight<p>Nine&nbsp;ten &lt;b&gt; eleven twelve thirteen <a href='/q?a>b'>fourteen</a> fifteen.</p><script>x()</script><div class="share">Share me</div><ul><li>Short<li>Also short</ul><p>.</p>"""
WANT = "The & title\nOne two three four five six seven. eight\nNine ten <b> eleven twelve thirteen fourteen fifteen.\nShort\nAlso short\n."


@pytest.mark.parametrize("wrapper", ["<article>%s</article>", "<main id='top'><article>%s</article></main>", '<div class="content">%s</div>', '<div><section class="post-body">%s</section></div>'])
def test_article_in_any_wrapper(wrapper):
    assert html_text.main_text(PAGE % (wrapper % BODY), {}) == WANT


def test_odd_pages():
    for page in (None, "", "<", "<p", "<!-- ", "<script>", "<nav>only a menu</nav>", "</div></p>"):
        assert html_text.main_text(page, {}) in ("", "<", "<p")
    assert html_text.main_text("plain text, no tags", {}) == "plain text, no tags"
    assert html_text.main_text("<article>" + "<p>some words here</p>" * 20_000, {}) == "\n".join(["some words here"] * 20_000)


def test_fitted_weights_and_rows(spark):
    rows = [(k, f"u{k}", PAGE % f"<article>{BODY}</article>", "x") for k in range(20)] + [(None, None, None, "y"), (1, "u1", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    weights = html_text.fit(pages)
    assert all(v < 0 for k, v in weights.items() if k.startswith("t ")) and all(v > 0 for k, v in weights.items() if k.startswith("w ") and k.endswith(" "))
    got = html_text.extract(pages, weights).collect()
    assert sorted(r.text for r in got) == ["", ""] + [WANT] * 20
    assert html_text.extract(pages.limit(0), {}).count() == 0 and html_text.fit(pages.limit(0)) == {}


@pytest.mark.parametrize("wrapper", ['<form id="aspnetForm" action="/">%s</form>', '<div class="with sidebar">%s</div>', '<form><div id="header-wrapper">%s</div></form>'])
@pytest.mark.parametrize("content", ["<article>%s</article>", "<div>%s</div>"])
def test_page_inside_a_marked_wrapper(wrapper, content):
    start, end = PAGE.index("<header>"), PAGE.index("</body>")
    assert html_text.main_text(PAGE[:start] + wrapper % PAGE[start:end] % (content % BODY) + PAGE[end:], {}) == WANT


def test_the_run_decides_inside_an_article():
    links = "<ul>" + "<li><a href='/x'>Other</a></li>" * 40 + "</ul>"
    text = html_text.main_text(f"<body><article>{BODY}{links}</article></body>", {"w li a": -1.0, "c in": 0.5})
    assert text == WANT
    long = "<p>" + "Words of a comment that is much longer than the text. " * 30 + "</p>"
    assert html_text.main_text(f'<body><div>{BODY}</div><div class="comments">{long}</div></body>', {}) == WANT


@pytest.mark.parametrize("page", [
    "<a " * 330_000, '<a "x>" ' * 120_000 + '"', "<! " * 330_000, "<a '" * 250_000 + ">", "<" * 1_000_000, "<!--" * 250_000, "<script></script " * 60_000,
    "<div>" * 100_000 + "</b>" * 100_000, "<b>" * 100_000 + "<p>x</p>" * 80_000, "<a><p>" + "<b>" * 150_000 + "</a>" * 100_000, "<p><li><td>" * 90_000,
    "<nav>" * 100_000 + "<p>word</p>" * 40_000, "<form>" * 100_000 + "<p>word</p>" * 40_000, "<article>" * 60_000 + "<h1>x</h1>" * 30_000,
], ids=lambda page: page[:12])
def test_a_malformed_megabyte_is_quick(page):
    start = time.process_time()
    html_text.main_text(page, {})
    assert time.process_time() - start < 3


def test_tags_left_open():
    assert html_text.main_text("<p>one two</p>less < more <b", {}) == "one two\nless < more <b"
    assert html_text.main_text('<p class="x>one two</p><p>three four</p>', {}) == "one two\nthree four"
    assert html_text.main_text("<p>one two<!-- three > four", {}) == "one two"
    assert html_text.main_text("<p>one two<!-->three<script>four</p>", {}) == "one twothree"


def test_best_run_is_the_maximum_of_all_runs():
    rnd = random.Random(4)
    for _ in range(300):
        scores = [rnd.randint(-5, 5) for _ in range(rnd.randint(0, 14))]
        runs = [(sum(scores[i:j + 1]), (i, j)) for i in range(len(scores)) for j in range(i, len(scores))]
        got = html_text.best_run(scores)
        best = max([x for x, _ in runs] + [0])
        assert got is None if best == 0 else (best, got) in runs


TEASERS = "".join(f"<article><h2>Other story {k}</h2><p>Teaser of some other story that one could read next.</p></article>" for k in range(4))
REMARKS = '<section class="thread">' + "".join(f'<article class="entry"><p>Remark of reader {k} who liked it very much.</p></article>' for k in range(4)) + "</section>"


@pytest.mark.parametrize("fitted", [False, True])
@pytest.mark.parametrize("wrapper", ["<article>%s</article>", "<div>%s</div>", "<div class='message'><article>%s</article></div>"])
def test_other_articles_are_not_the_text(spark, fitted, wrapper):
    rows = [(k, f"u{k}", PAGE % f"<article>{BODY}</article>") for k in range(20)]
    weights = html_text.fit(spark.createDataFrame(rows, "page_id long, url string, html string")) if fitted else {}
    page = PAGE % (wrapper % BODY)
    assert html_text.main_text(page.replace("</body>", f"<aside>{TEASERS}</aside></body>"), weights) == WANT
    if "article" in wrapper:
        assert html_text.main_text(page.replace("</body>", f"{REMARKS}</body>"), html_text.fit(spark.createDataFrame(rows, "page_id long, url string, html string"))) == WANT
        assert html_text.main_text(page.replace("</article>", f"{REMARKS}</article>"), {**weights, "x nested": -3.0}) == WANT


def test_fit_reads_a_bounded_number_of_pages(spark):
    rows = [(k, f"u{k}", PAGE % f"<article>{BODY}</article>") for k in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    few, all_rows = html_text.fit(frame, sample=10), html_text.fit(frame)
    assert few.keys() == all_rows.keys() and html_text.fit(frame.union(frame), sample=40) == html_text.fit(frame.union(frame))
