import re

import pytest

from tracemill.llm.html_text import NOISY, NOTHING, OTHERS, SOME, extract, main_text, named, op4_html_text

LONG = "Some words of a paragraph, long enough to count as prose; it goes on, and on, and then it ends."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body",
    [
        f"<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Head</h1><p>{LONG}</p><p>{LONG} 2</p></article><footer>&copy; x</footer>",
        f"<div class='menu'>Home About</div><div id=content><h1>Head</h1><p>{LONG}</p><p>{LONG} 2</p></div><div class='comments'><p>{LONG} I disagree.</p></div>",
        f"<header>Site</header><main><h1>Head</h1><p>{LONG}<p>{LONG} 2<div class='ad'>Buy</div></main><aside>{LONG}</aside>",
        f"<div><div class='post'><h1>Head</h1><p>{LONG}</p><form><p>Name</p><input></form><p>{LONG} 2</p></div><div class='sidebar'><p>{LONG}</p></div></div>",
        f"<div role=navigation>A b</div><table><tr><td><h1>Head</h1><p>{LONG}</p><script>var a='</p>';</script><p>{LONG} 2</p></td></tr></table>"
        "<div style='display:none'>secret</div><div class='cookie-notice'>We use cookies, yes.</div>",
    ],
)
def test_layouts(body):
    assert main_text(page(body)) == f"Head\n{LONG}\n{LONG} 2"


def test_text_rules():
    body = f"<article><p>a &amp;amp; b &lt;c&gt; &#233;&#x41; 1 < 2</p><p>{LONG}\n  <b>bold</b><i>er</i>\t<br>next</p><!-- <p>no</p> --><ul><li>one<li>two</ul></article>"
    assert main_text(page(body)) == f"a &amp; b <c> éA 1 < 2\n{LONG} bolder next\none\ntwo"


@pytest.mark.parametrize("odd", [None, "", "   ", "<", "<p", "<p class='x", "<!-- open", "<script>never closed", "</p></div>", "<div " + "a='" * 2000, "<" * 5000, "<div>" * 3000 + "x"])
def test_broken_pages_do_not_fail(odd):
    assert isinstance(main_text(odd), str)


def test_plain_text_page():
    assert main_text("only text, no tags") == "only text, no tags"


def test_query(spark, tiny):
    rows = {r.page_id: r for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    got = op4_html_text(spark, tiny).collect()
    assert len(got) == len(rows)
    import html

    for r in got:
        article = re.search(r"<article>(.*)</article>", rows[r.page_id].html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text.split("\n") == [x for x in want if x] and r.n_chars == len(r.text)


def test_columns_and_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x")], "page_id long, html string, text string")
    assert [(r.row.page_id, r.row.text, r.text) for r in extract(df).collect()] == [(1, "x", "")] * 2
    assert extract(df.limit(0)).collect() == []


PROSE = [LONG, f"{LONG} 2", f"{LONG} 3"]
P = "".join(f"<p>{x}</p>" for x in PROSE)
WANT = "\n".join(["Head", *PROSE])


@pytest.mark.parametrize(
    "body",
    [
        f"<nav><a href='/'>Home</a></nav><div class='content with-sidebar'><h1>Head</h1>{P}</div><div class='sidebar'><p>{LONG} side</p></div>",
        f"<div class='sidebar'><h1>Head</h1>{P}</div><footer>x</footer>",  # most of the page, whatever it is called
        f"<div class='legal-news'><h1>Head</h1>{P}</div>",
        f"<article><h1>Head</h1><p>{PROSE[0]}</p><div class='social'><p>{PROSE[1]}</p></div><p>{PROSE[2]}</p></article>",
        f"<header>Site</header><div class='post'><header><h1>Head</h1></header>{P}</div>",
        f"<div id='page-header'><h1>Head</h1></div><div class='body'>{P}</div>",
        f"<form id='aspnet'><h1>Head</h1>{P}<select><option>a<option>b</select></form>",
        f"<div id='content'><h1>Head</h1>{P}</div><div class='comments'>" + f"<div class='comment'><p>{LONG} I disagree.</p></div>" * 8 + "</div>",
        f"<article><h1>Head</h1>{P}<section id='comments'><h2>2 comments</h2><p>{LONG} I disagree.</p></section></article>",
        f"<div class='main'><h1>Head</h1><p>{PROSE[0]}</p><div class='ad-box'>{LONG} Buy</div><p>{PROSE[1]}</p><p>{PROSE[2]}</p></div>",
        f"<main><h1>Head</h1><div class='body'>{P}</div></main><div class='related'><h2>Related</h2><p>{LONG} other</p></div>",
        f"<article><h1>Head</h1><div class='body'>{P}</div></article><footer>x</footer>",
        f"<div id='wrap'><h1>Head</h1><div><div class='body'>{P}</div></div></div><div class='footer'>x</div>",
        f"<header><h1>Site name</h1></header><div><h2>Head</h2>{P}</div>",
        f"<div class='main'><h1>Head</h1>{P}</div><div id='newsletter-signup'><p>{LONG} Subscribe.</p></div>",
    ],
)
def test_names_only_weigh(body):
    assert main_text(page(body)) == WANT


def test_what_stands_inside_of_a_sentence_does_not_end_it():
    body = f"<article><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>tex</annotation></math> is <svg><text>x</text></svg>large<script>f()</script>, so it goes on.</p><p>{LONG}</p></article>"
    assert main_text(page(body)) == f"The sum a+b is large, so it goes on.\n{LONG}"


def test_one_paragraph_keeps_its_heading():
    assert main_text(page(f"<nav><a href='/'>Home</a></nav><div><h1>Head</h1><p>{LONG}</p></div><footer>x</footer>")) == f"Head\n{LONG}"


def test_names():
    kinds = {NOISY: "ad-box main-nav articleFooter entry-footer-inner top-bar cookie-notice", OTHERS: "comment-list post_comments post-comment-form", SOME: "social", NOTHING: "with-sidebar legal-news cookie-recipes content social-studies"}
    for kind, names in kinds.items():
        assert {named(x) for x in names.split()} == {kind}, names


@pytest.mark.parametrize("unit", ["<div>", "<div>a b c. ", "<span><p>x", "<b></i>", "<li><ul>", "</p>"])
def test_time_grows_with_the_page(unit):
    import time

    def spent(n):
        began = time.process_time()
        main_text(unit * n)
        return time.process_time() - began

    spent(100)
    assert spent(16_000) < max(0.2, 12 * min(spent(4_000), spent(4_000)))


def test_comments_of_readers_marked_as_articles():
    note = "".join(f"<article class='comment' id='c{k}'><p>{LONG} I disagree, {k}.</p></article>" for k in range(3))
    story = f"<h1>Head</h1><p>{LONG}</p><p>{LONG} 2</p>"
    want = f"Head\n{LONG}\n{LONG} 2"
    assert main_text(page(f"<main>{story}{note}</main>")) == want
    assert main_text(page(f"<main><article>{story}</article>{note}</main>")) == want
    assert main_text(page(f"<article class='post'>{story}<section>{note}</section></article>")) == want
    assert main_text(page(f"<article>{story}</article><ol class='thread'><li class='post'><p>{LONG} Yes.</p><li class='post'><p>{LONG} No.</p></ol>")) == want
    assert main_text(page(f"<main><article>{story}</article><article class='promo'><p>{LONG} Buy.</p></article></main>")) == want
    assert main_text(page(f"<article class='sponsored promo'>{story}</article>")) == want


def test_long_element_names_are_closed():
    name = "x-" + "very-long" * 20
    assert main_text(page(f"<article><{name} class='ad'><p>Buy</p></{name}><p>{LONG}</p><p>{LONG} 2</p></article>")) == f"{LONG}\n{LONG} 2"
