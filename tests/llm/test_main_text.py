"""Main text: pages of many shapes, and the whole table against articles cut out by pattern."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.llm.main_text import main_text, main_texts, marked, op6_main_text

LONG = "The river rose in the night and the people of the lower town carried what they could to the hill."
TWO = f"<p>{LONG}</p><p>By noon the water stood in the square, and nobody could say when it would fall again.</p>"
BODY = f"{LONG} By noon the water stood in the square, and nobody could say when it would fall again."
MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>About us</a></li></ul>"

PAGES = {
    "wrapper of widgets": (f"<div class='elementor-widget-container'><article>{TWO}</article></div>", BODY),
    "layout with a sidebar": (f"<div class='content has-sidebar'><article>{TWO}</article></div><div class='sidebar'>{TWO}</div>", BODY),
    "id of the article": (f"<article id='notice-of-intent'>{TWO}</article>", BODY),
    "sponsored post": (f"<article class='post sponsored'>{TWO}</article>", BODY),
    "paragraph about related work": (f"<article><p class='related-work'>{LONG}</p>{TWO}</article>", f"{LONG} {BODY}"),
    "nested spans of an advert": (f"<article><p>{LONG}</p><p>Then <span class='ad'>Buy <span>x</span> NOW LEAK</span> it fell.</p></article>", f"{LONG} Then it fell."),
    "header of the article": (f"<header><p>My site</p></header><article><header><h1>Flood</h1><p>{LONG}</p></header>{TWO}</article>", f"Flood {LONG} {BODY}"),
    "form around the page": (f"<form id='aspnetForm'><div class='menu'>{MENU}</div><h1>Flood</h1>{TWO}</form>", f"Flood {BODY}"),
    "no article, a bare menu": (f"<body>{MENU}<h1>Flood</h1><div>{TWO}</div>{MENU}</body>", f"Flood {BODY}"),
    "comments longer than the article": (f"<article><h1>Flood</h1>{TWO}</article><div id='comments'>" + f"<article>{TWO}{TWO}</article>" * 3 + "</div>", f"Flood {BODY}"),
    "comments within the article": (f"<article><h1>Flood</h1>{TWO}<section class='comment-list'>{TWO}{TWO}</section></article>", f"Flood {BODY}"),
    "unclosed elements": (f"<article><h1>Flood</h1><p><b>{LONG}<br><p>And <i>then</i> some.<ul><li>one<li>two</ul></article>", f"Flood {LONG} And then some. one two"),
    "references and white space": (f"<main><p>A&nbsp;&amp;\n  B&eacute; {LONG}</p></main>", f"A & Bé {LONG}"),
    "scripts and notices": (f"<script>var a='<p>{LONG}</p>'</script><div class='cookie-notice'>{TWO}</div><main>{TWO}</main><noscript>{LONG}</noscript>", BODY),
    "two articles in main": (f"<main><article><p>{LONG}</p></article><article>{TWO}</article></main>", f"{LONG} {BODY}"),
    "two articles side by side": (f"<nav>x</nav><article><p>{LONG}</p></article><article>{TWO}</article>", f"{LONG} {BODY}"),
    "heading and intro before the article": (f"<main><h1>Flood</h1><p>{LONG}</p><article>{TWO}</article></main>", f"Flood {LONG} {BODY}"),
    "heading before the article": (f"<main><h1>Flood</h1><article>{TWO}</article></main>", f"Flood {BODY}"),
    "formula": (f"<article><p>{LONG}</p><p>So <math><msup><mi>x</mi><mn>2</mn></msup></math> it is, and the people of the town knew.</p></article>", f"{LONG} So x2 it is, and the people of the town knew."),
    "names of comments and notices": (f"<div class='cookie-law-info'>{TWO}</div><article>{TWO}</article><section class='user-comments-thread'>{TWO}</section><div class='fb-comments'>{TWO}</div><div class='newsletter-cta'>{LONG}</div><div class='ad_mpu'>{LONG}</div>", BODY),
    "script that opens a comment": (f"<script>var a = '<!--'</script><article>{TWO}</article>", BODY),
    "only a menu": ("<nav>x</nav>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert main_text(page) == want


def test_names():
    assert all(map(marked, ("ad", "x sidebar", "site-footer", "comment-list", "adBanner", "related_posts", "cookie-notice")))
    assert not any(map(marked, ("has-sidebar", "no-sidebar", "notice-of-intent", "related-work", "elementor-widget-container", "header", "adapt", "content")))


def test_deep_page_is_linear():
    start = time.process_time()
    deep = "<div>" * 20000 + LONG + "</div>" * 20000
    assert main_text(deep) == LONG
    assert main_text("<p><b>" * 20000 + LONG).endswith(LONG)
    assert time.process_time() - start < 3


@pytest.mark.parametrize("bad", ["<!--", "<b", "<!", "<a href='"])
def test_markup_that_nothing_ends(bad):
    start = time.process_time()
    assert main_text(f"<article>{TWO}</article>" + bad * 40_000).startswith(BODY)
    assert main_text(bad * 40_000) is not None
    assert time.process_time() - start < 2


def test_whole_table(spark):
    def cut(page):
        body = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = re.sub(r"</?(?:p|h1|br|li|ul|div|table|tr|td)\b[^>]*>", "\0", re.sub(r'<div class="ad">.*?</div>', "\0", body))
        return " ".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks.split("\0")) if x)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in op6_main_text(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for r in pages:
        assert got[r.page_id].text == cut(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_edges(spark):
    rows = [(1, "u", None, "x"), (None, None, f"<article>{TWO}</article>", "y"), (2, "v", "", None), (2, "v", f"<p>{LONG}", "z"), (2, "v", f"<p>{LONG}", "z"), (3, "w", "<p>" + "word " * 200_000, None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text) for r in main_texts(d).collect())
    assert got == sorted([("1", ""), ("None", BODY), ("2", ""), ("2", LONG), ("2", LONG), ("3", ("word " * 200_000).strip())])
    assert main_texts(d.limit(0)).count() == 0
    assert main_texts(d).withColumn("n", F.length("text")).columns == ["page_id", "url", "text", "n"]
