"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events. A line is what stands between two block borders; its ratio is its text
length over the tags met in it. The ratios of all lines are smoothed by a Gaussian over neighbouring lines and split at
a threshold into content and the rest. The content lines choose the region: the article or main element with most of
their text (the outermost one, where an inner one would lose content or a heading; articles beside each other
together), or the deepest container that holds nearly all of it (with the page's heading).

Class names, ids and forms only confirm: what they mark is left out unless it holds that article, or as good as all of
the content lines. Menus, footers and the like that HTML's own elements or roles name are always left out. Where no
article or main element names the region, its containers of links without other content go too, and, where the region is
the whole page, the lines before its first and after its last content. A comment that nothing ends is empty, a tag that
nothing ends goes.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SIGMA = 1.5
#: Share of the mean smoothed ratio from which a line counts as content.
THRESHOLD = 0.8
#: Share of the content that a container must hold to become the region.
MOST = 0.8
#: Share of link text from which a container without a content line counts as a menu.
LINKS = 0.6

# Element and class names of HTML practice.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mfrac mi mn mo mover mrow msqrt msub msubsup msup mtext munder semantics".split())
CONTAINERS = frozenset("html body div main article section table tbody center form".split())
NO_TEXT = frozenset("head title script style noscript template iframe select textarea svg canvas object option datalist audio video map annotation".split())
LEFT_OUT = frozenset("nav footer aside button dialog menu".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising advertorial banner banners sponsor sponsored sponsors promo promos promotion promoted sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus discussion widget widgets toolbar pagination pager skip login search copyright topbar".split())
#: Words that may stand beside a mark in a name ("site-footer", "comment-list").
BESIDE = frozenset("site page global main primary secondary top bottom left right inner outer wide box block container wrapper wrap area list section link links button buttons bar item items slot unit post posts article articles content form text title header user author level law info cta mpu fb thread".split())
HEADER_NAMES = frozenset("header site-header page-header".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
ENDED_BY = {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "tr": {"p", "td", "th", "tr"}}

_CAMEL, _WORDS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])"), re.compile(r"[a-z]+")
_OPENING = re.compile(r"<[A-Za-z/!?]")
NONE, SOFT, HARD, SILENT = range(4)


@functools.lru_cache(1 << 16)
def marked(names: str) -> bool:
    """Whether one of the class names or ids says that the element isn't part of an article: all its words are marks
    or stand beside one."""
    for name in names.split():
        words = _WORDS.findall(_CAMEL.sub("-", name).lower())
        if any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words):
            return True
    return False


class _Page(HTMLParser):
    """Block elements as a tree (a child's number is above its parent's), and the lines of text with their element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.out = [-1], ["page"], [NONE]
        self.stack, self.open = [0], Counter()
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, characters of links, element
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.link, self.muted = False, None  # an inline element that is left out: tag, depth, height of the stack

    def _border(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, min(self.linked, len(text)), self.stack[-1]))
            self.tags = self.linked = 0
        self.parts = []

    def _kind(self, tag: str, attrs: dict) -> int:
        inside = self.open["article"] or self.open["main"]
        if tag in NO_TEXT:
            return SILENT
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
        if tag in LEFT_OUT or hidden or attrs.get("role", "").lower() in ROLES and tag not in ("article", "main", "body", "html", "form"):
            return HARD
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        if not inside and (tag == "header" or any(n in HEADER_NAMES for n in names.lower().split())):
            return HARD
        if tag in ("html", "body"):
            return NONE
        return SOFT if tag in ("form", "fieldset") or marked(names) else NONE

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in INLINE:
            if tag == "a":
                self.link = True
            if self.muted:
                self.muted[1] += tag == self.muted[0]
            elif attrs and tag not in VOID and self._kind(tag, {k: v or "" for k, v in attrs}) != NONE:
                self._border()
                self.muted = [tag, 1, len(self.stack)]
            return
        self._border()
        if tag in VOID:
            return
        while self.tag[self.stack[-1]] in ENDED_BY.get(tag, {"p"}):
            self._pop()
        kind = self._kind(tag, {k: v or "" for k, v in attrs})
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        self.out.append(kind)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] += 1

    def _pop(self) -> str:
        tag = self.tag[self.stack.pop()]
        self.open[tag] -= 1
        self.link = False
        if self.muted and len(self.stack) < self.muted[2]:
            self.muted = None
        return tag

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag not in INLINE:
            self._border()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in INLINE:
            self.link &= tag != "a"
            if self.muted and tag == self.muted[0]:
                self.muted[1] -= 1
                if not self.muted[1]:
                    self.muted = None
            return
        self._border()
        if self.open[tag] > 0:
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        if not self.muted:
            self.parts.append(data)
            if self.link:
                self.linked += len(data)

    def close(self):
        super().close()
        self._border()


def _smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]
    return np.convolve(ratios, kernel)[reach:-reach] / weight


def _summed(page: _Page, own: list[int]) -> list[int]:
    """For each element the sum over itself and all below it."""
    out = list(own)
    for n in range(len(out) - 1, 0, -1):
        out[page.parent[n]] += out[n]
    return out


def _handed_down(page: _Page, own: list[bool]) -> list[bool]:
    """For each element whether it or one above it is marked."""
    out = list(own)
    for n in range(1, len(out)):
        out[n] |= out[page.parent[n]]
    return out


def _over(page: _Page, node: int) -> set[int]:
    """The element and all above it."""
    out = set()
    while node >= 0:
        out.add(node)
        node = page.parent[node]
    return out


def _bounded(html: str) -> str:
    """The page with openings of comments that nothing ends as empty comments, and without a last tag that nothing ends
    (as browsers have it): the parser would look for their ends again at each opening."""
    at = html.find("<!--", max(html.rfind("-->"), 0))
    if at >= 0:
        html = html[:at] + html[at:].replace("<!--", "<!---->")
    cut = _OPENING.search(html, html.rfind(">") + 1)
    return html[: cut.start()] if cut else html


def main_text(html: str | None) -> str:
    """The main text of one page; empty where there is none."""
    if not html:
        return ""
    page = _Page()
    page.feed(_bounded(html))
    page.close()
    silent = _handed_down(page, [k == SILENT for k in page.out])
    lines = [x for x in page.lines if not silent[x[3]]]
    if not lines:
        return ""
    smooth = _smoothed(np.array([len(t) / max(1, n) for t, n, _, _ in lines]))
    content = (smooth >= THRESHOLD * smooth.mean()).tolist()
    count, never = len(page.tag), _handed_down(page, [k >= HARD for k in page.out])

    def mass_of(chosen) -> list[int]:
        own = [0] * count
        for text, _, _, n in chosen:
            own[n] += len(text)
        return _summed(page, own)

    # what marks confirm: all but what holds the article, or as good as all content
    mass = mass_of(x for x, c in zip(lines, content) if c and not never[x[3]])
    under = _handed_down(page, [k == SOFT for k in page.out])
    named = [n for n in range(count) if page.tag[n] in ("article", "main") and not never[n] and mass[n]]
    clear = [n for n in named if not under[n] and 2 * mass[n] > mass[0]] or [n for n in named if not under[n]] or named
    article = max(clear, key=lambda n: (mass[n], n), default=0)
    heads = [n for n in range(count) if page.tag[n] == "h1" and not never[n]]
    head = next((n for n in heads if not under[n]), heads[0] if heads else -1)
    safe, over_head = _over(page, article), _over(page, head)
    within = _handed_down(page, [n == article for n in range(count)])
    out = list(page.out)
    for n in range(1, count):
        if out[n] == SOFT and (n in safe or within[n] and 2 * mass[n] >= mass[article] > 0 and (n in over_head or mass[n] == mass[article])):
            out[n] = NONE
    gone = _handed_down(page, [k != NONE for k in out])

    kept = [(x, c) for x, c in zip(lines, content) if not gone[x[3]]]
    if not kept:
        return ""
    mass = mass_of([x for x, c in kept if c] or [x for x, _ in kept])
    named = [n for n in range(count) if page.tag[n] in ("article", "main") and 2 * mass[n] > mass[0]]
    region = named[0] if named else max(n for n in range(count) if mass[n] >= MOST * mass[0] and (n == 0 or page.tag[n] in CONTAINERS))
    # each of them holds over half, so they lie within each other: inwards as long as no content and no heading is lost
    for n in named[1:]:
        if mass[n] != mass[region] or any(n not in over and region in over for over in (_over(page, h) for h in heads if not gone[h])):
            break
        region = n
    if not named and head >= 0 and not gone[head]:
        while region not in over_head:
            region = page.parent[region]
    inside = [False] * count
    inside[region] = True
    if page.tag[region] == "article":  # with the articles beside it
        inside = [n == region or t == "article" and page.parent[n] == page.parent[region] for n, t in enumerate(page.tag)]
    inside = _handed_down(page, inside)
    kept = [(x, c) for x, c in kept if inside[x[3]]]
    if not named:
        text = [c and x[2] < LINKS * len(x[0]) or x[3] == head for x, c in kept]
        links, chars, good, several = [0] * count, [0] * count, [0] * count, [0] * count
        for (words, _, linked, n), t in zip((x for x, _ in kept), text):
            links[n] += linked
            chars[n] += len(words)
            good[n] += t
            several[n] += 1
        links, chars, good, several = (_summed(page, x) for x in (links, chars, good, several))
        menu = _handed_down(page, [not g and n > 1 and LINKS * c <= k for g, c, k, n in zip(good, chars, links, several)])
        at = [i for i, t in enumerate(text) if t]
        whole = page.tag[region] in ("page", "html", "body") and at  # of the whole page the outer lines go
        kept = [x for x in (kept[at[0] : at[-1] + 1] if whole else kept) if not menu[x[0][3]]]
    return " ".join(x[0] for x, _ in kept)


def main_texts(df: DataFrame) -> DataFrame:
    """page_id, url, text for every row of (page_id, url, html).

    Null and empty html, and pages without a text outside menus and the like, give an empty text; null urls and ids
    stay null; repeated pages are extracted each; other columns are not read. One pass, no shuffle.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            html = batch.column("html")
            for at in range(0, batch.num_rows, 64):
                texts = [main_text(x) for x in html.slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(at, 64), batch.column("url").slice(at, 64), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    pages = df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
