"""Main text of web pages by tag-path ratios.

A page becomes its blocks in order, each with the path of block tags from the root. Parts that are never text of an
article (scripts, controls, navigation and so on) are left out by tag and role, reader comments by class and id, and a form if
less than half of the page's text stands in it. For each tag path of the page, text outside links and punctuation are
summed up and divided by the path's blocks; both ratios are
given to the path's blocks, smoothed over neighbours in page order, and fused. Blocks above the threshold are content;
the smallest element that holds all of them is the article, and all its text stays. Paths that are mostly links and lie
below the threshold stay only between content or in an ``article`` of the page. A short paragraph thus stays with its
path and its article.

Other words of class and id only lower the score of what lies below: ``HINTED`` for a name made of such words alone, less within an
article or for a part of a name, not at all for ``no-sidebar`` and the like or around the article (a page without one: around most
text, for a name of such words alone around nearly all).

Elements are numbered in page order with their parent, and paths are numbered too, so that a page takes time and memory in
proportion to its length however deep it is nested.

Cases: null or empty html, or a page without text, gives an empty text. Unclosed and stray tags are closed as a browser
would, roughly. A broken reference stays as written. Rows with equal or null id are read each by itself; an empty table
gives an empty one. A page of nothing but comments keeps them. Only id, url and html are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import Rows

# Kinds of tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup "
                   "time tt u var wbr br img".split())
NEVER = frozenset("head title script style noscript template nav aside footer button label select option textarea iframe object svg "
                  "canvas audio video dialog menu datalist".split())
ENDS_P = frozenset("address article aside blockquote center details dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                   "h6 header hr li main menu nav ol p pre section table td th tr ul body html".split())
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "option": ("option",)}
BOUNDS = frozenset("ul ol dl table body article section div".split())  # tags that stop looking further up
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
                  "navigation breadcrumb breadcrumbs comment comments disqus reply replies respond notice notices cookie cookies consent gdpr popup "
                  "modal newsletter subscribe subscription signup share sharing social related recommended footer masthead widget toolbar "
                  "pagination pager login skip".split())
PUNCTUATION = frozenset(".,;:!?…。，、；：！？\"'()«»„“”")
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond responses".split())
AROUND_COMMENTS = frozenset("area author body box container content count form inner list main number reader readers region section the thread "
                            "threads user users view wrap wrapper".split())
NEGATED = frozenset("has no with without enabled disabled".split())
HINTED, WITHIN = 0.25, 0.6  # factor of the score below a hint, and that within an article or for a part of a name
TEXT = "page_id bigint, url string, text string"


class _Page(HTMLParser):
    """Elements of a page and its blocks: path, innermost block element, text, and how much of it stands in links."""

    def __init__(self, comments: bool):
        super().__init__(convert_charrefs=True)
        self.comments = comments  # whether comments are kept
        # of each element, the page itself being number 0: tag, parent, left out, innermost block element, its path, factor of its hint
        self.tag, self.parent, self.out, self.box, self.path, self.hint = [""], [-1], [False], [0], [0], [1.0]
        self.paths: dict[tuple[int, str], int] = {}
        self.stack = [0]
        self.open: dict[str, int] = {}  # open elements of each tag
        self.blocks: list[tuple[int, int, str, int]] = []
        self.text: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            box = self.box[self.stack[-1]]
            self.blocks.append((self.path[box], box, text, self.linked))
        self.linked = 0

    def within(self) -> bool:
        return bool(self.open.get("article") or self.open.get("main"))

    def _names(self, attrs: dict[str, str | None]) -> list[list[str]]:
        names = [re.findall(r"[a-z]+", x) for k in ("class", "id") for x in (attrs.get(k) or "").lower().split()]
        return [n for n in names if n and NEGATED.isdisjoint(n)]

    def _out(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in NEVER or (tag == "header" and not self.within()):
            return True
        if tag in ("html", "body", "main") or tag in INLINE:
            return False
        if not self.comments and any(not COMMENTS.isdisjoint(n) and COMMENTS.union(AROUND_COMMENTS).issuperset(n) for n in self._names(attrs)):
            return True
        if tag == "article":
            return False
        style = (attrs.get("style") or "").replace(" ", "").lower()
        return ((attrs.get("role") or "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"
                or "display:none" in style)

    def _hint(self, tag: str, attrs: dict[str, str | None]) -> float:
        """Factor for the score of what lies below the element."""
        if tag in ("html", "body", "article", "main") or tag in INLINE:
            return 1.0
        names = [n for n in self._names(attrs) if not HINTS.isdisjoint(n)]
        if not names:
            return 1.0
        return HINTED if not self.within() and any(HINTS.issuperset(n) for n in names) else WITHIN

    def _pop(self, at: int) -> None:
        """Close all elements from place ``at`` of the stack on."""
        if any(self.tag[e] not in INLINE for e in self.stack[at:]):
            self.flush()
        for e in self.stack[at:]:
            self.open[self.tag[e]] -= 1
        del self.stack[at:]

    def _close_open(self, tags: tuple[str, ...], bounds: frozenset[str]) -> None:
        if any(self.open.get(t) for t in tags):
            for i in range(len(self.stack) - 1, 0, -1):
                tag = self.tag[self.stack[i]]
                if tag in tags:
                    self._pop(i)
                    return
                if tag in bounds:
                    return

    def handle_starttag(self, tag, attrs):
        if tag == "form" and self.open.get("form"):  # forms do not nest
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            else:
                self.text.append(" ")
            return
        if tag in ENDS_P:
            self._close_open(("p", "h1", "h2", "h3", "h4", "h5", "h6") if tag[0] == "h" and tag[1:].isdigit() else ("p",), BOUNDS)
        if tag in ENDS_SAME:
            self._close_open(ENDS_SAME[tag], BOUNDS - {tag})
        if tag not in INLINE:
            self.flush()
        up, attrs, me = self.stack[-1], dict(attrs), len(self.tag)
        out = self.out[up] or self._out(tag, attrs)
        box = self.box[up]
        self.tag.append(tag)
        self.parent.append(up)
        self.out.append(out)
        self.box.append(box if tag in INLINE else me)
        self.path.append(self.path[box] if tag in INLINE else self.paths.setdefault((self.path[box], tag), len(self.paths) + 1))
        self.hint.append(1.0 if out else self._hint(tag, attrs))
        self.stack.append(me)
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open.get(tag):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.tag[self.stack[i]] == tag:
                    self._pop(i)
                    return
                if tag in INLINE and self.tag[self.stack[i]] not in INLINE:
                    return

    def handle_data(self, data):
        if not self.out[self.stack[-1]]:
            self.text.append(data)
            self.linked += len(data.strip()) if self.open.get("a") else 0


def tag_path_scores(blocks: list[tuple[int, int, str, int]]) -> np.ndarray:
    """Fused, smoothed ratio of each block: text and punctuation of its tag path for each block of the path."""
    paths = {p: i for i, p in enumerate(dict.fromkeys(b[0] for b in blocks))}
    own = np.array([paths[b[0]] for b in blocks])
    text = np.array([max(0, len(b[2]) - b[3]) for b in blocks], float)
    marks = np.array([sum(c in PUNCTUATION for c in b[2]) if b[3] < len(b[2]) / 2 else 0 for b in blocks], float)
    each = np.bincount(own)
    ratio = [np.log1p(np.bincount(own, x) / each)[own] for x in (text, marks)]
    weights = np.array([0.25, 0.5, 0.25])
    smooth = [np.convolve(np.pad(r, 1, mode="edge"), weights, "valid") for r in ratio]
    return (ratio[0] + smooth[0]) / 2 * (1 + (ratio[1] + smooth[1]) / 2)


def _below(parent: list[int], boxes: list[int], values) -> list:
    """Sum of the values of all blocks in each element or below it."""
    sums = [0] * len(parent)
    for box, value in zip(boxes, values):
        sums[box] += value
    for e in range(len(parent) - 1, 0, -1):  # parents have smaller numbers
        sums[parent[e]] += sums[e]
    return sums


def _passed_on(parent: list[int], own: list, join) -> list:
    """Each element's own value joined with that of all around it."""
    out = list(own)
    for e in range(1, len(parent)):
        out[e] = join(out[e], out[parent[e]])
    return out


def _without_forms(page: _Page) -> list[tuple[int, int, str, int]]:
    forms = [tag == "form" for tag in page.tag]
    if not any(forms):
        return page.blocks
    below = _below(page.parent, [b[1] for b in page.blocks], [len(b[2]) for b in page.blocks])
    gone = _passed_on(page.parent, [f and 2 * n < below[0] for f, n in zip(forms, below)], lambda a, b: a or b)
    return [b for b in page.blocks if not gone[b[1]]]


def _factors(page: _Page, blocks: list[tuple[int, int, str, int]]) -> list[float]:
    """Factor of each element's score by the hints on it and around it."""
    around = [False] * len(page.tag)
    marks = [e for e, tag in enumerate(page.tag) if tag in ("article", "main") and not page.out[e]]
    for e in marks:
        while e >= 0 and not around[e]:
            around[e], e = True, page.parent[e]
    if not marks:
        below = _below(page.parent, [b[1] for b in blocks], [max(0, len(b[2]) - b[3]) for b in blocks])
        around = [n > below[0] * (0.9 if h == HINTED else 0.5) for n, h in zip(below, page.hint)]
    return _passed_on(page.parent, [1.0 if a else h for a, h in zip(around, page.hint)], min)


def main_text(html: str, comments: bool = False) -> str:
    """Text of the article, a block a line."""
    page = _Page(comments)
    page.feed(html)
    page.close()
    page.flush()
    blocks = _without_forms(page)
    if not blocks:
        return "" if comments else main_text(html, comments=True)
    boxes = [b[1] for b in blocks]
    scores = tag_path_scores(blocks) * np.array(_factors(page, blocks))[boxes]
    bar = min(scores.mean(), scores.max() / 2)
    content = scores >= bar
    held = _below(page.parent, boxes, content.tolist())
    # the innermost element that holds all content; a lone paragraph is no article, its parent is
    whole, leaf = [e for e, n in enumerate(held) if n == held[0]], set(boxes)
    root = max((e for e in whole if e not in leaf), default=max(whole))
    inside = _passed_on(page.parent, [e == root for e in range(len(held))], lambda a, b: a or b)
    written = _passed_on(page.parent, [tag == "article" for tag in page.tag], lambda a, b: a or b)
    dead = _passed_on(page.parent, [h < 1 and not n for h, n in zip(page.hint, held)], lambda a, b: a or b)  # hinted, and without content
    at = np.flatnonzero(content)
    keep = []
    for i, (_, box, text, linked) in enumerate(blocks):
        listed = linked <= len(text) / 2 or written[box] or at[0] < i < at[-1]
        if content[i] or (inside[box] and listed and not dead[box]):
            keep.append(text)
    return "\n".join(keep)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` for each page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(TEXT)
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                text = main_text(html or "")
                out.add(page, url, text, size=len(text) + 128)
                if out.full():
                    yield from out.take()
        yield from out.take()

    return pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)).mapInArrow(run, TEXT)
