"""Main text of HTML pages by composite text density.

A page becomes a tree of block elements; inline elements are part of their
block's text. Menus, page headers and footers, sidebars, notices, adverts, forms,
comments and hidden parts are told by element, or suspected by the words of their class, id
and role, and take no part. But words also stand in names of wrappers: where the suspects leave
less than a tenth of the page's unlinked text, the one with most of it is cleared, and so on. For each other node the link-adjusted density of
characters per tag is computed, and the sum of the densities of its children
(runs of text of its own count as children). The node with the largest sum is
the main text; the least density on its path to the body is the threshold, and
in every node at or above it the subtree with the largest sum is main text as
well. Where that node lies in an `article` or `main` element, the element as a
whole is the main text instead.

Character references are decoded, white space inside a block becomes one space,
and blocks are joined in page order by one space. Null and empty pages, and pages
without text, give an empty text. Unclosed and stray tags are accepted as a browser
would; a page is parsed in time linear in its length, however long. Equal rows get
equal texts; an empty table gives an empty result. Only the named column is read.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How HTML elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "thead": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead"), "tfoot": ("td", "th", "tr", "tbody")}
#: Elements and words of class, id or role that mark what is not main text.
DROPPED = frozenset(
    "head nav footer aside form script style noscript template svg math iframe object embed audio video canvas button select textarea "
    "dialog menu title xmp noembed noframes".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion banner banners "
    "sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer footers masthead comment comments commentary "
    "disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended widget widgets toolbar search pagination pager complementary contentinfo "
    "doubleclick outbrain taboola".split())
PAGE_HEADER_WORDS = frozenset("header headers topbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Page:
    """The blocks of a page in page order, parents first."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped, self.suspect = ["body"], [-1], [False], [False]
        self.runs: list[tuple[int, str, int]] = []
        self.links = [0]
        self._stack: list[tuple[str, int]] = []
        self._open: Counter = Counter()
        self._node, self._text, self._linked, self._depth = 0, [], 0, 0
        at = 0
        while True:
            found = _TOKEN.search(source, at)
            self._words(source[at:found.start() if found else len(source)])
            if not found:
                break
            at = found.end()
            name = (found[2] or found[5] or "").lower()
            if not name:
                if found[0].startswith("<![CDATA["):
                    self._words(html.escape(found[0][9:].removesuffix("]]>"), quote=False))
                continue
            if found[1] or found[4]:
                self._close(name)
                continue
            rest = found[3] if found[2] else found[6]
            self._begin(name, rest)
            if name in RAW:
                end = re.compile(f"</{name}", re.I).search(source, at)
                at = end.start() if end else len(source)
        self._flush()

    def _words(self, text: str) -> None:
        if text and not self.dropped[self._node]:
            text = html.unescape(text)
            self._text.append(text)
            if self._depth:
                self._linked += len(text.strip())

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.runs.append((self._node, text, min(self._linked, len(text))))
        self._text, self._linked = [], 0

    def _pop(self) -> None:
        tag, node = self._stack.pop()
        self._open[tag] -= 1
        if tag == "a":
            self._depth -= 1
        if node >= 0:
            self._flush()
            self._node = self.parents[node]

    def _pop_to(self, place: int) -> None:
        while len(self._stack) > place:
            self._pop()

    def _nearest(self, names: tuple[str, ...], through: frozenset | None) -> int | None:
        """The place of the innermost open element of these names; only `through` elements may lie inside it."""
        if not any(self._open[n] for n in names):
            return None
        for place in range(len(self._stack) - 1, -1, -1):
            tag = self._stack[place][0]
            if tag in names:
                return place
            if through is not None and tag not in through:
                return None
        return None

    def _begin(self, name: str, rest: str) -> None:
        if name in ("html", "body"):
            return
        if name in CLOSES_P and (place := self._nearest(("p",), INLINE)) is not None:
            self._pop_to(place)
        if name in CLOSES:
            inner = INLINE | {"p", *CLOSES[name]}
            while (place := self._nearest(CLOSES[name], inner)) is not None:
                self._pop_to(place)
        if name in VOID:
            if name == "br":
                self._text.append("\n")
            elif name == "hr":
                self._flush()
            return
        if rest.endswith("/") and name in ("svg", "math", "path"):
            return
        if name in INLINE and _drops(name, rest, True) == KEPT:
            if name == "a":
                if (place := self._nearest(("a",), INLINE)) is not None:
                    self._pop_to(place)
                self._depth += 1
                self.links[self._node] += 1
            self._stack.append((name, -1))
            self._open[name] += 1
            return
        self._flush()
        inside = self._open["article"] + self._open["main"] > 0
        self.tags.append(name)
        self.parents.append(self._node)
        self.links.append(0)
        verdict = _drops(name, rest, inside)
        self.dropped.append(self.dropped[self._node] or verdict == GONE)
        self.suspect.append(verdict == SUSPECT)
        self._node = len(self.tags) - 1
        self._stack.append((name, self._node))
        self._open[name] += 1

    def _close(self, name: str) -> None:
        # An inline end tag does not reach beyond its block.
        place = self._nearest((name,), INLINE if name in INLINE else None)
        if place is not None:
            self._pop_to(place)


KEPT, SUSPECT, GONE = range(3)


def _drops(name: str, rest: str, inside: bool) -> int:
    """Whether an element is no main text by its kind or state (GONE), or by its names alone (SUSPECT)."""
    if name in DROPPED or name == "header" and not inside:
        return GONE
    if not rest or rest == "/":
        return KEPT
    verdict = KEPT
    for key, value in _NAMED.findall(rest):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return GONE
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return GONE
            continue
        words = {w.lower() for w in _WORD.findall(value)}
        if name in ("article", "main", "section") and key != "role" and not words & {"comment", "comments", "respond", "related", "ad", "ads", "advert", "sidebar"}:
            continue
        if words & DROPPED_WORDS or not inside and words & PAGE_HEADER_WORDS:
            verdict = SUSPECT
    return verdict


def _settle(page: Page) -> None:
    """Drop the suspects, but clear those without which next to no unlinked text is left, the fullest first."""
    n = len(page.tags)
    free, outer = [0] * n, [-1] * n
    for node, text, of_links in page.runs:
        free[node] += len(text) - of_links
    for k in range(n - 1, 0, -1):
        free[page.parents[k]] += free[k]
    within: dict[int, list[int]] = {}
    for k in range(1, n):
        up = page.parents[k]
        outer[k] = up if page.suspect[up] else outer[up]
        if page.suspect[k]:
            within.setdefault(outer[k], []).append(k)
    held = [(-free[k], k) for k in within.get(-1, [])]
    left = free[0] + sum(f for f, _ in held)
    heapq.heapify(held)
    while held and 10 * left < free[0]:
        most, k = heapq.heappop(held)
        page.suspect[k] = False
        inner = [(-free[j], j) for j in within.get(k, [])]
        left += sum(f for f, _ in inner) - most
        for one in inner:
            heapq.heappush(held, one)
    for k in range(1, n):
        page.dropped[k] = page.dropped[k] or page.suspect[k] or page.dropped[page.parents[k]]
    page.runs = [r for r in page.runs if not page.dropped[r[0]]]


def _density(c: int, lc: int, t: int, lt: int, ratio: float) -> float:
    """Characters per tag, lowered by the share of linked characters and links."""
    if not c:
        return 0.0
    lc, t, lt = max(1, lc), max(1, t), max(1, lt)
    base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
    return max(0.0, c / t * math.log(max(1.0, c / lc * t / lt) + 1.0) / math.log(base + 1.0))


def main_text(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    _settle(page)
    n = len(page.tags)
    chars, linked, tags, links = [0] * n, [0] * n, [0] * n, list(page.links)
    for node, text, of_links in page.runs:
        chars[node] += len(text)
        linked[node] += of_links
    for k in range(n - 1, 0, -1):
        if page.dropped[k]:
            continue
        up = page.parents[k]
        chars[up] += chars[k]
        linked[up] += linked[k]
        links[up] += links[k]
        tags[up] += tags[k] + 1
    ratio = max(1, linked[0]) / max(1, chars[0])
    density = [_density(chars[k], linked[k], tags[k] + links[k], links[k], ratio) for k in range(n)]
    sums = [0.0] * n
    for node, text, of_links in page.runs:
        sums[node] += _density(len(text), of_links, 1, 1 if of_links else 0, ratio)
    for k in range(n - 1, 0, -1):
        if not page.dropped[k]:
            sums[page.parents[k]] += density[k]
    # The largest sum in each subtree; of equal ones the outermost, then the first.
    best = list(range(n))
    for k in range(n - 1, 0, -1):
        up = page.parents[k]
        if not page.dropped[k] and sums[best[k]] > sums[best[up]] * (1 + 1e-12):
            best[up] = best[k]
        elif not page.dropped[k] and best[up] != up and sums[best[k]] >= sums[best[up]]:
            best[up] = best[k]
    top = best[0]
    threshold, whole, at = density[top], None, top
    while at >= 0:
        threshold = min(threshold, density[at])
        if page.tags[at] == "main" or page.tags[at] == "article" and whole is None:
            whole = at
        at = page.parents[at]
    chosen = [False] * n
    if whole is not None:
        chosen[whole] = True
    else:
        for k in range(n):
            if not page.dropped[k] and density[k] >= threshold and chars[k]:
                chosen[best[k]] = True
    for k in range(1, n):
        chosen[k] = (chosen[k] or chosen[page.parents[k]]) and not page.dropped[k]
    return " ".join(text for node, text, _ in page.runs if chosen[node])


def _main_texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extracted(source: Column) -> Column:
    """The main text of a column of pages."""
    return F.pandas_udf(_main_texts, "string").asNondeterministic()(source)
