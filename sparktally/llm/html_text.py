"""Main text of web pages: flat text blocks, classified by a decision tree trained on a small labelled table.

A scanner cuts a page into blocks at block-level tags. Each block knows its words, the share of them in links, those of
the two blocks before and after it, and in one feature what its markup says (furniture, article, or nothing). The tree,
grown by Gini impurity on a table that label_blocks draws from pages, three in five with the markup hidden, says which
blocks are content.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object textarea select head title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img picture video audio".split())
IMPLIED = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("article aside blockquote body div dl footer form header html main nav ol section table td th ul".split())
FURNITURE_TAGS = frozenset("nav footer aside form button menu dialog fieldset label".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs topbar sidebar aside widget footer "
    "comment comments commentlist reply replies discussion respond disqus cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations trending toolbar pagination pager skip copyright legal disclaimer masthead search form tags taglist".split()
)
ARTICLE = frozenset("article content main post entry story body".split())
#: Furniture unless an article is around it, or is part of the name.
HEAD = frozenset("header head".split())
LEGAL = re.compile(r"\s*(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)


@lru_cache(maxsize=10_000)
def marks(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """(furniture, head, article) that an element says of what is in it."""
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    words = {w.lower() for k in ("class", "id", "role") for w in PIECES.findall(named.get(k, ""))}
    own = bool(words & ARTICLE)
    bare = tag in ("html", "body", "main", "article")
    bad = tag in FURNITURE_TAGS or (not bare and bool(words & FURNITURE)) or bool(HIDDEN.search(attrs)) or named.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search")
    head = tag == "header" or (not bare and bool(words & HEAD) and not own)
    return bad, head, tag in ("article", "main") or named.get("role", "").lower() in ("main", "article") or (own and tag in ("div", "section") and not bad)


@dataclass
class Block:
    text: str
    words: int
    density: float
    kind: int  # what the markup says: -1 furniture, 0 outside of the page's article, 1 nothing, 2 in an article


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    # (tag, furniture, article) of each open element, with what it inherits
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    parts: list[str] = []
    linked: list[str] = []
    links = 0

    def flush() -> None:
        words = "".join(parts).split()
        if words:
            text = " ".join(words)
            share = min(1.0, len("".join(linked).split()) / len(words))
            _, bad, good = stack[-1]
            out.append(Block(text, len(words), share, -1 if bad or (not good and LEGAL.match(text)) else 2 if good else 1))
        parts.clear()
        linked.clear()

    def close(names: tuple[str, ...], scoped: bool) -> None:
        """Pops up to the innermost of ``names``; scoped: not beyond an element that holds blocks."""
        nonlocal links
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                links -= sum(x[0] == "a" for x in stack[i:])
                del stack[i:]
                return
            if scoped and stack[i][0] in SCOPES:
                return

    def say(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked.append(text)

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        m = TAG.match(page, lt)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?", "/") or page[lt + 1 : lt + 2].isalpha():  # a declaration or a broken tag
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                say("<")
                at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                if stop is None and tag in ("head", "title"):
                    continue
                end = page.find(">", stop.end()) if stop else -1
                at = size if end < 0 else end + 1
            continue
        if tag in INLINE and tag != "label":
            if tag in ("br", "wbr", "img"):
                say(" " if tag == "br" else "")
                continue
        else:
            flush()
        if m[1]:
            if tag in INLINE and len(stack) > 1 and stack[-1][1] and not stack[-2][1]:
                flush()  # an inline advert ends here
            close((tag,), tag in INLINE or tag in IMPLIED)
        elif tag not in VOID:
            if tag in IMPLIED:
                close(IMPLIED[tag], True)
            bad, head, good = marks(tag, m[3])
            _, in_bad, in_good = stack[-1]
            if tag in INLINE and bad and not in_bad:
                flush()
            if not m[3].endswith("/"):
                stack.append((tag, in_bad or bad or (head and not in_good), in_good or good))
                links += tag == "a"
    flush()
    if any(b.kind == 2 for b in out):
        for b in out:
            b.kind = 0 if b.kind == 1 else b.kind
    return out


NAMES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "words_before_2", "density_before_2", "words_after_2", "density_after_2", "kind")


def features(page: list[Block]) -> list[tuple[float, ...]]:
    """NAMES of each block; beyond the page's ends there are blocks of no words."""
    around = [(0, 0.0)] * 2 + [(b.words, b.density) for b in page] + [(0, 0.0)] * 2
    return [(b.words, b.density, *around[i + 1], *around[i + 3], *around[i], *around[i + 4], b.kind) for i, b in enumerate(page)]


#: The labelled table, drawn from pages by label_blocks: NAMES, then content or not.
LABELLED = """
6 0 8 0 1 0 1 1 10 0 1 1|8 0 1 1 6 0 1 1 1 0 1 0|1 1 1 1 1 1 1 1 8 0 1 0|1 0 6 0 10 0 8 0 3 0 1 1|1 1 1 1 11 0 1 1 1 1 -1 0|9 0 0 0 14 0 0 0 1 1 2 1|1 1 14 0 1 1 9 0 1 1 -1 0|14 0 9 0 1 1 0 0 1 1 2 1
1 1 7 0 10 0 1 1 0 0 -1 0|7 0 1 1 1 1 1 1 10 0 -1 0|10 0 1 1 0 0 7 0 0 0 2 1|1 1 1 1 7 0 1 1 1 1 -1 0|1 1 1 1 6 0 1 1 12 0 1 0|1 0 33 0 14 0 12 0 90 0 1 1|1 1 1 1 1 1 1 1 1 1 1 0|1 1 1 1 1 1 1 1 6 0 1 0
46 0 1 0 1 1 128 0 38 0 2 1|21 0 4 0 1 1 1 1 128 0 2 1|4 0 1 1 21 0 1 1 1 1 -1 0|1 1 1 1 4 0 1 1 21 0 -1 0|1 1 3 0 1 1 0 0 29 0 1 0|9 0 28 0 2 0 51 0 4 0 1 0|1 1 1 1 29 0 3 0 51 0 1 0|51 0 29 0 28 0 1 1 9 0 1 1
3 0 4 0 1 1 0 0 19 0 2 1|4 0 0 0 3 0 0 0 1 1 -1 0|1 1 19 0 2 0 1 1 174 0 -1 0|2 0 1 1 174 0 19 0 0 0 -1 0|11 0 8 0 43 0 1 1 82 0 1 1|8 0 82 0 0 0 43 0 0 0 1 0|1 1 1 1 1 1 0 0 1 1 1 0|12 0 4 0 0 0 1 1 0 0 -1 0
4 0 7 0 4 0 0 0 1 0 2 1|21 0 13 0 53 0 1 1 1 1 2 1|4 0 1 1 12 0 53 0 0 0 2 1|1 1 0 0 1 1 0 0 1 1 -1 0|1 1 1 1 1 1 1 1 1 1 -1 0|10 0 1 1 12 0 1 1 0 0 2 1|12 0 10 0 0 0 1 1 0 0 -1 0|43 0 36 0 1 0 1 1 1 1 1 1
1 1 1 0 1 1 43 0 1 1 1 0|1 0 1 1 12 0 4 0 10 0 1 1|1 1 4 0 1 0 1 1 12 0 1 0|5 0 31 0 10 0 31 0 0 0 2 1|31 0 31 0 31 0 8 0 31 0 2 1|31 0 8 0 31 0 7 0 31 0 2 1|1 1 0 0 1 1 0 0 1 1 1 0|2 0 84 0 11 0 6 0 0 0 1 1
16 0 44 0 4 0 78 0 38 0 1 1|22 0 38 0 5 0 4 0 14 0 1 1|14 0 5 0 11 0 22 0 27 0 1 1|1 1 1 1 4 0 1 1 78 0 1 0|5 0 1 1 1 1 0 0 23 0 1 1|1 1 0 0 5 0 0 0 1 1 1 0|11 0 121 0 1 1 1 1 39 0 1 0|9 0 15 0 0 0 1 1 0 0 1 1
10 0 1 1 15 0 12 0 1 1 2 1|1 1 15 0 1 1 10 0 1 1 -1 0|1 1 1 1 1 1 1 1 64 0 -1 0|1 1 12 0 10 0 6 0 15 0 -1 0|2 0 2 0 65 0 2 0 1 1 1 1|1 1 1 0 2 0 2 0 1 0 1 0|2 0 1 1 0 0 65 0 0 0 1 1|2 0 1 0 2 0 2 0 2 0 1 1
21 0 2 0 46 0 3 0 16 0 2 1|29 0 3 0 67 0 8 0 26 0 2 1|1 1 9 0 0 0 8 0 0 0 -1 0|26 0 26 0 1 0 7 0 56 0 2 1|114 0 14 0 26 0 13 0 17 0 2 1|95 0 18 0 87 0 60 0 93 0 2 1|1 1 1 1 8 0 1 1 46 0 -1 0|93 0 87 0 76 0 95 0 13 0 2 1
1 1 3 0 1 1 0 0 13 0 1 0|13 0 1 1 2 0 1 1 1 1 1 0|5 0 3 0 0 0 6 0 0 0 1 1|3 0 6 0 5 0 1 1 0 0 1 1|28 0 1 1 10 0 2 0 13 0 1 1|1 1 0 0 8 0 0 0 66 0 1 0|1 1 2 0 28 0 37 0 10 0 1 0|6 0 66 0 1 1 8 0 7 0 1 1
1 0 1 0 70 0 11 0 42 0 2 1|1 0 11 0 1 0 1 1 70 0 2 1|1 1 1 1 1 1 1 1 11 0 -1 0|1 1 1 1 11 0 1 1 1 0 -1 0|4 0 27 0 4 0 28 0 0 0 2 1|27 0 28 0 4 0 1 0 4 0 2 1|1 0 11 0 28 0 13 0 27 0 2 1|1 1 1 1 13 0 1 1 11 0 -1 0
3 0 174 0 0 0 19 0 0 0 -1 0|174 0 19 0 3 0 8 0 0 0 2 1|8 0 3 0 19 0 1 1 174 0 2 1|122 0 38 0 14 0 1 1 1 0 1 1|1 1 1 1 38 0 8 0 122 0 1 0|2 0 93 0 0 0 1 1 0 0 1 1|1 1 0 0 8 0 0 0 1 1 1 0|5 0 1 1 115 0 1 1 21 0 1 0
115 0 5 0 21 0 1 1 39 0 1 1|1 1 1 1 5 0 1 1 115 0 1 0|8 0 1 1 0 0 5 0 0 0 -1 0|1 1 14 0 5 0 1 1 1 1 -1 0|14 0 1 1 1 1 1 1 5 0 2 1|11 0 1 1 1 1 0 0 1 1 2 1|8 0 1 0 0 0 9 0 0 0 1 0|1 0 9 0 8 0 9 0 0 0 1 1
9 0 1 1 9 0 1 1 1 0 1 1|1 0 82 0 54 0 11 0 6 0 1 1|54 0 1 0 6 0 82 0 6 0 1 1|8 0 1 1 11 0 1 1 82 0 1 0|1 1 1 1 8 0 1 1 11 0 1 0|1 0 34 0 12 0 6 0 0 0 2 1|34 0 6 0 1 0 5 0 12 0 2 1|1 1 1 1 1 1 0 0 5 0 -1 0
6 0 5 0 34 0 1 1 1 0 2 1|46 0 1 0 8 0 13 0 6 0 2 1|1 1 1 1 1 1 0 0 1 1 -1 0|11 0 4 0 14 0 8 0 30 0 2 1|10 0 1 1 10 0 1 1 1 0 1 1|5 0 14 0 0 0 1 0 0 0 1 1|1 0 1 0 14 0 10 0 5 0 1 1|2 0 40 0 1 1 11 0 38 0 1 1
38 0 1 1 1 1 2 0 0 0 1 1|40 0 11 0 2 0 17 0 1 1 1 1|1 1 0 0 10 0 0 0 17 0 1 0|19 0 2 0 1 1 4 0 119 0 2 1|1 1 19 0 119 0 2 0 86 0 -1 0|1 1 68 0 1 1 1 0 74 0 -1 0|5 0 4 0 7 0 60 0 1 1 2 1|18 0 16 0 1 1 4 0 9 0 2 1
4 0 1 0 16 0 8 0 18 0 2 1|1 1 18 0 9 0 16 0 42 0 -1 0|1 0 8 0 4 0 119 0 16 0 2 1|1 1 1 1 0 0 4 0 0 0 -1 0|1 1 1 1 10 0 1 1 472 0 -1 0|4 0 472 0 1 1 10 0 1 1 -1 0|10 0 1 1 472 0 1 1 4 0 2 1|1 1 3 0 12 0 139 0 3 0 1 0
5 0 3 0 8 0 12 0 84 0 1 1|8 0 5 0 84 0 3 0 0 0 1 0|39 0 1 1 159 0 8 0 1 1 1 1|1 0 0 0 1 1 0 0 11 0 1 0|1 1 2 0 1 1 115 0 1 0 1 0|1 1 1 0 11 0 0 0 115 0 1 0|11 0 1 1 115 0 1 0 2 0 1 1|8 0 0 0 1 1 0 0 1 1 2 1
66 0 1 0 8 0 11 0 4 0 2 1|53 0 1 1 19 0 31 0 1 1 2 1|1 0 1 1 1 1 45 0 27 0 2 1|14 0 41 0 18 0 53 0 18 0 2 1|18 0 18 0 11 0 14 0 0 0 2 1|1 1 1 1 5 0 1 1 1 0 -1 0|5 0 1 1 1 0 1 1 2 0 -1 0|1 0 5 0 2 0 1 1 81 0 2 1
28 0 12 0 5 0 6 0 27 0 1 1|6 0 1 1 12 0 1 1 28 0 1 0|2 0 1 1 1 1 45 0 5 0 2 1|1 1 5 0 8 0 1 1 0 0 -1 0|1 1 11 0 45 0 0 0 1 1 -1 0|1 1 1 1 80 0 6 0 1 1 -1 0|80 0 1 1 1 1 1 1 8 0 2 1|1 1 80 0 8 0 1 1 36 0 -1 0
36 0 8 0 0 0 1 1 0 0 2 1|4 0 1 1 1 1 1 1 88 0 1 0|1 1 4 0 88 0 1 1 0 0 1 0|1 1 13 0 1 1 8 0 4 0 1 0|1 1 1 1 4 0 13 0 1 1 1 0|1 1 1 1 6 0 11 0 62 0 -1 0|62 0 6 0 0 0 1 1 0 0 2 1|11 0 1 1 1 1 12 0 1 1 -1 0
12 0 0 0 1 1 0 0 11 0 2 1|14 0 39 0 0 0 19 0 0 0 1 0|19 0 31 0 39 0 1 1 14 0 1 1|39 0 19 0 14 0 31 0 0 0 1 1|24 0 1 0 13 0 8 0 0 0 2 1|1 1 1 1 5 0 1 1 8 0 -1 0|141 0 6 0 5 0 16 0 1 0 1 1|7 0 21 0 81 0 1 0 12 0 1 1
1 1 1 1 1 1 0 0 133 0 1 0|133 0 1 1 9 0 1 1 26 0 1 1|26 0 9 0 0 0 133 0 0 0 1 1|1 0 8 0 0 0 1 1 0 0 2 1|1 1 1 1 12 0 1 1 13 0 -1 0|14 0 1 1 4 0 14 0 9 0 2 1|4 0 1 1 10 0 1 1 16 0 -1 0|34 0 10 0 9 0 1 0 0 0 2 1
9 0 34 0 0 0 10 0 0 0 -1 0|3 0 59 0 56 0 27 0 13 0 2 1|13 0 56 0 0 0 3 0 0 0 -1 0|13 0 13 0 57 0 1 1 27 0 2 1|57 0 13 0 27 0 13 0 59 0 2 1|1 1 1 1 1 1 1 1 5 0 -1 0|9 0 20 0 9 0 5 0 0 0 2 1|9 0 9 0 0 0 20 0 0 0 -1 0
20 0 5 0 9 0 1 1 9 0 2 1|39 0 138 0 1 0 10 0 17 0 1 1|1 0 39 0 17 0 138 0 1 1 1 1|17 0 1 0 1 1 39 0 6 0 1 1|10 0 10 0 138 0 1 1 39 0 1 1|1 1 10 0 8 0 1 1 81 0 1 0|1 1 0 0 10 0 0 0 1 1 1 0|1 1 81 0 10 0 8 0 2 0 1 0
2 0 10 0 7 0 1 1 0 0 1 0|92 0 8 0 0 0 1 1 0 0 2 1|1 1 1 1 1 1 1 1 8 0 -1 0|51 0 18 0 6 0 25 0 0 0 1 1|35 0 125 0 16 0 135 0 107 0 1 1|135 0 8 0 125 0 47 0 35 0 1 1|13 0 51 0 1 1 8 0 3 0 1 1|64 0 1 1 1 1 133 0 5 0 2 1
1 1 10 0 1 1 0 0 6 0 -1 0|1 1 64 0 5 0 1 1 0 0 -1 0|1 1 133 0 64 0 4 0 1 1 -1 0|46 0 61 0 1 1 0 0 18 0 1 1|1 1 46 0 18 0 61 0 1 1 1 0|1 1 1 1 1 1 8 0 0 0 1 0|1 1 1 1 8 0 18 0 1 1 1 0|35 0 7 0 6 0 9 0 23 0 1 1
15 0 23 0 36 0 6 0 1 0 1 1|36 0 15 0 1 0 23 0 9 0 1 1|1 0 1 1 1 1 7 0 26 0 1 0|1 1 1 0 26 0 1 1 1 1 1 0|26 0 1 1 1 1 1 0 7 0 1 1|1 1 1 1 7 0 0 0 1 1 1 0|6 0 1 0 1 1 9 0 1 1 2 1|1 1 1 1 1 1 6 0 0 0 -1 0
1 0 9 0 6 0 0 0 1 1 -1 0|9 0 0 0 1 0 0 0 6 0 -1 0|13 0 3 0 3 0 1 1 16 0 2 1|1 1 1 1 1 1 0 0 3 0 -1 0|3 0 13 0 16 0 3 0 68 0 2 1|1 0 76 0 0 0 68 0 0 0 2 1|1 1 168 0 1 1 9 0 1 1 1 0|168 0 9 0 1 1 9 0 1 1 1 1
5 0 1 1 1 1 1 1 9 0 1 0|1 1 11 0 0 0 9 0 0 0 1 0|1 1 1 1 8 0 1 1 3 0 1 0|3 0 8 0 19 0 1 1 37 0 1 1|1 1 14 0 5 0 1 1 0 0 1 0|1 1 1 1 14 0 1 1 1 1 1 0|5 0 1 1 0 0 14 0 0 0 1 1|7 0 55 0 5 0 8 0 2 0 1 1
5 0 7 0 2 0 55 0 8 0 1 1|8 0 8 0 0 0 2 0 0 0 1 0|11 0 23 0 0 0 41 0 0 0 1 0|4 0 8 0 4 0 1 1 1 0 1 1|41 0 9 0 23 0 118 0 11 0 1 1|3 0 8 0 84 0 1 1 55 0 1 1|55 0 84 0 9 0 3 0 0 0 1 1|8 0 121 0 0 0 12 0 0 0 -1 0
1 0 1 0 90 0 8 0 6 0 2 1|6 0 90 0 12 0 1 0 121 0 2 1|1 1 1 1 8 0 1 1 1 0 -1 0|1 1 1 1 1 1 23 0 0 0 1 0|47 0 9 0 1 0 1 1 23 0 1 1|23 0 1 0 1 1 47 0 1 1 1 1|9 0 1 1 47 0 0 0 1 0 1 1|4 0 2 0 9 0 13 0 1 1 2 1
4 0 34 0 41 0 1 1 13 0 2 1|41 0 4 0 13 0 34 0 2 0 2 1|50 0 1 1 1 1 1 0 34 0 2 1|22 0 63 0 27 0 1 1 6 0 1 1|63 0 1 1 22 0 10 0 27 0 1 1|159 0 1 1 1 1 50 0 1 1 1 1|27 0 22 0 6 0 63 0 50 0 1 1|1 1 1 1 1 1 1 1 2 0 1 0
69 0 1 0 13 0 120 0 13 0 1 1|1 1 0 0 1 1 0 0 7 0 -1 0|19 0 105 0 45 0 7 0 13 0 2 1|13 0 45 0 0 0 19 0 0 0 -1 0|1 1 1 1 7 0 0 0 105 0 -1 0|45 0 2 0 47 0 2 0 61 0 1 1|80 0 14 0 82 0 52 0 1 0 1 1|29 0 62 0 2 0 104 0 2 0 1 1
6 0 6 0 1 1 0 0 1 1 1 1|6 0 0 0 6 0 0 0 1 1 1 1|10 0 136 0 39 0 1 0 14 0 1 1|30 0 4 0 9 0 1 1 1 1 1 1|14 0 37 0 9 0 9 0 34 0 1 1|30 0 82 0 27 0 196 0 5 0 1 1|67 0 1 0 57 0 21 0 76 0 1 1|82 0 196 0 30 0 35 0 27 0 1 1
9 0 5 0 26 0 1 1 0 0 2 1|26 0 9 0 0 0 5 0 0 0 2 1|1 0 7 0 61 0 1 1 9 0 1 1|9 0 61 0 147 0 1 0 48 0 1 1|48 0 147 0 1 0 9 0 0 0 1 1|1 0 48 0 0 0 147 0 0 0 1 1|1 1 1 1 4 0 1 1 11 0 1 0|1 1 1 1 1 1 1 1 4 0 1 0
1 1 0 0 1 0 0 0 12 0 -1 0|18 0 1 1 49 0 1 1 1 1 2 1|1 0 1 1 12 0 0 0 11 0 -1 0|12 0 1 0 11 0 1 1 1 1 2 1|7 0 1 1 6 0 1 1 96 0 -1 0|9 0 19 0 0 0 1 0 0 0 2 1|1 1 16 0 0 0 1 1 0 0 1 0|5 0 9 0 1 1 16 0 16 0 1 1
1 1 0 0 1 1 0 0 10 0 1 0|16 0 10 0 9 0 49 0 5 0 1 0|1 1 1 1 3 0 1 1 1 0 -1 0|3 0 1 1 1 0 1 1 5 0 2 1|20 0 4 0 54 0 7 0 3 0 2 1|7 0 5 0 4 0 1 1 20 0 2 1|13 0 3 0 0 0 54 0 0 0 -1 0|9 0 11 0 0 0 28 0 0 0 1 0
1 0 91 0 1 0 4 0 7 0 1 1|4 0 3 0 91 0 4 0 1 0 1 1|158 0 39 0 29 0 65 0 1 0 1 1|29 0 158 0 1 0 39 0 13 0 1 1|65 0 86 0 39 0 38 0 158 0 1 1|9 0 13 0 10 0 1 0 0 0 1 1|10 0 0 0 8 0 0 0 7 0 2 1|20 0 1 1 2 0 11 0 13 0 2 1
8 0 17 0 11 0 36 0 1 1 2 1|78 0 7 0 1 1 8 0 1 1 2 1|21 0 154 0 36 0 114 0 46 0 1 1|37 0 4 0 10 0 39 0 14 0 1 1|7 0 26 0 64 0 21 0 1 0 1 1|26 0 21 0 7 0 55 0 64 0 1 1|13 0 54 0 120 0 1 0 8 0 -1 0|54 0 6 0 7 0 61 0 1 1 2 1
61 0 2 0 6 0 113 0 54 0 2 1|2 0 113 0 61 0 73 0 6 0 2 1|72 0 22 0 25 0 17 0 1 0 1 1|20 0 5 0 5 0 1 0 52 0 1 1|113 0 5 0 83 0 13 0 11 0 1 1|31 0 1 0 5 0 2 0 17 0 1 1|1 1 12 0 1 1 1 1 30 0 -1 0|13 0 1 1 59 0 23 0 5 0 -1 0
30 0 1 1 4 0 1 1 19 0 2 1|59 0 13 0 5 0 1 1 0 0 2 1|1 1 1 1 1 0 1 1 54 0 1 0|1 1 101 0 1 1 17 0 1 1 1 0|17 0 26 0 101 0 13 0 1 1 1 1|26 0 13 0 17 0 20 0 101 0 1 1|1 1 1 1 29 0 10 0 4 0 1 0|38 0 4 0 113 0 29 0 30 0 1 1
29 0 1 1 4 0 1 1 38 0 1 1|1 1 10 0 1 1 1 1 29 0 1 0|1 1 41 0 13 0 2 0 12 0 -1 0|12 0 13 0 31 0 1 1 25 0 2 1|79 0 25 0 21 0 31 0 12 0 2 1|57 0 1 1 12 0 1 0 2 0 2 1|8 0 1 1 46 0 1 1 17 0 1 1|8 0 25 0 97 0 17 0 11 0 1 1
20 0 10 0 1 1 0 0 4 0 1 1|11 0 97 0 1 1 8 0 1 1 1 0|12 0 7 0 1 1 3 0 1 1 2 1|51 0 1 0 20 0 1 1 1 1 2 1|1 1 20 0 3 0 51 0 7 0 -1 0|21 0 30 0 2 0 105 0 0 0 2 1|11 0 1 1 8 0 1 1 150 0 -1 0|150 0 8 0 6 0 11 0 13 0 2 1
94 0 52 0 1 1 1 1 27 0 2 1|8 0 1 0 1 1 1 1 52 0 -1 0|1 1 8 0 52 0 1 0 94 0 -1 0|1 0 1 1 8 0 0 0 1 1 2 1|1 0 13 0 0 0 94 0 0 0 1 1|7 0 1 1 1 1 1 1 1 1 1 1|13 0 94 0 1 0 1 1 0 0 1 1|1 1 1 1 1 1 7 0 94 0 1 0
16 0 480 0 0 0 12 0 0 0 1 0|12 0 1 1 480 0 1 1 16 0 1 0|6 0 8 0 40 0 1 1 27 0 1 1|16 0 9 0 0 0 7 0 0 0 1 0|9 0 7 0 16 0 41 0 0 0 1 1|6 0 1 1 10 0 1 1 16 0 -1 0|1 1 1 1 1 1 1 1 6 0 -1 0|31 0 3 0 4 0 16 0 6 0 2 1
1 0 1 1 5 0 8 0 1 1 1 0|1 1 1 1 24 0 5 0 31 0 1 0|1 1 5 0 1 1 1 0 24 0 1 0|24 0 1 1 31 0 1 1 31 0 1 1|3 0 119 0 18 0 14 0 2 0 1 1|10 0 6 0 56 0 1 1 55 0 1 1|119 0 14 0 3 0 55 0 18 0 1 1|18 0 3 0 2 0 119 0 0 0 1 1
103 0 1 1 8 0 1 1 1 1 1 1|1 1 1 1 1 1 10 0 103 0 1 0|1 1 10 0 1 1 0 0 1 1 1 0|1 1 1 1 103 0 1 1 8 0 1 0|13 0 5 0 41 0 15 0 75 0 1 1|19 0 75 0 57 0 41 0 2 0 1 1|5 0 1 1 10 0 1 1 15 0 1 0|230 0 11 0 14 0 1 1 0 0 1 1
1 1 1 1 11 0 1 1 230 0 1 0|1 1 1 1 1 1 1 1 11 0 1 0|13 0 20 0 0 0 2 0 0 0 1 0|237 0 2 0 9 0 1 1 1 1 2 1|1 1 1 1 1 1 9 0 3 0 -1 0|1 1 1 1 3 0 1 1 0 0 -1 0|1 1 0 0 1 1 0 0 2 0 -1 0|8 0 1 1 10 0 1 1 16 0 1 0
1 1 1 1 8 0 1 1 10 0 1 0|23 0 31 0 0 0 31 0 0 0 1 1|31 0 31 0 23 0 30 0 0 0 1 1|30 0 1 1 31 0 1 1 31 0 1 1|13 0 3 0 36 0 2 0 153 0 1 1|29 0 153 0 203 0 36 0 0 0 1 1|1 1 1 1 2 0 1 1 3 0 1 0|4 0 0 0 27 0 0 0 12 0 1 1
12 0 27 0 1 1 4 0 11 0 1 0|1 0 9 0 23 0 1 1 0 0 1 0|9 0 1 1 1 0 1 1 23 0 1 1|1 1 15 0 1 1 0 0 1 1 -1 0|46 0 1 1 1 1 1 1 0 0 2 1|1 1 1 1 46 0 1 1 1 1 -1 0|1 1 46 0 0 0 1 1 0 0 -1 0|11 0 43 0 6 0 1 1 9 0 1 1
5 0 1 1 6 0 9 0 1 0 1 0|1 1 1 1 43 0 55 0 11 0 1 0|55 0 1 1 1 1 1 0 1 1 1 1|23 0 17 0 211 0 54 0 35 0 1 1|138 0 77 0 54 0 55 0 17 0 1 1|13 0 51 0 1 0 8 0 34 0 1 1|8 0 10 0 189 0 35 0 12 0 1 1|1 1 1 1 5 0 51 0 18 0 1 0
5 0 1 1 18 0 1 1 0 0 1 1|51 0 7 0 1 1 13 0 1 1 1 1|13 0 1 1 7 0 4 0 51 0 1 1|1 1 0 0 1 1 0 0 11 0 -1 0|11 0 1 1 1 1 1 1 76 0 2 1|7 0 76 0 5 0 1 1 0 0 -1 0|76 0 1 1 7 0 11 0 5 0 2 1|1 1 1 1 6 0 1 1 6 0 1 0
11 0 69 0 11 0 1 0 0 0 1 1|22 0 37 0 10 0 69 0 32 0 2 1|43 0 2 0 89 0 1 1 8 0 2 1|2 0 1 1 43 0 1 1 89 0 -1 0|4 0 1 1 72 0 1 1 28 0 1 0|72 0 4 0 28 0 1 1 14 0 1 1|16 0 33 0 0 0 59 0 0 0 -1 0|22 0 347 0 27 0 1 1 34 0 2 1
1 1 1 1 347 0 1 1 22 0 -1 0|11 0 1 1 4 0 1 1 1 1 2 1|39 0 1 1 1 1 4 0 10 0 2 1|10 0 1 1 1 1 39 0 14 0 2 1|153 0 45 0 13 0 17 0 4 0 1 1|1 1 1 1 7 0 1 1 10 0 1 0|69 0 49 0 44 0 10 0 25 0 1 1|44 0 28 0 17 0 25 0 45 0 1 1
5 0 6 0 7 0 1 1 91 0 1 1|7 0 5 0 91 0 6 0 9 0 1 1|1 1 1 1 6 0 0 0 5 0 1 0|6 0 1 1 5 0 1 1 7 0 1 0|56 0 52 0 48 0 7 0 1 1 2 1|1 1 1 1 47 0 8 0 29 0 -1 0|20 0 11 0 1 1 26 0 0 0 2 1|52 0 7 0 56 0 5 0 48 0 2 1
1 1 1 1 1 1 1 1 5 0 1 0|5 0 1 1 10 0 1 1 18 0 1 0|1 1 1 1 5 0 1 1 10 0 1 0|7 0 18 0 0 0 10 0 0 0 1 0|1 1 6 0 1 1 0 0 6 0 1 0|1 1 5 0 29 0 21 0 25 0 1 0|12 0 9 0 1 1 6 0 1 1 1 1|21 0 1 1 5 0 1 1 1 1 1 1
1 1 14 0 1 1 24 0 0 0 -1 0|9 0 1 1 7 0 0 0 125 0 2 1|1 1 91 0 24 0 125 0 14 0 -1 0|14 0 24 0 1 1 1 1 1 1 2 1|1 1 1 1 1 1 1 1 9 0 1 0|36 0 20 0 120 0 9 0 31 0 1 1|1 0 53 0 5 0 22 0 59 0 1 1|1 1 10 0 10 0 30 0 31 0 1 0
1 0 1 0 30 0 1 1 10 0 1 1|30 0 1 0 10 0 1 0 1 1 1 1|1 1 1 1 14 0 68 0 1 1 1 0|6 0 16 0 6 0 1 1 122 0 2 1|1 1 72 0 11 0 1 1 21 0 -1 0|6 0 6 0 122 0 16 0 17 0 2 1|6 0 47 0 0 0 21 0 0 0 2 1|11 0 624 0 0 0 3 0 0 0 1 0
2 0 1 1 3 0 1 1 624 0 1 0|8 0 0 0 1 1 0 0 13 0 -1 0|10 0 13 0 18 0 1 1 1 1 2 1|1 1 18 0 1 1 10 0 0 0 -1 0|18 0 10 0 1 1 13 0 1 1 2 1|1 1 2 0 0 0 8 0 0 0 -1 0|28 0 4 0 1 0 2 0 32 0 2 1|2 0 0 0 4 0 0 0 28 0 2 1
1 0 28 0 32 0 4 0 1 1 2 1|57 0 17 0 0 0 2 0 0 0 1 1|7 0 1 1 2 0 1 1 17 0 1 0|17 0 2 0 57 0 7 0 0 0 1 1|1 1 0 0 1 1 0 0 7 0 1 0|1 1 1 1 3 0 1 1 12 0 -1 0|1 0 13 0 1 1 1 1 1 1 2 1|12 0 3 0 0 0 1 1 0 0 -1 0
13 0 1 1 1 0 52 0 1 1 -1 0|1 1 1 1 1 1 1 1 13 0 -1 0|5 0 1 0 1 0 26 0 6 0 2 1|1 1 1 1 13 0 1 1 10 0 -1 0|43 0 10 0 47 0 13 0 26 0 2 1|1 1 63 0 1 1 10 0 0 0 1 0|5 0 6 0 10 0 0 0 63 0 1 1|1 1 1 1 0 0 63 0 0 0 1 0
63 0 10 0 1 1 5 0 1 1 1 1|20 0 7 0 3 0 63 0 24 0 1 1|7 0 63 0 20 0 1 1 3 0 1 0|34 0 1 1 9 0 24 0 1 1 1 1|1 1 1 1 13 0 40 0 11 0 1 0|11 0 1 1 8 0 1 1 8 0 1 0|2 0 11 0 123 0 14 0 68 0 1 1|164 0 55 0 187 0 61 0 1 0 1 1
10 0 5 0 1 1 1 0 1 1 1 1|3 0 37 0 1 0 11 0 5 0 1 1|1 0 3 0 5 0 37 0 10 0 1 1|1 1 0 0 11 0 0 0 37 0 1 0|1 1 1 1 6 0 0 0 110 0 1 0|54 0 1 1 21 0 110 0 85 0 1 1|1 1 0 0 1 1 0 0 6 0 1 0|1 1 110 0 54 0 6 0 21 0 1 0
28 0 79 0 1 1 1 1 1 0 2 1|1 0 1 1 1 1 28 0 1 1 2 1|1 1 28 0 1 0 79 0 1 1 -1 0|1 1 1 1 1 1 1 0 11 0 -1 0|9 0 9 0 23 0 2 0 42 0 2 1|18 0 32 0 4 0 19 0 1 0 2 1|19 0 42 0 32 0 23 0 18 0 2 1|1 1 13 0 10 0 10 0 50 0 1 0
13 0 10 0 1 1 6 0 10 0 1 0|50 0 10 0 11 0 1 1 0 0 1 1|4 0 0 0 1 1 0 0 9 0 -1 0|25 0 34 0 36 0 38 0 12 0 2 1|38 0 1 1 34 0 1 1 25 0 2 1|12 0 1 1 65 0 9 0 1 1 2 1|38 0 4 0 75 0 2 0 5 0 2 1|5 0 19 0 0 0 3 0 0 0 -1 0
2 0 8 0 4 0 1 1 38 0 2 1|1 1 1 1 8 0 1 1 2 0 -1 0|1 1 47 0 1 1 16 0 0 0 -1 0|1 1 24 0 1 1 8 0 10 0 -1 0|47 0 16 0 1 1 1 0 1 1 2 1|1 1 1 1 0 0 47 0 0 0 -1 0|12 0 19 0 1 1 2 0 38 0 1 0|1 1 12 0 38 0 19 0 1 1 1 0
190 0 1 1 1 1 38 0 10 0 1 1|2 0 0 0 19 0 0 0 12 0 1 1|1 1 1 1 78 0 0 0 33 0 1 0|6 0 4 0 0 0 33 0 0 0 1 0|4 0 33 0 6 0 78 0 0 0 1 1|1 1 0 0 1 1 0 0 78 0 1 0|11 0 61 0 0 0 8 0 0 0 2 1|38 0 102 0 8 0 1 1 61 0 2 1
6 0 0 0 10 0 0 0 1 1 -1 0|1 1 10 0 54 0 6 0 4 0 -1 0|5 0 110 0 1 0 1 1 1 0 1 1|1 0 5 0 1 0 110 0 19 0 1 1|79 0 44 0 14 0 1 0 32 0 1 1|182 0 13 0 29 0 1 1 1 1 1 1|1 1 7 0 99 0 1 1 8 0 1 0|7 0 0 0 1 1 0 0 1 1 1 1
8 0 99 0 3 0 1 1 50 0 1 1|8 0 50 0 173 0 3 0 102 0 1 1|30 0 6 0 26 0 9 0 3 0 2 1|4 0 1 1 8 0 1 1 1 0 -1 0|104 0 50 0 1 0 3 0 1 0 2 1|1 0 1 0 8 0 104 0 0 0 2 1|1 1 1 1 23 0 27 0 57 0 -1 0|27 0 7 0 1 1 9 0 1 1 2 1
1 1 59 0 14 0 60 0 133 0 -1 0|17 0 1 0 60 0 0 0 59 0 2 1|1 1 1 0 1 0 1 1 0 0 1 0|1 1 9 0 77 0 0 0 4 0 1 0|1 1 198 0 1 0 1 1 1 1 1 0|9 0 0 0 1 1 0 0 77 0 1 1|16 0 31 0 38 0 1 0 19 0 2 1|36 0 19 0 14 0 38 0 0 0 2 1
38 0 16 0 19 0 31 0 36 0 2 1|1 0 3 0 31 0 26 0 16 0 2 1|6 0 2 0 16 0 18 0 89 0 2 1|2 0 18 0 6 0 1 1 16 0 2 1|25 0 36 0 6 0 10 0 37 0 2 1|18 0 1 1 2 0 10 0 6 0 2 1|10 0 4 0 18 0 4 0 93 0 1 1|18 0 10 0 93 0 4 0 2 0 1 1
2 0 93 0 13 0 18 0 0 0 1 1|4 0 4 0 10 0 1 1 18 0 1 1|1 1 1 1 1 1 1 1 0 0 1 0|12 0 1 1 1 1 12 0 1 1 1 1|12 0 1 1 1 1 2 0 12 0 1 0|2 0 0 0 1 1 0 0 12 0 1 1|30 0 1 0 1 1 3 0 12 0 1 1|12 0 1 1 21 0 30 0 1 1 1 0
1 1 21 0 1 1 12 0 0 0 1 0|1 0 3 0 30 0 1 1 1 1 1 1|7 0 13 0 0 0 33 0 0 0 1 1|12 0 19 0 38 0 56 0 1 1 1 0|1 1 1 1 1 1 50 0 33 0 1 0|45 0 48 0 1 0 1 0 108 0 1 1|1 1 1 1 1 1 1 1 3 0 -1 0|15 0 9 0 9 0 8 0 0 0 2 1
3 0 1 1 147 0 1 1 8 0 -1 0|1 1 1 1 1 1 1 1 10 0 -1 0|1 0 56 0 16 0 1 0 0 0 2 1|1 1 1 1 10 0 1 1 1 0 -1 0|1 1 2 0 1 1 47 0 0 0 -1 0|1 1 1 1 0 0 2 0 0 0 -1 0|1 1 1 1 47 0 1 1 2 0 -1 0|1 1 8 0 1 1 50 0 1 1 -1 0
1 1 5 0 0 0 65 0 0 0 -1 0|11 0 9 0 35 0 1 1 1 1 2 1|25 0 1 1 3 0 1 1 15 0 2 1|1 1 0 0 9 0 0 0 11 0 -1 0|1 1 33 0 25 0 1 1 10 0 -1 0|10 0 25 0 1 1 1 1 0 0 2 1|1 1 7 0 33 0 1 1 1 1 -1 0|7 0 1 1 1 1 2 0 33 0 2 1
1 1 12 0 1 1 8 0 8 0 -1 0|8 0 0 0 12 0 0 0 1 1 2 1|8 0 1 1 1 1 1 1 1 1 2 1|12 0 8 0 1 1 0 0 1 1 -1 0|21 0 6 0 41 0 60 0 10 0 1 1|32 0 112 0 9 0 25 0 0 0 1 1|36 0 1 1 1 1 121 0 45 0 1 1|11 0 9 0 4 0 0 0 1 1 1 1
1 1 1 1 1 1 3 0 1 0 1 0|1 1 3 0 1 1 0 0 1 1 1 0|5 0 1 1 28 0 1 0 19 0 1 1|1 1 19 0 123 0 28 0 0 0 1 0|12 0 17 0 113 0 1 1 7 0 1 1|113 0 12 0 7 0 17 0 1 0 1 1|17 0 1 1 12 0 14 0 113 0 1 1|5 0 1 0 1 1 7 0 19 0 1 1
3 0 1 0 5 0 1 1 0 0 2 1|36 0 6 0 1 0 6 0 1 1 2 1|1 1 0 0 6 0 0 0 6 0 -1 0|6 0 1 1 6 0 0 0 36 0 2 1|1 1 1 0 18 0 235 0 1 1 1 0|18 0 1 1 1 1 1 0 1 1 1 1|1 1 18 0 1 1 1 1 1 1 1 0|1 1 1 1 1 1 1 1 1 0 1 0
12 0 1 1 25 0 9 0 54 0 2 1|1 1 54 0 1 1 25 0 105 0 -1 0|9 0 1 1 1 1 28 0 12 0 -1 0|54 0 25 0 1 1 12 0 1 1 2 1|1 1 2 0 13 0 39 0 16 0 -1 0|39 0 7 0 2 0 0 0 1 1 2 1|122 0 1 0 11 0 19 0 1 1 2 1|1 1 43 0 19 0 22 0 73 0 -1 0
"""


@dataclass
class Split:
    """content is the answer of a leaf; else a feature and its limit: up to it left, beyond it right."""

    content: bool | None = None
    feature: int = 0
    limit: float = 0.0
    left: Split | None = None
    right: Split | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> Split:
    """A classification tree by Gini impurity, kept shallow as the table is small; ties go to the first feature and the lowest limit."""
    if depth == 0 or y.min() == y.max():
        return Split(content=bool(y.mean() >= 0.5))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            to_left = x[:, f] <= limit
            cost = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (to_left, ~to_left))
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, float(limit), to_left
    if best is None:
        return Split(content=bool(y.mean() >= 0.5))
    _, f, limit, to_left = best
    return Split(None, f, limit, grow(x[to_left], y[to_left], depth - 1), grow(x[~to_left], y[~to_left], depth - 1))


@cache
def trained() -> Split:
    rows = np.array([[float(v) for v in r.split()] for line in LABELLED.split("\n") if line for r in line.split("|")])
    return grow(rows[:, :-1], rows[:, -1])


def content(tree: Split, row: tuple[float, ...]) -> bool:
    while tree.content is None:
        tree = tree.left if row[tree.feature] <= tree.limit else tree.right
    return tree.content


def main_text(page: str | None, tree: Split | None = None) -> str:
    """The content blocks in page order, joined by a newline; empty for a null or empty page."""
    if not page:
        return ""
    tree, found = tree or trained(), blocks(page)
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if content(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``; text is never null. Other columns are ignored.

    Null or empty html: empty text. Pages of any length are read whole, in time that grows with the length. Repeated
    rows each give their row. No rows: none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = trained()
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": [main_text(x, tree) for x in pdf["html"]]})

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    out = rows.mapInPandas(run, "page_id string, url string, text string")
    return out.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
