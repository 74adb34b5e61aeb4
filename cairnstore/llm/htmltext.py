"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags. Each block has its word count and link density, those of
its two neighbours, and one feature of where it stands: in an article, where nothing is known, in what may be page
furniture, or in what is. A decision tree, grown here by Gini impurity on the small labelled table below, keeps or
drops each block: prose in an unknown or doubtful place is kept, runs of links in an article are a menu. What tags and
class names say is certain (navigation, comments, adverts) can't be told by counts, as it is prose too.

Defined results: null or empty html gives an empty text; unclosed tags, cut-off pages and stray ends are read
as far as they go; character references are decoded, white space in a block (line breaks too) becomes one
space, blocks are joined by one line feed in page order. Rows are read one by one, so rows that repeat a page_id give
a row each, and equal blocks are kept as often as they stand; null ids and urls stay null; other columns do not matter.
"""

from __future__ import annotations

import html as html_library
import re
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnstore.llm.common import map_columns

# Element names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p "
    "pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template textarea iframe noembed noframes xmp".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog head title button select label noscript".split())
ARTICLE_TAGS = frozenset(["article", "main"])
# Words in class, id or role that mark page furniture or the article.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promotion popup modal overlay "
    "newsletter subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs footer "
    "sidebar aside cookie cookies consent gdpr notice notices "
    "disclaimer comment comments reply replies respond discussion disqus form pagination pager "
    "complementary contentinfo".split()
)
# Words that often mark page furniture, but stand for parts of articles too.
DOUBTFUL_WORDS = frozenset(
    "banner promo header masthead side widget related recommended share sharing social alert search toolbar toc contents "
    "links more tags meta teaser".split()
)
ARTICLE_WORDS = frozenset("article content post entry story main body".split())

_TOKEN = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _region(tag: str, attributes: str, outer: int) -> int:
    """1 in the article, 0 unknown, -1 in what may be furniture, -2 in furniture; that stays so all the way down."""
    if outer == -2 or tag in FURNITURE_TAGS or tag == "header" and outer == 0:
        return -2
    words: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        value = next((v for v in m.groups()[1:] if v is not None), "")
        name = m[1].lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return -2
        if name != "style":
            words.update(re.split(r"[^a-z]+", value.lower()))
    if not (tag in ARTICLE_TAGS or tag == "body"):
        if words & FURNITURE_WORDS:
            return -2
        if words & DOUBTFUL_WORDS or outer == -1:
            return -1
    if outer == -1:
        return -1
    if tag in ARTICLE_TAGS or words & ARTICLE_WORDS and tag not in ("body", "html"):
        return 1
    return outer


def blocks_of(html: str | None) -> list[tuple[str, int, int, int]]:
    """(text, words, words in links, region) of a page's flat blocks."""
    html = html or ""
    out: list[tuple[str, int, int, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = []
    links, at, end = 0, 0, len(html)

    def words_of(raw: list[str]) -> list[str]:
        text = "".join(raw)
        return (html_library.unescape(text) if "&" in text else text).split()

    def flush(region: int) -> None:
        if parts:
            if words := words_of(parts):
                out.append((" ".join(words), len(words), len(words_of(linked)) if linked else 0, region))
            parts.clear()
        linked.clear()

    while at < end:
        start = html.find("<", at)
        m = _TOKEN.match(html, start) if start >= 0 else None
        if m:
            raw = html[at:start]
        else:  # a "<" that opens no tag is text
            raw = html[at : start + 1 if start >= 0 else end]
        region = stack[-1][1] if stack else 0
        if raw:
            parts.append(raw)
            if links:
                linked.append(raw)
        if not m:
            at += len(raw)
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if not closing and tag in RAW_TAGS:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = at if attributes.endswith("/") else stop.end() if stop else end
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
            linked.append(" ")
        elif tag in BLOCK_TAGS:
            flush(region)
            links = 0
        if tag in VOID_TAGS or attributes.endswith("/"):
            continue
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None:
                del stack[depth:]
        elif tag in BLOCK_TAGS or _ATTRIBUTE.search(attributes):
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            outer = stack[-1][1] if stack else 0
            inner = _region(tag, attributes, outer)
            if inner != outer and tag not in BLOCK_TAGS:
                flush(outer)
            stack.append((tag, inner))
    flush(stack[-1][1] if stack else 0)
    return out


def features(blocks: list[tuple[str, int, int, int]]) -> list[list[float]]:
    """Region, then words and link density of the block, of the one before and of the one after."""
    density = [linked / words if words else 0.0 for _, words, linked, _ in blocks]
    out = []
    for k, (_, words, _, region) in enumerate(blocks):
        before = (blocks[k - 1][1], density[k - 1]) if k else (0, 0.0)
        after = (blocks[k + 1][1], density[k + 1]) if k + 1 < len(blocks) else (0, 0.0)
        out.append([region, words, density[k], *before, *after])
    return out


# The labelled table: region, words, link density, the same two of the block before and after, keep (1) or drop (0).
LABELLED = """
 1 10 0.0   6 1.0  60 0.0  1
 1  1 0.0  40 0.0  35 0.0  1
 1  2 0.0  90 0.0  12 0.0  1
 1 60 0.0   9 0.0  80 0.0  1
 1 85 0.1  60 0.0   2 0.0  1
 1  3 0.0   2 0.0   0 0.0  1
 1 40 0.0  30 0.0   8 0.0  1
 1 25 0.3  50 0.0  40 0.0  1
 1  6 0.0  12 0.0   7 0.0  1
 1  1 0.0   1 1.0   1 1.0  1
 1  2 0.0   0 0.0  60 0.0  1
 1  3 0.0  80 0.0   0 0.0  1
 1  4 0.0   4 0.0   4 0.0  1
 1  7 0.0   2 1.0  50 0.0  1
 1  9 0.0  70 0.0   3 1.0  1
 1 11 0.1   3 1.0   2 1.0  1
 1 15 0.0   0 0.0   0 0.0  1
 1 20 0.2   1 1.0   1 1.0  1
 1 24 0.0   2 1.0   3 1.0  1
 1 45 0.0   1 1.0   2 1.0  1
 1 55 0.3   2 1.0   2 1.0  1
 1 95 0.0   3 1.0   1 1.0  1
 1  2 0.0   2 0.0   2 1.0  1
 1  1 0.0   5 1.0  90 0.0  1
 1  8 1.0  70 0.0  66 0.0  1
 1  2 1.0  44 0.0  31 0.0  1
 1 12 0.5   0 0.0  20 0.1  1
 1  5 0.0   1 1.0   0 0.0  1
 1 18 0.0   0 0.0   0 0.0  1
 1  1 0.0  30 0.0   1 1.0  1
 1 14 0.0   1 1.0   2 1.0  1
 1 33 0.0  40 0.0   2 1.0  1
 1  5 0.0   2 1.0   3 1.0  1
 1 70 0.0   1 1.0   1 1.0  1
 1 12 0.9   1 1.0   1 1.0  1
 1 14 1.0  12 1.0  15 1.0  1
 1  1 1.0   1 1.0   1 1.0  0
 1  2 1.0   3 1.0   1 1.0  0
 1  3 1.0   2 1.0   2 1.0  0
 1  2 1.0   2 1.0   4 1.0  0
 1  4 1.0   1 1.0   5 1.0  0
 1  2 1.0  60 0.0  25 0.0  1
 1  3 1.0  35 0.0  70 0.0  1
 1  5 1.0  52 0.0  48 0.0  1
 1  1 1.0  28 0.0  33 0.0  1
 1  2 1.0  50 0.0   3 1.0  0
 1  3 1.0  40 0.0   2 1.0  0
 1  2 1.0   3 1.0  50 0.0  0
 1  1 1.0   2 1.0  44 0.0  0
 1  3 1.0   4 1.0   3 1.0  0
 1  2 0.0   9 0.9   8 0.9  1
 1 17 1.0  22 0.0   1 1.0  1
 1 22 0.5   3 1.0   2 0.8  1
-2  1 1.0   0 0.0   1 1.0  0
-2  2 1.0   1 1.0   1 1.0  0
-2  1 1.0   1 1.0   9 0.0  0
-2 11 0.0   1 1.0  12 0.0  0
-2 30 0.0  80 0.0   0 0.0  0
-2 12 0.0  45 0.0   0 0.0  0
-2 60 0.0  70 0.0  55 0.0  0
-2 25 0.2   2 1.0  30 0.1  0
-2  4 0.5   4 0.5   5 0.4  0
-2  9 0.0   0 0.0  70 0.0  0
-2 90 0.0  60 0.0  40 0.0  0
-2 15 0.0  15 0.0  15 0.0  0
-1 45 0.0   3 1.0   2 1.0  1
-1 60 0.0  50 0.0  40 0.0  1
-1 30 0.1  70 0.0  20 0.0  1
-1 28 0.0   0 0.0  35 0.0  1
-1 80 0.2   6 0.0  44 0.0  1
-1 22 0.0  31 0.0  26 0.1  1
-1  3 1.0   2 1.0   3 1.0  0
-1  2 0.0  40 0.0   2 1.0  0
-1  2 1.0   0 0.0  50 0.0  0
-1  3 1.0  20 0.0  40 0.0  0
-1  4 0.8  60 0.0  25 0.0  0
-1  1 1.0   6 0.0  80 0.0  0
-1  4 0.5  60 0.0   5 0.6  0
-1 10 0.0  55 0.0  45 0.0  0
-1 24 0.9   8 1.0  12 0.9  0
-1 35 0.8  20 0.9  30 0.7  0
-1  7 0.0   4 1.0   9 0.0  0
-1 12 0.6   6 0.0   1 1.0  0
 0  1 1.0   0 0.0   1 1.0  0
 0  2 1.0   2 1.0   3 1.0  0
 0  3 1.0   0 0.0  45 0.0  0
 0  4 1.0  55 0.0  30 0.0  0
 0  3 0.7   1 1.0   2 1.0  0
 0  5 0.0   1 1.0   2 1.0  0
 0  4 0.0   3 0.8   0 0.0  0
 0  6 0.5   0 0.0   0 0.0  0
 0 14 0.9   6 1.0   8 0.9  0
 0 22 0.8  15 0.8  12 0.9  0
 0  3 0.0   2 1.0   1 1.0  0
 0  7 0.0   0 0.0   2 1.0  0
 0 40 0.0  35 0.0  50 0.0  1
 0 60 0.1   5 0.0  44 0.0  1
 0 25 0.0  60 0.0  30 0.0  1
 0 18 0.0   8 0.0  70 0.0  1
 0 80 0.0   2 1.0  60 0.0  1
 0 55 0.0  48 0.0   2 1.0  1
 0 12 0.0  40 0.0  45 0.0  1
 0  6 0.0  50 0.0  38 0.0  1
 0  3 0.0   2 1.0  60 0.0  1
 0  6 0.0   1 1.0  45 0.0  1
 0  4 0.0   3 1.0  70 0.0  1
 0  8 0.0   1 1.0  33 0.0  1
 0  3 0.0  44 0.0  52 0.0  1
 0 35 0.2  30 0.0  28 0.0  1
 0 30 0.0   0 0.0   0 0.0  1
 0 16 0.0   0 0.0  25 0.0  1
"""
DEPTH = 7


@cache
def tree():
    """A nested tuple (feature, threshold, left, right) or a leaf 0 / 1, grown by Gini impurity."""
    import numpy as np

    table = np.array([[float(x) for x in line.split()] for line in LABELLED.strip().splitlines()])

    def grow(rows, depth: int):
        y = rows[:, -1]
        if depth == 0 or y.min() == y.max():
            return int(y.mean() >= 0.5)
        best = None
        for f in range(rows.shape[1] - 1):
            values = np.unique(rows[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = rows[:, f] <= cut
                gini = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (left, ~left))
                if best is None or gini < best[0] - 1e-12:
                    best = (gini, f, float(cut), left)
        if best is None:
            return int(y.mean() >= 0.5)
        _, f, cut, left = best
        return f, cut, grow(rows[left], depth - 1), grow(rows[~left], depth - 1)

    return grow(table, DEPTH)


def keep(row: list[float], node) -> int:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def main_text(html: str | None) -> str:
    """The kept blocks of a page, in page order, one to a line."""
    blocks = blocks_of(html)
    node = tree()
    return "\n".join(b[0] for b, row in zip(blocks, features(blocks), strict=True) if keep(row, node))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page row."""

    def make():
        def work(ids, urls, htmls):
            texts = [main_text(h) for h in htmls]
            return ids, urls, texts, [len(t) for t in texts]

        return work

    out = map_columns(pages, ["page_id", "url", "html"], make, "page_id bigint, url string, text string, n_chars bigint")
    return out.select("page_id", "url", "text", F.col("n_chars"))
