"""Main text of web pages: flat text blocks, classified by a decision tree on neighbour figures.

A page is cut at its block tags into a flat list of text blocks. Each has its number of words, its
link density and those of the blocks before and after it, and marks of the elements around it. A
decision tree, grown on the small labelled table in ``html_labels``, says which blocks belong to the
article: of blocks outside an article or main element by their words and link density and those of
their neighbours. These are joined in page order.

Null, empty or text-free html: an empty text. Broken markup is read as far as it goes: an unclosed
element ends with its parent, an unknown character reference stays as written. Repeated rows are
extracted once each, other columns are ignored; a page of any length is read whole, in one task.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.llm.common import map_columns

#: A quote opens a value only right after an equals sign; elsewhere it is a letter like any other.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?|[^=>])*+)>"
    r"|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^>]*\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements whose content is never text of the page.
HIDDEN = frozenset(
    "script style noscript template svg math head title iframe object select option datalist "
    "textarea canvas audio video map".split()
)
#: Elements whose content is not markup: it ends only at the closing tag.
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Fixed marks of what surrounds an article. What is inside of the first two kinds stays outside of
#: the article whatever it is; an article within an element that only has a telling name, or within a
#: form around a whole page, is an article again.
ASIDE_TAGS = frozenset("nav footer aside menu dialog button fieldset".split())
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert menu menubar".split()
)
COMMENT_NAMES = frozenset("comment comments disqus replies".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie "
    "cookies copyright disclaimer footer login masthead menu modal nav navbar navigation newsletter "
    "notice notification pager pagination popup promo promotion recommended related share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
MAIN_NAMES = frozenset("article content entry main post story body".split())
#: Parts that say where or how something is shown, not what it is; and that it merely has something.
PLACE_PARTS = frozenset(
    "area bar block bottom box col column container group inner item items left link links list "
    "outer panel right row section site top wrap wrapper".split()
)
STATE_PARTS = frozenset("has is no not with without js".split())
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FIGURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "in_main",
    "in_aside", "heading", "in_page_header",
)
WORDS_AT_MOST = 60


def named(value: str) -> set[str]:
    """What a class or id says an element is: "aside", "comments", "main" or "header".

    Each name counts as a whole: its last part says what it is (``site-footer`` is a footer,
    ``menu-page`` a page), after parts that only say where (``sidebar-left``); ``has-sidebar`` says
    nothing of the element itself.
    """
    out = set()
    for name in value.split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        if not parts or parts[0] in STATE_PARTS:
            continue
        what = [p for p in parts if p not in PLACE_PARTS] or parts
        if COMMENT_NAMES & set(what):
            out.add("comments")
        elif what[-1] in MAIN_NAMES:
            out.add("main")
        elif what[-1] == "header":
            out.add("main" if what[0] in MAIN_NAMES else "header")
        elif what[-1] in ASIDE_NAMES:
            out.add("aside")
    return out


class _Element:
    __slots__ = ("tag", "hidden", "main", "aside", "header")

    def __init__(self, tag, attributes, parent):
        a = {}
        for name, x, y, z in ATTRIBUTE.findall(attributes):
            a.setdefault(name.lower(), x or y or z)
        names = named(" ".join(a.get(k) or "" for k in ("class", "id")))
        role = (a.get("role") or "").lower()
        style = (a.get("style") or "").replace(" ", "").lower()
        self.tag = tag
        self.hidden = (parent is not None and parent.hidden) or (
            tag in HIDDEN
            or "hidden" in a
            or (a.get("aria-hidden") or "").lower() == "true"
            or "display:none" in style
            or "visibility:hidden" in style
        )
        body = tag in ("html", "body")
        is_main = tag in ("article", "main") or role in ("main", "article")
        told = set() if body else names
        self.main = (parent is not None and parent.main) or is_main or (
            tag in ("div", "section") and "main" in told and not told & {"aside", "comments"}
        )
        # 0 outside, 1 by a name or a form, 2 by a tag, a role or as readers' comments
        inherited = parent.aside if parent is not None else 0
        if tag in ASIDE_TAGS or role in ASIDE_ROLES or "comments" in told:
            own = 2
        else:
            own = int(tag == "form" or role == "form" or ("aside" in told and not is_main))
        self.aside = max(own, 0 if is_main and inherited < 2 else inherited)
        # A header inside an article holds its title, one beside it the site's.
        self.header = (parent is not None and parent.header) or (
            (tag == "header" or "header" in told) and not self.main
        )


def blocks(page: str) -> list[tuple]:
    """(text, words, link words, in main, in aside, heading, in page header) in page order."""
    out: list[tuple] = []
    stack: list[_Element] = []
    parts: list[str] = []
    links = anchors = 0
    heading = False

    def flush():
        nonlocal parts, links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                top = stack[-1] if stack else None
                out.append((
                    text, text.count(" ") + 1, links, bool(top and top.main),
                    bool(top and top.aside), heading, bool(top and top.header),
                ))
        parts, links = [], 0

    def take(raw):
        nonlocal links
        if raw and not (stack and stack[-1].hidden):
            parts.append(raw)
            if anchors:
                links += len(raw.split())

    at = 0
    while at < len(page):
        m = MARKUP.search(page, at)
        take(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing, inline = bool(m[1]), tag in INLINE
        if not inline:
            flush()
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), -1)
            if depth >= 0:
                del stack[depth:]
            if tag == "a":
                anchors = max(0, anchors - 1)
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = False
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID or m[3].endswith("/") and inline:
            continue
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):  # these end implicitly
            k = len(stack) - 1
            while k >= 0 and (stack[k].tag in INLINE or stack[k].tag == tag):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                k -= 1
        stack.append(_Element(tag, m[3] or "", stack[-1] if stack else None))
        if tag == "a":
            anchors += 1
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = True
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            stack.pop()
            at = end.end() if end else len(page)
    flush()
    return out


def figures(found: list[tuple]) -> np.ndarray:
    """One row of figures per block; beyond the ends of a page there are no words."""
    n = len(found)
    words = np.array([min(b[1], WORDS_AT_MOST) for b in found], dtype=float)
    links = np.array([min(1.0, b[2] / b[1]) for b in found], dtype=float)
    shift = lambda v, k: np.concatenate([[0.0], v[:-1]] if k < 0 else [v[1:], [0.0]])
    marks = np.array([b[3:7] for b in found], dtype=float).reshape(n, 4)
    return np.column_stack(
        [words, links, shift(words, -1), shift(links, -1), shift(words, 1), shift(links, 1), marks]
    )


class Tree:
    """A binary decision tree grown by Gini impurity on a small table."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 16, leaf: int = 1):
        self.answer = float(y.mean())
        self.column = None
        if depth == 0 or self.answer in (0.0, 1.0):
            return
        best = None
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, j] < cut
                k = int(left.sum())
                if min(k, len(y) - k) < leaf:
                    continue
                a, b = y[left].mean(), y[~left].mean()
                impurity = k * a * (1 - a) + (len(y) - k) * b * (1 - b)
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, j, float(cut), left
        if best and best[0] < len(y) * self.answer * (1 - self.answer) - 1e-9:
            _, self.column, self.cut, left = best
            self.below = Tree(x[left], y[left], depth - 1, leaf)
            self.above = Tree(x[~left], y[~left], depth - 1, leaf)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.column is None or not len(x):
            return np.full(len(x), self.answer)
        out, left = np.empty(len(x)), x[:, self.column] < self.cut
        out[left], out[~left] = self.below.predict(x[left]), self.above.predict(x[~left])
        return out


def grown() -> Tree:
    """The tree of the labelled table; each labelled page holds one block per label."""
    from pitline.llm.html_labels import PAGES

    xs, ys = [], []
    for page, labels in PAGES:
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"{len(labels)} labels for {[b[0] for b in found]}")
        xs.append(figures(found))
        ys.append([int(c) for c in labels])
    return Tree(np.vstack(xs), np.concatenate(ys).astype(float))


def extracted(pages: list[str], tree: Tree) -> list[str]:
    """The main texts of some pages, classified together."""
    found = [blocks(p) for p in pages]
    full = [figures(f) for f in found if f]
    keep = iter(tree.predict(np.vstack(full)) >= 0.5 if full else ())
    return [" ".join([b[0] for b in f if next(keep)]) for f in found]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, one row per page."""
    tree = grown()

    def make():
        def work(ids, urls, pages):
            texts = extracted(pages, tree)
            return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    return map_columns(rows, make, "page_id long, url string, text string, n_chars long")
