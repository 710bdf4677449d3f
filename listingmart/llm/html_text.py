"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. A block is described by its number of words and its link
density, those of the blocks before and behind it, and by where it lies: in a container whose tag or names say that it
is not the article, in one that says it is, or outside the article of a page that has one. A decision tree, grown
from the small labelled table below, keeps or drops each block.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from listingmart.llm.common import need

# Tags that end a block, that hold containers, and whose content is no text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
# Their content is text up to their end tag, or to the end of the page; that of the others is markup that is not shown as text.
RAW = ("script", "style", "textarea", "title", "iframe", "xmp", "noframes")
MUTE = frozenset("noscript template svg math object canvas video audio select button".split())
CONTAINERS = (BLOCKS - frozenset("p hr html body title option".split())) | MUTE | {"span", "a", "label"}
# Containers without an end tag: an opening tag closes the open ones named here, back to the last of those in WALLS.
ROW, PART = ("tr", "td", "th", "caption"), ("thead", "tbody", "tfoot")
SIBLINGS = {"button": ("button",), "select": ("select",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ROW[1:], "th": ROW[1:], "tr": ROW, **dict.fromkeys(PART, (*PART, *ROW))}
WALLS = {
    **{t: ("cell", *sorted(MUTE - {t})) for t in ("button", "select")},
    **{"li": ("wall", "dt", "dd"), "dt": ("wall", "li"), "dd": ("wall", "li")},
    **dict.fromkeys((*ROW, *PART), ("table", "mute")),
}
# An end tag is void beyond the last of these: of a list item its list, of a part of a table its table, of others a cell.
LIMITS = {"li": ("cell", "ul", "ol"), **dict.fromkeys((*ROW, *PART), ("table",)), **dict.fromkeys(("span", "label"), ("special",))}
# The end tag of a section of the page closes it wherever it was opened, also from within an unclosed table.
SECTIONS = frozenset("article aside footer header main nav section form dialog table".split())
AWAY_TAGS = frozenset("nav aside footer form menu dialog".split())
ARTICLE_TAGS = frozenset("article main".split())
AWAY_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login search share sharing social related recommended recommendations comment comments respond disqus reply replies discussion pagination pager "
    "toolbar widget skip copyright legal complementary contentinfo outbrain taboola".split()
)
HEADER_NAMES = frozenset("header head top".split())
ARTICLE_NAMES = frozenset("article content post entry story".split())

# Labelled blocks: words and link density of the block, the one before and the one behind; in a container that is not the
# article; in one that is; outside the article of a page that has one; kept.
LABELLED = """
1 1.0 0 0.0 1 1.0 1 0 0 0
1 1.0 1 1.0 1 1.0 1 0 0 0
3 1.0 2 1.0 9 0.0 1 0 1 0
9 0.0 1 1.0 8 0.0 1 0 1 0
25 0.0 1 1.0 8 0.0 1 0 1 0
60 0.0 40 0.0 30 0.0 1 0 1 0
14 0.1 30 0.0 0 0.0 1 0 1 0
40 0.0 50 0.0 45 0.0 1 1 0 0
12 0.0 50 0.0 12 0.0 1 1 0 0
3 0.0 50 0.0 12 0.0 1 1 0 0
2 1.0 50 0.0 2 1.0 1 1 0 0
30 0.0 20 0.0 30 0.0 1 0 0 0
5 0.2 80 0.0 0 0.0 1 0 0 0
8 0.0 9 0.0 60 0.0 0 1 0 1
1 0.0 60 0.0 70 0.0 0 1 0 1
2 0.0 1 0.0 3 0.0 0 1 0 1
60 0.0 8 0.0 45 0.0 0 1 0 1
45 0.1 60 0.0 70 0.2 0 1 0 1
90 0.3 40 0.0 12 0.0 0 1 0 1
12 0.0 90 0.0 14 0.0 0 1 0 1
12 0.6 90 0.0 40 0.0 0 1 0 1
6 1.0 70 0.0 40 0.0 0 1 0 1
10 1.0 80 0.0 60 0.0 0 1 0 1
3 0.0 70 0.0 0 0.0 0 1 0 1
400 0.0 60 0.0 300 0.0 0 1 0 1
4 1.0 0 0.0 80 0.0 0 1 0 1
30 0.0 0 0.0 0 0.0 0 1 0 1
6 0.0 0 0.0 40 0.0 0 0 1 0
40 0.0 8 0.0 30 0.0 0 0 1 0
12 0.0 70 0.0 5 1.0 0 0 1 0
1 1.0 1 1.0 1 1.0 0 0 1 0
9 0.0 1 1.0 8 0.0 0 0 1 0
100 0.0 70 0.0 10 0.0 0 0 1 0
1 1.0 1 1.0 1 1.0 0 0 0 0
3 1.0 2 1.0 2 1.0 0 0 0 0
2 1.0 0 0.0 3 1.0 0 0 0 0
8 0.9 4 1.0 5 1.0 0 0 0 0
4 0.0 3 1.0 3 1.0 0 0 0 0
2 0.0 1 1.0 2 0.0 0 0 0 0
3 0.0 2 0.0 2 0.0 0 0 0 0
2 0.0 0 0.0 3 0.0 0 0 0 0
15 0.6 20 0.7 6 1.0 0 0 0 0
60 0.0 8 0.0 45 0.0 0 0 0 1
45 0.1 60 0.0 70 0.2 0 0 0 1
9 0.0 2 0.0 60 0.0 0 0 0 1
7 0.0 1 1.0 50 0.0 0 0 0 1
12 0.0 90 0.0 40 0.0 0 0 0 1
5 0.0 60 0.0 70 0.0 0 0 0 1
120 0.3 40 0.0 12 0.0 0 0 0 1
30 0.0 0 0.0 0 0.0 0 0 0 1
200 0.0 0 0.0 3 1.0 0 0 0 1
15 0.1 40 0.0 0 0.0 0 0 0 1
"""
DEPTH = 8


@dataclass(frozen=True)
class Tree:
    """Arrays over nodes; feature -1 marks a leaf, whose ``kept`` decides."""

    feature: np.ndarray
    limit: np.ndarray
    low: np.ndarray
    high: np.ndarray
    kept: np.ndarray

    def keep(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH + 1):
            f = self.feature[at]
            goes_low = x[np.arange(len(x)), np.maximum(f, 0)] <= self.limit[at]
            at = np.where(f < 0, at, np.where(goes_low, self.low[at], self.high[at]))
        return self.kept[at]


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> Tree:
    """Binary splits that lower the Gini impurity most, until leaves are pure; ties go to the first feature and limit."""
    nodes: list[list[float]] = []

    def add(rows: np.ndarray, left: int) -> int:
        me = len(nodes)
        share = y[rows].mean()
        nodes.append([-1, 0.0, 0, 0, float(share >= 0.5)])
        if left == 0 or share in (0.0, 1.0):
            return me
        choice = None
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for limit in (values[:-1] + values[1:]) / 2:
                low = x[rows, f] <= limit
                a, b = y[rows][low], y[rows][~low]
                impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                if choice is None or impurity < choice[0] - 1e-12:
                    choice = (impurity, f, limit)
        if choice is None:
            return me
        _, f, limit = choice
        low = x[rows, f] <= limit
        nodes[me][:2] = [f, limit]
        nodes[me][2] = add(rows[low], left - 1)
        nodes[me][3] = add(rows[~low], left - 1)
        return me

    add(np.arange(len(x)), depth)
    table = np.array(nodes)
    return Tree(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4] > 0)


def trained() -> Tree:
    """The tree of the labelled table. Where a container tells, lengths do not matter: such rows also count with others."""
    table = np.array([[float(v) for v in line.split()] for line in LABELLED.strip().splitlines()])
    told = table[table[:, 6:9].any(1)]
    varied = [told]
    for before in (0, 4, 30, 200):
        for behind in (0, 4, 30, 200):
            for scale in (1, 6):
                other = told.copy()
                other[:, 0] *= scale
                other[:, 2], other[:, 4] = before, behind
                varied.append(other)
    table = np.concatenate((table, *varied))
    return grow(table[:, :-1], table[:, -1])


def _kinds(tag: str) -> tuple[str, ...]:
    """Lists of open containers that a tag is in: its own, and those of tags that bound a search."""
    kinds = [tag]
    if tag in BLOCKS:
        kinds.append("special")
        if tag not in ("address", "div", "li", "dt", "dd"):
            kinds.append("wall")
    if tag in MUTE:
        kinds += ["mute", "wall"]
    if tag in ("table", "td", "th", "caption"):
        kinds.append("cell")
    return tuple(kinds)


_KINDS = {t: _kinds(t) for t in CONTAINERS}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTES = re.compile(r"""(?:"[^"]*"|'[^']*'|[^'"<>])*+""")
# Attributes whose quotes never close are read in vain. Once that has cost so many times the page's length, a tag of the
# page ends at its first > whatever its quotes say.
VAIN = 8
_ENDS = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([^\s/=]++)\s*+(?:=\s*+(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|(\S++)))?""")
_MAY_HIDE = re.compile("hidden|display", re.IGNORECASE)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def _hidden(attributes: str) -> bool:
    """Whether a tag's attributes hide it: `hidden` but not until found, `aria-hidden` true, or a style that shows nothing."""
    if not _MAY_HIDE.search(attributes):
        return False
    values: dict[str, str] = {}
    for name, *value in _ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), html.unescape("".join(value)).strip().lower())
    if values.get("hidden", "until-found") != "until-found" or values.get("aria-hidden") == "true":
        return True
    style: dict[str, tuple[bool, str]] = {}
    for declared in _COMMENT.sub(" ", values.get("style", "")).split(";"):
        name, _, value = declared.partition(":")
        value, _, flag = (part.strip() for part in value.partition("!"))
        if flag or not style.get(name.strip(), (False, ""))[0]:
            style[name.strip()] = (bool(flag), value)
    return style.get("display", (False, ""))[1] == "none" or style.get("visibility", (False, ""))[1] == "hidden"


def _place(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether a container says that it is not the article, and that it is."""
    away, article = tag in AWAY_TAGS or (tag == "header" and not inside), tag in ARTICLE_TAGS
    if attributes:
        names = {p.lower() for m in _NAMES.findall(attributes) for p in _PART.findall(m[0] or m[1] or m[2])}
        article |= bool(names & ARTICLE_NAMES) and not names & AWAY_NAMES
        if tag not in ARTICLE_TAGS:
            away |= bool(names & AWAY_NAMES) or (bool(names & HEADER_NAMES) and not inside and not article)
        away |= _hidden(attributes)
    return away, article


class Marks:
    """Comments, declarations and tags of a page, one after the other, in time linear in its length."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.left = VAIN * len(page) + 1000
        self.closing = -1

    def close(self, at: int) -> int:
        """The first > from ``at`` on, the page's length if there is none; ``at`` never falls."""
        if self.closing < at:
            found = self.page.find(">", at)
            self.closing = len(self.page) if found < 0 else found
        return self.closing

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, tag, attributes) of the next mark; no tag for comments and declarations.

        A ``<`` that begins nothing is text, and so is all that follows the last ``>``.
        """
        page = self.page
        while (i := page.find("<", at)) >= 0:
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                return i, len(page) if end < 0 else end + 3, False, "", ""
            end = self.close(i)
            if end == len(page):
                # Nothing closes any more; only a comment may still begin.
                i = page.find("<!--", i)
                return None if i < 0 else (i, len(page), False, "", "")
            if page.startswith(("<!", "<?"), i):
                return i, end + 1, False, "", ""
            tag = _TAG.match(page, i)
            if tag is None:
                at = i + 1
                continue
            if self.left > 0:
                stop = _ATTRIBUTES.match(page, tag.end()).end()
                if page.startswith(">", stop):
                    return i, stop + 1, bool(tag[1]), tag[2], page[tag.end() : stop]
                self.left -= (len(page) if page.startswith(("'", '"'), stop) else stop) - tag.end()
            end = self.close(tag.end())
            if end == len(page):
                at = i + 1
                continue
            return i, end + 1, bool(tag[1]), tag[2], page[tag.end() : end]
        return None


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, words in links, away, inside) of a page's flat blocks, empty ones left out."""
    found: list[tuple[str, int, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    # Places in the stack by tag and by kind, so that no search walks it.
    places: defaultdict[str, list[int]] = defaultdict(list)
    parts: list[str] = []
    away = inside = False
    link, linked = 0, 0
    # Whether a paragraph is open, outside what is mute and within it.
    paragraph = within = False
    at, n = 0, len(page)
    marks = Marks(page)

    def close() -> None:
        nonlocal linked
        words = "".join(parts).split()
        if words:
            found.append((" ".join(words), len(words), min(linked, len(words)), away, inside))
        parts.clear()
        linked = 0

    def last(kinds: tuple[str, ...]) -> int:
        return max((places[kind][-1] for kind in kinds if places[kind]), default=-1)

    def leave(k: int) -> None:
        """Close the containers from place ``k`` on."""
        nonlocal away, inside
        if stack[k][1:] != (away, inside):
            close()
        _, away, inside = stack[k]
        for tag, _, _ in stack[k:]:
            for kind in _KINDS[tag]:
                places[kind].pop()
        del stack[k:]

    while at < n:
        mark = marks.after(at)
        text = page[at : mark[0] if mark else n]
        muted = bool(places["mute"])
        if text and not muted:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if link:
                linked += len(text.split())
        if mark is None:
            break
        _, at, closing, tag, attributes = mark
        if not tag:
            continue
        tag = tag.lower()
        if tag in _ENDS and not closing:
            end = _ENDS[tag].search(page, at) if not attributes.endswith("/") else None
            at = end.end() if end else at if attributes.endswith("/") else n
            parts.append(" ")
            continue
        if muted and tag == "p":
            if closing and paragraph and not within:
                leave(places["mute"][0])
                muted = False
            within = not closing
        if not muted:
            if tag in BLOCKS:
                close()
                paragraph = tag == "p" and not closing
            elif tag == "br":
                parts.append(" ")
            if tag == "a":
                link = 0 if closing else 1
        if tag in MUTE and not closing:
            parts.append(" ")
            within &= muted
        if tag in CONTAINERS:
            if not closing:
                if not attributes.endswith("/"):
                    if tag in SIBLINGS:
                        bound = last(WALLS[tag])
                        open_ = [k for sibling in SIBLINGS[tag] if (k := last((sibling,))) > bound]
                        if open_:
                            leave(min(open_))
                    a, b = (False, False) if muted or tag in MUTE else _place(tag, attributes, inside)
                    if tag not in BLOCKS and a:
                        close()
                    for kind in _KINDS[tag]:
                        places[kind].append(len(stack))
                    stack.append((tag, away, inside))
                    away, inside = away or a, inside or (b and not away and not a)
            else:
                k = last((tag,))
                if k >= 0 and (tag in SECTIONS or k > last(tuple(kind for kind in LIMITS.get(tag, ("cell",)) if kind != tag))):
                    if muted and k < places["mute"][0]:
                        # The end of what encloses a mute element without an end tag.
                        if tag in BLOCKS:
                            close()
                            paragraph = False
                        elif tag == "a":
                            link = 0
                    leave(k)
    close()
    return found


def features(found: list[tuple[str, int, int, bool, bool]]) -> np.ndarray:
    own = np.array([(w, link / w) for _, w, link, _, _ in found]).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, behind = np.concatenate((edge, own[:-1])), np.concatenate((own[1:], edge))
    away, inside = (np.array([b[k] for b in found], float) for k in (3, 4))
    return np.column_stack((own, before, behind, away, inside, (1 - inside) * float(inside.any())))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree.keep(features(found))
    return " ".join(b[0] for b, k in zip(found, keep.tolist(), strict=True) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for ``pages`` (page_id, url, html): one row per row, whatever repeats or is null.

    Null or empty html gives an empty text. White space within a block becomes one space, kept blocks are joined by
    one space in page order, nothing is cut. n_chars counts code points. Other columns are left out.
    """
    need(pages, "page_id", "url", "html")
    tree = trained()
    ids = pages.select("page_id", "url").schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h, tree) for h in part.column("html").to_pylist()]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"{ids}, text string, n_chars bigint")
