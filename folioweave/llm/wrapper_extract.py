"""Main-text extraction by wrapper induction over the pages of a host.

The page of a host's smallest id is the host's reference tree. Each page's tree is aligned with it
by simple tree matching, which gives the page's blocks slots: the reference nodes they fall on. Over
all pages of the host the texts of each slot are counted. A slot whose text hardly changes while
the pages around it do is template, what varies or falls on no slot is content.

Varying alone doesn't make an article here: menus, adverts and footers differ from page to page as
well. So roles count too: elements and names of menus, headers, footers, sidebars, notices, adverts,
forms and reader comments are never content, and where a page marks its article, content is what
stands in it. In the article as elsewhere, what is constant goes.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A text is constant in a slot if it stands there in this share of the host's differing pages, two at least.
CONSTANT = 0.8
#: Where more than this share of a page's text is constant, the page is a copy of others, not their template.
COPY = 0.5
#: Wrappers up to so many bytes in all are broadcast; larger ones are joined by host.
BROADCAST = 64 << 20
#: Pairs of places of two lists of children up to which they are aligned by one table; longer lists are halved.
CELLS = 4_000_000

_OPEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>")
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=/>]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
# Fixed values of HTML: elements without content, with raw text that a page doesn't show, and those that start a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in "script style textarea title iframe template noembed noframes".split()}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option select button".split()
)
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}, "body": {"head"},
}
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
_CELLS_OF_ROWS = frozenset("tr td th tbody tfoot".split())
#: Elements and words in class, id or role names of menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
SIDE = frozenset("nav aside footer form button select dialog menu label".split())
SIDE_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer contentinfo sidebar aside complementary "
    "notice notices banner cookie cookies consent gdpr popup modal newsletter signup subscribe promo promos promotion ad ads adv advert adverts advertisement sponsor sponsored form comment comments reply replies disqus".split()
)
_ABOUT = frozenset("with without has have no is".split())
MAIN_NAMES = frozenset("article articlebody content main post story entry".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    """An element: tag, names, child elements, and its number in page order.

    ``side`` tells a name that marks menus and the like, or a hidden element; ``main`` 2 for a name
    with "main" in it, 1 for another name of an article, else 0. "with-sidebar" and such say nothing.
    """

    __slots__ = ("children", "main", "number", "shape", "side", "slot", "tag", "up")

    def __init__(self, tag: str, names: list[str], up: Node | None, hidden: bool = False) -> None:
        words = [w for w in map(_WORD.findall, names) if w and w[0] not in _ABOUT]
        self.tag, self.up = tag, up
        self.side = hidden or any(not SIDE_NAMES.isdisjoint(w) for w in words)
        self.main = max((2 if "main" in w else 1 for w in words if not MAIN_NAMES.isdisjoint(w) and SIDE_NAMES.isdisjoint(w)), default=0)
        self.children: list[Node] = []
        self.number = self.slot = self.shape = -1


class Page:
    """A parsed page: the tree of block elements, all of them in page order, and the blocks (element, text)."""

    __slots__ = ("blocks", "nodes", "root")

    def __init__(self) -> None:
        self.root = Node("#", [], None)
        self.nodes: list[Node] = []
        self.blocks: list[tuple[Node, str]] = []


def parse(source: str) -> Page:
    """One pass over the page. Where a tag's quotes never end, quotes count as plain signs from there on."""
    page = Page()
    top, opened = page.root, {}  # how often each tag is open
    text: list[str] = []
    at, quotes = 0, True

    def flush() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                page.blocks.append((top, line))
            text.clear()

    def close(tag: str) -> None:
        """Close the innermost element of ``tag`` and all in it."""
        nonlocal top
        flush()
        while True:
            done, top = top.tag, top.up
            opened[done] -= 1
            if done == tag:
                return

    while True:
        m = _OPEN.search(source, at)
        text.append(source[at : m.start()] if m else source[at:])
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            if m[0] == "<!--" or m[0] == "<![CDATA[":
                mark = "-->" if m[0] == "<!--" else "]]>"
                end = source.find(mark, at)
                if mark == "]]>":
                    text.append(source[at:end] if end >= 0 else source[at:])
            else:
                mark, end = ">", source.find(">", at)
            at = end + len(mark) if end >= 0 else len(source)
            continue
        tag = m[2].lower()
        rest = _REST.match(source, at) if quotes else None
        if rest:
            end = rest.end()
        else:
            quotes, end = False, source.find(">", at) + 1
            if not end:
                text.append(source[m.start() :])
                break
        names, at = source[at : end - 1], end
        if m[1]:
            if opened.get(tag):
                close(tag)
            continue
        if tag in RAW:
            if not names.rstrip().endswith("/"):
                stop = RAW[tag].search(source, at)
                at = stop.end() if stop else len(source)
            continue
        if tag not in BLOCK:
            if tag in VOID:
                text.append(" ")
            continue
        if top.tag == "p":
            close("p")
        ends = _CLOSES.get(tag)
        if ends:
            fence = _FENCE.get(tag, ())
            while any(opened.get(x) for x in ends):
                up = top
                while up.tag not in ends and up.tag not in fence and up.up is not None:
                    up = up.up
                if up.tag not in ends:
                    break
                close(up.tag)
                if tag not in _CELLS_OF_ROWS:
                    break
        flush()
        if tag in VOID:
            continue
        given = [n for x in _NAMES.findall(names) for n in "".join(x).lower().split()] if names else []
        node = Node(tag, given, top, bool(names and _HIDDEN.search(names)))
        node.number = len(page.nodes)
        page.nodes.append(node)
        top.children.append(node)
        opened[tag] = opened.get(tag, 0) + 1
        top = node
    flush()
    return page


class Wrapper:
    """A host's reference tree, whose equal subtrees bear one number: their shape."""

    def __init__(self, source: str) -> None:
        self.page = parse(source)
        self.shapes: dict[tuple, int] = {}
        self.sizes: list[int] = []
        _shape(self.page, self.shapes, self.sizes)


def _shape(page: Page, shapes: dict[tuple, int], sizes: list[int]) -> None:
    """Number the tree's subtrees by their tags, the same number for the same subtree."""
    for node in (*page.nodes[::-1], page.root):
        key = (node.tag, *[c.shape for c in node.children])
        found = shapes.get(key)
        if found is None:
            found = shapes[key] = len(sizes)
            sizes.append(1 + sum(sizes[c.shape] for c in node.children))
        node.shape = found


def _next_row(row: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The weights of the best matches with each first part of the other list, after one more item, of weights ``w`` with its items."""
    new = row.copy()
    np.maximum(new[1:], np.where(w > 0, row[:-1] + w, 0), out=new[1:])
    return np.maximum.accumulate(new)


def _aligned(x: list[int], y: list[int], weight: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest order-keeping match of two lists: its weight and the pairs of places.

    ``weight[a, b]`` is the weight of kinds a and b of which the lists consist, 0 if they can't match. Where the lists
    have more than ``CELLS`` pairs of places they are halved: the best place to part the other list is where the weights
    of the front's and of the back's best matches add up to most, which takes a row of them, not a table.
    """
    own, other = np.array(x), np.array(y)
    todo, pairs, total = [(0, len(x), 0, len(y))], [], 0
    while todo:
        x0, x1, y0, y1 = todo.pop()
        n, m = x1 - x0, y1 - y0
        if not n or not m:
            continue
        right = other[y0:y1]
        if n > 1 and n * m > CELLS:
            half, front, back = x0 + n // 2, np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
            for a in own[x0:half]:
                front = _next_row(front, weight[a, right])
            for a in own[half:x1][::-1]:
                back = _next_row(back, weight[a, right[::-1]])
            cut_at = y0 + int(np.argmax(front + back[::-1]))
            todo += [(x0, half, y0, cut_at), (half, x1, cut_at, y1)]
            continue
        best = np.zeros((n + 1, m + 1), np.int32)
        for i in range(n):
            best[i + 1] = _next_row(best[i], weight[own[x0 + i], right])
        total += int(best[n, m])
        i, j = n, m
        while i and j:
            if best[i, j] == best[i, j - 1]:
                j -= 1
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                pairs.append((x0 + i - 1, y0 + j - 1))
                i, j = i - 1, j - 1
    return total, sorted(pairs)


def match(page: Page, wrapper: Wrapper) -> int:
    """Simple tree matching: the largest top-down, order-keeping match; sets ``slot`` of page nodes.

    Equal subtrees at the ends of two lists of children match wholly, which loses nothing; what two
    shapes hold in common is worked out once.
    """
    shapes, sizes = dict(wrapper.shapes), list(wrapper.sizes)
    _shape(page, shapes, sizes)
    done: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def ends(a: Node, b: Node) -> tuple[int, int, int]:
        """How many children match at the front, and where the middles end."""
        x, y, lo = a.children, b.children, 0
        while lo < len(x) and lo < len(y) and x[lo].shape == y[lo].shape:
            lo += 1
        hx, hy = len(x), len(y)
        while hx > lo and hy > lo and x[hx - 1].shape == y[hy - 1].shape:
            hx, hy = hx - 1, hy - 1
        return lo, hx, hy

    todo = [(page.root, wrapper.page.root)]
    while todo:
        a, b = todo[-1]
        key = (a.shape, b.shape)
        if key in done or a.shape == b.shape:
            todo.pop()
            continue
        lo, hx, hy = ends(a, b)
        x, y = a.children[lo:hx], b.children[lo:hy]
        kinds_x, kinds_y = {c.shape: c for c in x}, {c.shape: c for c in y}
        some = [(p, q) for p in kinds_x.values() for q in kinds_y.values() if p.tag == q.tag]
        missing = [(p, q) for p, q in some if p.shape != q.shape and (p.shape, q.shape) not in done]
        if missing:
            todo += missing
            continue
        total, pairs = 1 + sum(sizes[c.shape] for c in (*a.children[:lo], *a.children[hx:])), []
        if some:
            code_x, code_y = {s: k for k, s in enumerate(kinds_x)}, {s: k for k, s in enumerate(kinds_y)}
            weight = np.zeros((len(code_x), len(code_y)), np.int32)
            for p, q in some:
                weight[code_x[p.shape], code_y[q.shape]] = sizes[p.shape] if p.shape == q.shape else done[p.shape, q.shape][0]
            more, pairs = _aligned([code_x[c.shape] for c in x], [code_y[c.shape] for c in y], weight)
            total += more
        done[key] = total, [(lo + i, lo + j) for i, j in pairs]
        todo.pop()
    todo = [(page.root, wrapper.page.root)]
    while todo:
        a, b = todo.pop()
        a.slot = b.number
        if a.shape == b.shape:
            todo += zip(a.children, b.children, strict=True)
            continue
        lo, hx, hy = ends(a, b)
        todo += zip(a.children[:lo], b.children[:lo], strict=True)
        todo += zip(a.children[hx:], b.children[hy:], strict=True)
        todo += [(a.children[i], b.children[j]) for i, j in done[a.shape, b.shape][1]]
    top = (page.root.shape, wrapper.page.root.shape)
    return sizes[top[0]] if top[0] == top[1] else done[top][0]


def _aside(node: Node) -> bool:
    return node.tag in SIDE or node.side and node.tag not in ("html", "body", "main")


def roles(page: Page) -> list[bool]:
    """For each block, whether it may be content by its role.

    That is: outside menus and the like, and, where elements are marked as the article, in such ones. An ``article``
    tells more than a ``main`` element or name, and that more than other names, but only a kind of mark that holds half
    of all marked text or more is followed, so that a teaser in an ``article`` doesn't outrank the story in ``main``. A heading in the
    article's header is the article's own, the header's other blocks aren't.
    """
    outside = (True, 0, False)
    kind: list[tuple[bool, int, bool]] = []
    for node in page.nodes:
        fine, marks, header = kind[node.up.number] if node.up.number >= 0 else outside
        own = 3 if node.tag == "article" else 2 if node.tag == "main" else node.main
        fine = fine and not _aside(node) and node.tag != "head" and (node.tag != "header" or marks > 0)
        kind.append((fine, marks | 1 << own >> 1 if fine else marks, header or node.tag == "header"))
    found = [(*(kind[node.number] if node.number >= 0 else outside), node.tag) for node, _ in page.blocks]
    size = {mark: sum(len(text) for (_, text), (fine, marks, _, _) in zip(page.blocks, found, strict=True) if fine and marks & mark) for mark in (4, 2, 1, 7)}
    mark = next((m for m in (4, 2, 1, 7) if size[m] and 2 * size[m] >= size[7]), 0)
    return [fine and (not mark or marks & mark > 0) and (not header or tag in _HEADING) for fine, marks, header, tag in found]


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _host(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


class _Wrappers:
    """A worker's reference trees of the hosts it last met."""

    def __init__(self) -> None:
        self.known: dict[str, Wrapper] = {}

    def of(self, source: str) -> Wrapper:
        if source not in self.known:
            if len(self.known) >= 64:
                self.known.clear()
            self.known[source] = Wrapper(source)
        return self.known[source]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", constant: float = CONSTANT, copy: float = COPY) -> DataFrame:
    """One row (id, url, text, n_chars, n_template) for each row of ``pages``.

    ``text`` is the article: character references decoded, white space inside a block one space,
    blocks in page order joined by newlines; '' if none. ``n_chars`` counts its code points,
    ``n_template`` the blocks left out of it as the host's template: those that stand at one place of
    at least ``constant`` of the host's pages, two or more, that aren't copies of each other. Of a page
    whose text is template by more than ``copy`` all stays, as it is a copy of other pages. A host of
    one page has nothing to compare it with, so all of it is content by its roles.

    A null or empty html gives an empty text. A null url, or one without a host, counts as one host
    of no name. Repeated rows each give a row; other columns aren't read; an empty table gives an
    empty result. Unclosed elements end where HTML has them end, or with the page.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), _host(url_col).alias("host"))
    # The first page of each host, chosen without bringing a host's pages together.
    wrappers = cut(own.groupBy("host").agg(F.min_by("html", F.struct(F.col("id").isNull(), F.col("id"), F.xxhash64("html"))).alias("wrapper"), F.count("*").alias("pages")))
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host")).alias("n")).first()["n"] or 0
    attach = lambda model: own.join(F.broadcast(model) if size <= BROADCAST else model, "host", "left")
    shared = attach(wrappers).where("pages > 1")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Wrappers()
        for batch in batches:
            rows = []
            for host, html, wrapper in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                page = parse(html)
                match(page, known.of(wrapper))
                mine = [(node.slot, _digest(text)) for (node, text), fine in zip(page.blocks, roles(page), strict=True) if fine]
                whole = _digest(repr([d for _, d in mine]))
                rows += [(host, slot, d, whole) for slot, d in dict.fromkeys(mine) if slot >= 0]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["host", "slot", "digest", "whole"])

    counted = shared.select(F.xxhash64("host").alias("host"), "html", "wrapper").mapInArrow(slots, "host long, slot int, digest long, whole long")
    # Pages alike as a whole count once, so that copies of an article don't make it a template.
    seen = cut(counted.distinct())
    each = seen.groupBy("host", "slot", "digest").agg(F.count("*").alias("n")).where("n > 1")
    total = seen.select("host", "whole").distinct().groupBy("host").agg(F.count("*").alias("all"))
    fixed = each.join(total, "host").where(F.col("n") >= constant * F.col("all"))
    # As many as a reference page has slots, at most.
    fixed = fixed.groupBy(F.col("host").alias("key")).agg(F.collect_list(F.struct("slot", "digest")).alias("fixed"))
    model = cut(wrappers.join(fixed, F.xxhash64("host") == F.col("key"), "left").select("host", F.when(F.col("fixed").isNotNull(), F.col("wrapper")).alias("wrapper"), "fixed"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Wrappers()
        for batch in batches:
            got, left_out = [], []
            for html, wrapper, fixed in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                page = parse(html)
                lines = [b for b, fine in zip(page.blocks, roles(page), strict=True) if fine]
                kept = lines
                if fixed and lines:
                    match(page, known.of(wrapper))
                    template = {(f["slot"], f["digest"]) for f in fixed}
                    kept = [(node, text) for node, text in lines if (node.slot, _digest(text)) not in template]
                    if sum(len(t) for _, t in kept) < (1 - copy) * sum(len(t) for _, t in lines):
                        kept = lines
                got.append("\n".join(t for _, t in kept))
                left_out.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array(left_out, pa.int64())], names=["id", "url", "text", "n_template"])

    kind = pages.schema[id_col].dataType.simpleString()
    out = attach(model).select("id", "url", "html", "wrapper", "fixed").mapInArrow(texts, f"id {kind}, url string, text string, n_template long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_template")
