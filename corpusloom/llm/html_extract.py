"""Main text of web pages by wrapper induction over same-host pages.

1. A page is parsed to a tree of block elements, with the tag repairs that browsers make, in one pass over its whole
   html.
2. The pages of a host are grouped by layout: the label paths that their upper LEVELS levels have. Each layout with MIN_PAGES
   pages, and with a hundredth of the host's at least, has a reference tree, that of its page with the smallest hash; pages
   of rarer layouts are aligned with the tree of the host's most frequent one. Every page is aligned by simple tree
   matching: roots must agree, and the children's best ordered matching maximises the matched nodes. Children with equal
   shapes at both ends are matched as they stand; the dynamic programme runs on what lies between, whatever its length:
   long lists are halved until a part's table is small. Trees are matched to their full depth.
3. The text of every aligned block votes for its slot; pages with equal html are one page. A text that stands in one slot
   in at least SHARE of the pages that are aligned with the tree, and in MIN_PAGES, is template wherever it stands, also
   inside an article. Slots whose texts vary are content.
4. Varying slots may be menus, comments, forms and adverts: elements, roles and classes break that tie. Of what is left, the
   main text is the blocks inside the article (an article, main or equally marked element) where a page has one, else all.

Votes are counts over all pages. Trees and constant slots are one row a host; they are broadcast only behind a
check of their size, and otherwise joined by shuffle, where a host with many pages is split among tasks.

Defined results: null html has no text; null and malformed urls share the host ""; layouts of fewer than MIN_PAGES
different pages have no template of their own; repeated rows have equal results; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_IDS
from corpusloom.llm.hashing import slices
from corpusloom.llm.worker import frugal, prepare
from corpusloom.schemas import require
from corpusloom.storage import materialize

#: Pages that a constant text needs, its share of the pages of its tree, and the share of a host's pages that a layout with
#: a tree of its own has.
MIN_PAGES, SHARE, RARE = 4, 0.5, 0.01
#: Levels of a page's tree that make its layout.
LEVELS = 4
#: Reference trees and constants that are broadcast together at most, in bytes.
BROADCAST_BYTES = 32 << 20
#: Cells of one dynamic programme's table; longer lists of unlike children are halved first, at the best place.
CELLS = 40_000
#: Pairs of children of one label from which their weights are found together; cells of such a table of weights at most (beyond
#: it, pairs are weighed one by one), and numbers that one step of it handles.
TOGETHER, TABLE, STEP = 2_000, 64 << 20, 2 << 20

# Element names of HTML by their parts in parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption head html legend li optgroup option dd dt tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
HEAD = frozenset("base link meta script style title template noscript".split())
#: An element that opens ends open elements of these names, up to the names after the bar.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
# Our own lists, which decide where slots vary: what is not main text.
CHROME_TAGS = frozenset("aside button datalist dialog footer form head iframe input menu nav noscript object search select svg template".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CHROME_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
HEADER_WORDS = frozenset("header topbar".split())
ARTICLE_WORDS = frozenset({"articlebody", "article-body", "article-content", "post-content", "entry-content", "post-body", "story-body"})

TOKEN = re.compile(
    r"""<!--(?:.*?)(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(>?)|<([a-zA-Z][^\s/>]*)((?:[^>"'=]+|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=|["'])*)(>?)|([^<]+|<)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
WORDS = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"([a-z0-9])([A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """A block element: its label, children, whether it is chrome or an article, and its texts (blocks) in order."""

    __slots__ = ("article", "children", "chrome", "label", "number", "shape", "size", "soft", "tag")

    def __init__(self, tag: str, label: str, chrome: bool, soft: bool, article: bool):
        self.tag, self.label, self.chrome, self.soft, self.article = tag, label, chrome, soft, article
        self.children: list[Node] = []
        self.shape, self.size, self.number = 0, 1, 0


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


_KNOWN: dict[tuple[str, str], tuple[str, bool, bool, bool]] = {}


def _kind(tag: str, raw: str) -> tuple[str, bool, bool, bool]:
    """Label, chrome for sure, chrome unless it holds an article or heading, article."""
    if (got := _KNOWN.get((tag, raw))) is not None:
        return got
    a = _attributes(raw) if raw and not raw.isspace() else {}
    named = f"{a.get('class', '')} {a.get('id', '')}"
    words = set(WORDS.findall(CAMEL.sub(r"\1 \2", named).lower()))
    role = a.get("role", "").lower()
    hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(a.get("style", "")))
    article = tag in ("article", "main") or role in ("main", "article") or a.get("itemprop", "").lower() == "articlebody" or bool(ARTICLE_WORDS & set(named.lower().split()))
    safe = tag in ("html", "body", "article", "main") or article
    soft = not safe and (bool(words & (CHROME_WORDS | HEADER_WORDS)) or tag == "header")
    sure = tag in CHROME_TAGS or (hidden and tag not in ("html", "body")) or role in CHROME_ROLES
    label = tag + "".join(f".{w}" for w in sorted(words) if not w.isdigit())
    if tag == "article" and words & {"comment", "comments", "reply"}:
        sure = True
    if len(_KNOWN) < 10_000:
        _KNOWN[tag, raw] = label, sure, soft, article
    return label, sure, soft, article


def parse(html: str) -> tuple[Node, list[tuple[Node, list[str]]]]:
    """The tree of block elements and (element, text parts) of its blocks in page order."""
    root = Node("#", "#", False, False, False)
    names: list[str] = ["#"]  # open elements: block elements have a node, others None
    nodes: list[Node | None] = [root]
    blocks: list[tuple[Node, list[str]]] = []
    inner, fresh = root, True  # the innermost block element; whether the next text begins a block
    at, n = 0, len(html)

    def close(i: int) -> None:
        nonlocal inner, fresh
        if any(x is not None for x in nodes[i:]):
            fresh = True
        del names[i:], nodes[i:]
        inner = next(x for x in reversed(nodes) if x is not None)

    def last(what: set[str] | frozenset[str], stop: set[str] | frozenset[str] = frozenset()) -> int:
        for i in range(len(names) - 1, 0, -1):
            if names[i] in what:
                return i
            if names[i] in stop:
                return 0
        return 0

    while at < n:
        m = TOKEN.match(html, at)
        at = m.end()
        if m[6] is not None:
            text = m[6]
            if fresh:
                if text.isspace():
                    continue
                if names[-1] == "head":
                    close(len(names) - 1)
                blocks.append((inner, []))
                fresh = False
            blocks[-1][1].append(text)
        elif m[3] is not None:
            tag = m[3].lower()
            if not m[5]:
                break  # the page ends inside a tag
            if tag == "br":
                if not fresh:
                    blocks[-1][1].append(" ")
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                if not end:
                    break
                at = html.find(">", end.end())
                if at < 0:
                    break
                at += 1
                continue
            if tag in VOID and tag != "hr":
                continue
            if tag not in BLOCK:
                names.append(tag)
                nodes.append(None)
                continue
            if names[-1] == "head" and tag not in HEAD:
                close(len(names) - 1)
            if tag in CLOSES_P and (i := last({"p"}, {"table", "td", "th", "button"})):
                close(i)
            if tag in ENDS:
                what, stop = ENDS[tag]
                while i := last(what, stop):
                    close(i)
            label, sure, soft, article = _kind(tag, m[4])
            node = Node(tag, label, sure, soft, article)
            inner.children.append(node)
            fresh = True
            if tag != "hr":
                names.append(tag)
                nodes.append(node)
                inner = node
        elif m[1] is not None:
            if not m[2]:
                break
            if i := last({m[1].lower()}):
                close(i)
    return root, blocks


def _measure(x: Node) -> None:
    """Sets a node's shape and size from its children's."""
    x.shape = hash((x.label, tuple(c.shape for c in x.children)))
    x.size = 1 + sum(c.size for c in x.children)


def _finish(root: Node) -> None:
    """Sets shapes, and makes chrome of what looks like it and holds no article and no first heading.

    An explicit stack keeps deeply nested pages from ending the interpreter.
    """
    holds: dict[int, bool] = {}
    stack = [(root, iter(root.children))]
    while stack:
        x, rest = stack[-1]
        child = next(rest, None)
        if child is not None:
            stack.append((child, iter(child.children)))
            continue
        stack.pop()
        found = holds[id(x)] = x.article or x.tag == "h1" or any([holds.pop(id(c)) for c in x.children])
        x.chrome = x.chrome or (x.soft and not found)
        _measure(x)


def skeleton(root: Node) -> list:
    """[label, number of children] of a tree's nodes in document order: what pages are aligned with."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append([x.label, len(x.children)])
        todo += reversed(x.children)
    return out


class Reference:
    """A reference tree; its nodes are numbered in document order."""

    def __init__(self, tree: list):
        self.count = len(tree)
        nodes: list[Node] = []
        open_: list[list] = []  # nodes that lack children, with how many
        for number, (label, n) in enumerate(tree):
            x = Node("", label, False, False, False)
            x.number = number
            nodes.append(x)
            if open_:
                open_[-1][0].children.append(x)
                open_[-1][1] -= 1
            open_.append([x, n])
            while open_ and not open_[-1][1]:
                open_.pop()
        for x in reversed(nodes):
            _measure(x)
        self.root = nodes[0]


def _ends(x: list[Node], y: list[Node]) -> tuple[int, int]:
    """How many children have equal shapes at the beginning, and at the end after these."""
    most = min(len(x), len(y))
    i = 0
    while i < most and x[i].shape == y[i].shape:
        i += 1
    j = 0
    while j < most - i and x[-1 - j].shape == y[-1 - j].shape:
        j += 1
    return i, j


def _weight(a: Node, b: Node, memo: dict) -> int:
    """Matched nodes of two trees by simple tree matching; an explicit stack, for trees of any depth."""
    todo = [(a, b)]
    while todo:
        c, d = todo[-1]
        key = (c.shape, d.shape)
        if key in memo:
            todo.pop()
        elif c.label != d.label:
            memo[key] = 0
        elif c.shape == d.shape:
            memo[key] = c.size
        else:
            i, j = _ends(c.children, d.children)
            x, y = ({e.shape: e for e in z.children[i : len(z.children) - j]} for z in (c, d))
            if (w := _together([*x.values()], [*y.values()])) is not None:
                first, second = ({shape: k for k, shape in enumerate(z)} for z in (x, y))
                rows, cols = (np.array([at[e.shape] for e in z.children[i : len(z.children) - j]]) for z, at in ((c, first), (d, second)))
                ends = c.children[:i] + c.children[len(c.children) - j :]
                memo[key] = 1 + sum(e.size for e in ends) + int(_last_row(w, rows, cols)[-1])
                continue
            lacking = [(e, f) for e in x.values() for f in y.values() if e.label == f.label and (e.shape, f.shape) not in memo]
            if lacking:
                todo += lacking
            else:
                memo[key] = 1 + sum(w for _, _, w in _pairs(c, d, memo))
    return memo[a.shape, b.shape]


def _paired(x: Iterable[Node], y: Iterable[Node]) -> int:
    """How many pairs of x and y have one label."""
    a, b = (Counter(n.label for n in z) for z in (x, y))
    return sum(k * b[label] for label, k in a.items())


def _padded(nodes: list[Node], at: dict[int, int]) -> np.ndarray:
    """The places of each node's children in at, filled up with a place of no child."""
    out = np.full((len(nodes), max(len(n.children) for n in nodes)), len(at), np.int64)
    for row, n in zip(out, nodes, strict=True):
        row[: len(n.children)] = [at[c.shape] for c in n.children]
    return out


def _classes(nodes: list[Node]) -> dict[str, dict[int, list[int]]]:
    """Places of nodes by label, then by how many children they have, to a power of two."""
    out: dict[str, dict[int, list[int]]] = {}
    for i, n in enumerate(nodes):
        out.setdefault(n.label, {}).setdefault(len(n.children).bit_length(), []).append(i)
    return out


def _table(x: list[Node], y: list[Node], kids: tuple[dict[int, int], dict[int, int]], below: np.ndarray | None) -> np.ndarray:
    """Weights of all pairs of x and y: the matching of their children, for many pairs in each step."""
    out = np.zeros((len(x), len(y)), np.int32)
    left, right = _classes(x), _classes(y)
    for label in left.keys() & right.keys():
        for m, rows in left[label].items():
            for n, cols in right[label].items():
                if not m or not n or below is None:
                    out[np.ix_(rows, cols)] = 1
                    continue
                a, b = _padded([x[i] for i in rows], kids[0]), _padded([y[i] for i in cols], kids[1])
                many = max(1, STEP // b.size)
                for first in range(0, len(rows), many):
                    some = a[first : first + many]
                    best = np.zeros((len(some), len(cols), b.shape[1] + 1), np.int32)
                    for child in some.T:
                        better = np.maximum(best[:, :, 1:], best[:, :, :-1] + below[child][:, b])
                        np.maximum.accumulate(better, axis=2, out=best[:, :, 1:])
                    out[np.ix_(rows[first : first + many], cols)] = 1 + best[:, :, -1]
    return out


def _together(x: list[Node], y: list[Node]) -> np.ndarray | None:
    """Weights of all pairs of unlike shapes x and y, from the lowest level of their trees up.

    None if they are few, or a level is too large: pairs are then weighed one by one.
    """
    if _paired(x, y) <= TOGETHER:
        return None
    levels = [(x, y)]
    while all(levels[-1]):
        if len(levels[-1][0]) * len(levels[-1][1]) > TABLE:
            return None
        a, b = ([*{c.shape: c for n in side for c in n.children}.values()] for side in levels[-1])
        levels.append((a, b))
    below = None
    for (a, b), kids in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        places = tuple({n.shape: i for i, n in enumerate(side)} for side in kids)
        if below is not None:
            below = np.pad(below, ((0, 1), (0, 1)))  # no child weighs nothing
        below = _table(a, b, places, below)
    return below


def _weights(x: list[Node], y: list[Node], memo: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights by shape of x and of y, and the shapes' numbers in both lists."""
    first, second = ({n.shape: n for n in z} for z in (x, y))
    a, b = [*first.values()], [*second.values()]
    w = _together(a, b)
    if w is None:
        w = np.zeros((len(a), len(b)), np.int32)
        of: dict[str, list[int]] = {}
        for j, d in enumerate(b):
            of.setdefault(d.label, []).append(j)
        for i, c in enumerate(a):
            for j in of.get(c.label, ()):
                w[i, j] = _weight(c, b[j], memo)
    places = [{shape: k for k, shape in enumerate(z)} for z in (first, second)]
    return w, np.array([places[0][c.shape] for c in x]), np.array([places[1][d.shape] for d in y])


def _last_row(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The best weights of matching all of x with each beginning of y, in two rows."""
    best = np.zeros(len(y) + 1, np.int64)
    for c in x:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + w[c][y]))
    return best


def _middle(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """The best ordered matching of two lists of shapes, as places."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a > 1 and (b - a) * (d - c) > CELLS:
            half = (a + b) // 2
            split = c + int(np.argmax(_last_row(w, x[a:half], y[c:d]) + _last_row(w, x[half:b][::-1], y[c:d][::-1])[::-1]))
            todo += [(a, half, c, split), (half, b, split, d)]
            continue
        best = np.zeros((b - a + 1, d - c + 1), np.int64)
        for p in range(b - a):
            best[p + 1, 1:] = np.maximum.accumulate(np.maximum(best[p, 1:], best[p, :-1] + w[x[a + p]][y[c:d]]))
        p, q = b - a, d - c
        while p and q:
            if best[p, q] == best[p - 1, q]:
                p -= 1
            elif best[p, q] == best[p, q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                out.append((a + p, c + q))
    return out


def _pairs(a: Node, b: Node, memo: dict) -> list[tuple[Node, Node, int]]:
    """The matched children of two matched nodes, with the nodes that each match brings."""
    x, y = a.children, b.children
    i, j = _ends(x, y)
    out = [(c, d, c.size) for c, d in [*zip(x[:i], y[:i], strict=True), *zip(x[len(x) - j :], y[len(y) - j :], strict=True)]]
    x, y = x[i : len(x) - j], y[i : len(y) - j]
    both = {c.label for c in x} & {d.label for d in y}  # children of other labels match nothing
    x, y = [c for c in x if c.label in both], [d for d in y if d.label in both]
    if x and y:
        w, first, second = _weights(x, y, memo)
        out += [(x[p], y[q], int(w[first[p], second[q]])) for p, q in _middle(w, first, second)]
    return out


def align(root: Node, reference: Reference) -> dict[int, int]:
    """id of each aligned node -> number of its reference node."""
    found: dict[int, int] = {}
    memo: dict = {}
    todo = [(root, reference.root)] if root.label == reference.root.label else []
    while todo:
        a, b = todo.pop()
        found[id(a)] = b.number
        todo += [(c, d) for c, d, w in _pairs(a, b, memo) if w]
    return found


def layout(root: Node) -> int:
    """A hash of the label paths in the upper levels of a tree; how often each occurs doesn't matter."""
    paths, todo = set(), [(root, "", 0)]
    while todo:
        x, path, level = todo.pop()
        path = f"{path}/{x.label}"
        if path not in paths or level < LEVELS:
            paths.add(path)
            if level < LEVELS:
                todo += [(c, path, level + 1) for c in x.children]
    return _hash("\n".join(sorted(paths)))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def page_blocks(html: str | None, references: dict[int, Reference]) -> tuple[int | None, list[str], list[int], list[int]]:
    """The layout whose tree a page is aligned with; texts, slots (-1: not aligned) and text hashes of its content blocks."""
    if not html:
        return None, [], [], []
    root, blocks = parse(html)
    _finish(root)
    which = layout(root)
    if references and which not in references:
        which = next(iter(references))  # the most frequent one
    state: dict[int, tuple[bool, bool]] = {}  # chrome, inside an article
    order = [(root, False, False)]
    has_article = False
    while order:
        x, chrome, inside = order.pop()
        chrome = chrome or (x.chrome and not (x.tag == "header" and inside))
        inside = (inside or x.article) and not chrome
        has_article = has_article or inside
        state[id(x)] = chrome, inside
        order += [(c, chrome, inside) for c in x.children]
    aligned = align(root, references[which]) if references else {}
    texts, slots, hashes = [], [], []
    used: dict[int, int] = {}
    for node, parts in blocks:
        chrome, inside = state[id(node)]
        text = " ".join(unescape("".join(parts)).split())
        k = used[id(node)] = used.get(id(node), -1) + 1
        if not text or chrome or (has_article and not inside):
            continue  # goes whether its slot varies or not
        slot = aligned.get(id(node), -1)
        texts.append(text)
        slots.append(slot << 32 | k if slot >= 0 else -1)
        hashes.append(_hash(text))
    return which, texts, slots, hashes


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))


def _by_host(rows: DataFrame, model: DataFrame, size: Column) -> DataFrame:
    """rows with their host's row of model (written); broadcast only behind a sum of sizes."""
    total = model.agg(F.coalesce(F.sum(size + 64), F.lit(0))).first()[0]
    return rows.join(F.broadcast(model) if total <= BROADCAST_BYTES else model, "host", "left")


def _layouts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, trees): a JSON list of [layout, tree] for each host, the most frequent layout first; (host, same, n): how many
    pages have one html, where these are several. Written tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                found = []
                for html in b.column(2).to_pylist():
                    root = parse(html)[0]
                    _finish(root)
                    found.append(layout(root))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64())], ["host", "same", "layout"])

    known = pages.where("html != ''").select("host", "same", "html")
    each = materialize(known.mapInArrow(frugal(run), "host string, same long, layout long").groupBy("host", "same").agg(F.min("layout").alias("layout"), F.count(F.lit(1)).alias("n")), "layouts")
    per = each.groupBy("host", "layout").agg(F.min("same").alias("same"), F.count(F.lit(1)).alias("pages"))
    total = each.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    chosen = materialize(per.where(F.col("pages") >= MIN_PAGES).join(total, "host").where(F.col("pages") >= RARE * F.col("total")), "chosen-layouts")
    few = chosen.count() * 64 <= BROADCAST_BYTES
    found = known.join(F.broadcast(chosen) if few else chosen, ["host", "same"]).select("host", "layout", "pages", "html")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for html in b.column(3).to_pylist():
                root = parse(html)[0]
                _finish(root)
                out.append(json.dumps(skeleton(root), separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string())], ["host", "layout", "pages", "tree"])

    one = found.mapInArrow(frugal(trees), "host string, layout long, pages long, tree string").groupBy("host", "layout").agg(F.max("pages").alias("pages"), F.min("tree").alias("tree"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("pages")).alias("n"), "layout", "tree")))  # 1/RARE trees a host at most
    told = one.groupBy("host").agg(F.to_json(F.transform(listed, lambda x: F.struct(x["layout"].alias("l"), x["tree"].alias("t")))).alias("trees"))
    return materialize(told, "reference-trees"), materialize(each.where("n > 1").select("host", "same", "n"), "equal-pages")


def page_texts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, text) of every row: the main text, blocks joined by two line feeds."""
    require(pages, key, "url", "html")
    prepare(pages.sparkSession)
    rows = pages.select(F.col(key), F.col("url"), F.col("html"), host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("same"))
    trees, equal = _layouts(rows)
    kind = pages.schema[key].dataType.simpleString()
    names = [key, "url", "host", "same", "layout", "texts", "slots", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, Reference]] = {}
        for batch in batches:
            for b in slices(batch):
                got = []
                for host, html, tree in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                    references = known.get(host)
                    if references is None:
                        if len(known) >= 500:
                            known.clear()
                        references = known[host] = {x["l"]: Reference(json.loads(x["t"])) for x in json.loads(tree or "[]")}
                    got.append(page_blocks(html, references))
                which, texts, slots, hashes = zip(*got, strict=True)
                columns = [*b.columns[:4], pa.array(which, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(slots, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    with_tree = _by_host(rows, trees, F.octet_length("trees")).select(key, "url", "host", "same", "html", "trees")
    blocks = materialize(with_tree.mapInArrow(frugal(run), f"`{key}` {kind}, url string, host string, same long, layout long, texts array<string>, slots array<long>, hashes array<long>"), "blocks")

    few = equal.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    weighed = blocks.select("host", "same", "layout", "slots", "hashes").join(F.broadcast(equal) if few else equal, ["host", "same"], "left").withColumn("w", 1 / F.coalesce("n", F.lit(1)))
    per_tree = weighed.groupBy("host", "layout").agg(F.sum("w").alias("pages"))
    votes = weighed.select("host", "layout", "w", F.explode(F.arrays_zip("slots", "hashes")).alias("v")).where("v.slots >= 0")
    per_text = votes.groupBy("host", "layout", "v.slots", "v.hashes").agg(F.sum("w").alias("n")).where(F.col("n") > MIN_PAGES - 0.01)
    constant = per_text.join(per_tree, ["host", "layout"]).where(F.col("n") >= SHARE * F.col("pages") - 0.01)
    template = materialize(constant.groupBy("host").agg(F.collect_list(F.struct("layout", "slots", "hashes")).alias("template")), "templates")  # 1/SHARE texts a slot at most

    found = _by_host(blocks, template, F.size("template") * 24)
    zipped = F.arrays_zip("texts", "slots", "hashes")
    kept = F.filter(zipped, lambda b: ~F.coalesce(F.array_contains(F.col("template"), F.struct(F.col("layout").alias("layout"), b["slots"].alias("slots"), b["hashes"].alias("hashes"))), F.lit(False)))
    return found.select(key, "url", F.array_join(F.transform(kept, lambda b: b["texts"]), "\n\n").alias("text"))
