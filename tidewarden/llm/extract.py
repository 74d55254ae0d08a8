"""Main text of web pages by wrapper induction.

A page is outlined: its containers form a small tree, each with the blocks of text
that lie directly in it. The outlines of a host's pages are aligned by simple tree
matching (`align`) with a reference, the commonest outline of the host, and with
the commonest of their own layout on that host (pages with the same containers
down to three below the body). So every container of every page falls on a node
of the reference, and all pages together say what the node is:

* texts that at least `constant_share` of the pages with the node have under it, two
  of them at least, are template;
* text that only one page has there and that is no link is the node's own text; the
  lowest node that holds `content_share` of the own text of an average page is the
  content slot. It grows to a parent of which all other parts are own text too, but never
  to the body;
* parts of the slot that are mostly links and mostly repeated are menus within it.

A page's text is what lies in the content slot without template. Tag, role and class
names only break ties alignment must leave open: they take parts off within the slot
(reader comments vary like articles), and where no node below the body holds enough
own text, parts so named count as having none. Pages of a layout that only one
page of the host has are read by the host's wrapper, pages of hosts with one page by
the table's, a page alone in the table by its own text and names.

Everything is counted over all pages; pages of equal text count once. A wrapper is
as large as its reference page, whatever the number of pages. Pages are parsed
once; outlines and texts are written to the shared folder and read from there.

Defined results: a null or empty html, or one without text, gives an empty text;
a null URL belongs to the empty host; repeated rows get equal results; pages with
unclosed or stray tags are parsed as browsers do for paragraphs, list items and
table cells; an empty table gives no row; other columns are ignored. Two lists of
containers whose table of matches would have more than `MOST_CELLS` cells are
aligned from both ends instead, each container with the next of its tag.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import cut, sliced, small, stored, text_or_empty

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math meta nobr object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr canvas map mi mn mo mrow mtext msup msub mfrac msqrt mstyle semantics area param source track embed input link".split())
#: What is never shown as running text, wherever it stands.
UNSEEN = frozenset("applet audio button datalist head iframe input legend meter noembed noframes noscript optgroup option output progress script select style svg template textarea title video".split())
#: Containers that are no article by their tag.
PARTS = frozenset("aside dialog fieldset footer form menu nav".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark a part which is not the article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus dropdown footer form gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promos promotion reader recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar topbar widget widgets alert".split())
#: Those of them that also mark what varies like an article and may be longer.
REMARKS = frozenset("comment comments disqus related recommended replies reply respond".split())
#: A start tag that ends an open one: tag -> (what it closes, what stops the search).
PARAGRAPH_END = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: What is nested deeper lies flat, as in browsers.
DEEPEST = 512
SCOPE = frozenset("table td th caption button object template html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of running text: they are no containers, and a name alone never removes them.
TEXT = HEADINGS | frozenset("p hgroup blockquote pre li dt dd tr td th thead tbody tfoot caption figcaption".split())
TOP = frozenset(("#root", "html", "body"))
MOST_CELLS = 1 << 20
#: A quote opens a value only behind the equals sign.
_ATTRS = r"""((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+){_ATTRS}>", re.S)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_NAMED = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+))?+|"[^"]*"|'[^']*'""")
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Words beside a mark that leave its meaning: `sidebar-left`, `site-footer`. With any other word, as in `no-sidebar` or `social-history`, a name is no proof.
BESIDE = frozenset("area bar block bottom box button buttons col column container content div element entry global group holder id in inner item items js left link links list main module outer page pane panel post posts primary region right row secondary section site slot text the title top unit user view wrap wrapper zone".split())


class Node:
    """An element; chars and links count its text and that of links in it, without white space."""

    __slots__ = ("attrs", "chars", "headed", "holds", "items", "links", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.items = tag, attrs, []
        self.chars = self.links = 0
        self.headed = self.holds = False

    @property
    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def parse(page: str) -> Node:
    """The DOM tree; text nodes are str items, undecoded."""
    root = Node("#root")
    stack, at, i, last = [root], 0, 0, page.rfind(">") + 1  # no tag ends behind the last bracket: so every search that starts a tag ends one
    while found := _TOKEN.search(page, i, last):
        if found.start() > at:
            stack[-1].items.append(page[at : found.start()])
        at = i = found.end()
        tag = found[2]
        if not tag:
            if found[0].startswith("<!--") and not found[0].endswith("-->"):
                at = len(page)
            continue
        tag = tag.lower()
        if found[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE and tag in ("p", "li") and stack[k].tag != tag:
                    break
            continue
        if tag in PARAGRAPH_END:
            _close(stack, {"p"}, SCOPE)
        if tag in CLOSES:
            _close(stack, *CLOSES[tag])
        node = Node(tag, found[3])
        stack[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            node.items.append(page[at : end.start() if end else len(page)])
            at = i = end.end() if end else len(page)
        elif tag not in VOID and not found[3].endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
    stack[-1].items.append(_OPEN.split(page[at:], maxsplit=1)[0])  # browsers drop a tag that the page's end cuts short
    return root


def _close(stack: list[Node], tags: set[str], stop: set[str] | frozenset[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in stop:
            return


def walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo += reversed(x.children)


def measure(root: Node) -> None:
    """Set chars, links, headed (a heading lies below) and holds (an article or main lies below) of every node."""
    for x in reversed(list(walk(root))):
        if x.tag not in RAW:
            for y in x.items:
                if isinstance(y, str):
                    x.chars += len("".join(y.split()))
                else:
                    x.chars, x.links = x.chars + y.chars, x.links + y.links
                    x.headed |= y.headed or y.tag in HEADINGS
                    x.holds |= y.holds or y.tag in ("article", "main")
        if x.tag == "a":
            x.links = x.chars


def names(node: Node) -> dict[str, str]:
    """Attributes by name, in lower case; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _NAMED.finditer(node.attrs):
        if m[1]:
            out.setdefault(m[1].lower(), (m[2] or "").strip("\"'").lower())
    return out


def marks(name: str) -> tuple[set[str], bool]:
    """The marks among a name's words, and whether the rest of the name leaves them their meaning."""
    words = {w for w in _SPLIT.split(name) if w and not w.isdigit()}
    return words & MARKS, words <= MARKS | BESIDE


#: How surely tag, role or names say that a part is no article: not at all; unless it heads one; by its class or id; by what always holds.
FREE, HEAD, NAMED, SURE = range(4)


def mark(node: Node, inside: bool) -> int:
    """FREE to SURE. inside: the part lies within an article or main.

    Forms and names that may mean a layout do not count around an article. Names with
    other words beside the mark, the names of running text within an article and the
    ids of its sections count only where links make up most of the text.
    """
    tag = node.tag
    if tag in PARTS:
        return FREE if tag == "form" and node.holds else SURE
    if tag == "header":
        return FREE if inside and node.headed else HEAD if node.headed else SURE
    if not node.attrs or tag in TOP:
        return FREE
    own = names(node)
    if "hidden" in own or own.get("role") in ROLES and not node.holds:
        return SURE
    sure, unsure = set(), set()
    for name, by_id in [(x, False) for x in own.get("class", "").split()] + [(own.get("id", ""), True)]:
        found, whole = marks(name)
        if tag in ("article", "main"):
            found &= REMARKS
        if inside and (tag in TEXT or tag in INLINE or by_id and tag == "section"):
            whole = False
        (sure if whole else unsure).update(found)
    if sure - {"header", "masthead"}:
        return SURE if sure & REMARKS else FREE if node.holds else NAMED
    if sure:
        return FREE if node.holds or inside and node.headed else HEAD if node.headed else NAMED
    return NAMED if unsure and not node.holds and 2 * node.links > node.chars else FREE


def tidy(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


class Block(NamedTuple):
    node: int  # the container's number in the outline
    links: int  # how many of its characters are those of links
    text: str


class Outline(NamedTuple):
    shape: str  # a line for each container, in order: depth, tag, class names, kinds of text directly in it
    marked: list[int]  # of each container
    blocks: list[Block]
    layout: int  # hash of the containers down to three below the body, none within an article


def outline(page: str) -> Outline:
    root = parse(page)
    measure(root)
    made: list[tuple[int, str, str, set[str]]] = []
    marked: list[int] = []
    found: list[Block] = []
    parts: list[str] = []
    linked = [0]
    layout: set[str] = set()

    def flush(own: int, tag: str) -> None:
        if parts:
            if text := tidy(parts):
                made[own][3].add(tag)
                found.append(Block(own, min(linked[0], len(text)), text))
            parts.clear()
        linked[0] = 0

    # (item, container, tag of the block, in a link, within an article, layout path or None); None as item ends a block
    todo: list[tuple] = [(root, -1, "", False, False, "")]
    while todo:
        item, own, block, link, inside, path = todo.pop()
        if item is None:
            flush(own, block)
        elif isinstance(item, str):
            parts.append(item)
            linked[0] += link * len("".join(item.split()))
        elif item.tag == "br":
            parts.append(" ")
        elif item.tag in UNSEEN:
            if item.tag not in INLINE and parts:
                todo.append((None, own, block, link, inside, path))
        elif item.tag in INLINE:
            if not item.attrs or mark(item, inside) < NAMED:
                todo += [(x, own, block, link or item.tag == "a", inside, path) for x in reversed(item.items)]
        else:
            level = mark(item, inside)
            if own >= 0:
                flush(own, block)
            if item.tag in TEXT:
                if level >= NAMED:
                    continue
                below = own
            else:
                below = len(made)
                classes = ".".join(sorted(w for w in names(item).get("class", "").split() if w.isalpha())) if item.attrs and "class" in item.attrs.lower() else ""
                made.append((made[own][0] + 1 if own >= 0 else 0, item.tag, classes, set()))
                marked.append(max(level, marked[own] if own >= 0 and marked[own] >= NAMED else FREE))
                if item.tag in TOP:
                    path = ""
                elif path is not None and path.count("/") < 3:
                    path = f"{path}/{item.tag}.{classes}"
                    layout.add(path)
                    path = None if item.tag in ("article", "main") else path
            tag = item.tag if item.tag in TEXT else ""
            inner = inside or item.tag in ("article", "main")
            todo.append((None, below, tag, link, inner, path))
            todo += [(x, below, tag, link, inner, path) for x in reversed(item.items)]
    shape = "\n".join(f"{depth} {tag} {classes} {','.join(sorted(kinds))}" for depth, tag, classes, kinds in made)
    return Outline(shape, marked, found, _hash("\n".join(sorted(layout))))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


# ---------------------------------------------------------------------- alignment


class Part(NamedTuple):
    number: int
    tag: str
    classes: str
    kinds: frozenset[str]
    children: list


def tree(shape: str) -> Part:
    """The tree of a shape; its containers are numbered in order."""
    top = Part(-1, "", "", frozenset(), [])
    path = [top]
    for k, line in enumerate(shape.split("\n")):
        depth, tag, classes, kinds = line.split(" ")
        part = Part(k, tag, classes, frozenset(kinds.split(",")) - {""}, [])
        del path[int(depth) + 1 :]
        path[-1].children.append(part)
        path.append(part)
    return top.children[0]


def alike(a: Part, b: Part) -> int:
    """Weight of a pair: 8 for the tag, and to settle ties 2 for equal class names and up to 4 for equal kinds of text."""
    if a.tag != b.tag:
        return 0
    union = len(a.kinds | b.kinds)
    return 8 + 2 * (a.classes == b.classes) + (4 * len(a.kinds & b.kinds) // union if union else 4)


def match(a: Part, b: Part, memo: dict) -> int:
    """Weight of the heaviest mapping of equal-tagged nodes that keeps parents and order (simple tree matching)."""
    own = alike(a, b)
    if not own:
        return 0
    if (got := memo.get((a.number, b.number))) is None:
        xs, ys = a.children, b.children
        if len(xs) * len(ys) > MOST_CELLS:
            got = memo[a.number, b.number] = (own + sum(match(x, y, memo) for x, y in ends(xs, ys)), None)
        else:
            row = [0] * (len(ys) + 1)
            table = [row]
            for x in xs:
                last, row = row, [0]
                for j, y in enumerate(ys):
                    row.append(max(last[j + 1], row[j], last[j] + match(x, y, memo)))
                table.append(row)
            got = memo[a.number, b.number] = (row[-1] + own, table)
    return got[0]


def ends(xs: list[Part], ys: list[Part]) -> list[tuple[Part, Part]]:
    """Two long lists aligned from both ends: equal tags in turn, up to the first that differ."""
    n = min(len(xs), len(ys))
    low = next((k for k in range(n) if xs[k].tag != ys[k].tag), n)
    high = next((k for k in range(n - low) if xs[-1 - k].tag != ys[-1 - k].tag), n - low)
    return [(xs[k], ys[k]) for k in range(low)] + [(xs[k - high], ys[k - high]) for k in range(high)]


def aligned(a: Part, b: Part) -> Iterator[tuple[Part, Part]]:
    """The pairs of nodes of that mapping."""
    memo: dict = {}
    if not match(a, b, memo):
        return
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        yield x, y
        xs, ys, table = x.children, y.children, memo[x.number, y.number][1]
        if table is None:
            todo += [(p, q) for p, q in ends(xs, ys) if p.tag == q.tag]
            continue
        i, j = len(xs), len(ys)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((xs[i], ys[j]))


@functools.lru_cache(4096)
def align(shape: str, reference: str) -> tuple[int, ...]:
    """For each container of the shape the reference's that it falls on, or -1."""
    out = [-1] * (shape.count("\n") + 1)
    if shape == reference:
        return tuple(range(len(out)))
    for x, y in aligned(tree(shape), tree(reference)):
        out[x.number] = y.number
    return tuple(out)


# --------------------------------------------------------------------- extraction


class Wrapper(NamedTuple):
    """What all pages of a host, or of one of its layouts, say: a reference, what an average page has at each of its nodes, and template."""

    reference: str
    pages: int
    nodes: dict[int, tuple[int, int, int]]  # characters, those of links, own ones, in total
    template: frozenset[tuple[int, int]]  # node and hash of the text


@functools.lru_cache(4096)
def _parents(shape: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Each container's parent (-1 for the first) and tag."""
    parents, tags, path = [], [], []
    for k, line in enumerate(shape.split("\n")):
        depth, tag = line.split(" ")[:2]
        del path[int(depth) :]
        parents.append(path[-1] if path else -1)
        tags.append(tag)
        path.append(k)
    return tuple(parents), tuple(tags)


def _lowest(own: list[float], parents: tuple[int, ...], share: float) -> int:
    """The lowest container with `share` of all own text at or below it."""
    below = list(own)
    for k in range(len(below) - 1, 0, -1):
        below[parents[k]] += below[k]
    if below[0] <= 0:
        return 0
    return max(k for k in range(len(below)) if below[k] >= share * below[0])  # those with more than half lie on one path


def extract(page: Outline, wrapper: Wrapper | None = None, content_share: float = 0.8) -> str:
    """The text of the content slot without template; without a wrapper the page's own text and names decide."""
    if not page.blocks:
        return ""
    parents, tags = _parents(page.shape)
    count = len(parents)
    to = align(page.shape, wrapper.reference) if wrapper else (-1,) * count
    chars, links, own = ([0.0] * count for _ in range(3))
    for b in page.blocks:
        if to[b.node] < 0:
            chars[b.node] += len(b.text)
            links[b.node] += b.links
            own[b.node] += len(b.text) - b.links
    for k in range(count):
        if to[k] >= 0:
            got = wrapper.nodes.get(to[k], (0, 0, 0))
            chars[k], links[k], own[k] = (x / wrapper.pages for x in got)
    free = [0.0 if page.marked[k] == SURE or not wrapper and page.marked[k] else x for k, x in enumerate(own)]
    slot = _lowest(free if any(free) else own, parents, content_share)
    if tags[slot] in TOP:  # a tie: no part below the body has enough
        named = [0.0 if page.marked[k] else x for k, x in enumerate(own)]
        slot = _lowest(named, parents, content_share) if any(named) else slot

    for k in range(count - 1, 0, -1):
        chars[parents[k]] += chars[k]
        links[parents[k]] += links[k]
        own[parents[k]] += own[k]

    def chrome(k: int) -> bool:
        return chars[k] > 0 and (2 * links[k] > chars[k] or 2 * own[k] < chars[k] or page.marked[k] != FREE)

    children: dict[int, list[int]] = {}
    for k in range(1, count):
        children.setdefault(parents[k], []).append(k)
    while slot and tags[up := parents[slot]] not in TOP and not any(chrome(k) for k in children[up] if k != slot):
        slot = up
    above = slot
    while above > 0 and tags[above] not in ("article", "main"):
        above = parents[above]
    if above > 0 and page.marked[above] < NAMED:
        slot = above
    elif not wrapper and tags[slot] in TOP:
        # alone: articles, if any, hold the text
        bodies = [k for k in range(count) if tags[k] in ("article", "main") and page.marked[k] < NAMED and chars[k]]
        slot = min(bodies, key=lambda k: (tags[k] != "main", k)) if bodies and len([k for k in bodies if parents[k] not in bodies]) == 1 else slot

    inside = [False] * count
    off = [False] * count
    worst = HEAD if tags[slot] in TOP else NAMED
    for k in range(slot, count):
        up = parents[k]
        inside[k] = k == slot or up >= 0 and inside[up]
        if inside[k] and k != slot:
            repeated = bool(wrapper) and 2 * links[k] > chars[k] > 2 * own[k]
            off[k] = off[up] or page.marked[k] >= worst or repeated
    template = wrapper.template if wrapper else frozenset()
    kept = (b.text for b in page.blocks if inside[b.node] and not off[b.node] and (to[b.node] < 0 or (to[b.node], _hash(b.text)) not in template))
    return "\n\n".join(kept)


def alone(page: str | None, content_share: float = 0.8) -> str:
    """The text of a page that no other can be aligned with."""
    return extract(outline(page), None, content_share) if page else ""


# ---------------------------------------------------------------------- induction

PAGE = "layout long, shape string, marked array<tinyint>, digest binary, blocks array<struct<node: int, links: int, chars: int, hash: long, text: string>>"
BLOCKS = pa.list_(pa.struct([("node", pa.int32()), ("links", pa.int32()), ("chars", pa.int32()), ("hash", pa.int64()), ("text", pa.string())]))
LEVEL = ["host", "level", "layout"]  # level 0: the whole host, layout 0; level 1: one of its layouts


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def outlines(df: DataFrame, kind: str) -> DataFrame:
    """id, url, host and the outline of each page (id, url, host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html", 4 << 20):
            made = [outline(h or "") for h in batch.column("html").to_pylist()]
            digests = [xxhash.xxh3_128_digest("\n".join(f"{b.node} {b.text}" for b in p.blocks).encode("utf-8", "surrogatepass")) for p in made]
            blocks = [[{"node": b.node, "links": b.links, "chars": len(b.text), "hash": _hash(b.text), "text": b.text} for b in p.blocks] for p in made]
            cols = [pa.array([p.layout for p in made], pa.int64()), pa.array([p.shape for p in made], pa.string()), pa.array([p.marked for p in made], pa.list_(pa.int8())), pa.array(digests, pa.binary()), pa.array(blocks, BLOCKS)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "url", "host")), *cols], ["id", "url", "host", "layout", "shape", "marked", "digest", "blocks"])

    return df.mapInArrow(run, f"id {kind}, url string, host string, {PAGE}")


def fallen(known: DataFrame, top: str) -> DataFrame:
    """host, level, layout, node, hash, chars, links: each text of a page once, on the node of the reference that it falls on.

    A null hash stands for the page's having the node. Level 2 has sums by node only, for the table's reference.
    """
    columns = (*LEVEL, "node", "hash", "chars", "links")
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "shape", 1 << 20):
            out: list[tuple] = []
            for host, layout, shape, blocks, of_layout, in_layout, of_host, in_host in _rows(batch, "host", "layout", "shape", "blocks", "of_layout", "in_layout", "of_host", "in_host"):
                levels = [(0, 0, of_host)] * (in_host > 1) + [(1, layout, of_layout)] * (1 < in_layout < in_host)
                for level, own, reference in levels:
                    to = align(shape, reference)
                    seen = {(to[b["node"]], b["hash"]): b for b in blocks if to[b["node"]] >= 0}
                    out += [(host, level, own, node, code, b["chars"], b["links"]) for (node, code), b in seen.items()]
                    out += [(host, level, own, node, None, 0, 0) for node in {n for n, _ in seen}]
                to, sums = align(shape, top), {}
                for b in blocks:
                    if to[b["node"]] >= 0:
                        chars, links = sums.get(to[b["node"]], (0, 0))
                        sums[to[b["node"]]] = chars + b["chars"], links + b["links"]
                out += [("", 2, 0, node, None, *x) for node, x in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], list(columns))

    return known.mapInArrow(run, "host string, level int, layout long, node int, hash long, chars long, links long")


def induce(pages: DataFrame, constant_share: float) -> tuple[DataFrame, Wrapper | None]:
    """The wrappers, as JSON, of hosts and their layouts (host, level, layout, wrapper), and that of the table.

    pages: host and the columns of an outline.
    """
    narrow = F.transform("blocks", lambda b: b.dropFields("text"))
    each = stored(pages.where(F.size("blocks") > 0).select("host", "digest", "layout", "shape", narrow.alias("blocks")).dropDuplicates(["host", "digest"]))
    shapes = cut(each.groupBy("host", "layout", "shape").agg(F.count(F.lit(1)).alias("n")))
    commonest = F.max_by("shape", F.struct("n", F.xxhash64("shape")))  # its size is that of a page's outline
    by_layout = cut(shapes.groupBy("host", "layout").agg(commonest.alias("of_layout"), F.sum("n").alias("in_layout")))
    by_host = cut(shapes.groupBy("host").agg(commonest.alias("of_host"), F.sum("n").alias("in_host")))
    top = shapes.groupBy("shape").agg(F.sum("n").alias("n")).agg(commonest.alias("shape"), F.sum("n").alias("n")).first()

    known = each.join(small(by_layout), ["host", "layout"]).join(small(by_host), "host")
    texts = cut(fallen(known, top["shape"] or "0 #root  ").groupBy(*LEVEL, "node", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links")))
    own = F.sum(F.when(F.col("n") == 1, F.col("chars") - F.col("links")).otherwise(0))
    having = F.max(F.when(F.col("hash").isNull(), F.col("n")))
    nodes = cut(texts.groupBy(*LEVEL, "node").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"), own.alias("own"), having.alias("having")))
    table = {r["node"]: (r["chars"], r["links"], r["chars"] - r["links"]) for r in nodes.where("level = 2").collect()}  # nodes of one reference
    nodes, texts = nodes.where("level < 2"), texts.where("level < 2")

    fixed = texts.where("hash IS NOT NULL AND n > 1").join(small(cut(nodes.where("having > 1").select(*LEVEL, "node", "having"))), [*LEVEL, "node"]).where(F.col("n") >= constant_share * F.col("having"))
    template = fixed.groupBy(*LEVEL).agg(F.collect_list(F.array(F.col("node").cast("long"), "hash")).alias("template"))
    held = nodes.groupBy(*LEVEL).agg(F.collect_list(F.array(F.col("node").cast("long"), "chars", "links", "own")).alias("nodes"))
    whole = by_host.where("in_host > 1").select("host", F.lit(0).alias("level"), F.lit(0).cast("long").alias("layout"), F.col("of_host").alias("reference"), F.col("in_host").alias("pages"))
    parts = by_layout.where("in_layout > 1").select("host", F.lit(1).alias("level"), "layout", F.col("of_layout").alias("reference"), F.col("in_layout").alias("pages"))
    made = whole.union(parts).join(held, LEVEL).join(template, LEVEL, "left")
    wrappers = made.select(*LEVEL, F.to_json(F.struct("reference", "pages", "nodes", F.coalesce("template", F.array().cast("array<array<bigint>>")).alias("template"))).alias("wrapper"))
    return wrappers, Wrapper(top["shape"], top["n"], table, frozenset()) if (top["n"] or 0) > 1 else None


@functools.lru_cache(1024)
def load(wrapper: str) -> Wrapper:
    got = json.loads(wrapper)
    return Wrapper(got["reference"], got["pages"], {n[0]: tuple(n[1:]) for n in got["nodes"]}, frozenset(map(tuple, got["template"])))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", constant_share: float = 0.8, content_share: float = 0.8, wrappers: bool = True) -> DataFrame:
    """id, url, host, text. Without wrappers every page keeps all its visible text: what alignment takes off can be measured."""
    host = F.lower(F.regexp_extract(text_or_empty(url_col), r"://([^/?#]*)", 1))
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    kind = df.schema[id_col].dataType.simpleString()
    made = outlines(pages, kind)
    if not wrappers:
        text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n")
        return made.select(F.col("id").alias(id_col), "url", "host", text.alias("text"))
    made = stored(made)
    induced, table = induce(made, constant_share)
    induced = cut(induced)
    of_layout = induced.where("level = 1").select("host", "layout", F.col("wrapper").alias("of_layout"))
    of_host = induced.where("level = 0").select("host", F.col("wrapper").alias("of_host"))
    both = made.join(small(of_layout), ["host", "layout"], "left").join(small(of_host), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "shape", 1 << 20):
            texts = []
            for shape, marked, blocks, by_layout, by_host in _rows(batch, "shape", "marked", "blocks", "of_layout", "of_host"):
                page = Outline(shape, marked, [Block(b["node"], b["links"], b["text"]) for b in blocks], 0)
                found = by_layout or by_host
                texts.append(extract(page, load(found) if found else table, content_share))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "url", "host")), pa.array(texts, pa.string())], [id_col, "url", "host", "text"])

    return both.select("id", "url", "host", "shape", "marked", "blocks", "of_layout", "of_host").mapInArrow(run, f"`{id_col}` {kind}, url string, host string, text string")
