"""Main text of web pages by wrapper induction.

Pages of one host and layout are parsed, summarised to their containers and
aligned by simple tree matching.  Nodes that stay the same become the template,
places whose text varies are slots.  The slot that holds most of what varies is
the article; its siblings that vary as an article's parts do belong to it.
Extraction reads those slots of every page and leaves the template out.  A host
with one page has nothing to align: its page is read by element names alone.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import web
from .store import Workspace

#: Pages that are aligned for one template.
PAGES = 6
#: A container with more children than this is aligned by kinds: those of one key count as one.
WIDE = 128
#: A slot beside the article's belongs to it if it varies by that share of it, or holds a heading.
BESIDE = 0.15
#: The article's slot varies at least by that share of what the pages hold; less is no evidence (pages that are copies).
EVIDENCE = 0.2

# Element names and roles of the HTML standard, and common names of page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = HEADINGS | set("p blockquote pre li dt dd td th figcaption caption".split())
CONTAINERS = "address article aside body center details dialog div dl fieldset figure footer form header main menu nav ol section summary table tbody tr ul"
CLOSED_BY_BLOCK = set("p".split())
FURNITURE = set("head nav header footer aside form script style noscript template iframe button select textarea svg canvas audio video object dialog menu title xmp noembed noframes".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form status".split())
COMMENT_NAMES = set("comment comments respond replies disqus".split())
FURNITURE_NAMES = COMMENT_NAMES | set(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner promo promotion promoted commercial "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar topbar header masthead footer "
    "sidebar widget widgets related recommended recommendations trending teaser teasers "
    "cookie cookies consent gdpr notice notices alert popup modal overlay disclaimer "
    "newsletter subscribe subscription signup login share sharing social skip".split()
)
#: Items that end an open item of the same kind.
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*>?|</(?P<end>[a-zA-Z][^\s>/]*+)[^>]*+>?"
    r"|<(?P<tag>[a-zA-Z][^\s>/]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>"
    r"|<(?P<odd>[a-zA-Z][^\s>/]*+)[^>]*+>?|(?P<text>[^<]++|<)"
)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME = re.compile(r"[a-z]+")
WORDS = re.compile(r"[^\s_-]+")


class Node:
    """An element: tag, key (tag with its classes, digits left out), children (nodes and strings) and what its names say.

    ``dull``: furniture by element or role, or reader comments; ``named``: furniture by class or id.
    """

    __slots__ = ("tag", "key", "dull", "named", "children", "holds_article", "in_article", "linked", "of")

    def __init__(self, tag: str, key: str, dull: bool = False, named: bool = False):
        self.tag, self.key, self.dull, self.named = tag, key, dull, named
        self.children: list[Node | str] = []
        self.holds_article = tag in ("article", "main")
        self.in_article = tag == "article"
        #: Characters of text in links, directly in this node; the parsed nodes that a summary's node stands for.
        self.linked, self.of = 0, ()


def names_of(value: str) -> set[str]:
    """Words that a class or id says of the element itself: each name whole, or its first part (``ad-box``, not ``no-sidebar``)."""
    out = set()
    for name in value.split():
        out.add(name)
        if first := WORDS.match(name):
            out.add(first[0])
    return out


def _node(tag: str, attrs: str) -> Node:
    if not attrs or "=" not in attrs:
        return Node(tag, tag, tag in FURNITURE or bool(attrs) and "hidden" in attrs.lower().split())
    got = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTR.finditer(attrs)}
    says = f"{got.get('class', '')} {got.get('id', '')}"
    said = names_of(says) if tag not in ("html", "body", "main") else set()
    hidden = "hidden" in ATTR.sub(" ", attrs).lower().split() or "hidden" in got
    dull = tag in FURNITURE or hidden or got.get("role", "") in FURNITURE_ROLES or not COMMENT_NAMES.isdisjoint(said)
    return Node(tag, ".".join([tag, *dict.fromkeys(NAME.findall(says))]), dull, not FURNITURE_NAMES.isdisjoint(said))


def parse(html: str) -> Node:
    """Tree of the block elements, as deep as it is; inline tags vanish unless named as furniture, references are decoded."""
    root = Node("#root", "#root")
    stack, opened, at, size, link = [root], Counter(), 0, len(html), False

    def cut(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]

    while at < size:
        m = TOKEN.match(html, at)
        at = m.end()
        top = stack[-1]
        if (text := m["text"]) is not None:
            text = unescape(text) if "&" in text else text
            top.children.append(text)
            if link:
                top.linked += len(text)
        elif (tag := m["tag"] or m["odd"]) is not None:
            tag = tag.lower()
            if tag in RAW:
                end = re.compile(rf"</{tag}[\s>/]|</{tag}\Z", re.I).search(html, at)
                at = size if end is None else end.start()
                if end is not None:
                    at = (html.find(">", at) + 1) or size
                top.children.append(" ")
            elif tag in INLINE:
                link = link or tag == "a"
                if m["attrs"] and "=" in m["attrs"] and (node := _node(tag, m["attrs"])).named | node.dull:
                    top.children.append(node)
                    stack.append(node)
                    opened[tag] += 1
            elif tag in VOID:
                if tag in ("br", "hr"):
                    top.children.append(" ")
            else:
                i = len(stack) - 1
                while stack[i].tag in INLINE:
                    i -= 1
                if stack[i].tag in CLOSED_BY_BLOCK:
                    cut(i)
                while tag in SAME_ENDS and stack[-1].tag in SAME_ENDS[tag]:
                    cut(len(stack) - 1)
                node = _node(tag, m["attrs"] or "")
                # A header inside an article is the article's own.
                node.in_article |= stack[-1].in_article
                if tag == "header" and node.in_article:
                    node.dull = False
                stack[-1].children.append(node)
                stack.append(node)
                opened[tag] += 1
                if node.holds_article:
                    for x in reversed(stack[:-1]):
                        if x.holds_article:
                            break
                        x.holds_article = True
        elif (tag := m["end"]) is not None:
            tag = tag.lower()
            link = link and tag != "a"
            if tag in VOID or not opened[tag]:
                if tag not in INLINE and tag not in VOID:
                    top.children.append(" ")
                continue
            i = len(stack) - 1
            while stack[i].tag != tag:
                # An inline end tag closes nothing beyond its block.
                if tag in INLINE and stack[i].tag not in INLINE:
                    i = 0
                    break
                i -= 1
            if i:
                cut(i)
    return root


def squash(text: str) -> str:
    """White space, of any kind, as single spaces, trimmed."""
    return " ".join(text.split())


def is_dull(node: Node) -> bool:
    """Furniture by element, and not a frame around the article."""
    return node.dull and (not node.holds_article or node.tag in ("head", "script", "style", "footer", "aside"))


def is_furniture(node: Node) -> bool:
    """Furniture by element or by name, and not a frame around the article."""
    return is_dull(node) or node.named and not node.holds_article


def leaf_texts(node: Node, skip=is_furniture) -> list[str]:
    """Texts of the node and below, in page order, without what ``skip`` says."""
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not skip(x):
            edge = "" if x.tag in INLINE else " "
            out.append(edge)
            todo.append(edge)
            todo.extend(reversed(x.children))
    return out


def text_of(node: Node, skip=is_furniture) -> str:
    return squash("".join(leaf_texts(node, skip)))


def _linked(node: Node) -> int:
    n, todo = 0, [node]
    while todo:
        x = todo.pop()
        n += x.linked
        todo.extend(c for c in x.children if isinstance(c, Node))
    return n


def _mark(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def step(place: str, key: str) -> str:
    """Name of a child's place in the tree: that of its parent and its key."""
    return _mark(f"{place}/{key}")


class Aligner:
    """Simple tree matching of two trees: the largest mapping that keeps order and ancestry.  No recursion, so any depth."""

    def __init__(self) -> None:
        self.memo: dict[tuple[int, int], float] = {}

    def weight(self, a: Node | str, b: Node | str) -> float:
        if isinstance(a, str) or isinstance(b, str):
            return (1.0 if a == b else 0.5) if isinstance(a, str) and isinstance(b, str) else 0.0
        if a.key != b.key:
            return 0.0
        if (id(a), id(b)) not in self.memo:
            # Pairs below come after their parents in this list, so its reverse has all that a table needs.
            order, seen = [(a, b)], {(id(a), id(b))}
            for x, y in order:
                right = defaultdict(list)
                for d in y.children:
                    if not isinstance(d, str):
                        right[d.key].append(d)
                for c in x.children:
                    for d in () if isinstance(c, str) else right[c.key]:
                        k = (id(c), id(d))
                        if k not in seen and k not in self.memo:
                            seen.add(k)
                            order.append((c, d))
            for x, y in reversed(order):
                self.memo[(id(x), id(y))] = 1 + self.table(x, y)[-1][-1]
        return self.memo[(id(a), id(b))]

    def table(self, a: Node, b: Node) -> list[list[float]]:
        rows = [[0.0] * (len(b.children) + 1)]
        for x in a.children:
            last, row = rows[-1], [0.0]
            for j, y in enumerate(b.children):
                row.append(max(last[j + 1], row[j], last[j] + self.weight(x, y)))
            rows.append(row)
        return rows

    def pairs(self, a: Node, b: Node) -> Iterator[tuple[Node | str, Node | str]]:
        """Matched children of two matched nodes."""
        self.weight(a, b)
        t = self.table(a, b)
        i, j, found = len(a.children), len(b.children), []
        while i and j:
            w = self.weight(a.children[i - 1], b.children[j - 1])
            if w and t[i][j] == t[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                found.append((a.children[i], b.children[j]))
            elif t[i][j] == t[i - 1][j]:
                i -= 1
            else:
                j -= 1
        yield from reversed(found)


def tidy(node: Node) -> None:
    """Texts of the tree squashed, empty ones dropped."""
    todo = [node]
    while todo:
        x = todo.pop()
        x.children = [c for c in ((squash(c) if isinstance(c, str) else c) for c in x.children) if c != ""]
        todo.extend(c for c in x.children if isinstance(c, Node))


class Flow(str):
    """Text blocks and loose text in a row, without a container between: one leaf, however many blocks it has."""

    blocks: tuple[str, ...] = ()
    linked: int = 0
    heading: bool = False


def _flow(blocks: list[tuple[str, int, bool]]) -> Flow:
    out = Flow("\n".join(t for t, _, _ in blocks))
    out.blocks, out.linked, out.heading = tuple(t for t, _, _ in blocks), sum(n for _, n, _ in blocks), any(h for _, _, h in blocks)
    return out


def is_block(c: Node | str) -> bool:
    """Text, or an element that is read as a text."""
    return isinstance(c, str) or c.tag in TEXT_BLOCKS or c.tag in INLINE


def summary(root: Node) -> Node:
    """Tree of the containers that aren't dull, with flows as leaves: as large as the layout, not as the text."""
    out = Node(root.tag, root.key)
    out.of = (root,)
    todo = [out]
    while todo:
        node = todo.pop()
        kids = [c for src in node.of for c in src.children if isinstance(c, str) or not is_dull(c)]
        if sum(not is_block(c) for c in kids) > WIDE:
            kinds = defaultdict(list)
            for c in kids:
                kinds["" if is_block(c) else c.key].append(c)
            runs = list(kinds.values())
        else:
            runs = []
            for c in kids:
                if runs and is_block(c) and is_block(runs[-1][-1]):
                    runs[-1].append(c)
                else:
                    runs.append([c])
        loose = sum(src.linked for src in node.of)
        for run in runs:
            if not is_block(run[0]):
                child = Node(run[0].tag, run[0].key)
                child.of = tuple(run)
                node.children.append(child)
                todo.append(child)
                continue
            got, part = [], ""
            for c in [*run, None]:
                if isinstance(c, str) or c is not None and c.tag in INLINE:
                    part += c if isinstance(c, str) else "".join(leaf_texts(c, is_dull))
                    continue
                if part := squash(part):
                    got.append((part, min(loose, len(part)), False))
                    loose -= min(loose, len(part))
                part = ""
                if c is not None and (text := text_of(c, is_dull)):
                    got.append((text, _linked(c), c.tag in HEADINGS))
            if got:
                node.children.append(_flow(got))
    return out


class Places:
    """What the aligned pages show at every place (container path)."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}
        self.below: dict[str, set[str]] = defaultdict(set)
        self.tag: dict[str, str] = {"": "#root"}
        #: Characters that vary, that are there, that are in links; places with headings.
        self.vary, self.size, self.linked, self.heading = Counter(), Counter(), Counter(), set()
        #: How often a container, or a block on its own, was equal in both pages of a pair.
        self.equal, self.blocks = Counter(), Counter()

    def name(self, place: str, node: Node) -> str:
        to = step(place, node.key)
        if to not in self.parent:
            self.parent[to], self.tag[to] = place, node.tag
            self.below[place].add(to)
        return to

    def read(self, tree: Node) -> None:
        """Sizes of one page."""
        todo = [(tree, "")]
        while todo:
            node, place = todo.pop()
            for c in node.children:
                if isinstance(c, str):
                    self.size[place] += len(c)
                    self.linked[place] += c.linked
                    if c.heading:
                        self.heading.add(place)
                else:
                    todo.append((c, self.name(place, c)))

    def lone(self, c: Node | str, place: str) -> None:
        """A node that the other page doesn't have varies as a whole."""
        todo = [(c, place)]
        while todo:
            x, at = todo.pop()
            if isinstance(x, str):
                self.vary[at] += len(x)
            else:
                to = self.name(at, x)
                todo += [(k, to) for k in x.children]

    def compare(self, a: Node, b: Node) -> None:
        """Align two pages and count what varies and what stays."""
        align, todo, seen = Aligner(), [(a, b, "", -1)], []
        while todo:
            x, y, place, up = todo.pop()
            me = len(seen)
            kids = list(align.pairs(x, y))
            same = len(kids) == len(x.children) == len(y.children)
            for c, d in kids:
                if isinstance(c, str):
                    left, right = Counter(c.blocks), Counter(d.blocks)
                    for t in left & right:
                        self.blocks[place, t] += 1
                    self.vary[place] += sum(len(t) * n for t, n in ((left - right) + (right - left)).items())
                    same &= c == d
                else:
                    todo.append((c, d, self.name(place, c), me))
            met = {id(c) for c, _ in kids} | {id(d) for _, d in kids}
            for c in (*x.children, *y.children):
                if id(c) not in met:
                    self.lone(c, place)
            seen.append([x, place, up, same])
        # Parents come before their children.
        for x, place, up, same in reversed(seen):
            if not same and up >= 0:
                seen[up][3] = False
        for x, place, _, same in seen:
            if same and place and len(x.of) == 1:
                self.equal[place, _mark(text_of(x.of[0], is_dull))] += 1

    def total(self, count: Counter) -> Counter:
        """Sums over each place and all below it."""
        order = [""]
        for p in order:
            order.extend(sorted(self.below[p]))
        out = Counter(count)
        for p in reversed(order):
            if p:
                out[self.parent[p]] += out[p]
        return out

    def upward(self, place: str) -> list[str]:
        """The places above, from the root down."""
        out = []
        while place:
            place = self.parent[place]
            out.append(place)
        return out[::-1]


def induce(pages: list[str]) -> dict:
    """Template of pages of one layout, or an empty one if they don't tell.

    ``core``: places of the article; ``way``: the places above it, each with marks
    of the blocks that stay; ``also``: places beside the way that belong to it;
    ``known``: those that don't; ``fixed``: containers that stay, as place and mark.
    """
    trees = [t for t in (summary(parse(p)) for p in pages) if t.children]
    if len(trees) < 2:
        return {}
    seen, pairs = Places(), len(trees) - 1
    for t in trees:
        seen.read(t)
    for t in trees[1:]:
        seen.compare(trees[0], t)
    vary, size, linked = seen.total(seen.vary), seen.total(seen.size), seen.total(seen.linked)
    if not vary[""]:
        return {}
    linky = lambda p: 2 * linked[p] > size[p]
    marked = _landmarks(seen, size)
    if marked:
        core, also = marked, []
        way = {p: None for c in core for p in seen.upward(c)}
    else:
        at, names = "", []
        while kids := [k for k in sorted(seen.below[at]) if vary[k] and not linky(k)]:
            best = max(kids, key=lambda k: vary[k])
            if 2 * vary[best] <= seen.vary[at] + sum(vary[k] for k in kids):
                break
            names.append(at)
            at = best
        # Both pages of a pair count, so the first page counts in every pair.
        if vary[at] < EVIDENCE * 2 * pairs / len(trees) * size[""]:
            return {}
        core = [at]
        way = {p: sorted(_mark(t) for (q, t), n in seen.blocks.items() if q == p and n == pairs and pairs > 1) for p in names}
        aside = [k for p in names for k in seen.below[p] if k not in way and k != at]
        parts = seen.total(Counter(dict.fromkeys(seen.heading, 1)))
        also = [k for k in aside if vary[k] and not linky(k) and (vary[k] >= BESIDE * vary[at] or parts[k])]
    fixed = defaultdict(list)
    for (p, mark), n in seen.equal.items():
        if n == pairs and pairs > 1 and p not in way and p not in core:
            fixed[p].append(mark)
    known = sorted(k for p in way for k in seen.below[p] if k not in way and k not in core and k not in also)
    return {"core": sorted(core), "way": way, "also": sorted(also), "known": known, "fixed": dict(sorted(fixed.items()))}


def _landmarks(seen: Places, size: Counter) -> list[str]:
    """The outermost places of articles with text; else those of main."""
    for tag in ("article", "main"):
        found = [p for p, t in seen.tag.items() if t == tag and size[p]]
        if found:
            return [p for p in found if not any(seen.tag[q] == tag for q in seen.upward(p))]
    return []


def extract(html: str, template: dict | None = None) -> str:
    """Main text of a page: the slots of its template, else article, main or body."""
    root = parse(html)
    if template:
        if text := _by_template(root, template):
            return text
    return squash(" ".join(text_of(n) for n in _named(root)))


def _by_template(root: Node, template: dict) -> str:
    """Text of the article's slots in page order; empty if the page has none of them."""
    core, also, way, known, fixed = set(template["core"]), set(template["also"]), template["way"], set(template["known"]), template["fixed"]
    out: list[str] = []
    # What is read of a node: all below the article's places, only blocks that vary on the way to them.
    todo: list[tuple[Node | str, str, bool]] = [(root, "", "" in core)]
    met = "" in core
    while todo:
        x, place, inside = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        edge = "" if x.tag in INLINE else " "
        out.append(edge)
        steps: list[tuple[Node | str, str, bool]] = []
        stays = None if inside else way.get(place)
        loose: list[str] = []

        def flush() -> None:
            if stays is not None and (t := squash("".join(loose))) and _mark(t) not in stays:  # noqa: B023
                steps.append((f" {t} ", "", True))  # noqa: B023
            loose.clear()  # noqa: B023

        for c in x.children:
            if inside:
                if isinstance(c, str):
                    steps.append((c, "", True))
                elif not is_dull(c):
                    to = step(place, c.key) if place is not None and not is_block(c) else None
                    if to is None or to not in fixed or _mark(text_of(c, is_dull)) not in fixed[to]:
                        steps.append((c, to, True))
                continue
            if isinstance(c, str) or c.tag in INLINE:
                if isinstance(c, str) or not is_dull(c):
                    loose.append(c if isinstance(c, str) else "".join(leaf_texts(c, is_dull)))
                continue
            flush()
            if is_dull(c):
                continue
            if c.tag in TEXT_BLOCKS:
                if stays is not None and _mark(text_of(c, is_dull)) not in stays:
                    steps.append((c, None, True))
                continue
            to = step(place, c.key)
            if to in core or to in also:
                met |= to in core
                if to not in fixed or _mark(text_of(c, is_dull)) not in fixed[to]:
                    steps.append((c, to, True))
            elif to in way:
                steps.append((c, to, False))
            elif stays is not None and to not in known and not is_furniture(c):
                # A container that no aligned page has: its names decide.
                steps.append((f" {text_of(c)} ", "", True))
        flush()
        todo.append((edge, "", True))
        todo.extend(reversed(steps))
    return squash("".join(out)) if met else ""


def _named(root: Node) -> list[Node]:
    """The outermost articles that aren't furniture; else main; else the whole."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if x.tag == tag and not is_furniture(x):
                found.append(x)
            elif not is_furniture(x):
                todo.extend(c for c in reversed(x.children) if isinstance(c, Node))
        if any(text_of(x) for x in found):
            return found
    return [root]


def layout(html: Column) -> Column:
    """A page's layout: a hash of the kinds of its containers (tag and classes, digits left out)."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*+>.*?</\1", " ")
    tags = F.regexp_extract_all(F.lower(bare), F.lit(rf"<((?:{CONTAINERS.replace(' ', '|')})\b[^>]*+)"), F.lit(1))
    # Text blocks and inline elements come and go with the text; containers make the layout.
    kind = lambda t: F.concat_ws(".", F.regexp_extract(t, r"^\w+", 0), F.regexp_replace(F.regexp_extract(t, r"\bclass\s*=\s*[\"']?([^\"'>]*)", 1), r"[^a-z]+", "."))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(tags, kind))))


def templates(pages: DataFrame, k: int = PAGES) -> DataFrame:
    """host, layout and template (JSON) of every layout with two pages or more; layout null: the host's own, over all its layouts.

    ``pages`` has host, layout, html, page_id and url.  Every layout of a host has
    a template of its own, so none is left out however many there are.  Of each,
    the page of least seeded hash in each of ``k`` hash slots is aligned;
    map-side minima leave at most ``k`` pages to a task, however many there are.
    """
    h = F.xxhash64("page_id", "url", F.lit(31))
    rows = pages.where("host <> ''").select("host", F.explode(F.array("layout", F.lit(None).cast("long"))).alias("layout"), F.pmod(h, F.lit(k)).alias("slot"), h.alias("h"), "html")
    some = rows.groupBy("host", "layout", "slot").agg(F.min_by("html", "h").alias("html"))

    def learn(table: pa.Table) -> pa.Table:
        made = induce([x for x in table.sort_by("slot").column("html").to_pylist() if x])
        keep = [json.dumps(made)] if made else []
        first = [[table.column(c)[0].as_py()] * len(keep) for c in ("host", "layout")]
        return pa.table([pa.array(first[0], pa.string()), pa.array(first[1], pa.int64()), pa.array(keep, pa.string())], names=["host", "layout", "template"])

    return some.groupBy("host", "layout").applyInArrow(learn, "host string, layout long, template string")


def main_text(pages: DataFrame, ws: Workspace) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    ``text`` is the article with references decoded, white space inside a block
    as one space, blocks joined by one space.  A page is read by the template of
    its host and layout, else by that of its host, else by element names.  A null
    or empty html gives an empty text; a null url has no host and so no template.
    Very long and very deep pages are read whole.  Repeated rows get equal texts;
    a null page_id stays null; an empty table gives an empty result; further
    columns are ignored.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), web.host(F.col("url")).alias("host"))
    rows = rows.withColumn("layout", layout(F.col("html")))
    known = ws.save(templates(rows), "templates")
    own = known.where("layout is not null")
    general = known.where("layout is null").select("host", F.col("template").alias("general"))
    rows = rows.join(own, ["host", "layout"], "left").join(general, "host", "left").select("page_id", "url", "html", F.coalesce("template", "general").alias("template"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict] = {}
        for b in batches:
            texts = []
            for html, template in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                if template is not None and template not in seen:
                    if len(seen) > 1000:
                        seen.clear()
                    seen[template] = json.loads(template)
                texts.append(extract(html.as_py(), seen.get(template) if template is not None else None))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
