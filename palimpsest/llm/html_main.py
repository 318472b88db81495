"""Main text of web pages by composite text density.

A page becomes a tree of elements in one pass (comments, scripts and the like are skipped, ends that HTML leaves out
are supplied). Elements that are boilerplate by tag are left out with all below them. Suspects are forms, elements that a role, `hidden`, aria-hidden or `display:none` sets apart, and those
with a class or id whose first or last part names boilerplate (comment-list, user-comments, ad-slot; not has-sidebar or no-ads). A suspect goes where it holds no article or main and not the
greatest density sum, so wrappers of the content stay; reader comments, which can be longer than what they comment on, go whatever their sum, and an article that is itself a comment holds nothing.
A notice or advert of the density of content goes like any other. Every other node gets its characters, tags, link characters and link tags, and from them its link-adjusted characters per tag (its density); a node's density sum adds up its children's. Of the containers (elements that hold a block) the
one with the greatest sum is content, the outermost, first of equals; a body without containers is content itself. The threshold is the least density on the way from
there to the body, and in each other subtree that reaches it the container with the greatest sum, or the subtree without containers, is content too.
If the greatest sum lies in an article, that article is content as a whole and alone: short headings and paragraphs stay with it, what lies beside it goes. Without an
article a main element does the same.

Text: character references are decoded, white space within a block becomes one space, blocks are trimmed, empty ones go, and the
rest are joined in page order by one line feed. A null or empty page, and one without text, gives an empty string. Nothing is cut off; malformed pages are
read as far as they make sense. Time and memory are linear in the page, however deep it nests. Repeated rows are answered each, an empty table
gives an empty result, and columns of the input with the names of the output's are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import prepare

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
BOILERPLATE_TAGS = frozenset("head nav footer aside script style noscript template iframe object svg canvas button select textarea input title dialog menu audio video map math".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs pagination masthead topbar toolbar footer comment comments "
    "commentlist disqus replies respond share sharing social related recommended recommendations widget widgets tracking paywall".split()
)
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption"} | {"nav", "footer", "aside", "form"}
#: An element ends an open one of these, unless one of the second group lies between.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset()),
}
HOLDS = frozenset({"article", "main"})
#: Names of reader comments, and names that only say boilerplate where nothing else stands beside them; openings that turn a name round.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
WHOLE_WORDS = frozenset("widget widgets overlay tracking social".split())
TURNING_WORDS = frozenset("no not has with without hide".split())
#: Their ends also end boilerplate that was left open inside.
ENCLOSING = frozenset({"article", "main", "body", "html", "head"})

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TAG_END = re.compile(r"""[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+>""")
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("best", "chars", "children", "density", "link_chars", "link_tags", "parent", "pick", "suspect", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, suspect: int = 0):
        self.tag, self.parent, self.suspect = tag, parent, suspect
        self.children: list[Node] = []
        self.clear()

    def clear(self) -> None:
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = self.best = 0.0
        self.pick: Node | None = None  # of the greatest sum, `best`, among the containers of the subtree


class Stack:
    """The open elements, with the places of each tag and of the blocks among them."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element of one of the tags, or 0."""
        return max([self.places[t][-1] for t in tags if self.places.get(t)], default=0)

    def cut(self, k: int) -> bool:
        """Closes the elements from place k on; True if a block or form was among them."""
        edge = False
        while len(self.nodes) > k:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            edge |= tag in BLOCKS or tag == "form"
        return edge


def _attributes(body: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(body)} if body.strip(" /\n\t") else {}


def is_boilerplate(tag: str, within: bool) -> bool:
    """within: an article or main element is open."""
    return tag in BOILERPLATE_TAGS or tag == "header" and not within


def suspicion(tag: str, attributes: dict[str, str]) -> int:
    """0: none; 1: boilerplate unless it holds the content; 2: reader comments."""
    if tag in ("html", "body") or not attributes:
        return int(tag == "form")
    level = int(tag == "form")
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = _WORD.findall(name)
        if not parts or parts[0] in TURNING_WORDS:
            continue
        ends = {parts[0], parts[-1]}
        if ends & COMMENT_WORDS:
            return 2
        if BOILERPLATE_WORDS.issuperset(parts) or ends & BOILERPLATE_WORDS - WHOLE_WORDS:
            level = 1
    if tag in HOLDS:
        return 0
    if attributes.get("role", "").lower() in BOILERPLATE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return 1
    return 1 if "display:none" in attributes.get("style", "").replace(" ", "").lower() else level


def parse(page: str) -> tuple[Node, list[tuple[Node | None, str]]]:
    """The tree below html, and its text runs in page order with the node of each; a block's edge is (None, "")."""
    root = Node("html", None)
    stack, runs = Stack(root), []
    skip: list[str] = []  # open elements from the outermost boilerplate one on
    lower, at, n, text_from = page.lower(), 0, len(page), 0
    if len(lower) != n:  # some letters have longer lower cases
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in page)

    def text(end: int) -> None:
        if end > text_from and not skip:
            runs.append((stack.nodes[-1], page[text_from:end]))

    def close(k: int) -> None:
        if stack.cut(k):
            runs.append((None, ""))

    while (start := page.find("<", at)) >= 0:
        mark = page[start + 1 : start + 2]
        if mark == "!" or mark == "?":
            text(start)
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            text_from = at
            continue
        closing = mark == "/"
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            at = start + 1
            continue
        text(start)
        whole = _TAG_END.match(page, name.end())
        end = whole.end() if whole else page.find(">", name.end()) + 1 or n
        tag = name[0].lower()
        at = text_from = end
        if closing:
            if skip and tag in skip:
                while skip.pop() != tag:
                    pass
            elif not skip or tag in ENCLOSING:
                skip.clear()
                if k := stack.last((tag,)):
                    close(k)
            continue
        body = page[name.end() : end - 1] if end > name.end() else ""
        if tag in RAW:
            stop = lower.find(f"</{tag}", end)
            at = text_from = n if stop < 0 else (page.find(">", stop) + 1 or n)
            continue
        if tag == "body" and skip[:1] == ["head"]:
            skip.clear()
        if skip:
            if tag not in VOID and not body.endswith("/"):
                if skip[-1] == tag and (tag == "p" or tag in ENDS):
                    skip.pop()
                skip.append(tag)
            continue
        if tag == "html":
            continue
        if tag == "body" and stack.last(("body",)):
            continue
        if tag in CLOSES_P and (k := stack.last(("p",))) and k == stack.blocks[-1]:
            close(k)
        if tag in ENDS:
            ended, walls = ENDS[tag]
            if (k := stack.last(ended)) > stack.last(walls):
                close(k)
        if is_boilerplate(tag, stack.last(HOLDS) > 0):
            runs.append((None, ""))
            if tag not in VOID and not body.endswith("/"):
                skip.append(tag)
            continue
        suspect = suspicion(tag, _attributes(body))
        if tag in BLOCKS or suspect:
            runs.append((None, ""))
        elif tag == "br":
            runs.append((stack.nodes[-1], " "))
        node = Node(tag, stack.nodes[-1], suspect)
        stack.nodes[-1].children.append(node)
        if tag not in VOID and not body.endswith("/"):
            stack.push(node)
    text_from = max(text_from, 0)
    text(n)
    return root, runs


def measure(root: Node, runs: list[tuple[Node | None, str]]) -> tuple[list[Node], Node]:
    """All nodes, parents first, with densities and sums; and the body."""
    nodes = [root]
    for node in nodes:
        nodes.extend(node.children)
    linked: set[int] = set()
    for node in nodes:
        if node.tag == "a" or node.parent is not None and id(node.parent) in linked:
            linked.add(id(node))
    for node, run in runs:
        if node is not None:
            size = len("".join(run.split()))
            node.chars += size
            if id(node) in linked:
                node.link_chars += size
    for node in reversed(nodes):
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.tag == "a")
    body = next((x for x in nodes if x.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
        if c:
            plain = max(1, c - lc)
            base = math.log(c / plain * lc + share * c + math.e)
            ratio = c / max(1, lc) * t / max(1, lt)
            node.density = c / t * (math.log(max(ratio, 1.0)) / math.log(base) if base > 1.0 + 1e-9 else math.log(max(ratio, 1.0)) + 1.0)
        node.sum = sum(x.density for x in node.children)
        inner = max((x for x in node.children if x.pick), key=lambda x: x.best, default=None)
        if inner is not None and (inner.best > node.sum or not is_container(node)):
            node.best, node.pick = inner.best, inner.pick
        elif is_container(node):
            node.best, node.pick = node.sum, node
    return nodes, body


def is_container(node: Node) -> bool:
    """Whether blocks stand in it: a paragraph is content of a container, not one."""
    return any(x.tag in BLOCKS for x in node.children)


def prune(nodes: list[Node], body: Node, level: int) -> bool:
    """Take suspects of this level on without an article or main (of level 1, nor the node of the greatest density sum) off the tree; True if there were any."""
    if not any(x.suspect >= level for x in nodes):
        return False
    holders: set[int] = set()
    greatest = [body, *(x for x in nodes if x.pick and x.best >= body.best)] if level == 1 else []
    for node in [*greatest, *(x for x in nodes if x.tag in HOLDS and x.suspect < 2)]:
        while node is not None and id(node) not in holders:
            holders.add(id(node))
            node = node.parent
    for node in nodes:
        node.children = [x for x in node.children if x.suspect < level or id(x) in holders]
        node.clear()
    return True


def select(body: Node) -> list[Node]:
    """The content nodes."""
    top = body.pick or body
    path = [top]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    for tag in ("article", "main"):
        if holder := next((x for x in reversed(path) if x.tag == tag), None):
            return [holder]
    threshold, way = min(x.density for x in path), {id(x) for x in path}
    marked, seen, todo = [top], {id(top)}, [body]
    while todo:
        node = todo.pop()
        if id(node) in seen:
            continue
        if id(node) not in way and node.chars and node.density >= threshold:
            best = node.pick or node
            if id(best) not in seen:
                seen.add(id(best))
                marked.append(best)
        todo.extend(node.children)
    return marked


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root, runs = parse(page)
    nodes, body = measure(root, runs)
    for level in (2, 1):
        if prune(nodes, body, level):
            nodes, body = measure(root, runs)
    if not body.chars:
        return ""
    chosen = {id(x) for x in select(body)}
    inside: set[int] = set()
    for node in nodes:
        if id(node) in chosen or node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
    blocks: list[str] = []
    parts: list[str] = []
    for node, run in [*runs, (None, "")]:
        if node is None:
            if parts and (block := " ".join(unescape("".join(parts)).split())):
                blocks.append(block)
            parts = []
        elif id(node) in inside:
            parts.append(run)
    return "\n".join(blocks)


def extract_main(pages: DataFrame, key: str = "page_id", html: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the carried columns, text, n_chars: one row a page."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "__text", "__chars"])

    kept = pages.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate((key, *carry))], F.col(html).alias("__html"))
    kinds = ", ".join(f"{c} {t}" for c, t in kept.dtypes[:-1])
    out = kept.mapInArrow(run, f"{kinds}, __text string, __chars long")
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate((key, *carry))], F.col("__text").alias("text"), F.col("__chars").alias("n_chars"))
