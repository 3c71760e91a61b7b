"""Main text of web pages by composite text density.

A page becomes a tree. For every node, C is the number of characters below it, T of tags, LC of characters and LT of
tags within links; b stands for the body. Composite density weighs characters a tag by how little of them is linked:

    C / T * log(C * T / (LC * LT)) / log(log(C * LC / (C - LC) + LC_b * C / C_b + e))

with zeros counted as one, and both logarithms at least one (else nodes of a few characters weigh most). A node's density sum is the sum of its children's densities. The threshold is the least
density on the path from the body down to the node of the largest density sum; within nodes that reach it, the one
with the largest density sum is marked as content, as in Sun, Song and Liao, "DOM based content extraction via text
density" (2011). Its text, block by block, is the page's.

Elements that never hold an article (scripts, styles, forms, menus, asides, footers, articles within an article, which are its
comments, and containers whose class, id, role or heading names an advert, a notice, a side bar or comments) are cut before the
densities are taken, whatever their size. A header is cut unless an article or the page's main heading stands in it, and so is what only a
name speaks against unless it holds the main heading, the main element or all articles. Names that are also words of articles
(menu, side, reply) only keep a container out of the densities: its text stays if it lies within the content and is not mostly links. Inline
elements and paragraphs are never cut by name. A list of three or more entries with a by-line each (a short link, a time or a
cite before their text) is a discussion or a list of teasers, if it stands after the main heading and outside of articles, and prose is left besides it. Cuts by name are undone
only if no text at all is left.

If the page's main heading has prose beside it, the content lies in the smallest element that holds both. If the content node lies in an article, it is widened
to that, as headings and short paragraphs are sparse but belong to it; if it is a text block (a paragraph whose words are all
in bold is denser within than its container), to the container around it. It is never narrowed.

Edge cases: null, empty and blank html gives an empty text, as does a page without text; an unclosed or misnested tag is
closed where its parent is; markup without a body counts as one; null and repeated ids keep their rows; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.arrow import bound_batches

# An attribute's value is quoted, or ends at white space or the tag's end; so does one whose quote is never closed.
# All repetitions are possessive: a tag is read once from left to right.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_ATTRIBUTE = rf"=?[^\s/>=]++(?:\s*+=\s*+{_VALUE})?+"
BEGIN = re.compile(r"<(?=[A-Za-z!?]|/[A-Za-z])")
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE}|=)*+)>", re.S)
ATTRIBUTE = re.compile(rf"(?:(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+({_VALUE}))?+(?=[\s/]|\Z))|{_ATTRIBUTE}", re.I)
# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math canvas object select".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUND = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
CONTAINERS = frozenset("article main section div td body html".split())
CUT = frozenset("nav footer aside button menu dialog head".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMED_TAGS = frozenset("div section article ul ol dl li table td center details figure fieldset header hgroup".split())
_WORD = r"(?:^|[\s_-])(?<!\bno-)(?<!\bhas-)(?<!\bwith-)(?:{})(?:$|[\s_-])"
CUT_NAMES = re.compile(
    _WORD.format(
        r"ad|ads|advert\w*|adbox|banner|promo\w*|sponsor\w*|nav|navbar|navigation|breadcrumbs?|sidebar|widget\w*|footer|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|"
        r"comments?|commentlist|disqus|respond|replies|responses|discussions?|guestbook|share|sharing|social|related(?:-(?:posts|articles|stories|links))?|recommend\w*|more-like|pagination|pager|toolbar|masthead|topbar|skip"
    ),
    re.I,
)
WEAK_NAMES = re.compile(_WORD.format("menu|side|foot|reply"), re.I)
HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
ENTRIES = ({"div"}, {"li"}, {"section"}, {"article"})
COMMENT_HEADING = re.compile(r"(?i)\s*+(?:\d++\s++)?(?:(?:reader|user|leave a|post a|add a)\s++)?(?:comments?|responses|replies|discussion|kommentare?|commentaires?|comentarios?)(?:\s*+\(?\d*+\)?)\s*+:?\s*+")
BYLINE = 40  # characters of a link or a time that opens an entry
PROSE = 80  # unlinked characters of a text block
OPENING = 50  # nodes in which a heading or a by-line ends
SPACE = re.compile(r"\s+")


class Node:
    """An element: its tag, its children (nodes and strings in page order), and counts over all that is below it."""

    __slots__ = ("tag", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "cut", "named", "weak")

    def __init__(self, tag: str, cut: bool = False, named: bool = False, weak: bool = False):
        self.tag, self.cut, self.named, self.weak, self.children = tag, cut, named, weak, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _attributes(text: str) -> Iterator[tuple[str, str]]:
    """Names and values of the attributes that matter here."""
    for m in ATTRIBUTE.finditer(text):
        if m[1]:
            yield m[1].lower(), (m[2] or "").strip("\"'")


def _is_cut(tag: str, attributes: str) -> bool:
    """Whether an element never holds an article."""
    if tag in CUT:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _attributes(attributes):
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in CUT_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _names(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether the class or id of a container names what is cut, or it is a form; and whether it has a name that may be one."""
    if tag == "form":
        return True, False
    if not attributes or tag not in NAMED_TAGS:
        return False, False
    values = [value for name, value in _attributes(attributes) if name in ("class", "id")]
    return any(CUT_NAMES.search(v) for v in values), any(WEAK_NAMES.search(v) for v in values)


class _Open:
    """The open elements, outermost first, and for each tag where its open elements stand among them."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def _nearest(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, wanted: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        """Close the nearest open element of ``wanted``, and all in it, if no element of ``bounds`` stands before."""
        at = self._nearest(wanted)
        if at and at >= self._nearest(bounds):
            while len(self.stack) > at:
                self.places[self.stack.pop().tag].pop()


def parse(page: str) -> Node:
    """The tree of a page, in time that grows with its length; a tag that never ends is text, with all after it."""
    root = Node("html")
    opened, at = _Open(root), 0
    last_end: dict[str, int] = {}  # of raw elements: where the last end tag of the page stands
    while True:
        begin = BEGIN.search(page, at)
        m = TAG.match(page, begin.start()) if begin else None
        text = page[at : m.start() if m else len(page)]
        if text:
            opened.stack[-1].children.append(text)
        if not m:
            return root
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                opened.stack[-1].children.append(Node("br"))
            elif tag not in ("html", "body"):
                opened.close((tag,), ("article", "main", "section", "table", "body") if tag in ("p", "li", "b", "i", "em", "strong", "a", "span", "font") else ("body",))
            continue
        if tag in RAW:
            if tag not in last_end:
                last_end[tag] = max((e.start() for e in re.finditer(rf"(?i)</{tag}\s*>", page)), default=-1)
            if last_end[tag] >= at:
                at = re.compile(rf"(?i)</{tag}\s*>").search(page, at).end()
            elif tag in ("script", "style"):
                at = len(page)
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P:
            opened.close(("p",), ("td", "th", "article", "main", "section", "div", "li", "blockquote", "body", "table", "nav", "footer", "header", "aside", "form", "button"))
        if tag in SAME:
            opened.close(SAME[tag], BOUND[tag])
        if tag == "body":
            opened.close(("head",), ())
        node = Node(tag, _is_cut(tag, m[3]), *_names(tag, m[3]))
        opened.stack[-1].children.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            opened.push(node)


def _below(node: Node) -> list[Node]:
    """The node and all elements below it, parents first; without recursion, as pages may nest deeply."""
    queue, found = [node], []
    while queue:
        n = queue.pop()
        found.append(n)
        queue.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return found


def _opening(node: Node) -> str:
    """The text below a node, as it is written, if it takes at most ``OPENING`` nodes; else nothing."""
    queue, out, seen = [node], [], 0
    while queue:
        n, seen = queue.pop(), seen + 1
        if seen > OPENING:
            return ""
        if isinstance(n, str):
            out.append(n)
        else:
            queue.extend(reversed(n.children[:OPENING]))
    return "".join(out)


def _mark(order: list[Node]) -> None:
    """Name what markup shows to be comments: containers that open with such a heading, and articles within an article."""
    within: set[int] = set()
    for n in order:
        if n.tag in NAMED_TAGS:
            first = next((c for c in n.children if isinstance(c, Node) or c.strip()), None)
            if isinstance(first, Node) and first.tag in HEADINGS and COMMENT_HEADING.fullmatch(entities.unescape(_opening(first))):
                n.named = True
        inside = id(n) in within
        if inside and n.tag == "article":
            n.named = True
        if inside or n.tag == "article":
            within.update(id(c) for c in n.children if isinstance(c, Node))


def _prune(root: Node) -> None:
    """Take what is marked out of the tree; a header goes unless it holds an article or the main heading, and what is
    only named so unless it holds the main heading, the main element or all articles."""
    for n in _below(root):
        n.children = [c for c in n.children if not (isinstance(c, Node) and c.cut)]
    order = _below(root)
    _mark(order)
    heading = next((n for n in order if n.tag == "h1"), None)
    size: dict[int, tuple[int, int, int]] = {}  # articles without such a name, main elements and main headings below
    for n in reversed(order):
        own = [size[id(c)] for c in n.children if isinstance(c, Node)]
        articles, mains, heads = (sum(x) for x in zip(*own)) if own else (0, 0, 0)
        size[id(n)] = articles + (n.tag == "article" and not n.named), mains + (n.tag == "main"), heads + (n is heading)
    whole = size[id(root)]
    # An article that its name speaks against is the story if there is no other one.
    sole = [n for n in order if n.tag == "article"]
    if len(sole) == 1:
        sole[0].named = False

    def kept(n: Node) -> bool:
        articles, mains, heads = size[id(n)]
        return bool(heads or mains or articles and articles == whole[0])

    for n in order:
        n.weak = n.weak and not kept(n)
        n.children = [c for c in n.children if not (isinstance(c, Node) and ((c.named and not kept(c)) or c.tag == "header" and not size[id(c)][0] and not size[id(c)][2]))]


def _has_byline(entry: Node) -> bool:
    """Whether an entry opens with a short link, time or cite."""
    queue, chars, seen = [entry], 0, 0
    while queue and seen < OPENING:
        n, seen = queue.pop(), seen + 1
        if isinstance(n, str):
            chars += len(n.strip())
            if chars > BYLINE:
                return False
        elif n.tag in ("h1", "h2", "h3") or n.tag == "p" and chars:
            return False
        elif n.tag in ("a", "time", "cite"):
            return 0 < len(_opening(n).strip()) <= BYLINE
        else:
            queue.extend(reversed(n.children[:OPENING]))
    return False


def _own_text(n: Node) -> int:
    """Characters of a block's own text and of its inline children's, links left out."""
    pieces = [c for c in n.children if isinstance(c, str)]
    for c in n.children:
        if isinstance(c, Node) and c.tag not in BLOCK and c.tag != "a":
            pieces += [x for x in c.children if isinstance(x, str)]
    return len("".join("".join(pieces).split()))


def _lists(root: Node) -> None:
    """Take out lists of entries with by-lines after the main heading, outside of articles, where prose is left besides them."""
    order = _below(root)
    paragraphs: dict[int, bool] = {}
    for n in reversed(order):
        paragraphs[id(n)] = n.tag == "p" or any(paragraphs[id(c)] for c in n.children if isinstance(c, Node))
    begun, prose, gone, inside = False, False, set(), set()
    for n in order:
        begun = begun or n.tag == "h1"
        kids = [c for c in n.children if isinstance(c, Node)]
        if id(n) in inside or n.tag in ("article", "main"):
            inside.update(map(id, kids))
        entries = [c for c in kids if c.tag not in HEADINGS]
        if id(n) not in inside and begun and n.tag in NAMED_TAGS and len(entries) >= 3 and {c.tag for c in entries} in ENTRIES and all(paragraphs[id(c)] and _has_byline(c) for c in entries):
            gone.add(id(n))
        if id(n) in gone:
            gone.update(map(id, kids))
        elif n.tag in BLOCK and not prose:
            prose = _own_text(n) >= PROSE
    if prose:
        for n in order:
            n.children = [c for c in n.children if not (isinstance(c, Node) and id(c) in gone)]


def _measure(root: Node) -> list[Node]:
    """Counts and densities of all nodes; returns them parents first. What may be no content does not count above itself."""
    order = _below(root)
    for n in reversed(order):
        for c in n.children:
            if isinstance(c, str):
                n.chars += len("".join(c.split()))
            elif not c.weak:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags + (c.tag == "a")
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags
    return order


def _density(n: Node, body: Node) -> float:
    c, t, linked = n.chars, n.tags or 1, n.link_chars
    if not c:
        return 0.0
    weight = c / max(1, c - linked) * linked + body.link_chars / max(1, body.chars) * c + math.e
    return c / t * math.log(max(math.e, c / max(1, linked) * t / max(1, n.link_tags))) / max(1.0, math.log(math.log(weight)))


def _around_heading(order: list[Node], parent: dict[int, Node], body: Node) -> Node:
    """The smallest element that holds the main heading and prose beside it, else the body."""
    at = heading = next((n for n in order if n.tag == "h1"), body)
    while at is not body and id(at) in parent:
        at = parent[id(at)]
        if at.chars - at.link_chars - heading.chars >= PROSE and at.tag not in ("header", "hgroup"):
            return at
    return body


def content_node(root: Node) -> Node:
    """The subtree of the largest density sum among the nodes that reach the threshold, widened to the outermost
    article, else main element, else nearest container below the body, that holds it."""
    order = _measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    parent: dict[int, Node] = {}
    hidden: set[int] = set()
    for n in order:
        n.density = _density(n, body)
        for c in n.children:
            if isinstance(c, Node):
                parent[id(c)] = n
                if c.weak or id(n) in hidden:
                    hidden.add(id(c))
    for n in order:
        n.total = sum(c.density for c in n.children if isinstance(c, Node) and not c.weak)
        if any(isinstance(c, str) and c.strip() for c in n.children) and not n.total:
            n.total = n.density
    inside = [n for n in _below(_around_heading(order, parent, body)) if id(n) not in hidden]
    best = max(inside, key=lambda n: n.total)
    least, at = best.density, best
    while at is not body and id(at) in parent:
        at = parent[id(at)]
        least = min(least, at.density)
    chosen = at = max((n for n in inside if n.density >= least), key=lambda n: n.total)
    around, box = {}, None
    while at is not None:
        around[at.tag] = at
        if box is None and at.tag in CONTAINERS:
            box = at
        at = parent.get(id(at))
    return around.get("article") or around.get("main") or (chosen if box is None or box in (body, root) else box)


def text_of(node: Node) -> str:
    """The text below a node: blocks joined by one space, white space within them as one space."""
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        joined = SPACE.sub(" ", entities.unescape("".join(run))).strip()
        if joined:
            blocks.append(joined)
        run.clear()

    queue: list = [node]
    while queue:
        x = queue.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.weak and x is not node and 2 * x.link_chars > x.chars:
            continue
        else:
            block = x.tag in BLOCK
            if block:
                end()
                queue.append(None)
            queue.extend(reversed(x.children))
    end()
    return " ".join(blocks)


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page or not page.strip():
        return ""
    root = parse(page)
    _prune(root)
    _lists(root)
    text = text_of(content_node(root))
    if not text:  # nothing but what names speak against
        root = parse(page)
        for n in _below(root):
            n.named = n.weak = False
            n.children = [c for c in n.children if not (isinstance(c, Node) and c.cut)]
        text = text_of(content_node(root))
    return text


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    columns = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return columns.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
