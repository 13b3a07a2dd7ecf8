"""HTML extraction by tree scoring.

Each page is parsed into an element tree; every paragraph-like block earns points for its length and commas, discounted by
the share of it that is links, and passes them to its ancestors: all to the parent, less to each further one up to LEVELS. An
element that declares itself the page's text (article, main) gets the points of all its blocks. A container's points are
discounted by its link density. The best container and those of its siblings that look like text are kept. Inside them,
menus go: lists and blocks that hold several links and little else. Furniture that names itself by its element, or by a
class, id or role, is left out of the tree. A paragraph, heading or cell is furniture only if a whole class says so.

The parse and the scores take time in proportion to the page, however deep it nests: open elements are found by name, and the
blocks of an element are a range, whose text and links are differences of running sums.

Cases: null html gives an empty text; a page without a scoring block gives the blocks of its article, main or body, in
that order of preference; of equal scores the outer element of the two wins, else the first; an unclosed comment, tag or
raw-text element runs to the end of the page; repeated pages give repeated rows; columns of pages that are named like a
result give way to it; an empty table gives no rows. Memory is bounded by one Arrow batch and the tree of one page.
"""

from __future__ import annotations

import html as html_lib
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import and_fields, text_batches

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
# Element names of HTML and words that mark page furniture in class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript template".split())
DROPPED = frozenset("nav header footer aside form button select option dialog menu head svg object canvas audio video".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "caption"}
FURNITURE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot bottombar sidebar aside rail ad ads adv advert adverts"
    " advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices notification"
    " alert popup modal overlay newsletter subscribe subscription signup signin login share sharing sharebar social related recommended recommendations"
    " comment comments commentlist disqus respond replies form search searchbox pagination pager toolbar widget widgets skip copyright legal disclaimer"
    " paywall outbrain taboola complementary contentinfo hidden".split()
)
KEEPERS = frozenset("html body article main".split())
DECLARED = frozenset("article main".split())
PARAGRAPHS = frozenset("p pre td li blockquote dd div section article main body".split())
#: Elements that carry text themselves: one word of many in a class says little about them.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption summary span b i em strong a code abbr cite q sub sup small".split())
#: Words that name a subject as often as furniture, where they mark such an element.
SUBJECTS = frozenset("legal notice notices alert form search comment disclaimer hidden skip foot rail".split())
SPLIT_NAME = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
#: A sibling of the best container is kept from this share of the best score on.
SIBLING_SHARE = 0.2
#: How many ancestors a block passes points to.
LEVELS = 5
#: What can be a menu, and the links and share of linked text that make it one.
MENUS = frozenset("ul ol dl table p div section".split())
MENU_LINKS, MENU_SHARE = 3, 0.8


class Node:
    __slots__ = ("tag", "parent", "depth", "score", "dropped", "first", "last")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, first: int):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.depth = parent.depth + 1 if parent else 0
        self.score = 0.0
        self.first = self.last = first  # its blocks are first to last - 1


def is_furniture(tag: str, attrs: str) -> bool:
    if tag in DROPPED:
        return True
    if not attrs or tag in KEEPERS:
        return False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and not m[0].rstrip().endswith(("false", '"false"')):
            return True
        if name == "aria-hidden":
            if value.lower() == "true":
                return True
        elif name != "hidden":
            for named in value.split():
                words = [w.lower() for w in SPLIT_NAME.split(named) if w]
                if tag in TEXTUAL:
                    if words and all(w in FURNITURE for w in words) and not (len(words) == 1 and words[0] in SUBJECTS):
                        return True
                elif any(w in FURNITURE for w in words):
                    return True
    return False


class Block:
    __slots__ = ("node", "text", "linked", "links")

    def __init__(self, node: Node, text: str, linked: int, links: int):
        self.node, self.text, self.linked, self.links = node, text, linked, links


class Tree:
    """The elements of a page and its text blocks, both in document order."""

    def __init__(self, page: str):
        self.root = Node("#root", None, False, 0)
        self.nodes, self.blocks = [self.root], []
        self.stack: list[Node] = [self.root]
        self.open: dict[str, list[int]] = {}  # by tag, the places in the stack
        self.borders: list[int] = [0]  # places of block elements
        self.parts: list[str] = []
        self.links = self.link_chars = self.link_count = 0
        self.parse(page)
        self.close_block()
        self.close_to(0)
        self.root.last = len(self.blocks)

    def close_block(self) -> None:
        if self.parts:
            text = " ".join(html_lib.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append(Block(self.stack[self.borders[-1]], text, min(self.link_chars, len(text)), self.link_count))
            self.parts.clear()
        self.link_chars, self.link_count = 0, int(self.links > 0)

    def close_to(self, place: int) -> None:
        """Close the elements above a place of the stack."""
        while len(self.stack) > place + 1:
            node = self.stack.pop()
            node.last = len(self.blocks)
            self.open[node.tag].pop()
            if self.borders[-1] == len(self.stack):
                self.borders.pop()

    def last_open(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def begin(self, tag: str, attrs: str) -> None:
        here = self.stack[-1]
        node = Node(tag, here, here.dropped or is_furniture(tag, attrs), len(self.blocks))
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.borders.append(len(self.stack))
        self.stack.append(node)
        self.nodes.append(node)

    def parse(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            m = TOKEN.search(page, at)
            stop = m.start() if m else end
            if stop > at and not self.stack[-1].dropped:
                self.parts.append(page[at:stop])
                if self.links:
                    self.link_chars += stop - at
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.end(tag)
            elif tag in RAW:
                e = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = e.end() if e else end
            else:
                self.start(tag, m[3] or m[6] or "")

    def end(self, tag: str) -> None:
        if tag == "a" and self.links:
            self.links -= 1
        place = self.last_open((tag,))
        if tag not in BLOCKS and place < self.borders[-1]:
            return  # a stray inline end tag never closes a block
        if place:
            if tag in BLOCKS:
                self.close_block()
            self.close_to(place - 1)
        elif tag in BLOCKS:
            self.close_block()

    def start(self, tag: str, attrs: str) -> None:
        if tag in BLOCKS:
            self.close_block()
            if tag in CLOSES_P or tag in ("li", "dd", "dt", "td", "th", "tr"):
                own = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(tag, ())
                limit = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",)}.get(tag, ("table",))
                place = self.last_open((*own, "p"))
                if own and place > self.last_open(limit) or not own and place and place == self.borders[-1]:
                    self.close_to(place - 1)
        if tag in VOID:
            if tag in ("br", "wbr", "img", "hr") and not self.stack[-1].dropped and self.parts:
                self.parts.append(" ")
            return
        if tag == "a":
            self.links += 1
            self.link_count += 1
        self.begin(tag, attrs)


def points_of(b: Block) -> float:
    if b.node.tag not in PARAGRAPHS or len(b.text) < 25:
        return 0.0
    return (1 + b.text.count(",") + b.text.count("、") + min(len(b.text) / 100, 3)) * (1 - b.linked / len(b.text))


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    tree = Tree(page)
    blocks = tree.blocks
    if not blocks:
        return ""
    points = [points_of(b) for b in blocks]
    running = lambda values: list(accumulate(values, initial=0))
    texts, linked, links, earned = running(len(b.text) for b in blocks), running(b.linked for b in blocks), running(b.links for b in blocks), running(points)
    of = lambda sums, n: sums[n.last] - sums[n.first]
    density = lambda n: of(linked, n) / max(of(texts, n), 1)
    for b, p in zip(blocks, points, strict=True):
        if p:
            if b.node.tag in ("div", "section", "body"):  # text that stands in a container itself
                b.node.score += p
            up = b.node.parent
            for level in range(1, LEVELS + 1):
                if not up:
                    break
                up.score += p / (1 if level == 1 else 2 if level == 2 else level * 3)
                up = up.parent
    seen = [n for n in tree.nodes if n.last > n.first]
    for n in seen:
        if n.tag in DECLARED:
            n.score = of(earned, n)
    value = lambda n: n.score * (1 - density(n))
    groups = [n for n in seen if n.tag in BLOCKS and n.tag not in ("p", "html", "li") and n.score > 0]
    if groups:
        best = max(groups, key=lambda n: (value(n), n.tag in DECLARED, -n.depth))
        # The element that declares itself the text, if the best container is a part of it that scores near to it.
        up = best.parent
        while up and best.tag not in DECLARED:
            if up.tag in DECLARED and value(up) >= value(best) / 2:
                best = up
            up = up.parent
    else:
        named = [n for t in ("article", "main", "body") for n in seen if n.tag == t]
        best = named[0] if named else max(seen, key=lambda n: of(texts, n))
    kept = [(best.first, best.last)]
    top = value(best)
    if best.parent and best.tag not in ("body", "html"):
        for n in seen:
            if n is best or n.parent is not best.parent:
                continue
            if n.tag == "p" and (of(texts, n) > 80 and density(n) < 0.25 or density(n) == 0 and re.search(r"\.( |$)", blocks[n.first].text)):
                kept.append((n.first, n.last))
            elif n.tag in ("h1", "h2", "h3") and n.last <= best.first and density(n) == 0:
                kept.append((n.first, n.last))
            elif n.tag in ("div", "section", "article", "td", "blockquote", "pre") and value(n) >= max(10, top * SIBLING_SHARE):
                kept.append((n.first, n.last))
    keep = [False] * len(blocks)
    for a, z in kept:
        keep[a:z] = [True] * (z - a)
    # Menus inside: several links and little else, in one list, table or block.
    for n in seen:
        if n is not best and n.tag in MENUS and of(links, n) >= MENU_LINKS and density(n) >= MENU_SHARE:
            keep[n.first : n.last] = [False] * (n.last - n.first)
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_main_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages with the main text of its column html added as into, and its length in code points as n_chars.

    A narrow map: no shuffle. Columns of these names are replaced.
    """
    keep = [c for c in pages.columns if c not in (html, into, "n_chars")]
    given = pages.select(*keep, html)
    text_batches(pages.sparkSession)
    schema = and_fields(given.select(*keep).schema, f"{into} string, n_chars long")

    def run(batches):
        for b in batches:
            texts = [extract(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, into, "n_chars"])

    return given.mapInArrow(run, schema)
