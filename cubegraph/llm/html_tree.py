"""Pages as trees of block elements: a tolerant reader, runs of like siblings folded, and simple tree matching.

Only elements that make blocks are nodes; inline elements belong to the text around them. A tree is written
as ``label(child child)``, so equal layouts are equal strings.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Elements by what they do to a page's text.
BLOCKS = frozenset(
    "html body head header footer nav aside main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr "
    "blockquote pre figure figcaption form fieldset legend details summary address hr dialog menu search center hgroup "
    "select option optgroup button label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("noscript template svg math object canvas audio video".split())
CLOSES_PARAGRAPH = BLOCKS - frozenset("html head body select option optgroup button label li dt dd tr thead tbody tfoot caption".split())
#: Element -> the open ones it ends, unless one of the stops lies between.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset("table thead tbody tfoot".split())),
    "thead": (frozenset("thead tbody tfoot".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset("select optgroup".split())),
}
BOUNDARIES = frozenset("table td th caption button object template html".split())

# How pages name what is not their article.
NOISE = frozenset(
    "ad ads advert banner sponsor sponsored promo promotion nav menu sidebar aside footer masthead breadcrumb breadcrumbs cookie cookies consent "
    "gdpr notice alert popup modal overlay comment comments reply replies respond disqus social share sharing related recommended newsletter "
    "subscribe subscription signup login search pagination pager toolbar copyright widget complementary contentinfo dialog navigation".split()
)
NOISE_STEMS = ("advert", "adsense", "sponsor", "cookie", "navbar", "navig", "sidebar", "breadcrumb", "comment", "newsletter", "pagination", "subscri")
NEGATIONS = frozenset("has with no not without is show hide".split())
CONTENT_NAMES = frozenset(["articlebody"])
#: Elements that never hold an article's text, whatever their names.
NOISE_ELEMENTS = frozenset("head nav aside footer form fieldset dialog menu button select option optgroup label legend search".split())

MARKUP = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+>?|/(?![a-zA-Z])[^>]*+>?"
    r"|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}
SPACE = re.compile(r"\s+")
#: Elements nested deeper than this are read as part of the element around them.
DEEPEST = 200


@dataclass(eq=False)
class Node:
    label: str
    children: list[Node] = field(default_factory=list)
    merged: Node | None = None
    number: int = -1

    def known(self) -> Node:
        node = self
        while node.merged is not None:
            node = node.merged
        return node


@dataclass
class Block:
    """A stretch of text inside one block element, its white space made single; ``linked`` of its characters are in links."""

    node: Node
    text: str
    linked: int


@dataclass
class Page:
    root: Node
    blocks: list[Block]


def label_of(name: str, rest: str) -> str:
    """The element, its names that stand for noise or content (marked by ! and +), and else its first class."""
    if "=" not in rest:
        return name
    marks, first = {}, ""
    for m in ATTRIBUTE.finditer(rest):
        value = m[2] or m[3] or m[4] or ""
        for token in re.sub(r"([a-z])([A-Z])", r"\1 \2" if m[1].lower() != "itemprop" else r"\1\2", value).lower().split():
            words = re.findall("[a-z]+", token)
            if not words or words[0] in NEGATIONS:
                continue
            if "".join(words) in CONTENT_NAMES:
                marks["+" + "".join(words)] = True
            elif name not in ("html", "body", "main"):
                # Articles carry states such as comments-open; only a whole name says what they are.
                told = words if name != "article" else words[:1] if len(words) == 1 else []
                marks.update(("!" + w, True) for w in told if w in NOISE or w.startswith(NOISE_STEMS))
            if m[1].lower() == "class" and not first:
                first = "".join(words)
    return ".".join([name, *(marks or ([first] if first else []))])


def is_noise(path: list[str]) -> bool:
    """Whether a path of labels from the page's root leads to something other than the article."""
    inside = False
    for label in path:
        name, *words = label.split(".")
        if name in NOISE_ELEMENTS or any(w[0] == "!" for w in words) or (name == "header" and not inside):
            return True
        inside = inside or is_article(label)
    return False


def is_article(label: str) -> bool:
    name, *words = label.split(".")
    return name in ("article", "main") or any(w[0] == "+" for w in words)


class Reader:
    """Reads a page: blocks of text in order, each at its node."""

    def __init__(self):
        self.root = Node("#page")
        self.open: list[tuple[str, Node | None]] = [("#page", self.root)]
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.links = self.silent = self.linked = 0

    def at(self) -> Node:
        return next(node for _, node in reversed(self.open) if node is not None)

    def flush(self) -> None:
        if self.text:
            text = SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.blocks.append(Block(self.at(), text, min(self.linked, len(text))))
            self.text, self.linked = [], 0

    def add(self, data: str) -> None:
        if data and not self.silent:
            data = html.unescape(data) if "&" in data else data
            self.text.append(data)
            if self.links:
                self.linked += len(SPACE.sub(" ", data).strip(" "))

    def pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            name, node = self.open[-1]
            if name in BLOCKS:
                self.flush()
            self.open.pop()
            self.links -= name == "a"
            self.silent -= name in SILENT
            if node is not None:
                fold(node)

    def close_open(self, names: frozenset[str], stops: frozenset[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.open[depth][0]
            if name in names:
                self.pop_to(depth)
                return
            if name in stops or name in BOUNDARIES:
                return

    def start(self, name: str, rest: str) -> None:
        if name in CLOSES_PARAGRAPH:
            self.close_open(frozenset(["p"]), frozenset())
        if name in ENDS:
            self.close_open(*ENDS[name])
        if name == "a":
            self.close_open(frozenset(["a"]), BLOCKS)
        if name in ("br", "td", "th", "wbr"):
            self.add("" if name == "wbr" else " ")
        if name in VOID:
            if name == "hr":
                self.flush()
            return
        node = None
        if name in BLOCKS:
            self.flush()
        if len(self.open) >= DEEPEST:
            return
        if name in BLOCKS:
            node = Node(label_of(name, rest))
            self.at().children.append(node)
        self.open.append((name, node))
        self.links += name == "a"
        self.silent += name in SILENT

    def end(self, name: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == name:
                self.pop_to(depth)
                return
            if name not in BLOCKS and self.open[depth][1] is not None:
                return

    def read(self, page: str) -> Page:
        at = 0
        while True:
            m = MARKUP.search(page, at)
            if m is None:
                self.add(page[at:])
                break
            self.add(page[at : m.start()])
            at = m.end()
            if m["name"] is None:
                continue
            name = m["name"].lower()
            if m["end"]:
                if name == "br":
                    self.add(" ")
                else:
                    self.end(name)
                continue
            if name in RAW:  # no markup inside, and no text of the page's
                close = RAW_ENDS[name].search(page, at)
                at = close.end() if close else len(page)
                continue
            self.start(name, m["rest"])
        self.pop_to(1)
        self.flush()
        fold(self.root)
        return Page(self.root, self.blocks)


def read_page(page: str) -> Page:
    return Reader().read(page)


# ---------------------------------------------------------------- folding and matching


def fold(node: Node, widest: int = 4) -> None:
    """Merge a group of up to ``widest`` children into an equal group right before it, again and again.

    Lists and paragraphs become one child however long they are; what the repeats lack or add is united.
    """
    kept: list[Node] = []
    for child in node.children:
        kept.append(child)
        again = True
        while again:
            again = False
            for k in range(1, min(widest, len(kept) // 2) + 1):
                last, before = kept[-k:], kept[-2 * k : -k]
                if all(a.label == b.label for a, b in zip(before, last)):
                    for a, b in zip(before, last):
                        unite(a, b)
                    del kept[-k:]
                    again = True
                    break
    node.children = kept


def unite(into: Node, other: Node) -> None:
    """Align two nodes of one label by simple tree matching and merge ``other`` into ``into``; unmatched children are inserted."""
    other.merged = into
    if not other.children:
        return
    if not into.children:
        into.children = other.children
        return
    pairs, children, at = matched(into.children, other.children), [], 0
    place = {j: i for i, j in pairs}
    for j, child in enumerate(other.children):
        if j in place:
            children += into.children[at : place[j] + 1]
            at = place[j] + 1
            unite(into.children[place[j]], child)
        else:
            children.append(child)
    into.children = children + into.children[at:]
    fold(into)


def matched(left: list[Node], right: list[Node]) -> list[tuple[int, int]]:
    """The children that simple tree matching pairs: in order, of equal labels, with the most matched nodes below."""
    if [n.label for n in left] == [n.label for n in right]:
        return [(i, i) for i in range(len(left))]
    weight = [[match_size(a, b) for b in right] for a in left]
    best = best_table(weight)
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def best_table(weight: list[list[int]]) -> list[list[int]]:
    width = len(weight[0])
    best = [[0] * (width + 1)]
    for row in weight:
        above, line = best[-1], [0]
        for j, w in enumerate(row):
            line.append(max(above[j + 1], line[j], above[j] + w))
        best.append(line)
    return best


def match_size(a: Node, b: Node) -> int:
    """Nodes that simple tree matching pairs in two trees; 0 where the roots differ."""
    if a.label != b.label:
        return 0
    if not a.children or not b.children:
        return 1
    return 1 + best_table([[match_size(x, y) for y in b.children] for x in a.children])[-1][-1]


def written(root: Node) -> str:
    """The tree as text; numbers its nodes in that order."""
    out, count = [], 0

    def visit(node: Node) -> None:
        nonlocal count
        node.number = count
        count += 1
        out.append(node.label)
        if node.children:
            out.append("(")
            for k, child in enumerate(node.children):
                if k:
                    out.append(" ")
                visit(child)
            out.append(")")

    visit(root)
    return "".join(out)


def parsed(layout: str) -> Node:
    """The tree that ``written`` wrote."""
    stack: list[Node] = [Node("")]
    for token in re.findall(r"[()]|[^() ]+", layout):
        if token == "(":
            stack.append(stack[-1].children[-1])
        elif token == ")":
            stack.pop()
        else:
            stack[-1].children.append(Node(token))
    return stack[0].children[0]


def nodes_of(root: Node) -> list[Node]:
    """All nodes in the order of their numbers."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.children)
    return out


def aligned(layout: Node, wrapper: Node) -> list[int]:
    """For every node of a layout the number of the wrapper's node it matches, -1 for none."""
    written(wrapper)
    out = []

    def visit(node: Node, other: Node | None) -> None:
        out.append(other.number if other is not None else -1)
        partner = {}
        if other is not None and other.children and node.children:
            partner = {i: other.children[j] for i, j in matched(node.children, other.children)}
        for i, child in enumerate(node.children):
            visit(child, partner.get(i))

    visit(layout, wrapper if layout.label == wrapper.label else None)
    return out
