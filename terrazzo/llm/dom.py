"""A small, forgiving HTML reader: blocks and runs of text, without external libraries.

Block elements, and inline ones that carry a class, id or role, become nodes; contiguous inline
content of a node is one text run. Unknown, unclosed and stray tags are tolerated; scripts,
styles, comments and the head leave no text, nor does what a browser shows only in place of media
or frames. Formulas and drawings keep their words. Character references are decoded once, and not
in <xmp>. Reading takes time in proportion to the page, whatever its tags.
"""

from __future__ import annotations

import html as entities
import re

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title desc metadata annotation annotation-xml select noembed noframes canvas audio video xmp".split())
SILENT = frozenset("script style noscript template desc metadata annotation annotation-xml".split())
FORMULA = frozenset("math semantics mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mspace".split())
DRAWING = frozenset("svg g text tspan textpath switch foreignobject symbol use defs path rect circle ellipse line polyline polygon marker".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | FORMULA | DRAWING
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
BARRIER = frozenset("ul ol dl table div article section main body html td th aside nav footer header form blockquote".split())
LISTS = ("ul", "ol", "dl", "table", "select")

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>""")
#: Without regard to quotes: for what comes after a quote that never ends.
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/>]|$))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "text", "link_chars", "inline", "hidden")

    def __init__(self, tag: str, parent: "Node | None", tokens=frozenset(), inline: bool = False, hidden: bool = False):
        self.tag, self.parent, self.tokens, self.inline, self.hidden = tag, parent, tokens, inline, hidden
        self.children: list[Node] = []
        self.text, self.link_chars = "", 0
        if parent is not None:
            parent.children.append(self)


def _attributes(source: str) -> tuple[frozenset, bool]:
    tokens, hidden = set(), False
    for name, value in _ATTR.findall(source):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name in ("class", "id", "role", "itemprop"):
            tokens.update(_TOKEN.findall(_CAMEL.sub(" ", value).lower()))
    return frozenset(tokens), hidden


class _Opened:
    """The open elements, and for each tag (and for barriers) where they stand among them."""

    def __init__(self):
        self.elements: list[tuple[str, Node | None]] = []  # (tag, node or None if transparent)
        self.places: dict[str, list[int]] = {}

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a tag; -1 if none is open."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def push(self, tag: str, node: "Node | None") -> None:
        for name in (tag, "#barrier") if tag in BARRIER else (tag,):
            self.places.setdefault(name, []).append(len(self.elements))
        self.elements.append((tag, node))

    def pop(self) -> tuple[str, "Node | None"]:
        tag, node = self.elements.pop()
        for name in (tag, "#barrier") if tag in BARRIER else (tag,):
            self.places[name].pop()
        return tag, node


def parse(page: str) -> Node:
    """The tree of a page; text runs are nodes with the tag #text."""
    root = Node("#root", None)
    stack: list[Node] = [root]
    opened = _Opened()
    parts: list[str] = []
    link_chars = links = 0
    low = None
    tag_at = _TAG

    def flush():
        nonlocal link_chars
        if parts:
            text = "".join(parts)
            if text.strip():
                run = Node("#text", stack[-1])
                run.text, run.link_chars = text, link_chars
                run.inline = True
            else:
                Node("#space", stack[-1])
            parts.clear()
        link_chars = 0

    def add(text: str, decode: bool = True):
        nonlocal link_chars
        if text:
            text = entities.unescape(text) if decode and "&" in text else text
            parts.append(text)
            if links:
                link_chars += len(text.strip())

    def pop_to(at: int):
        nonlocal links
        while len(opened.elements) > at:
            tag, node = opened.pop()
            if tag == "a":
                links -= 1
            if node is not None:
                flush()
                stack.pop()

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        match = tag_at.match(page, lt)
        if not match:
            if lt + 1 < size and (page[lt + 1].isalpha() or page[lt + 1] == "/"):
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
                if page[lt + 1].isalpha():
                    tag_at = _BARE_TAG  # a quote runs to the end of the page
            else:
                add("<")
                at = lt + 1
            continue
        at = match.end()
        closing, tag, source = match.group(1), match.group(2).lower(), match.group(3)
        if closing:
            place = opened.last(tag)
            if place >= 0 and not (tag in INLINE and opened.last("#barrier") > place):
                pop_to(place)
            elif place < 0 and tag in ("p", "br"):
                parts.append(" ")
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
            continue
        if tag in RAW:
            low = page.lower() if low is None else low
            if len(low) != size:  # lower-casing changed the length: search slowly but rightly
                end = re.compile(f"</{tag}", re.I).search(page, at)
                end = end.start() if end else -1
            else:
                end = low.find(f"</{tag}", at)
            inside = page[at : size if end < 0 else end]
            if end < 0:
                at = size
            else:
                end = page.find(">", end)
                at = size if end < 0 else end + 1
            if tag not in SILENT:
                parts.append(" ")
                if tag == "xmp":
                    add(inside, decode=False)
                    parts.append(" ")
            continue
        if tag in CLOSES_P and opened.last("p") > opened.last("#barrier"):
            pop_to(opened.last("p"))
        place = max((opened.last(t) for t in SAME_CLOSES.get(tag, ())), default=-1)
        if place > max(opened.last(t) for t in LISTS):
            pop_to(place)
        if source.endswith("/") and tag not in INLINE and tag not in CLOSES_P or tag in DRAWING and source.endswith("/"):
            continue
        tokens, hidden = _attributes(source) if source else (frozenset(), False)
        inline = tag in INLINE
        if inline and not tokens and not hidden or tag in FORMULA or tag in DRAWING:
            opened.push(tag, None)
        else:
            flush()
            node = Node(tag, stack[-1], tokens, inline, hidden)
            stack.append(node)
            opened.push(tag, node)
        if tag == "a":
            links += 1
    pop_to(0)
    flush()
    return root


def walk(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo += reversed(node.children)
    return found


def render(root: Node, kept) -> str:
    """Text of the kept runs: one space at block borders and for white space, none at inline ones."""
    parts: list[str] = []
    todo: list[Node | None] = [root]
    while todo:
        node = todo.pop()
        if node is None:
            parts.append(" ")
        elif node.tag == "#text":
            if kept(node):
                parts.append(node.text)
        else:
            if not node.inline:
                parts.append(" ")
                todo.append(None)
            todo += reversed(node.children)
    return " ".join("".join(parts).split())
