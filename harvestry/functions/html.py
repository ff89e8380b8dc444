"""A small HTML tree with selectors and text, on the standard library's parser.

Selectors: tag, .class, #id, [name] and [name=value] parts, joined to one another; descendants by blanks, children by >,
alternatives by commas. Anything else is refused with ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

#: Fixed by HTML: elements without content, and elements that begin a block of text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
#: Parts of a page that are not its own content.
SIDE = frozenset("script style noscript template nav footer iframe svg".split())

_PART = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<name>[\w-]+)(?:=[\"']?(?P<value>[^\"'\]]*)[\"']?)?\]")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, skip: frozenset[str] = frozenset(("script", "style"))) -> str:
        """The text inside, blocks set apart by a blank; white space collapsed."""
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in skip:
                if x.tag in BLOCKS:
                    out.append(" ")
                    todo.append(" ")
                todo.extend(reversed(x.children))
        return " ".join("".join(out).split())

    def select(self, selector: str) -> list[Node]:
        """Matching nodes below this one, in document order."""
        ways = [compiled(s) for s in selector.split(",")]
        return [n for n in self.walk() if n is not self and any(matches(n, w, self) for w in ways)]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("li", "p", "tr", "td", "option") and self.at.tag == tag:  # their end tags may be left out
            self.at = self.at.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def compiled(selector: str) -> list[tuple[str, list[dict[str, str | None]]]]:
    """(relation to the step before, conditions) from the last step to the first."""
    steps, relation = [], " "
    for word in selector.replace(">", " > ").split():
        if word == ">":
            relation = ">"
            continue
        parts = list(_PART.finditer(word))
        if not parts or "".join(m[0] for m in parts) != word:
            raise ValueError(f"selector {selector!r}")
        steps.append((relation, [m.groupdict() for m in parts]))
        relation = " "
    if not steps or relation == ">":
        raise ValueError(f"selector {selector!r}")
    return steps[::-1]


def fits(node: Node, conditions: list[dict[str, str | None]]) -> bool:
    for c in conditions:
        if c["tag"] and c["tag"] not in ("*", node.tag):
            return False
        if c["cls"] and c["cls"] not in node.attrs.get("class", "").split():
            return False
        if c["id"] and c["id"] != node.attrs.get("id"):
            return False
        if c["name"] and (c["name"] not in node.attrs or c["value"] not in (None, node.attrs[c["name"]])):
            return False
    return True


def matches(node: Node, steps: list[tuple[str, list]], top: Node) -> bool:
    relation, conditions = steps[0]
    if not fits(node, conditions):
        return False
    if len(steps) == 1:
        return True
    above = node.parent
    while above and above is not top.parent:
        if matches(above, steps[1:], top):
            return True
        if relation == ">":
            return False
        above = above.parent
    return False


#: Attributes that a page's skeleton keeps, longest skeleton, and siblings of one kind that stay of a long run.
KEPT_ATTRIBUTES, SKELETON, STAY, RUN = ("class", "id", "href", "datetime"), 45_000, 8, 10
#: Elements that hold nothing to read.
SILENT = SIDE | frozenset("link meta img picture source video form".split())


def aside(node: Node) -> bool:
    """Menus, footers and banners that every page has."""
    return node.tag in SIDE or node.attrs.get("role") == "navigation" or "cookie" in f"{node.attrs.get('id', '')} {node.attrs.get('class', '')}".lower()


def body_of(page: str | Node) -> Node:
    """The body of a page, or of its tree; all of it where it has none."""
    root = parse(page) if isinstance(page, str) else page
    return next((n for n in root.walk() if n.tag == "body"), root)


def skeleton(page: str | Node, most: int = SKELETON) -> str:
    """A page's markup for a reader of structure: own content, few attributes, of a run of more than RUN like siblings the
    first STAY and how many more there were; cut at `most` letters."""
    out: list[str] = []

    def show(node: Node) -> None:
        kinds: dict[tuple[str, str], int] = {}
        inner = [c for c in node.children if isinstance(c, str) or not (c.tag in SILENT or aside(c))]
        kind = lambda c: (c.tag, c.attrs.get("class", ""))
        for c in inner:
            if isinstance(c, Node):
                kinds[kind(c)] = kinds.get(kind(c), 0) + 1
        shown: dict[tuple[str, str], int] = {}
        for c in inner:
            if isinstance(c, str):
                out.append(" ".join(c.split()) if c.strip() else " " * bool(c))
                continue
            many, at = kinds[kind(c)], shown.setdefault(kind(c), 0)
            shown[kind(c)] += 1
            if many > RUN and at >= STAY:
                if at == STAY:
                    out.append(f"<p>[{many - STAY} more]</p>")
                continue
            begin = len(out)
            out.append(f"<{c.tag}" + "".join(f' {k}="{c.attrs[k]}"' for k in KEPT_ATTRIBUTES if k in c.attrs) + ">")
            show(c)
            if c.tag in ("div", "span") and not "".join(out[begin + 1 :]).strip():
                del out[begin:]  # an empty box
            elif c.tag not in VOID:
                out.append(f"</{c.tag}>")

    show(body_of(page))
    return " ".join("".join(out).split())[:most]


def own_text(page: str | Node, most: int = 6000) -> str:
    """A page's visible text without menus, footers and banners; of at most `most` letters."""
    parts: list[str] = []
    todo: list[Node | str] = [body_of(page)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not aside(x):
            parts.append(" " if x.tag in BLOCKS else "")
            todo.extend(([" "] if x.tag in BLOCKS else []) + x.children[::-1])
    return " ".join("".join(parts).split())[:most]


def shortened(html: str) -> tuple[str, str]:
    """skeleton() and own_text() of a page that is read once."""
    body = body_of(html)
    return skeleton(body), own_text(body)
