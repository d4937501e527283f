"""A tree of an HTML page and a subset of CSS selectors.  Plain Python, no Spark.

The tree repairs nothing: an end tag closes the nearest open element of its name and
everything inside, one without such an element is ignored, nothing closes implicitly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.name, self.attrs, self.parent = name, attrs or {}, parent
        self.children: list[Node | str] = []

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def elements(self) -> Iterator[Node]:
        """Elements below, in page order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def strings(self) -> Iterator[str]:
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    stack.append(iter(child.children))
                    break
                if not isinstance(child, Raw):
                    yield child
            else:
                stack.pop()

    def text(self, separator: str = "", strip: bool = False) -> str:
        parts = (s.strip() for s in self.strings()) if strip else self.strings()
        return separator.join(p for p in parts if p) if strip else separator.join(parts)

    def raw_text(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def parents(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def append(self, child: Node | str) -> None:
        if isinstance(child, Node):
            child.remove()
            child.parent = self
        self.children.append(child)

    def find(self, *names: str, **attrs) -> Node | None:
        return next((e for e in self.elements() if (not names or e.name in names) and _has(e, attrs)), None)

    def find_all(self, *names: str, **attrs) -> list[Node]:
        return [e for e in self.elements() if (not names or e.name in names) and _has(e, attrs)]

    def select(self, selector: str) -> list[Node]:
        chains = compiled(selector)
        return [e for e in self.elements() if any(_matches(e, chain) for chain in chains)]


class Raw(str):
    """Text of a script, a style or a comment: no part of the page's text."""


class Document(Node):
    def __init__(self):
        super().__init__("[document]")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Document()
        self.open: list[Node] = [self.root]

    def handle_starttag(self, tag, attrs):
        held: dict[str, str] = {}
        for k, v in attrs:
            held[k] = v or ""
        node = Node(tag, held, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        at = self.open[-1]
        at.children.append(Raw(data) if at.name in ("script", "style", "template") else data)


def parse(html: str | None) -> Document:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _has(e: Node, attrs: dict) -> bool:
    for k, v in attrs.items():
        have = e.attrs.get(k.rstrip("_").replace("_", "-"))
        if have is None or (v is not True and have != v):
            return False
    return True


_SIMPLE = re.compile(r"""(?P<tag>^[a-zA-Z*][\w-]*|^\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*(?P<ci>i)?\s*)?\]""")
_cache: dict[str, list] = {}


def compiled(selector: str) -> list[list[list[tuple]]]:
    """Comma list of descendant chains of compound selectors; other syntax is an error."""
    if selector not in _cache:
        _cache[selector] = [[_compound(c, selector) for c in _split(part)] for part in re.split(r",(?![^\[]*\])", selector)]
    return _cache[selector]


def _split(part: str) -> list[str]:
    found = re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", part.strip())
    if not found:
        raise ValueError(f"empty selector in {part!r}")
    return found


def _compound(text: str, whole: str) -> list[tuple]:
    tests, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text[at:] if at == 0 else text, 0 if at == 0 else at)
        if not m or m.end() == m.start():
            raise ValueError(f"unsupported selector {whole!r}")
        g = m.groupdict()
        if g["tag"]:
            if g["tag"] != "*":
                tests.append(("tag", g["tag"].lower()))
        elif g["cls"]:
            tests.append(("class", g["cls"]))
        elif g["id"]:
            tests.append(("id", g["id"]))
        else:
            value = next((g[k] for k in ("dq", "sq", "bare") if g[k] is not None), None)
            tests.append(("attr", g["attr"].lower(), g["op"], value, bool(g["ci"])))
        at = m.end()
    return tests


def _test(e: Node, test: tuple) -> bool:
    kind = test[0]
    if kind == "tag":
        return e.name == test[1]
    if kind == "class":
        return test[1] in e.classes
    if kind == "id":
        return e.attrs.get("id") == test[1]
    _, name, op, value, ci = test
    have = e.attrs.get(name)
    if have is None or op is None:
        return have is not None
    if ci:
        have, value = have.lower(), value.lower()
    if op == "=":
        return have == value
    if op == "~=":
        return value in have.split()
    if op == "|=":
        return have == value or have.startswith(value + "-")
    return bool(value) and {"*=": value in have, "^=": have.startswith(value), "$=": have.endswith(value)}[op]


def _matches(e: Node, chain: list[list[tuple]]) -> bool:
    if not all(_test(e, t) for t in chain[-1]):
        return False
    rest = chain[:-1]
    for parent in e.parents():
        if not rest:
            return True
        if all(_test(parent, t) for t in rest[-1]):
            rest = rest[:-1]
    return not rest


def markup(node: Node | str) -> str:
    """HTML of a node."""
    if isinstance(node, Raw):
        return str(node)
    if isinstance(node, str):
        return node.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    inner = "".join(map(markup, node.children))
    if isinstance(node, Document):
        return inner
    attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in node.attrs.items())
    return f"<{node.name}{attrs}/>" if node.name in VOID else f"<{node.name}{attrs}>{inner}</{node.name}>"
