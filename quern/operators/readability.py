"""The readable part of a page by its paragraphs (PRJ-06): the second way to the main content, where no selector fits.

Each paragraph gives points by its length and commas to its parent, and half of them to
its grandparent; an element's points weigh less by the share of its text that is links,
and names of classes and ids speak for or against it.  The winner takes in siblings that
score a fifth of its points or read like prose.  A pick counts if it has ``LEAST`` words
of which half are still in the page without its boilerplate.
"""

from __future__ import annotations

import re

from quern.operators.dom import Document, Node

LEAST, KEPT = 80, 0.5
BLOCKS = ("p", "pre", "td", "blockquote")
UNREAD = ("script", "style", "noscript", "template", "iframe", "svg", "form", "head")
_FOR = re.compile(r"article|body|content|entry|main|page|post|text|blog|story", re.I)
_AGAINST = re.compile(r"combx|comment|com-|contact|foot|footer|footnote|masthead|media|meta|outbrain|promo|related|scroll|shoutbox|sidebar|sponsor|shopping|tags|tool|widget|nav|menu|cookie|consent|banner", re.I)


def link_share(node: Node) -> float:
    said = len(" ".join(node.text(" ").split()))
    linked = sum(len(" ".join(a.text(" ").split())) for a in node.find_all("a"))
    return linked / said if said else 0.0


def _bias(node: Node) -> float:
    named = f"{node.get('class') or ''} {node.get('id') or ''}"
    own = {"article": 25.0, "main": 25.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "form": -3.0, "ul": -3.0, "ol": -3.0, "nav": -25.0, "aside": -25.0, "footer": -25.0, "header": -10.0}.get(node.name, 0.0)
    return own + 25.0 * bool(_FOR.search(named)) - 25.0 * bool(_AGAINST.search(named))


def points(doc: Document) -> dict[int, tuple[float, Node]]:
    """Points of the elements that hold paragraphs."""
    out: dict[int, list] = {}
    for block in doc.find_all(*BLOCKS):
        said = " ".join(block.text(" ").split())
        if len(said) < 25:
            continue
        worth = 1.0 + said.count(",") + min(len(said) // 100, 3)
        for share, node in zip((1.0, 0.5), block.parents(), strict=False):
            if node.name != "[document]":
                out.setdefault(id(node), [_bias(node), node])[0] += share * worth
    return {k: (p * (1 - link_share(n)), n) for k, (p, n) in out.items()}


def _joins(node: Node, score: dict[int, tuple[float, Node]], floor: float) -> bool:
    if score.get(id(node), (0.0, node))[0] >= floor:
        return True
    said = " ".join(node.text(" ").split())
    share = link_share(node)
    return node.name == "p" and ((len(said) > 80 and share < 0.25) or (0 < len(said) <= 80 and share == 0 and bool(re.search(r"\.( |$)", said))))


def pick(raw: Document, cleaned: Document) -> Node | None:
    """The readable part of the raw page, None where it is short or mostly what cleaning removed."""
    for node in raw.find_all(*UNREAD):
        node.remove()
    score = points(raw)
    best, winner = max(score.values(), key=lambda x: x[0], default=(0.0, None))
    if winner is None or best <= 0:
        return None
    kin = [c for c in (winner.parent.children if winner.parent is not None else [winner]) if isinstance(c, Node)]
    floor = max(10.0, 0.2 * best)
    found = Node("div")
    found.children = [c for c in kin if c is winner or _joins(c, score, floor)]
    picked = [w.casefold() for w in found.text(" ").split()]
    left = {w.casefold() for w in cleaned.text(" ").split()}
    return found if len(picked) >= LEAST and sum(w in left for w in picked) >= KEPT * len(picked) else None
