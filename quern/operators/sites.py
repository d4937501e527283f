"""Site preprocessors (PRJ-13..16): MkDocs Material, numbered paragraphs, WordPress.  Each is (detects, changes) on a parsed page."""

from __future__ import annotations

import re

from quern.operators.dom import Document, Node

# Marks of MkDocs Material, any one of the first or two of the others.
MKDOCS = ".md-content, .md-main, [data-md-component]"
MKDOCS_PAIR = ["a.headerlink", "div.admonition", "div.tabbed-set", "table.highlighttable"]
# What WordPress pages lose, and where their title may stand.
WORDPRESS_EXTRAS = [
    ".fixed-nav", ".fixed-nav-prev", ".fixed-nav-next", ".post-navigation", ".nav-links", ".post-pager", ".share-simple-wrapper", ".sharedaddy", ".social-share",
    ".related-posts", ".section-post-related", ".yarpp-related", ".rich-reviews", ".feedback-form", "[class*='rating']", "[class*='review-form']",
]
WORDPRESS_TITLES = ["#Subheader h1.title", ".entry-title", ".page-title", "header h1"]
#: Numbered paragraphs further apart than so many siblings belong to different lists.
NEAR = 10


def made(name: str, *content: Node | str, **attrs: str) -> Node:
    node = Node(name, dict(attrs))
    for c in content:
        node.append(c) if isinstance(c, Node) else node.children.append(c)
    return node


def put_in_place(old: Node, new: Node) -> None:
    parent = old.parent
    at = next(k for k, c in enumerate(parent.children) if c is old)
    parent.children[at], new.parent, old.parent = new, parent, None


def is_mkdocs(doc: Document) -> bool:
    return bool(doc.select(MKDOCS)) or sum(bool(doc.select(s)) for s in MKDOCS_PAIR) > 1


def _code_of(table: Node) -> Node | None:
    """A table of numbered lines as a code block in its language."""
    code = next((c for cell in table.find_all("td") if "code" in cell.classes for c in cell.find_all("code")), None)
    if code is None:
        return None
    holder = next((p for p in table.parents() if p.name == "div" and "highlight" in p.classes), None)
    language = next((c for c in (holder.classes if holder else []) if c.startswith("language-")), None)
    return made("pre", made("code", code.text(), **({"class": language} if language else {})))


def _quoted(box: Node) -> Node:
    """An admonition as a quotation behind its title in bold."""
    kind = next((c for c in box.classes if c != "admonition"), "note")
    title = next((p for p in box.find_all("p") if "admonition-title" in p.classes), None)
    name = title.text("", True) if title is not None else kind.capitalize()
    if title is not None:
        title.remove()
    said = [c.text("", True) if isinstance(c, Node) else c.strip() for c in box.children]
    return made("blockquote", made("p", made("strong", f"{name}:"), " " + " ".join(x for x in said if x)))


def _untabbed(tabs: Node) -> Node:
    """Tabs one after another, each under its label."""
    labels = [x for area in tabs.select("div.tabbed-labels label") if (x := area.text("", True))]
    out = made("div")
    for k, block in enumerate(tabs.select("div.tabbed-block")):
        out.append(made("h4", labels[k] if k < len(labels) else f"Tab {k + 1}"))
        for c in list(block.children):
            out.append(c) if isinstance(c, Node) else out.children.append(c)
    return out


def clean_mkdocs(doc: Document) -> None:
    for link in doc.select("a.headerlink"):
        link.remove()
    for selector, change in (("table.highlighttable", _code_of), ("div.admonition", _quoted), ("div.tabbed-set", _untabbed)):
        for node in doc.select(selector):
            new = change(node)
            if new is not None and node.parent is not None:
                put_in_place(node, new)


def is_numbered(doc: Document) -> bool:
    return bool(doc.select("p[data-list-level]"))


def _level(item: Node) -> int:
    said = (item.get("data-list-level") or "").strip()
    return int(said) if re.fullmatch(r"-?\d+", said) else 1


def _groups(items: list[Node]) -> list[list[Node]]:
    """Neighbours among the same parent's elements, ``NEAR`` apart at most."""
    out: list[list[Node]] = []
    for item in items:
        last = out[-1][-1] if out else None
        if last is not None and last.parent is item.parent:
            kin = [c for c in item.parent.children if isinstance(c, Node)]
            place = {id(c): k for k, c in enumerate(kin)}
            if 0 < place[id(item)] - place[id(last)] <= NEAR:
                out[-1].append(item)
                continue
        out.append([item])
    return out


def _nested(items: list[Node]) -> Node:
    """A list of the items, deeper levels inside the item before them.

    An item above the first one's level goes to the outermost list.
    """
    outer = made("ol")
    open_: list[tuple[int, Node]] = [(min(map(_level, items)), outer)]
    for item in items:
        level = _level(item)
        while len(open_) > 1 and open_[-1][0] > level:
            open_.pop()
        if open_[-1][0] < level:
            above = open_[-1][1]
            held = [c for c in above.children if isinstance(c, Node)]
            inner = made("ol")
            (held[-1] if held else above).append(inner)
            open_.append((level, inner))
        entry = made("li")
        for c in list(item.children):
            entry.append(c) if isinstance(c, Node) else entry.children.append(c)
        open_[-1][1].append(entry)
    return outer


def number(doc: Document) -> None:
    """Paragraphs that carry a list level become ordered lists."""
    for group in _groups(doc.select("p[data-list-level]")):
        nested = _nested(group)
        put_in_place(group[0], nested)
        for item in group[1:]:
            item.remove()


def is_wordpress(doc: Document) -> bool:
    classes = (c for n in doc.find_all() for c in n.classes)
    generator = doc.find("meta", name="generator")
    return any(re.match(r"wp-|post-\d+$|hentry$|entry-content$", c) for c in classes) or (generator is not None and "wordpress" in (generator.get("content") or "").lower())


def clean_wordpress(doc: Document) -> None:
    title = next((n[0] for s in WORDPRESS_TITLES if (n := doc.select(s))), None)
    main = doc.find("main") or doc.find("article") or doc.find(id="Content") or next(iter(doc.select(".entry-content")), None)
    if title is not None and main is not None:
        heading = made("h1", title.text("", True))
        heading.parent = main
        main.children.insert(0, heading)
    for node in doc.select(", ".join(WORDPRESS_EXTRAS)):
        node.remove()
    for image in doc.find_all("img"):
        if (image.get("src") or "").startswith("data:image/svg+xml"):
            image.remove()


ALL = [(is_mkdocs, clean_mkdocs), (is_numbered, number), (is_wordpress, clean_wordpress)]
