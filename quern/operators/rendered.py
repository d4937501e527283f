"""What a reader of a page sees: its text as laid out by lines, and counts of its parts (SRC-23, JOIN-07).

The text follows the rules of ``innerText`` as far as a page says by itself how it is laid
out: names of elements, the hidden attribute, and styles on the elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.operators.dom import Document, Node, Raw, parse

# Where the main text is looked for, and what is counted.
CONTAINERS = ("main", "article", "[role='main']", ".mw-parser-output", "#content")
COUNTED = {"headings": ("h1", "h2", "h3", "h4", "h5", "h6"), "tables": ("table",), "code": ("pre", "code"), "images": ("img",), "links": ("a",)}
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
UNSEEN = frozenset("area audio base canvas datalist embed head iframe link meta noscript object param script source style template title track video".split())
GOLD = "case_id long, gold_text string, full_text string, headings int, tables int, code int, images int, links int"


def _style(node: Node) -> dict[str, str]:
    return {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(":") for x in (node.get("style") or "").split(";")) if v.strip()}


def _pieces(node: Node, keep: bool, seen: bool) -> Iterator[str | int]:
    """Texts, and numbers: how many line breaks are needed at a place at least."""
    for child in node.children:
        if isinstance(child, Raw):
            continue
        if isinstance(child, str):
            if seen:
                yield child if keep else re.sub(r"[ \t\n\r\f]+", " ", child)
            continue
        style = _style(child)
        if child.name in UNSEEN or "hidden" in child.attrs or style.get("display") == "none":
            continue
        if child.name == "br":
            yield "\n"
            continue
        visible = style["visibility"] == "visible" if "visibility" in style else seen
        space = style.get("white-space", "")
        kept = space.startswith(("pre", "break-spaces")) if space else keep or child.name in ("pre", "textarea")
        block = style["display"] in ("block", "flex", "grid", "list-item", "table") if style.get("display", "inherit") != "inherit" else child.name in BLOCKS
        if child.name in ("td", "th") and "display" not in style:
            if any(isinstance(c, Node) and c.name in ("td", "th") for c in node.children[: node.children.index(child)]):
                yield "\t"
            yield from _pieces(child, kept, visible)
            continue
        breaks = 2 if child.name == "p" else 1 if block else 0
        if breaks:
            yield breaks
        yield from _pieces(child, kept, visible)
        if breaks:
            yield breaks


def inner_text(node: Node) -> str:
    """The text below a node: spaces run together outside preformatted parts, a blank line around paragraphs."""
    out: list[str] = []
    pending, line_start = 0, True
    for piece in _pieces(node, node.name == "pre", True):
        if isinstance(piece, int):
            pending = max(pending, piece)
            continue
        if line_start or pending:
            piece = piece.lstrip(" ") if not piece.strip(" ") or piece[:1] == " " else piece
        elif out and out[-1].endswith(" ") and piece[:1] == " ":
            piece = piece[1:]
        if not piece:
            continue
        if pending and out:
            out[-1] = out[-1].rstrip(" ")
            out.append("\n" * pending)
        pending = 0
        if piece == "\n" and out:
            out[-1] = out[-1].rstrip(" ")
        out.append(piece)
        line_start = piece.endswith("\n")
    return "".join(out).strip()


def gold(doc: Document) -> tuple[str, str, list[int]]:
    """(text of the first container there is or of the body, text of the body, counts)."""
    body = doc.find("body") or doc
    main = next((found[0] for s in CONTAINERS if (found := doc.select(s))), body)
    names = [e.name for e in doc.elements()]
    return inner_text(main), inner_text(body), [sum(n in wanted for n in names) for wanted in COUNTED.values()]


def captured(pages: DataFrame) -> DataFrame:
    """Gold of stored pages (case_id, html); a page without html has null texts and counts."""

    def run(batches):
        for batch in batches:
            held = [gold(parse(h)) if h is not None else None for h in batch.column(1).to_pylist()]
            texts = [pa.array([g and g[k] for g in held], pa.string()) for k in (0, 1)]
            counts = [pa.array([g and g[2][k] for g in held], pa.int32()) for k in range(len(COUNTED))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *texts, *counts], names=[c.split()[0] for c in GOLD.split(", ")])

    return pages.select("case_id", "html").mapInArrow(run, GOLD)
