"""Text of PDF files as markdown (PRJ-31, SRC-07, MSC-10).

Python reads a file's objects and says what its pages show: runs of text with place and
size.  All else is DataFrame work over runs: lines by their height, words by gaps, the
size most of a page is written in, headings by their ratio to it, pages in order.

Objects are found by their marks instead of the cross-reference table, so tables that are
broken or compressed do not matter; the last definition of a number counts.  Flate streams,
object streams, form objects, ToUnicode maps and text matrices are understood; other
filters, encryption and pictures of text are not: such files have no runs and ``error``
says why.  Tables come as lines.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNS = "id string, page int, seq int, x double, x_end double, y double, size double, text string, title string, pages int, error string"
_FIELDS = [c.split()[0] for c in RUNS.split(", ")]
#: A gap of this share of the size is a space; sizes of this ratio to a page's usual one are headings of levels 1 to 3.
GAP = 0.2
RATIOS = (1.8, 1.4, 1.15)
_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(<<|>>|\[|\]|/[^\s()<>\[\]{}/%]*|\d+\s+\d+\s+R(?![A-Za-z])|[+-]?(?:\d+\.?\d*|\.\d+)|<[0-9A-Fa-f\s]*>|\(|[^\s()<>\[\]{}/%]+|[{}])")
# an operator behind numbers, names and at most one plain string, as nearly all are; whatever else there is goes token by token
_PLAIN = re.compile(rb"\s*+((?:(?:[+-]?(?:\d++(?:\.\d*+)?|\.\d++)|/[^\s()<>\[\]{}/%#]*+)\s++)*+)(?:<([0-9A-Fa-f]*+)>|\(([^()\\]*+)\))?\s*+([A-Za-z'\"][^\s()<>\[\]{}/%]*+)")
_CHARS = re.compile(rb"beginbfchar((?:\s*+<(?:[0-9A-Fa-f]{2})++>\s*+<(?:[0-9A-Fa-f]{2})++>)*+)\s*+endbfchar")
_PAIR = re.compile(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A PDF name; other texts are bytes."""


class Ref(int):
    """The number of another object."""


class Word(bytes):
    """An operator."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string whose bracket opens before ``at``."""
    out, depth = [], 1
    while depth:
        m = re.compile(rb"[^()\\]*([()\\])", re.S).match(data, at)
        if m is None:
            return b"".join(out), len(data)
        out.append(m[0][:-1])
        at = m.end()
        if m[1] == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at)
            if octal:
                out.append(bytes([int(octal[0], 8) & 255]))
                at = octal.end()
            else:
                c = data[at : at + 1]
                out.append(b"" if c in b"\r\n" else _ESCAPES.get(c, c))
                at += 1
        else:
            depth += 1 if m[1] == b"(" else -1
            if depth:
                out.append(m[1])
    return b"".join(out), at


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[Any, int]]:
    """Values and operators with where each ends."""
    stack: list[list] = []
    while m := _TOKEN.match(data, at):
        said, at = m[1], m.end()
        if said in (b"<<", b"["):
            stack.append([said])
            continue
        if said in (b">>", b"]"):
            if not stack:
                continue
            held = stack.pop()[1:]
            value: Any = held if said == b"]" else {k: v for k, v in zip(held[::2], held[1::2], strict=False) if isinstance(k, Name)}
        elif said == b"(":
            value, at = _string(data, at)
        elif said[:1] == b"<":
            digits = b"".join(said[1:-1].split())
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif said[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), said[1:]).decode("latin-1"))
        elif said[-1:] == b"R" and b" " in b" ".join(said.split()):
            value = Ref(said.split()[0])
        elif said[:1] in b"+-.0123456789":
            value = float(said) if b"." in said else int(said)
        else:
            value = {b"true": True, b"false": False, b"null": None}.get(said, Word(said))
        if stack:
            stack[-1].append(value)
        else:
            yield value, at


def operations(code: bytes) -> Iterator[tuple[bytes, list]]:
    """Operators of a content stream, each with what stands before it."""
    at = 0
    while True:
        m = _PLAIN.match(code, at)
        if m is not None and m[4] not in (b"R", b"true", b"false", b"null"):
            numbers, digits, said, word = m.groups()
            held: list[Any] = [float(x) if x[0] != 47 else Name(x[1:].decode("latin-1")) for x in numbers.split()]
            if digits is not None:
                held.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
            elif said is not None:
                held.append(said)
            at = m.end()
            yield word, held
            continue
        held = []
        for value, at in tokens(code, at):
            if isinstance(value, Word):
                yield value, held
                break
            held.append(value)
        else:
            return


class File:
    def __init__(self, data: bytes):
        self.objects: dict[int, tuple[Any, bytes | None]] = {}
        self.trailer: dict = {}
        self.fonts: dict[int, Font] = {}
        if b"%PDF-" not in data[:1024]:
            raise ValueError("no PDF")
        at = 0
        while m := re.compile(rb"(?:(\d+)\s+\d+\s+obj|trailer)\b").search(data, at):
            value, end = next(tokens(data, m.end()), (None, m.end()))
            at = end
            if m[1] is None:
                self.trailer |= value if isinstance(value, dict) else {}
                continue
            body = re.compile(rb"\s*stream\r?\n").match(data, end) if isinstance(value, dict) else None
            raw = None
            if body:
                size = value.get("Length")
                stop = body.end() + size if type(size) is int else -1
                if stop < 0 or not re.compile(rb"\s*endstream").match(data, stop):
                    stop = data.find(b"endstream", body.end())
                    stop = len(data) if stop < 0 else stop
                raw, at = data[body.end() : stop], stop
            self.objects[int(m[1])] = (value, raw)
        for value, raw in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "XRef":
                self.trailer |= {k: v for k, v in value.items() if k in ("Root", "Info", "Encrypt")}
            if isinstance(value, dict) and value.get("Type") == "ObjStm" and raw is not None:
                held = self.content(value, raw)
                first, n = value["First"], value["N"]
                heads = [v for v, _ in tokens(held[:first])][: 2 * n]
                for number, place in zip(heads[::2], heads[1::2], strict=True):
                    self.objects.setdefault(number, (next(tokens(held, first + place), (None, 0))[0], None))
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted")

    def get(self, value: Any) -> Any:
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(int(value), (None, None))[0]
        return None

    def content(self, value: dict, raw: bytes) -> bytes:
        filters = self.get(value.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if self.get(f) not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {self.get(f)}")
            raw = zlib.decompressobj().decompress(raw)
        return raw

    def stream(self, ref: Any) -> bytes:
        value, raw = self.objects.get(int(ref), (None, None)) if isinstance(ref, Ref) else (None, None)
        return self.content(value, raw) if raw is not None else b""

    def font(self, ref: Any) -> Font:
        """A font, read once a file."""
        key = int(ref) if isinstance(ref, Ref) else id(ref)
        if key not in self.fonts:
            self.fonts[key] = Font(self, self.get(ref) or {})
        return self.fonts[key]

    def pages(self) -> list[tuple[dict, dict]]:
        """(page, its resources), in order; a tree that runs in a circle is walked once."""
        root = self.get(self.trailer.get("Root")) or next((v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), {})
        out, seen, left = [], set(), [(root.get("Pages"), {})]
        while left:
            ref, given = left.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and int(ref) in seen):
                continue
            seen.add(int(ref) if isinstance(ref, Ref) else id(node))
            given = self.get(node.get("Resources")) or given
            if "Kids" in node:
                left += [(k, given) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                out.append((node, given))
        return out

    def title(self) -> str | None:
        said = self.get((self.get(self.trailer.get("Info")) or {}).get("Title"))
        if not isinstance(said, bytes):
            return None
        return (said[2:].decode("utf-16-be", "replace") if said[:2] == b"\xfe\xff" else said.decode("cp1252", "replace")).strip() or None


class Font:
    """How a font's codes become text, and how far each goes."""

    def __init__(self, file: File, font: dict):
        self.wide = file.get(font.get("Subtype")) == "Type0"
        self.map: dict[int, str] = {}
        if isinstance(font.get("ToUnicode"), Ref):
            self._mapped(file.stream(font["ToUnicode"]))
        self.widths: dict[int, float] = {}
        below = file.get((file.get(font.get("DescendantFonts")) or [None])[0]) or {}
        self.usual = float(file.get(below.get("DW")) or 1000) if self.wide else 500.0
        first = file.get(font.get("FirstChar")) or 0
        self.widths = {first + k: float(file.get(w)) for k, w in enumerate(file.get(font.get("Widths")) or [])}
        w, k = file.get(below.get("W")) or [], 0
        while k + 1 < len(w):
            begin, then = file.get(w[k]), file.get(w[k + 1])
            if isinstance(then, list):
                self.widths |= {begin + i: float(file.get(x)) for i, x in enumerate(then)}
                k += 2
            elif k + 2 < len(w):
                self.widths |= dict.fromkeys(range(begin, then + 1), float(file.get(w[k + 2])))
                k += 3
            else:
                break

    def _mapped(self, cmap: bytes) -> None:
        held: list = []
        text = lambda b: b.decode("utf-16-be", "surrogatepass")
        blocks = _CHARS.findall(cmap) if b"bfrange" not in cmap else []
        if blocks and len(blocks) == cmap.count(b"beginbfchar"):
            self.map = {int(a, 16): text(bytes.fromhex(b.decode())) for block in blocks for a, b in _PAIR.findall(block)}
            return
        for value, _ in tokens(cmap):
            if not isinstance(value, Word):
                held.append(value)
                continue
            if value == b"endbfchar":
                self.map |= {int.from_bytes(a): text(b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif value == b"endbfrange":
                for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False):
                    low, high = int.from_bytes(a), min(int.from_bytes(b), int.from_bytes(a) + 65535)
                    if isinstance(c, list):
                        self.map |= {low + k: text(x) for k, x in enumerate(c[: high - low + 1])}
                    else:
                        self.map |= {low + k: text(c[:-2] + (int.from_bytes(c[-2:]) + k & 0xFFFF).to_bytes(2)) for k in range(high - low + 1)}
            held = []

    def shown(self, said: bytes) -> tuple[str, float, int]:
        """(text, width in thousandths, number of codes)."""
        codes = said.decode("utf-16-be", "surrogatepass") if self.wide and len(said) % 2 == 0 else said.decode("latin-1")
        if self.wide and len(said) % 2 == 0 and len(codes) * 2 < len(said):  # pairs of surrogates are two codes
            codes = "".join(chr(int.from_bytes(said[k : k + 2])) for k in range(0, len(said), 2))
        width = sum(map(self.widths.get, map(ord, codes), (self.usual,) * len(codes))) if self.widths else self.usual * len(codes)
        if self.map:
            out = codes.translate(self.map)
        else:
            out = codes if self.wide else said.decode("cp1252", "replace")
        return out if out.isascii() else out.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace"), width, len(codes)


def _times(a: list[float], b: list[float]) -> list[float]:
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def runs(file: File, code: bytes, resources: dict, matrix: list[float], depth: int = 0) -> Iterator[tuple[float, float, float, float, str]]:
    """(x, x at the end, y, size, text) of what a content stream shows."""
    saved: list[dict] = []
    state = {"m": matrix, "font": None, "size": 1.0, "lead": 0.0, "char": 0.0, "word": 0.0, "wide": 1.0, "rise": 0.0}
    text, line = [1.0, 0, 0, 1.0, 0, 0], [1.0, 0, 0, 1.0, 0, 0]

    def show(parts: list) -> Iterator[tuple[float, float, float, float, str]]:
        nonlocal text
        for part in parts:
            if isinstance(part, bytes) and state["font"] is not None:
                said, width, n = state["font"].shown(part)
                spaces = part.count(b" ") if not state["font"].wide else 0
                ahead = (width / 1000 * state["size"] + n * state["char"] + spaces * state["word"]) * state["wide"]
                m, size, rise = state["m"], state["size"], state["rise"]
                place = _times(text, m)
                text = [*text[:4], ahead * text[0] + text[4], ahead * text[1] + text[5]]
                end = text[4] * m[0] + text[5] * m[2] + m[4]
                yield rise * place[2] + place[4], end, rise * place[3] + place[5], ((size * place[2]) ** 2 + (size * place[3]) ** 2) ** 0.5, said
            elif isinstance(part, (int, float)):
                text = _times([1, 0, 0, 1, -part / 1000 * state["size"] * state["wide"], 0], text)

    def moved(x: float, y: float) -> None:
        nonlocal text, line
        line = _times([1, 0, 0, 1, x, y], line)
        text = line

    simple = {b"Tc": "char", b"Tw": "word", b"TL": "lead", b"Ts": "rise"}
    for value, a in operations(code):
        try:
            if value == b"q":
                saved.append(dict(state))
            elif value == b"Q" and saved:
                state.update(saved.pop())
            elif value == b"cm":
                state["m"] = _times(list(map(float, a[-6:])), state["m"])
            elif value == b"BT":
                text, line = [1.0, 0, 0, 1.0, 0, 0], [1.0, 0, 0, 1.0, 0, 0]
            elif value == b"Tf":
                state["font"], state["size"] = file.font((file.get(resources.get("Font")) or {}).get(a[-2])), float(a[-1])
            elif value in simple:
                state[simple[value]] = float(a[-1])
            elif value == b"Tz":
                state["wide"] = a[-1] / 100
            elif value == b"Tm":
                text = line = list(map(float, a[-6:]))
            elif value in (b"Td", b"TD"):
                if value == b"TD":
                    state["lead"] = -float(a[-1])
                moved(a[-2], a[-1])
            elif value == b"T*":
                moved(0, -state["lead"])
            elif value == b"Tj":
                yield from show(a[-1:])
            elif value == b"TJ":
                yield from show(a[-1])
            elif value in (b"'", b'"'):
                if value == b'"':
                    state["word"], state["char"] = float(a[-3]), float(a[-2])
                moved(0, -state["lead"])
                yield from show(a[-1:])
            elif value == b"Do" and depth < 8:
                ref = (file.get(resources.get("XObject")) or {}).get(a[-1])
                form = file.get(ref)
                if isinstance(form, dict) and form.get("Subtype") == "Form":
                    own = _times(list(map(float, file.get(form.get("Matrix")) or [1, 0, 0, 1, 0, 0])), state["m"])
                    yield from runs(file, file.stream(ref), file.get(form.get("Resources")) or resources, own, depth + 1)
        except (IndexError, TypeError, AttributeError):  # an operator without its operands shows nothing
            continue


_KINDS = [pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.string(), pa.int32(), pa.string()]
#: Runs that are handed on at once.
_AT_ONCE = 4000


def _shown(name: str, data: bytes | None) -> list[tuple]:
    """A file's runs as rows; one row without text if it has none."""
    title, count = None, 0
    try:
        file = File(data or b"")
        pages, title = file.pages(), file.title()
        count = len(pages)
        rows = []
        for k, (page, resources) in enumerate(pages):
            said = file.get(page.get("Contents")) if not isinstance(file.get(page.get("Contents")), dict) else [page["Contents"]]
            code = b"\n".join(file.stream(r) for r in said or [])
            rows += [(name, k + 1, i, *run, title, count, None) for i, run in enumerate(runs(file, code, resources, [1.0, 0, 0, 1.0, 0, 0]))]
        return rows or [(name, *[None] * 7, title, count, None)]
    except (ValueError, zlib.error, KeyError, RecursionError) as e:
        return [(name, *[None] * 7, title, count, str(e))]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_FIELDS)
    rows: list[tuple] = []
    for batch in batches:
        for name, data in zip(batch.column(0), batch.column(1), strict=True):
            rows += _shown(name.as_py(), data.as_py())
            if len(rows) >= _AT_ONCE:
                yield made(rows)
                rows = []
    if rows:
        yield made(rows)


def markdown(files: DataFrame) -> DataFrame:
    """(id, title, pages, markdown, error) of PDF files (id, content).

    A line is what stands at one height, from left to right; pages are divided by rules, and the title goes in front
    unless the text begins with it.  Files are dealt anew before they are read, so few large partitions do not bind few
    tasks; their runs move once, by file, and lines, pages and texts are grouped where they lie.
    """
    shown = files.select(F.col("id").cast("string"), "content").repartition("id").mapInArrow(_read, RUNS).repartition("id")
    first = lambda c: F.first(c, True).alias(c)
    heads = [first("title"), F.max("pages").alias("pages"), first("error")]
    part = F.when(F.col("text") != "", F.struct("x", "seq", "x_end", "size", "text"))
    n = F.when(F.col("text") != "", F.char_length("text"))
    lines = shown.groupBy("id", "page", F.round("y").alias("line")).agg(F.sort_array(F.collect_list(part)).alias("parts"), (F.sum(F.col("size") * n) / F.sum(n)).alias("size"), *heads)
    joined = F.aggregate(
        "parts", F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("end")),
        lambda a, p: F.struct(F.concat(a["t"], F.when((p["x"] - a["end"] > p["size"] * GAP) & ~a["t"].endswith(" ") & ~p["text"].startswith(" "), F.lit(" ")).otherwise(F.lit("")), p["text"]).alias("t"), p["x_end"].alias("end")),
    )["t"]
    sizes = F.transform("parts", lambda p: F.struct(F.round(p["size"], 1).alias("s"), F.char_length(p["text"]).alias("n")))
    lines = lines.select("id", "page", F.struct(F.negative("line").alias("l"), F.trim(joined).alias("text"), "size").alias("line"), sizes.alias("sizes"), "title", "pages", "error")
    pages = lines.groupBy("id", "page").agg(F.sort_array(F.collect_list(F.when(F.col("line.text") != "", F.col("line")))).alias("lines"), F.flatten(F.collect_list("sizes")).alias("sizes"), *heads)
    held = lambda s: F.aggregate(F.filter("sizes", lambda x: x["s"] == s), F.lit(0), lambda a, x: a + x["n"])
    usual = F.array_max(F.transform(F.array_distinct("sizes.s"), lambda s: F.struct(held(s).alias("n"), F.negative(s).alias("s"))))["s"]
    pages = pages.withColumn("usual", F.negative(usual))

    def marked(x: Column) -> Column:
        ratio = x["size"] / F.col("usual")
        mark = F.when(F.char_length(x["text"]) < 2, "").when(ratio >= RATIOS[0], "# ").when(ratio >= RATIOS[1], "## ").when(ratio >= RATIOS[2], "### ").otherwise("")
        return F.concat(mark, x["text"])

    text = F.when(F.size("lines") > 0, F.struct("page", F.array_join(F.transform("lines", marked), "\n").alias("text")))
    texts = pages.select("id", text.alias("text"), "title", "pages", "error").groupBy("id").agg(F.sort_array(F.collect_list("text")).alias("texts"), *heads)
    body = F.array_join(F.col("texts.text"), "\n\n---\n\n")
    titled = F.when(F.col("title").isNotNull() & ~body.startswith(F.concat(F.lit("# "), "title")), F.concat(F.lit("# "), "title", F.lit("\n\n"), body)).otherwise(body)
    return texts.select("id", "title", "pages", titled.alias("markdown"), "error")
