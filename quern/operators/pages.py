"""Pages to typed columns: each page is parsed once in an Arrow batch, and only wanted formats are computed (PRJ-36)."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.operators import extract, passages
from quern.operators.branding import branding
from quern.operators.dom import parse
from quern.operators.markdown import convert

META = ["title", "description", "language", "keywords", "robots", "canonical_url", "og_title", "og_description", "og_image", "og_url", "og_site_name", "timezone"]
LINK = "array<struct<url:string,text:string,context:string,heading:string,chrome:boolean>>"

#: Format: Spark type, and how to compute it from (html, parsed page, url).
FORMATS: dict[str, tuple[str, Callable]] = {
    "markdown": ("string", lambda h, d, u: convert(h, u)[0]),
    "full_markdown": ("string", lambda h, d, u: convert(h, u, only_main=False)[0]),
    "metadata": (f"struct<{','.join(f'{k}:string' for k in META)}>", lambda h, d, u: extract.metadata(parse(extract.head_of(h)))),
    "links": ("array<string>", lambda h, d, u: extract.flat_links(d, u)),
    "images": ("array<string>", lambda h, d, u: extract.images(d, u)),
    "image_widths": ("map<string,int>", lambda h, d, u: list(extract.image_widths(d, u).items())),
    "json_ld": ("array<string>", lambda h, d, u: [json.dumps(x, sort_keys=True) for x in extract.json_blocks(d)]),
    "next_data": ("string", lambda h, d, u: json.dumps(x, sort_keys=True) if (x := extract.next_data(d)) is not None else None),
    "opengraph": ("map<string,string>", lambda h, d, u: list(extract.opengraph(d).items())),
    "microdata": ("array<string>", lambda h, d, u: [json.dumps(x, sort_keys=True) for x in extract.microdata(d, u)]),
    "branding": ("string", lambda h, d, u: json.dumps(branding(d, u), sort_keys=True)),
    "clean_html": ("string", lambda h, d, u: extract.clean_html(h)),
    "visible_text": ("string", lambda h, d, u: " ".join((d.find("body") or d).text(" ").split())),
    "hidden_disclosure": ("boolean", lambda h, d, u: extract.hidden_disclosure(h)),
    "link_details": (LINK, lambda h, d, u: extract.page_links(d, u)),  # changes the tree, so it comes last
}

_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "map<string,int>": pa.map_(pa.string(), pa.int32()), "map<string,string>": pa.map_(pa.string(), pa.string())}


def _arrow(kind: str) -> pa.DataType:
    if kind in _ARROW:
        return _ARROW[kind]
    if kind == LINK:
        return pa.list_(pa.struct([(k, pa.string()) for k in ("url", "text", "context", "heading")] + [("chrome", pa.bool_())]))
    return pa.struct([(k, pa.string()) for k in META])


def features(pages: DataFrame, *formats: str, keep_html: bool = False) -> DataFrame:
    """(page_id, url, each format) of pages (page_id, url, html), on demand with the html; null html gives nulls."""
    unknown = set(formats) - FORMATS.keys()
    if unknown:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    wanted = [f for f in FORMATS if f in formats]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for html, url in zip(part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True):
                    doc = parse(html) if html is not None else None
                    rows.append([FORMATS[f][1](html, doc, url or "") if html is not None else None for f in wanted])
                columns = [pa.array([r[k] for r in rows], _arrow(FORMATS[f][0])) for k, f in enumerate(wanted)]
                kept = [part.column(k) for k in range(2 + keep_html)]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=["page_id", "url", *["html"] * keep_html, *wanted])

    schema = ", ".join(["page_id long", "url string", *["html string"] * keep_html, *(f"{f} {FORMATS[f][0]}" for f in wanted)])
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def per_row(df: DataFrame, inputs: list[str], function: Callable, name: str, kind: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``name``: a Python function of the input columns, an Arrow batch at a time."""
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    types = dict(df.dtypes)

    def run(batches):
        for batch in batches:
            got = [batch.column(len(keep) + k).to_pylist() for k in range(len(inputs))]
            made = pa.array([function(*row) for row in zip(*got, strict=True)], kinds[kind])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), made], names=[*keep, name])

    from pyspark.sql import functions as F

    source = df.select(*keep, *(F.col(c).alias(f"_{k}") for k, c in enumerate(inputs)))
    return source.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in keep), f"{name} {kind}"]))


__all__ = ["FORMATS", "META", "features", "passages", "per_row"]
