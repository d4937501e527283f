"""Sources: page tables, URL lists, sitemaps, manifests, suites, and fetchers behind an interface (SRC-*).

Nothing here reaches the network; a fetcher, a search provider or a language model is
a callable that the caller brings, and ``replay`` answers from a stored page table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import urls

PAGE = "page_id long, url string, html string"
#: Largest page and document that a fetch keeps, in bytes.
MAX_HTML, MAX_PDF = 5 << 20, 50 << 20


class NotSupportedHere(RuntimeError):
    """What needs a browser, the network, a key or a library that is not installed."""


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).parquet(path)


def replay(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Fetch from a stored page table: (url, html, status); pages that it lacks are 404."""
    held = stored.groupBy(urls.dedupe_key(F.col("url")).alias("key")).agg(F.min_by("html", "page_id").alias("html"))
    asked = wanted.select("url", urls.dedupe_key(F.col("url")).alias("key"))
    return asked.join(held, "key", "left").select("url", "html", F.when(F.col("html").isNull(), 404).otherwise(200).alias("status"))


def static_gate(responses: DataFrame) -> DataFrame:
    """Responses (content_type, body) that a plain request may keep: HTML, XML, text or PDF within their limits."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    page = kind.rlike("html|xml|text/plain") & (F.octet_length("body") <= MAX_HTML)
    pdf = (F.contains(kind, F.lit("pdf")) | urls.is_pdf_body(F.col("body"))) & (F.octet_length("body") <= MAX_PDF)
    return responses.where(page | pdf)


def fetched(wanted: DataFrame, fetch: Callable[[str], tuple[int, str | None]], per_host: int = 64) -> DataFrame:
    """(url, status, html) by the caller's fetcher, hosts kept together so that each is asked by one task."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            got = [fetch(u) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in got], pa.int32()), pa.array([h for _, h in got], pa.string())], names=["url", "status", "html"])

    return wanted.select("url").repartition(per_host, urls.host(F.col("url"))).mapInArrow(run, "url string, status int, html string")


def rendered(*_args, **_kwargs):
    raise NotSupportedHere("rendering a page needs a browser; bring a fetcher instead")


def pdf_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, pages, markdown, error) of the PDF files under a path."""
    from quern.operators import pdf

    return pdf.markdown(spark.read.format("binaryFile").load(path).select(F.col("path").alias("id"), "content"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of a text file, a line each; blank lines and comments are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not url like '#%'")


def sitemap(xml: DataFrame, *keep: str) -> DataFrame:
    """(loc, kind) of sitemap documents (column xml), behind the columns to keep: pages, and nested sitemaps to read next."""
    loc = lambda tag: F.regexp_extract_all("xml", F.lit(rf"(?s)<{tag}>.*?<loc>\s*([^<]*?)\s*</loc>.*?</{tag}>"), F.lit(1))
    found = xml.select(*keep, F.explode(F.concat(F.transform(loc("url"), lambda x: F.struct(x.alias("loc"), F.lit("page").alias("kind"))), F.transform(loc("sitemap"), lambda x: F.struct(x.alias("loc"), F.lit("sitemap").alias("kind"))))).alias("x"))
    return found.select(*keep, F.replace("x.loc", F.lit("&amp;"), F.lit("&")).alias("loc"), "x.kind")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Addresses that a crawl's manifest lists as done."""
    return spark.read.schema("scraped_urls array<string>").json(path).select(F.explode("scraped_urls").alias("url"))


def suite(spark: SparkSession, cases: Iterable[dict]) -> DataFrame:
    """Benchmark cases as a table."""
    schema = "id string, url string, category string, title string, content_type string, difficulty string, stable boolean, scored boolean, expect array<string>, expect_absent array<string>"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = [tuple(c.get(n, [] if n.startswith("expect") else (True if n in ("stable", "scored") else None)) for n in names) for c in cases]
    return spark.createDataFrame(rows, schema)


def yaml(text: str):
    """Block YAML as suites are written in: mappings, lists, quoted and plain scalars, flow lists, folded and literal texts."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.splitlines()]
    at = 0

    def scalar(said: str):
        quoted = re.fullmatch(r"""(["'])(.*)\1""", said)
        if quoted:
            return json.loads(said) if said[0] == '"' else quoted[2].replace("''", "'")
        if said[:1] == "[" and said[-1:] == "]":
            inner = said[1:-1].strip()
            return [scalar(x.strip()) for x in re.findall(r"""(?:"(?:[^"\\]|\\.)*"|'[^']*'|[^,"'])+""", inner)] if inner else []
        said = re.sub(r"(?:^|\s)#.*$", "", said).strip()
        plain = {"": None, "null": None, "~": None, "true": True, "false": False}
        if said.lower() in plain:
            return plain[said.lower()]
        for kind in (int, float):
            try:
                return kind(said)
            except ValueError:
                continue
        return said

    def skip() -> None:
        nonlocal at
        while at < len(lines) and (not lines[at][1] or lines[at][1][0] == "#" or lines[at][1] == "---"):
            at += 1

    def value(said: str, depth: int):
        nonlocal at
        if said in (">", "|", ">-", "|-"):
            held = []
            while at < len(lines) and (lines[at][0] > depth or not lines[at][1]):
                held.append(lines[at][1])
                at += 1
            return (" " if said[0] == ">" else "\n").join(held).strip()
        if said and said[0] != "#":
            return scalar(said)
        skip()
        deeper = at < len(lines) and (lines[at][0] > depth or (lines[at][0] == depth and lines[at][1].startswith("- ")))
        return block(lines[at][0]) if deeper else None

    def block(depth: int):
        nonlocal at
        out: list | dict | None = None
        while True:
            skip()
            if at >= len(lines) or lines[at][0] != depth:
                return out
            said = lines[at][1]
            if said == "-" or said.startswith("- "):
                out = [] if out is None else out
                if not isinstance(out, list):
                    return out
                rest = said[1:].strip()
                if re.match(r"""(?:"[^"]*"|[\w.-]+):(?:\s|$)""", rest):  # a mapping begins on the dash's line
                    lines[at] = (depth + 2, rest)
                    out.append(block(depth + 2))
                else:
                    at += 1
                    out.append(value(rest, depth))
                continue
            m = re.match(r"""("[^"]*"|'[^']*'|[^:#]+?):(?:\s+(.*))?$""", said)
            if m is None or isinstance(out, list):
                if isinstance(out, list):
                    return out
                raise ValueError(f"no YAML that is read here: {said!r}")
            out = {} if out is None else out
            at += 1
            out[str(scalar(m[1]))] = value((m[2] or "").strip(), depth)

    skip()
    return block(lines[at][0]) if at < len(lines) else None


def suite_file(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a suite's YAML file as a table."""
    text = spark.read.text(path, wholetext=True).first()[0]  # one small file
    return suite(spark, (yaml(text) or {}).get("cases") or [])


def config(stored: dict, env: dict[str, str], prefix: str = "QUERN_") -> dict:
    """Settings: what the environment says, else what is stored."""
    return stored | {k[len(prefix) :].lower(): v for k, v in env.items() if k.startswith(prefix)}


def with_setting(stored: dict, name: str, value=None, known: Iterable[str] = ()) -> dict:
    """Settings with one set, or unset without a value; a name that is not known is refused."""
    names = list(known)
    if names and name not in names:
        raise KeyError(f"{name} is none of {', '.join(names)}")
    return {k: v for k, v in stored.items() if k != name} | ({} if value is None else {name: value})


def shown(stored: dict, secrets: Iterable[str] = ("key", "token", "password", "secret")) -> dict:
    """Settings to show: values of secret names as stars."""
    return {k: "***" if v and any(s in k.lower() for s in secrets) else v for k, v in stored.items()}


def resolution(text: str | None) -> tuple[int, int] | None:
    """``WxH`` as numbers."""
    m = re.fullmatch(r"\s*(\d+)\s*[x×]\s*(\d+)\s*", text or "")
    return (int(m[1]), int(m[2])) if m else None


def llm_json(chat: Callable[[str], str], prompt: str) -> dict | list:
    """JSON from a chat model, with one repair round."""
    reply = chat(prompt)
    for attempt in range(2):
        try:
            return json.loads(reply)
        except ValueError:
            if attempt:
                raise
            reply = chat(f"{prompt}\nAnswer with JSON only; this was not: {reply}")
    raise AssertionError
