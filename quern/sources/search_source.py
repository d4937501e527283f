"""Search as a Spark data source: ``spark.read.format("quern_search")`` (UDF-04, SRC-14..19, STM-07).

    register(spark)
    found = spark.read.format("quern_search").options(searches=path, chain="brave,tavily", replies=path).load()
    found.where("kind = 'news' and site = 'example.org' and published >= '2024-03-01' and i < 5")

Searches are rows (search, query) of Parquet files; an input partition is one search, or
``per_partition`` of them.  A partition asks the chain's providers in order, web, image and
news searches alike, until one has results: exhausted or refused credentials and timeouts
lead to the next provider, an empty answer does too, any other error ends the search.

Filters become the provider's own parameters before anything is sent: ``kind`` (what is
searched), ``site`` (sites, as parameters or ``site:`` operators), ``published`` (bounds of
time) and ``i`` (how many results).  Providers only approximate them, so Spark applies
sites, times and counts to the results again; ``kind`` alone is left to the source.

Sending is the caller's ``sender="module:function"``, a function of (provider, kind,
request) that gives (status, headers, body) or raises, or a replay: ``replies`` names
Parquet files of (search, provider, kind, status, remaining, body).  A search without a
stored reply is answered as if its provider were out of reach.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

KINDS = ("web", "images", "news")
SCHEMA = (
    "search long, kind string, provider string, i int, url string, site string, title string, description string, "
    "published_at string, published date, source_name string, image_url string, thumbnail string, image_width int, image_height int, remaining int, error string"
)

# Where replies of each kind hold their results, and the fields of a result (several: the first there is).
RESULTS: dict[str, dict[str, tuple[str, dict[str, str | tuple[str, ...]]]]] = {
    "web": {
        "brave": ("web.results", {"url": "url", "title": "title", "description": "description"}),
        "tavily": ("results", {"url": "url", "title": "title", "description": "content"}),
        "serper": ("organic", {"url": "link", "title": "title", "description": "snippet"}),
        "serpapi": ("organic_results", {"url": "link", "title": "title", "description": "snippet"}),
        "exa": ("results", {"url": "url", "title": "title", "description": ("text", "snippet"), "published_at": "publishedDate"}),
        "searxng": ("results", {"url": "url", "title": "title", "description": "content"}),
    },
    "images": {
        "brave": ("results", {"url": "url", "title": "title", "description": "source", "image_url": "properties.url", "thumbnail": "thumbnail.src", "image_width": "properties.width", "image_height": "properties.height"}),
        "serper": ("images", {"url": "link", "title": "title", "description": "source", "image_url": "imageUrl", "thumbnail": "thumbnailUrl", "image_width": "imageWidth", "image_height": "imageHeight"}),
        "serpapi": ("images_results", {"url": "link", "title": "title", "description": "source", "image_url": "original", "thumbnail": "thumbnail", "image_width": "original_width", "image_height": "original_height"}),
        "searxng": ("results", {"url": "url", "title": "title", "description": ("content", "source"), "image_url": "img_src", "thumbnail": ("thumbnail_src", "img_src"), "size": "resolution"}),
    },
    "news": {
        "brave": ("results", {"url": "url", "title": "title", "description": "description", "published_at": "page_age", "source_name": "meta_url.hostname"}),
        "tavily": ("results", {"url": "url", "title": "title", "description": "content", "published_at": "published_date"}),
        "serper": ("news", {"url": "link", "title": "title", "description": "snippet", "published_at": "date", "source_name": "source"}),
        "serpapi": ("news_results", {"url": "link", "title": "title", "description": "snippet", "published_at": "date", "source_name": "source.name"}),
        "exa": ("results", {"url": "url", "title": "title", "description": ("text", "snippet"), "published_at": "publishedDate"}),
        "searxng": ("results", {"url": "url", "title": "title", "description": "content", "published_at": "publishedDate", "source_name": "engine"}),
    },
}
# Statuses that lead to the next provider, words that make a 400 or 403 do so, and words of raised errors.
SPENT = (401, 402, 429)
REFUSED = ("api key", "invalid key", "expired", "credit", "quota", "billing", "subscription", "unauthorized", "payment", "rate limit", "exceeded", "too many")
RAISED = ("quota", "rate limit", "too many requests", "captcha", "bot detection", "payment required", "subscription", "unresponsive")
# Addresses of the providers' interfaces.
PLACES = {
    "brave": "https://api.search.brave.com/res/v1/{kind}/search", "tavily": "https://api.tavily.com/search", "serper": "https://google.serper.dev/{path}",
    "serpapi": "https://serpapi.com/search.json", "exa": "https://api.exa.ai/search", "searxng": "{base}/search",
}


@dataclass
class Wanted:
    """What a search asks of its providers."""

    kinds: list[str] = field(default_factory=lambda: list(KINDS))
    limit: int = 10
    sites: list[str] = field(default_factory=list)
    since: date | None = None
    until: date | None = None


def _us(day: date) -> str:
    return f"{day.month}/{day.day}/{day.year}"


def _asked_sites(query: str, sites: list[str]) -> str:
    said = " OR ".join(f"site:{s}" for s in sites)
    return " ".join(x for x in (query.strip(), f"({said})" if len(sites) > 1 else said) if x)


def request(provider: str, kind: str, query: str, wanted: Wanted, base: str = "") -> dict[str, Any]:
    """(place, parameters) of a search; image searches know no filters, and where both ends of a time are needed one is not sent."""
    images, spelled = kind == "images", query if kind == "images" else _asked_sites(query, wanted.sites)
    between = None if images or not (wanted.since and wanted.until) else (wanted.since, wanted.until)
    place = PLACES[provider].format(kind=kind, path="search" if kind == "web" else kind, base=base.rstrip("/"))
    tbs = f"cdr:1,cd_min:{_us(between[0])},cd_max:{_us(between[1])}" if between else None
    instant = lambda d: d and f"{d.isoformat()}T00:00:00.000Z"
    if provider == "brave":
        asked = {"q": spelled, "count": wanted.limit, "freshness": between and f"{between[0]}to{between[1]}"}
    elif provider == "serper":
        asked = {"q": spelled, "num": wanted.limit, "tbs": tbs}
    elif provider == "serpapi":
        asked = {"engine": {"web": "google", "images": "google_images", "news": "google_news"}[kind], "q": spelled, "num": str(wanted.limit), "tbs": tbs}
    elif provider == "tavily":
        asked = {"query": query, "max_results": wanted.limit, "topic": "news" if kind == "news" else "general", "include_domains": wanted.sites or None, "start_date": wanted.since and str(wanted.since), "end_date": wanted.until and str(wanted.until)}
    elif provider == "exa":
        asked = {"query": query, "numResults": wanted.limit, "category": "news" if kind == "news" else None, "includeDomains": wanted.sites or None, "startPublishedDate": instant(wanted.since), "endPublishedDate": instant(wanted.until)}
    else:
        asked = {"q": spelled, "format": "json", "categories": "general" if kind == "web" else kind}
    return {"place": place, "parameters": {k: v for k, v in asked.items() if v is not None}}


def _at(value: Any, path: str) -> Any:
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _day(said: Any) -> date | None:
    m = re.match(r"\d{4}-\d{2}-\d{2}", said) if isinstance(said, str) else None
    try:
        return date.fromisoformat(m[0]) if m else None
    except ValueError:
        return None


def _number(value: Any) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def results(provider: str, kind: str, body: str, limit: int) -> list[dict[str, Any]]:
    """Rows of a reply; results without an address are left out, a reply that is no JSON object has none."""
    place, names = RESULTS[kind][provider]
    try:
        held = _at(json.loads(body), place)
    except ValueError:
        return []
    out = []
    for x in (held if isinstance(held, list) else [])[:limit]:
        row = {k: next((v for p in ([paths] if isinstance(paths, str) else paths) if (v := _at(x, p)) is not None), None) for k, paths in names.items()}
        size = re.fullmatch(r"\s*(\d+)\s*[x×X]\s*(\d+)\s*", row.pop("size", None) or "")
        if size:
            row |= {"image_width": int(size[1]), "image_height": int(size[2])}
        if isinstance(row["url"], str) and row["url"]:
            host = re.match(r"[a-z]+://([^/?#:]+)", row["url"], re.I)
            out.append({k: str(v) if not k.startswith("image_w") and not k.startswith("image_h") and v is not None else v for k, v in row.items()} | {"published": _day(row.get("published_at")), "site": host[1].lower() if host else None, "image_width": _number(row.get("image_width")), "image_height": _number(row.get("image_height"))})
    return out


def falls_through(status: int, body: str) -> bool:
    """Whether a reply that is not 200 leads to the next provider."""
    return status in SPENT or (status in (400, 403) and any(w in body.lower() for w in REFUSED))


@dataclass
class Searches(InputPartition):
    rows: list[tuple[int, str]]

    def __post_init__(self):
        super().__init__(None)


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.wanted = dict(options), Wanted(limit=int(options.get("limit", "10")))
        self.chain = [p.strip() for p in options.get("chain", "").split(",") if p.strip()]
        if bad := [p for p in self.chain if p not in PLACES]:
            raise ValueError(f"no such provider: {', '.join(bad)}")

    def pushFilters(self, filters):
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("kind",):
                self.wanted.kinds = [k for k in KINDS if k in values]
                continue
            if values is not None and f.attribute == ("site",):
                self.wanted.sites = sorted(values)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("i",):
                self.wanted.limit = max(0, min(self.wanted.limit, f.value + isinstance(f, LessThanOrEqual)))
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("published",):
                self.wanted.since = f.value
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("published",):
                self.wanted.until = f.value if isinstance(f, LessThanOrEqual) else f.value - timedelta(days=1)
            yield f

    def partitions(self) -> list[Searches]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.options["searches"])
        size = int(self.options.get("per_partition", "1"))
        held = ds.dataset(path, filesystem=store, format="parquet").to_table(columns=["search", "query"]).to_pylist()
        rows = sorted({(r["search"], r["query"] or "") for r in held})
        return [Searches(rows[k : k + size]) for k in range(0, len(rows), size)]

    def _sender(self, rows: list[tuple[int, str]]) -> Callable[[int, str, str, dict], tuple[int, dict, str]]:
        if "sender" in self.options:
            module, name = self.options["sender"].split(":")
            send = getattr(importlib.import_module(module), name)
            return lambda search, provider, kind, asked: send(provider, kind, asked)
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.options["replies"])
        some = ds.field("search").isin([r[0] for r in rows]) & ds.field("kind").isin(self.wanted.kinds)
        held = ds.dataset(path, filesystem=store, format="parquet").to_table(filter=some).to_pylist()
        stored = {(r["search"], r["provider"], r["kind"]): (r["status"], {"X-RateLimit-Remaining": r["remaining"]}, r["body"] or "") for r in held}

        def replay(search: int, provider: str, kind: str, asked: dict) -> tuple[int, dict, str]:
            if (search, provider, kind) not in stored:
                raise TimeoutError(f"{provider} gave no reply")
            return stored[search, provider, kind]

        return replay

    def read(self, partition: Searches) -> Iterator[tuple]:
        send = self._sender(partition.rows)
        for search, query in partition.rows:
            for kind in self.wanted.kinds:
                yield from self._searched(send, search, query, kind)

    def _searched(self, send, search: int, query: str, kind: str) -> Iterator[tuple]:
        failed, empty = None, False
        for provider in self.chain:
            if provider not in RESULTS[kind]:
                continue
            try:
                status, headers, body = send(search, provider, kind, request(provider, kind, query, self.wanted, self.options.get("base", "")))
            except Exception as e:  # noqa: BLE001  a provider's fault is data for the chain
                failed = (provider, None, str(e))
                if isinstance(e, TimeoutError) or any(w in str(e).lower() for w in RAISED):
                    continue
                break
            left = str(headers.get("X-RateLimit-Remaining") or "") if provider == "brave" else ""
            left = int(left) if re.fullmatch(r"-?\d+", left) else None
            if status >= 400:
                failed = (provider, left, f"{provider} answered {status}")
                if falls_through(status, body):
                    continue
                break
            found = results(provider, kind, body, self.wanted.limit)
            for i, x in enumerate(found):
                yield (search, kind, provider, i, x["url"], x["site"], x.get("title"), x.get("description"), x.get("published_at"), x["published"], x.get("source_name"), x.get("image_url"), x.get("thumbnail"), x["image_width"], x["image_height"], left, None)
            if found:
                return
            empty = True
        if failed and not empty:
            yield (search, kind, failed[0], *[None] * 12, failed[1], failed[2])


class SearchSource(DataSource):
    """See the module's text."""

    @classmethod
    def name(cls) -> str:
        return "quern_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known, and let Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchSource)

