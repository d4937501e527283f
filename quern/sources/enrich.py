"""Metadata of search results by requests of few bytes (SRC-22): bounded, spaced by host, failures beside.

A task holds the requests of its hosts in one event loop: at most ``in_flight`` at a time,
``gap`` seconds between two of one host, each given up after ``timeout``.  The caller
brings ``fetch``, a coroutine function of (method, url) that gives (status, headers).
"""

from __future__ import annotations

import asyncio
import re
from collections.abc import Awaitable, Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import urls

METADATA = "url string, content_type string, content_length long, last_modified string, error string"
Fetch = Callable[[str, str], Awaitable[tuple[int, dict[str, str]]]]


async def _asked(fetch: Fetch, url: str, timeout: float) -> tuple:
    """(content type, length, date, error): a HEAD, and where that is not allowed a GET of which only the headers count."""
    try:
        status, headers = await asyncio.wait_for(fetch("HEAD", url), timeout)
        if status == 405:
            status, headers = await asyncio.wait_for(fetch("GET", url), timeout)
    except (TimeoutError, asyncio.TimeoutError):
        return None, None, None, "timeout"
    except Exception as e:  # noqa: BLE001  a failed request is a row of its own
        return None, None, None, str(e) or "fetch_failed"
    held = {k.lower(): v for k, v in headers.items()}
    kind, length = (held.get("content-type") or "").split(";")[0].strip(), (held.get("content-length") or "").strip()
    return kind or None, int(length) if re.fullmatch(r"\d{1,18}", length) else None, held.get("last-modified"), None


async def _all(fetch: Fetch, rows: list[tuple[str, str]], in_flight: int, gap: float, timeout: float) -> list[tuple]:
    room, free, turns = asyncio.Semaphore(in_flight), {}, {h: asyncio.Lock() for h, _ in rows}
    clock = asyncio.get_running_loop().time

    async def one(host: str, url: str) -> tuple:
        async with turns[host]:  # a host's requests leave one after another
            await asyncio.sleep(max(0.0, free.get(host, 0.0) - clock()))
            await room.acquire()
            free[host] = clock() + gap
        try:
            return (url, *await _asked(fetch, url, timeout))
        finally:
            room.release()

    return list(await asyncio.gather(*(one(h, u) for h, u in rows)))


def metadata(addresses: DataFrame, fetch: Fetch, in_flight: int = 8, gap: float = 0.0, timeout: float = 5.0) -> DataFrame:
    """(url, content_type, content_length, last_modified, error) of distinct addresses; a host's requests share a task, and so its gap."""

    def run(batches):
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            got = asyncio.run(_all(fetch, rows, in_flight, gap, timeout))
            columns = list(zip(*got, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in METADATA.split(", ")])

    each = addresses.select("url").where("url is not null").distinct().select(F.coalesce(urls.host(F.col("url")), F.lit("")).alias("host"), "url")
    return each.repartition("host").mapInArrow(run, METADATA)


def enriched(results: DataFrame, fetch: Fetch, **bounds) -> tuple[DataFrame, DataFrame]:
    """(results with ``metadata``, dead letters): web results alone are asked about, each address once; what failed has none.

    What was fetched is written before both read it, so no request is sent twice.
    """
    from quern.scratch import materialize

    got = materialize(metadata(results.where("source_type = 'web'"), fetch, **bounds), "metadata")
    held = got.where("error is null").select(F.col("url").alias("_url"), F.struct("content_type", "content_length", "last_modified").alias("metadata"))
    joined = results.join(held, (F.col("url") == F.col("_url")) & (F.col("source_type") == "web"), "left").drop("_url")
    return joined, got.where("error is not null").select("url", "error")
