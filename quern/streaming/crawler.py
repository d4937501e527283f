"""A crawl as a stream with state (STM-03, STM-09, JOIN-02, SET-05).

Addresses arrive as files of a folder, the frontier.  Each goes to its host's queue: map
state of the addresses seen and of those that wait, by number, and a clock with the next
time, the gap and what is left of the host's budget.  A queue lets one address through at
a time, at least the host's delay after the one before; while others wait, a
processing-time timer wakes it.  What comes through is read (here: joined with stored
links), written to ``done`` and to the frontier as the addresses one step further, so the
stream feeds itself.  Robots rules and delays are joined before the queue.

A large host may be cut into ``lanes`` by a hash of the address, each with its share of
the budget and ``lanes`` times the delay, so no host is bound to one task.

State, progress and files lie under one folder; a crawl that was stopped goes on when it is
started again.  A micro-batch that is repeated writes its files anew (``b<n>``), and an
address that arrives again is known, so nothing is read twice.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.functions import urls
from quern.plans.crawl import robots_allowed

FOUND = "url string, depth int"
#: at: milliseconds at which an address came through, null when it began to wait; waited: whether it had to.
PASSED = "host string, lane int, url string, depth int, at long, waited boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_LIMIT = (1 << 62) - 1


class HostQueue(StatefulProcessor):
    """Lets each address of a host through once, spaced by the host's delay, within a budget."""

    def __init__(self, lanes: int, budget: int | None):
        self.lanes, self.budget = lanes, NO_LIMIT if budget is None else -(-budget // lanes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "url string", "depth int")
        self.waiting = handle.getMapState("waiting", "number long", FOUND)
        self.clock = handle.getValueState("clock", "due long, gap long, left long, head long, tail long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        due, gap, left, head, tail = self.clock.get() if self.clock.exists() else (0, 0, self.budget, 0, 0)
        for r in rows:
            gap = max(gap, (r.delay or 0) * self.lanes)
            if left <= 0 or self.seen.containsKey((r.url,)):
                continue
            self.seen.updateValue((r.url,), (r.depth,))
            left -= 1
            if head == tail and due <= now:
                due = now + gap
                yield Row(host=key[0], lane=key[1], url=r.url, depth=r.depth, at=now, waited=False)
                continue
            if head == tail:
                self.handle.registerTimer(due)
            self.waiting.updateValue((tail,), (r.url, r.depth))
            tail += 1
            yield Row(host=key[0], lane=key[1], url=r.url, depth=r.depth, at=None, waited=True)
        self.clock.update((due, gap, left, head, tail))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        _, gap, left, head, tail = self.clock.get()
        if head < tail:
            url, depth = self.waiting.getValue((head,))
            self.waiting.removeKey((head,))
            self.clock.update((now + gap, gap, left, head + 1, tail))
            if head + 1 < tail:
                self.handle.registerTimer(now + gap)
            yield Row(host=key[0], lane=key[1], url=url, depth=depth, at=now, waited=True)

    def close(self) -> None:
        pass


def passed(frontier: DataFrame, rules: DataFrame | None = None, delays: DataFrame | None = None, budget: int | None = None, lanes: int = 1) -> DataFrame:
    """Addresses (see ``PASSED``) that a stream of found ones (url, depth) lets through or makes wait.

    rules: origin, kind, pattern (``quern.plans.crawl.robots_allowed``); delays: host, delay in milliseconds.
    """
    found = frontier.where("url is not null").withColumn("host", F.coalesce(urls.host(F.col("url")), F.lit("")))
    if rules is not None:
        found = robots_allowed(found.withColumn("origin", urls.origin(F.col("url"))), rules).where("allowed").drop("allowed", "origin")
    if delays is not None:
        found = found.join(delays.select("host", F.col("delay").cast("long").alias("delay")), "host", "left")
    else:
        found = found.withColumn("delay", F.lit(0).cast("long"))
    found = found.withColumn("lane", F.pmod(F.xxhash64("url"), F.lit(lanes)).cast("int"))
    queue = HostQueue(lanes, budget)
    return found.groupBy("host", "lane").transformWithState(queue, PASSED, "Append", "ProcessingTime")


def started(spark: SparkSession, links: DataFrame, folder: str, depth: int, rules: DataFrame | None = None, delays: DataFrame | None = None, budget: int | None = None, lanes: int = 1, files: int | None = None, every: str = "0 seconds") -> StreamingQuery:
    """The running crawl under ``folder``; links (src, dst) stand for reading a page.  It goes on until it is stopped."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def read(batch: DataFrame, number: int) -> None:
        at = f"{folder}/done/b{number}"
        batch.write.mode("overwrite").parquet(at)
        come = batch.sparkSession.read.schema(PASSED).parquet(at)
        if come.isEmpty():
            _removed(spark, at)
            return
        come = come.where(F.col("at").isNotNull() & (F.col("depth") < depth))
        further = come.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url"), (F.col("depth") + 1).alias("depth")).distinct()
        further.write.mode("overwrite").parquet(f"{folder}/frontier/b{number}")

    given = {} if files is None else {"maxFilesPerTrigger": str(files)}
    stream = spark.readStream.schema(FOUND).options(recursiveFileLookup="true", **given).parquet(f"{folder}/frontier")
    out = passed(stream, rules, delays, budget, lanes)
    return out.writeStream.foreachBatch(read).outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(processingTime=every).start()


def _place(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _removed(spark: SparkSession, path: str) -> None:
    p, fs = _place(spark, path)
    fs.delete(p, True)


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _place(spark, path)
    return fs.exists(p)


def begin(start: DataFrame, folder: str) -> None:
    """Put the first addresses (url) on the frontier; harmless when repeated."""
    start.select("url", F.lit(0).alias("depth")).distinct().write.mode("overwrite").parquet(f"{folder}/frontier/start")


def done(spark: SparkSession, folder: str) -> DataFrame:
    """All that came through or waits so far (see ``PASSED``)."""
    return spark.read.schema(PASSED).option("recursiveFileLookup", "true").parquet(f"{folder}/done")


def finished(spark: SparkSession, query: StreamingQuery, folder: str, seconds: float = 600) -> DataFrame:
    """Wait until no address is left or waits, stop the stream, and return (url, depth, host, at)."""
    until, seen = time.time() + seconds, -1
    while time.time() < until:
        if query.exception() is not None:
            raise query.exception()
        last = query.lastProgress
        if last is not None and last["batchId"] != seen:
            seen = last["batchId"]
            # a batch that read nothing and let nothing through: what was written before it has been read
            if last["numInputRows"] == 0 and not _exists(spark, f"{folder}/done/b{seen}") and not _waits(spark, folder):
                break
        time.sleep(0.1)
    else:
        query.stop()
        raise TimeoutError("the crawl did not end in time; start it again to go on")
    query.stop()
    return done(spark, folder).where("at is not null").select("url", "depth", "host", "at")


def _waits(spark: SparkSession, folder: str) -> bool:
    """Whether more addresses began to wait than came through after waiting."""
    held = done(spark, folder)
    return bool(held.agg(F.sum(F.when(F.col("waited"), F.when(F.col("at").isNull(), 1).otherwise(-1)).otherwise(0))).first()[0])
