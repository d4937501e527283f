"""Keyed state under Structured Streaming: the batch folds of ``quern.plans.states`` on unbounded input.

Additions of our own, not parity: an event-time watermark and tumbling success rates.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.plans import states, telemetry
from quern.plans.running import previous, running

_STATE = "engine string, stealth boolean, wait_for int, only_main_content boolean, ewma_score double, samples int, last_verdict string, updated_at timestamp"
_FIELDS = [c.split()[0] for c in _STATE.split(", ")]


def champion_stream(observations: DataFrame) -> DataFrame:
    """Each domain's champion after every micro-batch that saw it (update mode); none while it has none.

    A domain's state is one row, and observations of a micro-batch are folded in order.
    """

    def run(key, frames, state: GroupState):
        champion = dict(zip(_FIELDS, state.get, strict=True)) if state.exists else None
        for frame in frames:
            for row in frame.sort_values(["ts", "seq"]).astype(object).where(lambda x: x.notna(), None).to_dict("records"):
                champion = states.champion_step(champion, row)
        if champion is None:
            if state.exists:
                state.remove()
            return
        state.update(tuple(champion[f] for f in _FIELDS))
        yield pd.DataFrame([{"domain": key[0]} | champion])[["domain", *_FIELDS]]

    return observations.groupBy("domain").applyInPandasWithState(run, f"domain string, {_STATE}", _STATE, "update", GroupStateTimeout.NoTimeout)


def hourly_success(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tumbling success rates of a telemetry stream; events later than ``late`` are dropped."""
    return telemetry.windowed_success(events.withWatermark("ts", late))


def append_events(events: DataFrame, path: str, checkpoint: str):
    """A streaming query that appends events to a JSON-lines log."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Parts by key that a cache is kept in; a micro-batch rewrites those that it touches.
BUCKETS = 64


def upsert_cache(entries: DataFrame, path: str, checkpoint: str, key: str = "key", order: tuple[str, ...] = ("ts", "seq"), buckets: int = BUCKETS):
    """A streaming query that keeps the last entry of each key.

    A micro-batch is merged with the buckets that hold its keys, into new files of these alone; a version file, written
    last, says which files each bucket has.  What the newest two versions do not name goes.  A repeated batch writes
    its version anew, so a restart leaves the same cache.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = _version(spark, path, number)
        keyed = batch.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = sorted(r[0] for r in keyed.select("_b").distinct().collect())  # as many as there are buckets
        if not touched:
            return
        held = [last[b] for b in touched if b in last]
        if held:
            old = spark.read.schema(batch.schema).parquet(*[f"{path}/{p}" for p in held])
            keyed = keyed.unionByName(old.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        states.latest(keyed, key, list(order)).write.mode("overwrite").partitionBy("_b").parquet(f"{path}/data/v={number}")
        _publish(spark, path, number, last | {b: f"data/v={number}/_b={b}" for b in touched})

    return entries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark, path: str) -> list[int]:
    folder, fs = _folder(spark, f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def _version(spark, path: str, before: int | None = None) -> dict[int, str]:
    """The files of each bucket by the newest version (before a number)."""
    known = [n for n in _versions(spark, path) if before is None or n < before]
    if not known:
        return {}
    said = "".join(r[0] for r in spark.read.text(f"{path}/versions/{known[-1]}.json").collect())
    return {int(b): p for b, p in json.loads(said).items()}


def _publish(spark, path: str, number: int, files: dict[int, str]) -> None:
    """Write a version under another name first, then delete what it and the one before do not need."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder, fs = _folder(spark, f"{path}/versions")
    out = fs.create(made(f"{path}/versions/_{number}"), True)
    out.write(bytearray(json.dumps(files).encode()))
    out.close()
    fs.delete(made(f"{path}/versions/{number}.json"), False)
    fs.rename(made(f"{path}/versions/_{number}"), made(f"{path}/versions/{number}.json"))
    kept = _versions(spark, path)[-2:]
    needed = {p for n in kept for p in _version(spark, path, n + 1).values()}
    for n in set(_versions(spark, path)) - set(kept):
        fs.delete(made(f"{path}/versions/{n}.json"), False)
    for v in fs.listStatus(made(f"{path}/data")):
        name = v.getPath().getName()
        for b in fs.listStatus(v.getPath()):
            part = b.getPath().getName()
            if part.startswith("_b=") and f"data/{name}/{part}" not in needed:
                fs.delete(b.getPath(), True)
        if not any(b.getPath().getName().startswith("_b=") for b in fs.listStatus(v.getPath())):
            fs.delete(v.getPath(), True)


def cache_version(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a cache (before a number), None without one."""
    files = _version(spark, path, before)
    return spark.read.parquet(*[f"{path}/{p}" for _, p in sorted(files.items())]) if files else None


def crawl_queue(urls: DataFrame, handle, checkpoint: str):
    """A streaming query that hands each micro-batch of new addresses, once each, to ``handle(df, batch_id)``."""
    fresh = urls.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["url"])
    return fresh.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(snapshots: DataFrame, n: int = 3, width: float = 86_400.0) -> DataFrame:
    """First time at which a page's last ``n`` snapshots (url, ts, hash) were the same (batch form).

    A run's length is the count so far less the count before its first snapshot; histories are dealt by blocks of
    ``width`` seconds.  ``ts`` may be a struct that begins with a time.
    """
    kind = snapshots.schema["ts"].dataType
    at = F.col("ts")[kind.names[0]] if isinstance(kind, T.StructType) else F.col("ts")
    blocked = states._blocked(snapshots.withColumn("_at", at), "_at", width)
    marked = previous(blocked, "url", "_block", ["ts"], F.col("hash"), "_was")
    marked = running(marked, "url", "_block", ["ts"], {"_i": ("sum", F.lit(1))})
    changed = F.when((F.col("_i") == 1) | ~F.col("_was").eqNullSafe(F.col("hash")), F.col("_i"))
    marked = running(marked, "url", "_block", ["ts"], {"_from": ("max", changed)})
    return marked.where(F.col("_i") - F.col("_from") + 1 >= n).groupBy("url").agg(F.min("ts").alias("settled_at"))
