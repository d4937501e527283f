"""Keyed state in batch form (STM-05..09, WIN-06..08, JOIN-03/06): champions, caches, breakers, throttles.

Where the state is a fold that no aggregate expresses, one key's history is folded in
time order by ``fold_by_key``; the same step functions run under Structured Streaming.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.running import previous, running

CHAMPION = "domain string, engine string, stealth boolean, wait_for int, only_main_content boolean, ewma_score double, samples int, last_verdict string, updated_at timestamp"
ALPHA, SLACK, LEAST, TTL_DAYS = 0.5, 5.0, 40, 14
# Verdicts of a wall before the page.
WALLS = ("bot_challenge", "captcha")


def engine_cost(engine: str | None, stealth: bool) -> int:
    return (1 if stealth else 0) if engine in (None, "playwright") else 2


def _ruling(champion: dict | None, seen: dict) -> str:
    """What an observation does to a champion: evict, keep, blend or replace it."""
    same = champion is not None and all(champion[k] == seen[k] for k in ("engine", "stealth"))
    walled, worth = seen["verdict"] in WALLS, seen["verdict"] == "ok" and (seen["score"] or 0) >= LEAST
    if not worth:
        return "evict" if walled and same else "keep"
    if same:
        return "blend"
    lead = float(seen["score"]) - (champion["ewma_score"] if champion else -math.inf)
    saves = champion is not None and engine_cost(seen["engine"], seen["stealth"]) < engine_cost(champion["engine"], champion["stealth"])
    return "replace" if lead > SLACK or (saves and lead >= -SLACK) else "keep"


def champion_step(champion: dict | None, seen: dict) -> dict | None:
    """A domain's champion after one observation (engine, stealth, wait_for, only_main_content, verdict, score, ts)."""
    ruling = _ruling(champion, seen)
    if ruling in ("evict", "keep"):
        return None if ruling == "evict" else champion
    update = {"ewma_score": float(seen["score"]), "samples": 1, "last_verdict": seen["verdict"], "updated_at": seen["ts"]}
    if ruling == "replace":
        return {k: seen[k] for k in ("engine", "stealth", "wait_for", "only_main_content")} | update
    mean = ALPHA * update["ewma_score"] + (1 - ALPHA) * champion["ewma_score"]
    return champion | update | {"ewma_score": mean, "samples": champion["samples"] + 1}


def fold_by_key(events: DataFrame, key: str, order: list[str], step: Callable, result: Callable, schema: str) -> DataFrame:
    """The final state of each key, folding its rows in order.

    Rows are dealt by key and sorted in the shuffle, and each partition is walked once
    in Arrow batches, so no key's history has to fit in memory.
    """
    import pyarrow as pa

    columns = events.columns

    def run(batches):
        state, at, started, out = None, None, False, []
        for batch in batches:
            for row in batch.to_pylist():
                if not started or row[key] != at:
                    if started and state is not None:
                        out.append(result(at, state))
                    state, at, started = None, row[key], True
                state = step(state, row)
            if len(out) > 1000:
                yield _batch(out)
                out = []
        if started and state is not None:
            out.append(result(at, state))
        if out:
            yield _batch(out)

    def _batch(rows):
        return pa.RecordBatch.from_pylist(rows, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return events.select(*columns).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def champions(observations: DataFrame) -> DataFrame:
    """The champion of each domain after all observations (domain, engine, stealth, wait_for, only_main_content, verdict, score, ts, seq)."""
    return fold_by_key(observations, "domain", ["ts", "seq"], champion_step, lambda k, s: {"domain": k} | s, CHAMPION)


def seeds(urls: DataFrame, known: DataFrame, now: Column, explore: float = 0.1) -> DataFrame:
    """Each URL's starting strategy: its domain's fresh champion, or the cheapest for a hashed tenth that explores."""
    fresh = known.where(F.col("updated_at") >= now - F.expr(f"interval {TTL_DAYS} days"))
    held = urls.join(fresh, "domain", "left")
    cost = F.when(F.col("engine").isNull() | (F.col("engine") == "playwright"), F.col("stealth").cast("int")).otherwise(2)
    dice = F.pmod(F.xxhash64("domain", now.cast("string")), F.lit(1000)) < int(1000 * explore)
    probe = F.col("ewma_score").isNotNull() & (cost > 0) & dice
    return held.select(*urls.columns, F.when(~probe, F.col("engine")).alias("engine"), (~probe & F.coalesce("stealth", F.lit(False))).alias("stealth"), F.when(probe, 0).otherwise(F.coalesce("wait_for", F.lit(0))).alias("wait_for"))


def _blocked(events: DataFrame, at: str, width: float) -> DataFrame:
    """``events`` with the block of time that each falls in: the part of a key's history that one task runs through."""
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6 if dict(events.dtypes)[at].startswith("timestamp") else F.col(at)
    return events.withColumn("_block", F.floor(seconds / width))


def breaker(events: DataFrame, by: str, failed: Column, empty: Column, threshold: int = 3, width: float = 86_400.0) -> DataFrame:
    """Events (by, ts, seq) with the source's runs of failures and empties so far, and its status.

    A success ends both runs, an empty answer ends failures only.  A run's length is the count so far less the count
    at its last reset, so all follows from running sums and maxima, which blocks of ``width`` seconds share out.
    """
    f, e = F.coalesce(failed, F.lit(False)), F.coalesce(~failed & empty, F.lit(False))
    marked = _blocked(events, "ts", width).withColumns({"_f": f.cast("long"), "_e": e.cast("long")})
    order = ["ts", "seq"]
    good = (F.col("_f") == 0) & (F.col("_e") == 0)
    marked = running(marked, by, "_block", order, {"_i": ("sum", F.lit(1)), "_nf": ("sum", F.col("_f")), "_ne": ("sum", F.col("_e"))})
    resets = {"_rf": ("max", F.when(F.col("_f") == 0, F.col("_nf"))), "_re": ("max", F.when(good, F.col("_ne"))), "_ri": ("max", F.when(good, F.col("_i")))}
    marked = running(marked, by, "_block", order, resets)
    marked = marked.withColumns({"consecutive_failures": F.col("_nf") - F.coalesce("_rf", F.lit(0)), "consecutive_empty": F.col("_ne") - F.coalesce("_re", F.lit(0))})
    down = F.col("consecutive_failures") >= threshold
    marked = running(marked, by, "_block", order, {"_down": ("max", F.when(down, F.col("_i")))})
    status = F.when(down, "unavailable").when((F.col("consecutive_failures") > 0) | (F.col("consecutive_empty") >= threshold), "degraded")
    status = status.when((F.col("_e") == 1) & (F.col("_down") > F.coalesce("_ri", F.lit(0))), "degraded").when(good, "healthy")
    # an empty answer below the threshold leaves the status as it was
    marked = running(marked.withColumn("_st", status), by, "_block", order, {"_known": ("max", F.when(F.col("_st").isNotNull(), F.struct("_i", "_st")))})
    return marked.withColumn("status", F.coalesce("_known._st", F.lit("healthy"))).select(*events.columns, "consecutive_failures", "consecutive_empty", "status")


def cooled(events: DataFrame, by: str, at: str = "t", cool: float = 300.0, width: float = 86_400.0) -> DataFrame:
    """Events of ``breaker`` (with ``at`` in seconds) and whether the source may be asked then: not within the cool-down after a failure that left it unavailable."""
    last = F.struct(F.col("status").alias("s"), F.col(at).alias("t"))
    held = previous(_blocked(events, at, width), by, "_block", [at, "seq"], last, "_last")
    return held.withColumn("available", F.coalesce((F.col("_last.s") != "unavailable") | (F.col(at) - F.col("_last.t") >= cool), F.lit(True))).drop("_last", "_block")


def send_times(requests: DataFrame, by: str, at: str, gap: float | Column, width: float = 86_400.0, burst: int = 1) -> DataFrame:
    """When each request (by, ``at`` in seconds, seq) may go: t_i = max(a_i, t_(i-1) + gap_i), as a running maximum.

    ``gap`` may be a column, so each host can bring the delay of its robots file; ``burst`` requests share a slot of
    ``gap`` seconds.  Histories are split by blocks of ``width`` seconds.
    """
    step = (gap if isinstance(gap, Column) else F.lit(float(gap))).cast("double")
    numbered = running(_blocked(requests, at, width).withColumn("_gap", step), by, "_block", [at, "seq"], {"_i": ("sum", F.lit(1))})
    if burst > 1:  # requests of one burst leave together, at the time of the slowest of them
        numbered = numbered.withColumn("_turn", F.floor((F.col("_i") - 1) / burst))
        paid = F.when((F.col("_i") - 1) % burst == 0, F.col("_gap")).otherwise(0.0)
    else:
        paid = F.col("_gap")
    first = F.when(F.col("_i") == 1, 0.0).otherwise(paid)
    spent = running(numbered.withColumn("_pay", first), by, "_block", [at, "seq"], {"_sum": ("sum", F.col("_pay"))})
    freed = running(spent, by, "_block", [at, "seq"], {"_free": ("max", F.col(at) - F.col("_sum"))})
    return freed.withColumn("send_at", F.col("_free") + F.col("_sum")).select(*requests.columns, "send_at")


def alerts(events: DataFrame, by: str, debounce: float = 300.0) -> DataFrame:
    """Events (by, t in seconds, seq) of which an alert goes out: the first, then none within the debounce time of the last alert.

    Rows are dealt by key and sorted in the shuffle; alerts leave as they come, so no history is kept.
    """
    import pyarrow as pa

    kinds = dict(events.dtypes)

    def run(batches):
        started, key, last = False, None, None
        for batch in batches:
            keys, times, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, (name, t) in enumerate(zip(keys, times, strict=True)):
                if not started or name != key:
                    started, key, last = True, name, None
                if last is None or t - last >= debounce:
                    last = t
                    out.append(k)
            yield batch.take(pa.array(out, pa.int64()))

    rows = events.select(by, "t", "seq").repartition(by).sortWithinPartitions(by, "t", "seq")
    return rows.mapInArrow(run, f"`{by}` {kinds[by]}, t {kinds['t']}, seq {kinds['seq']}").select(by, "t")


def latest(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last entry of each key: what a cache holds after a series of sets."""
    return entries.groupBy(key).agg(F.max_by(F.struct(*entries.columns), F.struct(*order)).alias("e")).select("e.*")


def fresh(entries: DataFrame, now: Column) -> DataFrame:
    """Entries that have not expired (strictly after their time they have)."""
    return entries.where(~(now > F.col("expires_at")))


def cache_stats(entries: DataFrame, now: Column, size: Column) -> DataFrame:
    gone = (now > F.col("expires_at")).cast("int")
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(gone), F.lit(0)).alias("expired"), F.coalesce(F.sum(1 - gone), F.lit(0)).alias("valid"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def with_previous(pages: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Pages and what the cache held for them before (previous_hash, seen)."""
    held = cached.select(key, F.col("content_hash").alias("previous_hash"), F.lit(True).alias("seen"))
    return pages.join(held, key, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def provider_chain(answers: DataFrame) -> DataFrame:
    """Per request the first provider with results, in order of priority; errors that no fallback covers fail it unless an empty answer came before.

    Columns: request, priority, provider, n_results, error_class (null, fallback, auth or fatal).
    """
    upto = Window.partitionBy("request").orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    empty = (F.col("n_results") == 0) & F.col("error_class").isNull()
    fatal = F.col("error_class") == "fatal"
    ended = F.coalesce(F.max(((F.col("n_results") > 0) | fatal).cast("int")).over(upto), F.lit(0)) == 1
    tried = answers.withColumn("_over", ended).where("not _over")
    won = F.min(F.when(F.col("n_results") > 0, F.struct("priority", "provider", "n_results")))
    return tried.groupBy("request").agg(won.alias("w"), F.max(empty.cast("int")).alias("e"), F.max(F.coalesce(fatal, F.lit(False)).cast("int")).alias("f")).select(
        "request", F.col("w.provider").alias("provider"), F.coalesce("w.n_results", F.lit(0)).alias("n_results"),
        F.when(F.col("w").isNotNull(), "answered").when(F.col("e") == 1, "empty").when(F.col("f") == 1, "failed").otherwise("exhausted").alias("outcome"),
    )


def best_attempts(attempts: DataFrame, key: str) -> DataFrame:
    """The best attempt of each key: success first, then score, the later one on ties."""
    return attempts.groupBy(key).agg(F.max_by(F.struct(*attempts.columns), F.struct("success", "score", "attempt")).alias("a"), F.count("*").alias("attempts")).select("a.*", "attempts")


def upserted(held: DataFrame, more: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A cache after a series of sets: of each key the last entry of either table."""
    return latest(held.unionByName(more), key, order)


def token_slots(requests: DataFrame, by: str, at: str, gap: float, burst: int = 3, patience: float = 30.0, hold: float = 0.0) -> DataFrame:
    """Requests (by, ``at`` in seconds, seq) with when each is sent, null where it gave up.

    At most ``burst`` requests of a source are under way (from admission until ``hold`` seconds after sending); sends go
    ``gap`` seconds apart; who is not admitted within ``patience`` seconds gives up.  Rows are dealt by source, sorted in
    the shuffle and walked once; only the slots are remembered.
    """
    import heapq

    import pyarrow as pa

    kinds = dict(requests.dtypes)

    def run(batches):
        started, source, slots, last = False, None, [], float("-inf")
        for batch in batches:
            out = []
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not started or name != source:
                    started, source, slots, last = True, name, [], float("-inf")
                admitted = t if len(slots) < burst else max(t, slots[0])
                if admitted - t > patience:
                    out.append(None)
                    continue
                if len(slots) >= burst:
                    heapq.heappop(slots)
                last = max(admitted, last + gap)
                heapq.heappush(slots, last + hold)
                out.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.float64())], names=[by, at, "seq", "sent_at"])

    rows = requests.select(by, at, "seq").repartition(by).sortWithinPartitions(by, at, "seq")
    return rows.mapInArrow(run, f"`{by}` {kinds[by]}, `{at}` {kinds[at]}, seq {kinds['seq']}, sent_at double")


def previous_versions(entries: DataFrame, key: str, order: list[str], width: float = 86_400.0) -> DataFrame:
    """Entries (with content_hash) with the hash of the version before, null for the first; equal versions in a row are one.

    The first of ``order`` is a time; a key's history is dealt by blocks of ``width`` seconds.
    """
    lagged = previous(_blocked(entries, order[0], width), key, "_block", order, F.col("content_hash"), "previous_hash")
    return lagged.where(~F.col("previous_hash").eqNullSafe(F.col("content_hash"))).drop("_block")


def pruned_cache(entries: DataFrame, now: Column, most: int | None = None) -> DataFrame:
    """Entries that have not expired, of these the newest ``most``."""
    left = fresh(entries, now)
    return left if most is None else left.orderBy(F.desc("ts"), F.desc("seq")).limit(most)
