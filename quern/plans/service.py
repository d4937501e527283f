"""Rules around a fetch or a search: escalation, prompts, paging, projections (STM-10/12, MSC-03/04/11/19, TOP-04/05/08, AGG-15, JOIN-11, PRJ-37, STR-24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that a prompt loses on its way to a search query (also inside other words).
INSTRUCTIONS = ["find", "get", "extract", "gather", "collect", "the", "all", "from"]
MOST_ATTEMPTS = 3


def next_step(engine: Column, stealth: Column, http1: Column, pinned: Column, http2_error: Column) -> Column:
    """The next stronger strategy after an attempt, null at the ladder's end.

    A pinned engine stays, but for an HTTP/2 fault, with which it cannot connect at all.
    """
    strong = F.coalesce(engine, F.lit("playwright")) == "camoufox"
    last = F.when(~http1, "camoufox + HTTP/1.1")
    return (
        F.when(http2_error, F.when(~strong, "camoufox").otherwise(last))
        .when(pinned, None)
        .when(~strong & ~stealth, "patchright (stealth)")
        .when(~strong, "camoufox")
        .otherwise(last)
    )


def escalates(verdict: Column, attempt: Column) -> Column:
    """Whether a stronger fetch may help and is still allowed."""
    from quern.functions.quality import ESCALATE

    return verdict.isin(ESCALATE) & (attempt <= MOST_ATTEMPTS)


def prompt_query(prompt: Column) -> Column:
    """A search query of at most 100 characters from a prompt."""
    said = F.lower(prompt)
    for word in INSTRUCTIONS:
        said = F.replace(said, F.lit(word), F.lit(" "))
    return F.substring(F.trim(F.regexp_replace(said, r"\s+", " ")), 1, 100)


def failure_text(verdict: Column, reasons: Column, advice: Column) -> Column:
    """What a caller is told about a verdict without usable content."""
    from quern.functions.quality import usable

    why = F.coalesce(F.nullif(F.array_join(reasons, "; "), F.lit("")), verdict)
    return F.when(~usable(verdict), F.concat_ws(" ", F.concat(F.lit("No usable content ("), verdict, F.lit("): "), why, F.lit(".")), advice))


def job_page(items: DataFrame, job: str, order: str, offset: int, size: int = 10) -> DataFrame:
    """Items ``offset`` to ``offset + size`` of each job, with their place ``i``."""
    at = F.row_number().over(Window.partitionBy(job).orderBy(order)) - 1
    return items.withColumn("i", at).where((F.col("i") >= offset) & (F.col("i") < offset + size))


def probed_images(candidates: DataFrame, most: int = 40) -> DataFrame:
    """Each page's images to measure (page_id, url, hint): the widest hints, those without one first."""
    order = Window.partitionBy("page_id").orderBy(F.desc(F.coalesce(F.nullif("hint", F.lit(0)), F.lit(1_000_000))), "url")
    return candidates.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")


def image_order(width: Column, height: Column, icon: Column) -> list[Column]:
    """Sort keys of measured images: icons last, larger areas first; a missing height counts as the width."""
    return [icon, F.desc(width * F.coalesce(F.nullif(height, F.lit(0)), width))]


def most_common(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The most common value of each group, the smaller on ties."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.max_by(F.col(value), F.struct("n", -F.col(value))).alias("value"))


def heading_level(size: Column, body: Column) -> Column:
    """Heading level of a line by its font size over the body's: 1.8, 1.4, 1.15 times."""
    ratio = size / body
    return F.when(ratio >= 1.8, 1).when(ratio >= 1.4, 2).when(ratio >= 1.15, 3)


def field_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ between two versions, with both."""
    a, b = old.select(key, F.col(value).alias("previous")), new.select(key, F.col(value).alias("current"))
    return a.join(b, key, "full").where(~F.col("previous").eqNullSafe(F.col("current")))


def sources(asked: Column) -> Column:
    """Known sources of a search request; web when there are none."""
    known = F.filter(F.coalesce(asked, F.array().cast("array<string>")), lambda s: s.isin("web", "images", "news"))
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("web")))


def buckets(results: Column) -> Column:
    """Results (with source_type) by source."""
    of = lambda source: F.filter(results, lambda r: r["source_type"] == source).alias(source)
    return F.struct(*map(of, ("web", "images", "news")))


def capped(column: Column, most: int) -> Column:
    """Text of at most ``most`` characters, and a note where it was cut."""
    return F.when(F.char_length(column) > most, F.concat(F.substring(column, 1, most), F.lit("\n\n[cut]"))).otherwise(column)


def search_limit(asked: Column) -> Column:
    return F.least(F.greatest(asked, F.lit(1)), F.lit(10))


def empty_with_dead_engines(results: Column, dead: Column) -> Column:
    """Whether an empty answer is an error: engines did not respond."""
    return (F.size(results) == 0) & (F.size(dead) > 0)


def extracted(items: DataFrame, job: str) -> DataFrame:
    """Whether all of a job's items succeeded, and their data in order."""
    return items.groupBy(job).agg(F.bool_and("success").alias("success"), F.transform(F.array_sort(F.collect_list(F.struct("ix", "data"))), lambda x: x["data"]).alias("data"))


def batch_counts(results: DataFrame) -> DataFrame:
    good = F.sum(F.col("success").cast("int"))
    return results.agg(F.count("*").alias("total"), good.alias("succeeded"), (F.count("*") - good).alias("failed"))


def unkeyed_empty(results: Column, providers: Column) -> Column:
    """Whether an empty answer is an error: no usable provider has a key (only the keyless one is left)."""
    return (F.size(results) == 0) & ~F.exists(providers, lambda p: p != "duckduckgo")


ACTIVE, JOB_TTL = 3, 86_400


def admitted(jobs: DataFrame, most: int = ACTIVE, ttl: int = JOB_TTL) -> DataFrame:
    """Jobs (job, created, ended, in seconds; ended null while running) with whether each was let in.

    A job is refused while ``most`` of those let in before it are still running; an expired one (``ttl`` after its
    creation) no longer counts.  Requests are walked in order of creation, and only running jobs are remembered.
    """
    import pyarrow as pa

    def run(batches):
        running: list[float] = []
        for batch in batches:
            created, ended, out = batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
            for c, e in zip(created, ended, strict=True):
                running = [t for t in running if t > c]
                ok = len(running) < most
                if ok:
                    running.append(min(c + ttl, c + ttl if e is None else e))
                out.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.bool_())], names=["job", "created", "ended", "admitted"])

    # one list of requests, as one server keeps it
    rows = jobs.select(F.col("job").cast("long"), F.col("created").cast("double"), F.col("ended").cast("double")).repartition(1).sortWithinPartitions("created", "job")
    return rows.mapInArrow(run, "job long, created double, ended double, admitted boolean")


def job_status(jobs: DataFrame, now: float, ttl: int = JOB_TTL) -> DataFrame:
    """Jobs that have not expired (job, created, total, done, failed, cancelled) and their status."""
    status = F.when(F.col("cancelled"), "cancelled").when(F.col("failed"), "failed").when(F.col("done") >= F.col("total"), "completed").otherwise("scraping")
    return jobs.where(F.col("created") + ttl > now).withColumn("status", status)


def batch_attempts(attempts: DataFrame, retry: int, continue_on_error: bool = True) -> DataFrame:
    """Each address's outcome (ix, url, success, attempts, error) from its attempts (ix, url, attempt, success, error).

    Attempts end with the first success or after ``retry``; the last error speaks for a failure.  Without
    ``continue_on_error`` what comes after the first failed address is cancelled.
    """
    tried = attempts.where(F.col("attempt") <= max(1, retry))
    won = F.min(F.when(F.col("success"), F.col("attempt")))
    out = tried.groupBy("ix", "url").agg(won.alias("_won"), F.max("attempt").alias("_last"), F.max_by("error", "attempt").alias("error"))
    out = out.select("ix", "url", F.col("_won").isNotNull().alias("success"), F.coalesce("_won", "_last").alias("attempts"), F.when(F.col("_won").isNull(), F.col("error")).alias("error"))
    if continue_on_error:
        return out
    first = out.where("not success").agg(F.min("ix").alias("_first"))  # one row
    late = F.coalesce(F.col("ix") > F.col("_first"), F.lit(False))
    cut = out.join(F.broadcast(first), how="cross")
    return cut.select("ix", "url", (F.col("success") & ~late).alias("success"), F.when(late, 0).otherwise(F.col("attempts")).alias("attempts"), F.when(late, "cancelled").otherwise(F.col("error")).alias("error"))


# Words for a hosted proxy pool, which there is none of.
POOLS = ("basic", "enhanced", "auto")


def translated(request: DataFrame) -> DataFrame:
    """Requests of the second interface in our units: ages in seconds, no cache as age 0, pool names no proxy, a device for mobile."""
    age = F.when(~F.coalesce("store_in_cache", F.lit(True)), 0).otherwise(F.floor(F.col("max_age") / 1000))
    proxy = F.when(~F.lower("proxy").isin(*POOLS), F.col("proxy"))
    return request.withColumns({"max_age": age.cast("long"), "proxy": proxy, "device": F.when(F.col("mobile"), "iPhone 14")})


def ordered_first_failure(results: DataFrame) -> DataFrame:
    """Results in order of ``ix``, or the first failure alone if there is one."""
    failed = results.where("error is not null").agg(F.min("ix").alias("_ix"))
    return results.join(F.broadcast(failed), how="cross").where(F.col("_ix").isNull() | (F.col("ix") == F.col("_ix"))).drop("_ix").orderBy("ix")


def page_title(og_title: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(og_title), F.lit("")), title)


def healthy(results: Column, least: int = 3) -> Column:
    """Whether a probe's answer shows a working search; probes stay out of the record of recent searches."""
    return F.size(results) >= least


def action_markdown(results: Column) -> Column:
    """What page actions returned (kind, value) as markdown: headings for texts, fences for script results."""
    said = F.transform(results, lambda r: F.when(r["kind"] == "scrape", r["value"]).when(r["kind"] == "javascript", F.concat(F.lit("```json\n"), r["value"], F.lit("\n```"))))
    return F.array_join(F.array_compact(said), "\n\n")


def wire(provider: Column, model: Column, prompt: Column) -> Column:
    """A chat request as JSON in the form of a provider: ollama, openai or anthropic."""
    messages = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    return (
        F.when(provider == "ollama", F.to_json(F.struct(model.alias("model"), messages.alias("messages"), F.lit(False).alias("stream"))))
        .when(provider == "openai", F.to_json(F.struct(model.alias("model"), messages.alias("messages"))))
        .when(provider == "anthropic", F.to_json(F.struct(model.alias("model"), F.lit(4096).alias("max_tokens"), messages.alias("messages"))))
    )


def correlated(error: Column, seed: Column) -> Column:
    """An error's text with an id to find it by: eight digits of a hash of what was asked."""
    return F.concat(error, F.lit(" [correlation_id="), F.substring(F.sha2(seed, 256), 1, 8), F.lit("]"))


def strategy_label(engine: Column, stealth: Column, http1: Column) -> Column:
    """How an attempt was made, in words."""
    name = F.when((F.coalesce(engine, F.lit("playwright")) == "playwright") & stealth, "patchright (stealth)").otherwise(F.coalesce(engine, F.lit("playwright")))
    return F.concat(name, F.when(http1, " + HTTP/1.1").otherwise(""))


def attempt_trail(attempts: DataFrame, key: str) -> DataFrame:
    """Each request's attempts in order (label: verdict), the best one, and whether it was escalated."""
    label = F.concat(strategy_label(F.col("engine"), F.col("stealth"), F.col("http1")), F.lit(": "), "verdict")
    told = F.array_sort(F.collect_list(F.struct("attempt", label.alias("said"))))
    best = F.max_by("attempt", F.struct((F.col("verdict") == "ok").alias("ok"), "score", "attempt"))
    return attempts.groupBy(key).agg(F.array_join(F.transform(told, lambda t: t["said"]), "; ").alias("trail"), best.alias("best"), (F.count("*") > 1).alias("escalated"))


def summary_words(asked: Column, default: int = 120, most: int = 1000) -> Column:
    """How many words a summary may have."""
    return F.least(F.greatest(F.coalesce(asked, F.lit(default)), F.lit(1)), F.lit(most))


def visited(queries: DataFrame, results: DataFrame, pages: DataFrame, steps: int = 10, most: int = 30_000) -> DataFrame:
    """What an agent reads for each query (search): the first ``steps`` distinct addresses that were read, their text cut to ``most``."""
    order = Window.partitionBy("search").orderBy("i")
    first = results.groupBy("search", "url").agg(F.min("i").alias("i")).join(queries, "search", "left_semi")
    first = first.withColumn("step", F.row_number().over(order)).where(F.col("step") <= steps)
    return first.join(pages.select("url", F.substring("markdown", 1, most).alias("excerpt")), "url").select("search", "step", "url", "excerpt")


def engine_names(dead: Column) -> Column:
    """Names of engines that did not answer, from names or (name, reason) pairs as text."""
    return F.array_distinct(F.filter(F.transform(dead, lambda d: F.trim(F.regexp_extract(d, r"^\s*\[?\s*[\"']?([^,\"'\]]*)", 1))), lambda d: d != ""))


def without_credentials(url: Column) -> Column:
    """(url without user and password, user, password)."""
    p = r"^([a-zA-Z][a-zA-Z0-9+.-]*://)(?:([^/?#@:]*)(?::([^/?#@]*))?@)?(.*)$"
    part = lambda k: F.regexp_extract(url, p, k)
    return F.struct(F.concat(part(1), part(4)).alias("url"), F.nullif(part(2), F.lit("")).alias("user"), F.nullif(part(3), F.lit("")).alias("password"))
