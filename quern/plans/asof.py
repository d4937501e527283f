"""As-of joins by blocks of time, and requests pinned to the addresses their hosts had (PRD-30).

Both sides go through one running maximum of (time, turn) by key, so no row meets more
than one other; a key's history is dealt to tasks by blocks of time (``quern.plans.running``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import urls
from quern.plans.running import running


def asof(left: DataFrame, right: DataFrame, by: str, at: str, tie: str, width: float = 21_600.0, until: str | None = None, name: str = "held") -> DataFrame:
    """``left`` with the newest row of ``right`` (without its key) of the same key at or before its time, as a struct; null if there is none.

    Of several at one time the one with the largest ``tie`` counts.  With ``until`` a row holds before that time only,
    and older rows do not come back.  Rows without a key or a time find nothing.
    """
    held = [c for c in right.columns if c != by]
    after = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.struct(*held).alias("_r"))
    asking = F.col(by).isNotNull() & F.col(at).isNotNull()
    before = left.where(asking).select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    both = before.unionByName(after, allowMissingColumns=True)
    seconds = F.unix_micros(F.col("_at").cast("timestamp")) / 1e6 if dict(both.dtypes)["_at"].startswith("timestamp") else F.col("_at").cast("double")
    both = both.withColumn("_block", F.floor(seconds / width))
    newest = F.when(F.col("_side") == 0, F.struct("_at", "_tie", "_r"))
    found = running(both, "_by", "_block", ["_at", "_side"], {"_held": ("max", newest)}).where("_side = 1")
    kept = F.col("_held._r")
    if until is not None:
        kept = F.when(F.coalesce(F.col("_at") < kept[until], F.lit(True)), kept)
    out = found.select("_l.*", kept.alias(name))
    return out.unionByName(left.where(~asking).withColumn(name, F.lit(None).cast(out.schema[name].dataType)))


def _refused(address: Column, strict: bool) -> Column:
    """Whether an address, IPv6 ones in brackets or not, lies in a refused network."""
    place = F.when(F.contains(address, F.lit(":")), F.concat(F.lit("http://["), address, F.lit("]/"))).otherwise(F.concat(F.lit("http://"), address, F.lit("/")))
    return F.coalesce(urls.refusal(place, strict).isNotNull(), F.lit(True))


def pinned(requests: DataFrame, answers: DataFrame, strict: bool = False, width: float = 21_600.0) -> DataFrame:
    """Requests (id, host, checked_at, fetched_at) with ``address``, to which they connect, or ``refusal``.

    answers: host, at, tie, until (may be null), addresses.  A host's answer is the newest at the time of the check; it is
    refused if there is none (``unresolved``) or if any of its addresses lies in a refused network (``network``); else the
    first address is pinned.  If the answer at the time of the fetch has no such address any more, the request is refused
    (``changed``), so a name cannot be led elsewhere in between.  A null in the place of the first address is one that no
    answer holds (``changed``), one in another place is passed over.
    """
    # a fixed answer is judged once, however many requests read it
    judged = answers.select("host", "at", "tie", "until", F.posexplode_outer("addresses").alias("i", "a"))
    bad = judged.withColumn("bad", F.when(F.col("a").isNotNull(), _refused(F.col("a"), strict)))
    known = bad.groupBy("host", "at", "tie").agg(F.first("until").alias("until"), F.sort_array(F.collect_list(F.struct("i", "a"))).alias("p"), F.coalesce(F.bool_or("bad"), F.lit(False)).alias("bad"))
    known = known.select("host", "at", "tie", "until", F.transform(F.filter("p", lambda x: x.i.isNotNull()), lambda x: x.a).alias("addresses"), "bad")
    ask = requests.select("id", "host", "checked_at", "fetched_at", F.col("checked_at").alias("at"))
    checked = asof(ask, known, "host", "at", "tie", width, "until", "then")
    fetched = asof(checked.withColumn("at", F.col("fetched_at")), known, "host", "at", "tie", width, "until", "now")
    first = F.get("then.addresses", F.lit(0))
    why = (
        F.when(F.coalesce(F.size("then.addresses"), F.lit(0)) <= 0, "unresolved").when(F.col("then.bad"), "network")
        .when(~F.coalesce(F.array_contains("now.addresses", first), F.lit(False)) | F.coalesce(F.col("now.bad"), F.lit(False)), "changed")
    )
    return fetched.select("id", "host", "checked_at", "fetched_at", F.when(why.isNull(), first).alias("address"), why.alias("refusal"))
