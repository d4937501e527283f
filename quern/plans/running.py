"""Running sums, maxima and last values of long histories, split into blocks of time, and exact medians of large groups.

A window over a key's whole history puts that history into one task.  Here a key's rows
are dealt by (key, block); each block is run through by itself, block totals (a row a
block) are run through once more, and what came before a block is added to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a kind of running value is taken over rows.
KINDS = {"sum": F.sum, "max": F.max}


def running(rows: DataFrame, by: str, block: str, order: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` with a running value up to each row for every name: (sum or max, of what).

    ``block`` must not descend along ``order``.  A sum counts null as 0, a maximum passes over it.
    """
    upto = Window.partitionBy(by, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(by, block).agg(*(KINDS[kind](c).alias(name) for name, (kind, c) in values.items()))
    before = totals.select(F.col(by).alias("_before_by"), F.col(block).alias("_before_block"), *(KINDS[kind](name).over(earlier).alias(f"_before_{name}") for name, (kind, _) in values.items()))
    local = rows.withColumns({name: KINDS[kind](c).over(upto) for name, (kind, c) in values.items()})
    joined = local.join(before, F.col(by).eqNullSafe(F.col("_before_by")) & F.col(block).eqNullSafe(F.col("_before_block")))
    kinds, whole = dict(local.dtypes), {}
    for name, (kind, _) in values.items():
        here, prior = F.col(name), F.col(f"_before_{name}")
        if kind == "sum":
            whole[name] = F.coalesce(here, F.lit(0)) + F.coalesce(prior, F.lit(0))
        else:  # greatest() knows no structs
            whole[name] = F.array_max(F.array_compact(F.array(here, prior))) if kinds[name].startswith("struct") else F.greatest(here, prior)
    return joined.withColumns(whole).drop("_before_by", "_before_block", *(f"_before_{name}" for name in values))


def previous(rows: DataFrame, by: str, block: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the value at the row just before each, null for the first; ``block`` must not descend along ``order``.

    A block's first row gets the last value of the nearest block before it, of which a key has one row each.
    """
    held = rows.withColumn("_value", F.struct(value.alias("v")))
    ends = held.groupBy(by, block).agg(F.max_by("_value", F.struct(*order)).alias("_end"))
    carried = F.lag("_end").over(Window.partitionBy(by).orderBy(block))
    ends = ends.select(F.col(by).alias("_end_by"), F.col(block).alias("_end_block"), carried.alias("_carried"))
    inside = held.withColumn("_lag", F.lag("_value").over(Window.partitionBy(by, block).orderBy(*order)))
    joined = inside.join(ends, F.col(by).eqNullSafe(F.col("_end_by")) & F.col(block).eqNullSafe(F.col("_end_block")))
    return joined.withColumn(name, F.coalesce("_lag", "_carried")["v"]).drop("_value", "_lag", "_end_by", "_end_block", "_carried")


def medians(rows: DataFrame, by: list[str], value: str, rounds: int = 2, buckets: int = 1024) -> DataFrame:
    """(by, median): the exact median of each group's values that are not null.

    Equal values are counted before anything moves.  Each round keeps of a group the one or two of ``buckets`` ranges
    that hold the middle, so in the end a few distinct values of each group meet.
    """
    left = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    same = lambda names: [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names]
    # (rows below what is left, rows at all, range of what is left) of each group
    state = left.groupBy(*by).agg(F.lit(0).cast("long").alias("_skip"), F.sum("_n").alias("_all"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    low, high = F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)
    for _ in range(rounds):
        place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets), F.lit(buckets - 1))).otherwise(0)
        placed = left.alias("l").join(state.alias("r"), same(by)).select("l.*", "r._skip", "r._all", place.cast("long").alias("_b"))
        counts = placed.groupBy(*by, "_b").agg(F.sum("_n").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("_skip").alias("_skip"), F.first("_all").alias("_all"))
        to = F.sum("_m").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_skip")  # at most `buckets` rows a group
        counts = counts.withColumn("_to", to).where((F.col("_to") > low) & (F.col("_to") - F.col("_m") <= high))
        chosen = counts.groupBy(*by).agg(F.min(F.col("_to") - F.col("_m")).alias("_skip"), F.first("_all").alias("_all"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        left = left.alias("l").join(chosen.alias("r"), same(by)).where("l._v between r._lo and r._hi").select("l.*")
        state = chosen
    held = left.alias("l").join(state.alias("r"), same(by)).select("l.*", "r._skip", "r._all")
    to = F.sum("_n").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_skip")
    held = held.withColumn("_to", to)
    at = lambda k: F.min(F.when(F.col("_to") > k, F.col("_v")))
    return held.groupBy(*by).agg(((at(low) + at(high)) / 2).alias("median"))
