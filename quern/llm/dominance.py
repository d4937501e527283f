"""Operator 11: for each row, how many others stand at a smaller slot and a strictly larger level.

1. Rows are range-partitioned by descending level (and descending slot within a level)
   into bands, as many as the session has shuffle partitions.
2. Each band is swept in that order with a Fenwick tree over *ranges* of slots; ranges
   hold about equal numbers of rows, and a slot with more than a range's share is one
   by itself.  A row asks for what stands in smaller ranges, then it is put in.  At its
   end a band writes its histogram over the ranges.
3. The histograms of all higher bands, summed range by range, count what stands in
   higher bands and smaller ranges.
4. What is left stands in a row's own range: rows are dealt out by range and swept once
   more by descending level, with a Fenwick tree over the slots of that range.  The sums
   of step 3 travel with them.  In a range of one slot nothing is left to count, so its
   rows are dealt to ``SALTS`` parts.

A histogram over ranges instead of slots keeps what the bands hand on at bands x ranges,
whatever the number of slots.  Rows of one level come by descending slot, so each is asked
about before any row of its level with a smaller slot is put in: equal levels never count,
also where a level runs over several bands.  Both sweeps stream sorted rows and keep one
tree; the driver sees the ``RANGES`` cut points and nothing else.

Defined results: a row whose slot or level is null is above none and its counts are null;
a null weight counts as 0 rows; repeated rows count as often as they stand there; an empty
table gives an empty one.  Counts are 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.scratch import materialize

RANGES = 1024
SALTS = 32
TILE = 512


class Fenwick:
    """Sums of counts and of weights over places 0 to size - 1, asked and filled for many places at once."""

    def __init__(self, size: int):
        self.size = size
        self.sums = np.zeros((size + 2, 2), np.int64)  # the last cell takes what runs over
        self.steps = max(1, size.bit_length())

    def below(self, places: np.ndarray) -> np.ndarray:
        """(count, weight) of all places smaller than each given one."""
        at = places.copy()
        out = np.zeros((len(at), 2), np.int64)
        for _ in range(self.steps):
            out += self.sums[at]
            at &= at - 1
        return out

    def put(self, places: np.ndarray, weights: np.ndarray) -> None:
        at = places + 1
        values = np.stack([np.ones_like(weights), weights], axis=1)
        for _ in range(self.steps + 1):
            np.add.at(self.sums, at, values)
            at = np.minimum(at + (at & -at), self.size + 1)

    def swept(self, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """(count, weight) of rows that came before each row, also of this call, with a smaller place; then all are in."""
        out = np.zeros((len(places), 2), np.int64)
        for a in range(0, len(places), TILE):
            p, w = places[a : a + TILE], weights[a : a + TILE]
            out[a : a + TILE] = self.below(p)
            earlier = np.tril(p[None, :] < p[:, None], -1)
            out[a : a + TILE, 0] += earlier.sum(axis=1)
            out[a : a + TILE, 1] += earlier @ w
            self.put(p, w)
        return out

    def totals(self) -> np.ndarray:
        """(count, weight) below each place."""
        return self.below(np.arange(self.size, dtype=np.int64))


def edges_of(cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(lower ends of ranges 1.., whether each range from 0 is of one slot); a cut that is repeated is one by itself."""
    values, times = np.unique(np.array(cuts, np.int64), return_counts=True)
    ends = set((values + 1).tolist()) | set(values[times > 1].tolist())
    ends = np.array(sorted(ends), np.int64)
    single = np.zeros(len(ends) + 1, bool)
    single[1:-1] = np.diff(ends) == 1
    return ends, single


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _bands(ends: np.ndarray, single: np.ndarray, id_type: pa.DataType):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, seen = TaskContext.get().partitionId(), 0
        tree = Fenwick(len(single))
        for batch in batches:
            n = batch.num_rows
            slots, weights = _ints(batch, "slot"), _ints(batch, "weight")
            ranges = np.searchsorted(ends, slots, side="right")
            found = tree.swept(ranges, weights)
            salts = np.where(single[ranges], (seen + np.arange(n)) % SALTS, 0)
            seen += n
            yield pa.RecordBatch.from_pydict(
                {"kind": pa.array(np.full(n, 2, np.int32)), "range": pa.array(ranges.astype(np.int32)), "salt": pa.array(salts.astype(np.int32)), "band": pa.array(np.full(n, band, np.int32)),
                 "id": batch.column("id"), "slot": batch.column("slot"), "level": batch.column("level"), "weight": batch.column("weight"), "n": pa.array(found[:, 0]), "w": pa.array(found[:, 1])}
            )
        if seen:
            n, below = len(single), tree.totals()
            yield pa.RecordBatch.from_pydict(
                {"kind": pa.array(np.zeros(n, np.int32)), "range": pa.array(np.arange(n, dtype=np.int32)), "salt": pa.array(np.zeros(n, np.int32)), "band": pa.array(np.full(n, band, np.int32)),
                 "id": pa.nulls(n, id_type), "slot": pa.nulls(n, pa.int64()), "level": pa.nulls(n, pa.int64()), "weight": pa.nulls(n, pa.int64()), "n": pa.array(below[:, 0]), "w": pa.array(below[:, 1])}
            )

    return sweep


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order of kind: sums of higher bands, slots, then rows by descending level."""
    now, above, slots, tree = None, [], [], None
    for batch in batches:
        keys = np.stack([_ints(batch, c) for c in ("range", "salt", "kind")], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            part = batch.slice(a, b - a)
            if now != tuple(keys[a, :2]):
                now, above, slots, tree = tuple(keys[a, :2]), [], [], None
            if keys[a, 2] == 0:
                above.append(np.stack([_ints(part, c) for c in ("band", "n", "w")], axis=1))
                continue
            if keys[a, 2] == 1:
                slots.append(_ints(part, "slot"))
                continue
            if tree is None:
                held = np.concatenate(above)
                sums = np.zeros((held[:, 0].max() + 1, 2), np.int64)
                sums[held[:, 0]] = held[:, 1:]
                places = np.sort(np.concatenate(slots)) if slots else np.empty(0, np.int64)
                tree = Fenwick(len(places))
            found = sums[_ints(part, "band")] + np.stack([_ints(part, "n"), _ints(part, "w")], axis=1)
            if len(places):
                found += tree.swept(np.searchsorted(places, _ints(part, "slot")), _ints(part, "weight"))
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "slot": part.column("slot"), "level": part.column("level"), "n_above": pa.array(found[:, 0]), "n_rows": pa.array(found[:, 1])})


def dominated(rows: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(id, slot, level, n_above, n_rows) of ``rows`` (id, slot, level, weight): rows above each one, and the sum of their weights."""
    given = rows.select("id", F.col("slot").cast("long"), F.col("level").cast("long"), F.coalesce(F.col("weight").cast("long"), F.lit(0).cast("long")).alias("weight"))
    whole = given.where("slot is not null and level is not null")
    kind = given.schema["id"].dataType.simpleString()
    cuts = whole.agg(F.percentile_approx("slot", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or []
    ends, single = edges_of(cuts)
    order = [F.col("level").desc(), F.col("slot").desc(), F.col("id")]
    schema = f"kind int, range int, salt int, band int, id {kind}, slot long, level long, weight long, n long, w long"
    banded = whole.repartitionByRange(*order).sortWithinPartitions(*order)
    banded = materialize(banded.mapInArrow(_bands(ends, single, _arrow(given.schema["id"].dataType)), schema), "bands")
    higher = Window.partitionBy("range").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    sums = banded.where("kind = 0").select("range", "band", *(F.coalesce(F.sum(c).over(higher), F.lit(0).cast("long")).alias(c) for c in ("n", "w")))
    alone = [int(k) for k in np.flatnonzero(single)]
    salts = F.when(F.col("range").isin(alone), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    sums = sums.withColumn("kind", F.lit(0)).withColumn("salt", F.explode(salts))
    slots = banded.where((F.col("kind") == 2) & ~F.col("range").isin(alone)).select("range", "slot").distinct().withColumns({"kind": F.lit(1), "salt": F.lit(0)})
    swept = banded.where("kind = 2").unionByName(sums, allowMissingColumns=True).unionByName(slots, allowMissingColumns=True)
    swept = swept.repartition("range", "salt").sortWithinPartitions("range", "salt", "kind", F.col("level").desc(), F.col("slot").desc())
    found = swept.mapInArrow(_ranges, f"id {kind}, slot long, level long, n_above long, n_rows long")
    rest = given.where("slot is null or level is null").select("id", "slot", "level", F.lit(None).cast("long").alias("n_above"), F.lit(None).cast("long").alias("n_rows"))
    return found.union(rest)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def minute_of(name: str, kind: T.DataType) -> Column:
    """Whole minutes since 1970 of a time column taken as UTC, in any session zone."""
    at = F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.floor(F.unix_seconds(at) / 60)
    return F.unix_date(F.to_date(at)).cast("long") * 1440 + F.hour(at) * 60 + F.minute(at)


def sales_above(sales: DataFrame) -> DataFrame:
    """(sale_id, slot, level, n_sales, n_rows): for each sale those at an earlier minute and a strictly larger total.

    A level is the total in rounded cents; a total that is no number has none.  A sale stands for 1 to 5 rows by a
    hash of its id; without an id, for one.
    """
    level = F.when(~F.isnan("total"), F.floor(F.floor(F.col("total") * 100 + 0.5) / 1))
    copies = 1 + F.pmod(F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    rows = sales.select(F.col("sale_id").alias("id"), minute_of("sold_at", sales.schema["sold_at"].dataType).alias("slot"), level.cast("long").alias("level"), copies.alias("weight"))
    return dominated(rows).select(F.col("id").alias("sale_id"), "slot", "level", F.col("n_above").alias("n_sales"), "n_rows")
