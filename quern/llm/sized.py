"""Broadcast only behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 32 << 20


def small(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``df`` marked for broadcast if its rows hold at most ``limit`` bytes, else as it is (Spark shuffles).

    The size is counted, one pass over ``df``: 16 bytes a row and column, and what strings and arrays hold as text.
    """
    text = [F.length(F.to_json(F.struct(c))) if kind.startswith(("array", "struct", "map")) else F.octet_length(c) for c, kind in df.dtypes if kind in ("string", "binary") or kind.startswith(("array", "struct", "map"))]
    held = F.lit(16 * len(df.columns)).cast("long")
    for t in text:
        held = held + F.coalesce(t, F.lit(0))
    size = df.agg(F.sum(held)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df
