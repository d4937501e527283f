"""Connected components of an edge table, by alternating star operations.

Each round rewrites edges so that every node points at the smallest node it can
see (large-star, then small-star); rounds end when the edges are stars, which one
grouped count tells before a round is run.  The number of rounds grows with the
logarithm of a component's size.  Edges point from the larger node to the smaller,
so what a node sees below it is a grouped minimum of its own edges.  A round is
three shuffles: minima, edges by their smaller end, edges by their larger end.
Joins stream sorted rows against one row a node, so no group is held by a task, and
lineage is cut by a written table each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.scratch import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """(k, m): the smallest node that each edge's larger end is joined to."""
    return edges.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).hint("merge")


def _large(edges: DataFrame) -> DataFrame:
    """The larger end of each edge is joined to the smallest node that the smaller end sees."""
    return edges.join(_least(edges), F.col("b") == F.col("k"), "left").select("a", F.coalesce("m", "b").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours and itself are joined to the smallest of them; there are never more edges than before."""
    edges = edges.repartition("a").distinct()  # one shuffle for distinct rows, minima and the join
    return edges.join(_least(edges), F.col("a") == F.col("k")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def _unsettled(edges: DataFrame) -> tuple[int, int]:
    """How many nodes see two smaller ones, or a smaller and a larger one; how many edges repeat one."""
    ends = edges.select(F.col("a").alias("k"), F.col("b").alias("o")).union(edges.select("b", F.lit(None).cast(edges.schema["b"].dataType)))
    nodes = ends.groupBy("k").agg(F.min("o").alias("lo"), F.max("o").alias("hi"), F.count("o").alias("below"), F.count("*").alias("all"))
    wrong = (F.col("lo") != F.col("hi")) | ((F.col("below") > 0) & (F.col("all") > F.col("below")))
    return tuple(nodes.agg(F.count_if(wrong), F.count_if(F.col("below") > 1)).first())


def stars(edges: DataFrame, known: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """Written rows (a, b), one for each node of ``edges`` that is not its component's smallest: the node, and that smallest one.

    ``known`` is an earlier result, which the edges are added to.  Edges with a null end or with equal ends are ignored.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(now if known is None else now.union(known), "edges")
    for turn in range(max_rounds):
        # edges that add to stars leave none of them as it is
        wrong, repeated = (1, 0) if not turn and known is not None else _unsettled(now)
        if not wrong and not repeated:
            return now
        then = materialize(_small(_large(now)) if wrong else now.distinct(), "edges")
        discard(now)
        now = then
    raise RuntimeError("components did not settle")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the component's smallest node.

    Edges with a null end or with equal ends are ignored; repeated edges are harmless.
    """
    found = stars(edges, max_rounds=max_rounds)
    return found.toDF("node", "root").union(found.select("b", "b").distinct())
