"""Connected components of an edge table, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumtrail.llm.common import small
from sumtrail.session import written


def components(edges: DataFrame, a: str = "a", b: str = "b", broadcast_rows: int = 500_000) -> DataFrame:
    """(node, component) for every node of an edge, component being its smallest reachable node.

    Each round, every node points at the smallest of itself and its neighbours,
    pointers are followed once more, and edges are drawn anew between the nodes
    pointed at, until none is left. A star vanishes in one round, and every
    component at least halves. Minima are aggregated before the shuffle, so a
    node with very many links is no hot spot; the smallest node of a component
    points at itself throughout, so it is the one that remains.
    """
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    found: DataFrame | None = None
    while now.take(1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")))
        again = small(first.select(F.col("node").alias("to"), F.col("to").alias("component")), broadcast_rows)
        pointer = written(first.join(again, "to").select("node", "component"))
        table = small(pointer, broadcast_rows)
        of = lambda s, table=table: table.select(F.col("node").alias(s), F.col("component").alias(f"to_{s}"))
        moved = now.join(of("a"), "a").join(of("b"), "b").where("to_a <> to_b")
        now = written(moved.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct())
        if found is None:
            found = pointer
        else:
            found = written(found.join(of("component"), "component", "left").select(
                "node", F.coalesce("to_component", "component").alias("component")))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")) if found is None else found
