"""Connected components of an edge table, by alternating star contractions.

Every round replaces each node's neighbourhood by links to its smallest neighbour. Only minima per node are
aggregated (partially, before the shuffle), so a node with very many neighbours is never gathered anywhere. Each
round is written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.session import Staging


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, staging: Staging) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)`` that isn't itself the smallest id of its component.

    ``component`` is the smallest id reachable. Loops and repeated edges do no harm; nulls are ignored; an empty
    table gives an empty one. Callers left-join and fall back to the node's own id.
    """
    stars = staging.write(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    before = _state(stars)
    while before[0]:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staging.write(large, "large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = staging.write(moved.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
        after = _state(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
