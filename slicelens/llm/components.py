"""Connected components by alternating large and small stars.

Both steps only take minima of neighbours by aggregation and join them back,
so no node's neighbours are gathered, and the number of edges never grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicelens.llm.common import contained, stage


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("least"))


@contained
def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``id, component`` of every id in ``edges`` (``a, b``): the smallest id it reaches.

    Edges have no direction; loops and repeats do no harm. Ids on no edge have no row.
    """
    edges = stage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = (
            both.filter("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        )
        large = stage(large, "large-star")
        joined = large.join(_least(large), "a")
        small = joined.select("a", F.col("least").alias("b")).union(
            joined.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        )
        edges = stage(small.distinct(), "small-star")
        # Settled once no id points at two others, and none that is pointed at points on.
        n, ids = edges.agg(F.count("*"), F.count_distinct("a")).first()
        if n == ids and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # These edges are stars: every id points at its component's smallest.
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
