"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogops.plans.durable import durable


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root at most, and no root hangs on another node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    # Sums combine before the shuffle, so hubs are no hot spot.
    hangs = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n"))
    return hangs.where("ups > 1 OR (ups = 1 AND n > 1)").isEmpty()


def _hung(pairs: DataFrame) -> DataFrame:
    """Least neighbour of every node; a minimum combines before the shuffle, so hubs are no hot spot."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component.

    The rounds needed grow with the logarithm of the component's size. Each round writes the
    edges once; a round never has more edges than the one before. Nodes may be of any type that
    sorts. Null ends and loops are no edges.
    """
    edges = durable(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(),
        "edges",
    )
    while not _settled(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = durable(
            both.join(_hung(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large"
        )
        small = large.join(_hung(large), "u")
        edges = durable(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v"))).distinct(),
            "small",
        )
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
