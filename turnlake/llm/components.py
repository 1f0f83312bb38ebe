"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join over the edges. The centre of a star may have most edges:
where one has more than a task's share, its join is split over tasks. A reliable checkpoint cuts the
lineage after each round, and one count of the nodes' edges tells whether only stars are left and
how large they are. The number of rounds grows with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import checkpointed, spread_join, uneven


def _starred(near: DataFrame, hot: bool) -> tuple[DataFrame, DataFrame]:
    """near: u and a neighbour v. The least of u and its neighbours (m) of each u, and of each edge."""
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("edges")).select("u", F.least("u", "m").alias("m"), "edges")
    return least, spread_join(near, least, ["u"], "edges", [F.col("v")], hot=hot)


def _shape(edge: DataFrame) -> tuple[int, bool, bool]:
    """How many edges, whether they are separate stars (v the centre), and whether a node has more than its share of them."""
    ends = edge.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf")))).alias("end")).select("end.*")
    nodes = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.count(F.lit(1)).alias("edges"))
    loose = (F.col("leaf") > 1) | ((F.col("leaf") > 0) & (F.col("edges") > F.col("leaf")))
    most, total, more = nodes.agg(F.max("edges"), F.sum("edges"), F.count_if(loose)).first()
    return (total or 0) // 2, not more, uneven(edge.sparkSession, most or 0, total or 0)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b), longs."""
    edge = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    count, stars, hot = _shape(edge)
    while count and not stars:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _starred(both, hot)[1].where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # a node and its smaller neighbours: no more than it had of those before
        least, tied = _starred(large, False)
        edge = checkpointed(tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        _, stars, hot = _shape(edge)
    return edge.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edge.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
