"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Rows of a partition that a round keeps, where that leaves a partition for every core.
PARTITION_ROWS = 1 << 17


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of undirected ``a, b`` edges.

    Alternates large-star and small-star contraction until the edge set stays
    the same, which takes a number of rounds logarithmic in the longest path.
    Both steps first take a minimum per node, which combines before the
    shuffle, so a hub of any degree is summed up and never collected.  Each
    round is cut by checkpoints, in as many partitions as the first edges need
    (no step makes more of them), whatever the number of shuffle partitions:
    on a local file system each file costs processes, which for an instant
    count as large as the executor.  Nodes without an edge to another node do
    not appear; an empty list gives an empty result; repeated edges count once.
    """
    edges = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )  # a > b: from a node to a smaller one
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, edges.count() // PARTITION_ROWS)
    before = None
    while True:
        # large star: every larger neighbour of a node goes to the node's least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # kept, so that both sides of the join are shuffled for it and a hub's rows can be split over tasks
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(parts))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour, and the node, go to the least one
        large = cut(large.coalesce(parts))
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(parts))
        small = (
            large.join(least, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        edges = cut(small.coalesce(parts))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") / F.lit(1 << 20)).cast("decimal(38,6)"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now[0] == (before or [None])[0] and now[2] == before[2]:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct().coalesce(parts)
