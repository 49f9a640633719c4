"""Connected components of a graph that no machine has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("s")).first()
    return r["n"], r["s"]


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of `edges` (a, b); a component is named by its least node.

    Alternates two star operations until nothing changes: the large star links a node's larger neighbours to its least
    neighbour, the small star its smaller ones and itself. The edges shrink to a star for each component in a few
    rounds. Each round is written to the shared folder. Least neighbours are found by partial aggregation and joined
    back, so a hub with a third of all nodes is aggregated before it is shuffled and split when it is joined.
    """
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (now := _digest(current)) != before:
        before = now
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        current = materialize(small, "small-star")
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
