"""Connected components of an edge table by alternating stars; no component comes together in a task or the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for each node of edges (x, y), label being the smallest node of its component.

    Each round links every node's larger neighbours to its smallest one, then every node's smaller
    neighbours to their smallest; the edges shrink to stars in a logarithmic number of rounds.
    Minima are taken in parts before the shuffle, and a hub's edges can be split in the join.
    """
    e = edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    e = materialize(e, name)
    while True:
        # Done when all edges lead to centres: no node has two edges, no centre one of its own.
        uneven = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        if uneven.isEmpty() and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            centres = e.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(centres)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first: Spark can split a hub's edges only if both sides of the join are plain exchanges.
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct(), name)
