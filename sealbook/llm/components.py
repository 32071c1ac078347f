"""Connected components of a table of edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealbook.operators.durable import Scratch, durable


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: each node's neighbours are hung on the smallest of them and the node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    hung = both.join(least, "u")
    if larger:
        moved = hung.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        moved = hung.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            least.select("u", F.col("least").alias("v"))
        )
    return moved.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of an edge table (``u``, ``v``).

    Repeated edges and loops are harmless; no edges give no rows. A node with very many edges stays
    many rows: only minima are taken per node. Each round is written once, since it is read three
    times, and removed after the next; the rounds needed grow with the logarithm of the longest path.
    """
    spark, state = edges.sparkSession, None
    rounds = [Scratch(spark)]
    edges = rounds[0].keep(edges.select("u", "v").filter("u != v").distinct())
    try:
        while True:
            rounds.append(Scratch(spark))
            edges = rounds[-1].keep(_stars(_stars(edges, True), False))
            rounds.pop(0).__exit__()
            seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if not seen[0] or tuple(seen) == state:
                break
            state = tuple(seen)
        roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return durable(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots))
    finally:
        for left in rounds:
            left.__exit__()
