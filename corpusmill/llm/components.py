"""Distributed connected components by alternating large and small stars, in DataFrame operations.

Each round rewrites the edges so that every node points at a smaller neighbour; the rounds end when the edges stay as
they are, which takes a logarithmic number of rounds. Every round's edges are a table in the shared folder. A hub
with very many edges is only met by joins, which adaptive execution splits, and by sums with partial aggregation.

Defined cases: an edge with a null end, or from a node to itself, links nothing; repeated edges count once; an empty
table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, keep


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one type. Returns node, component (the smallest node reachable) for nodes that have an edge to another node."""
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = _signature(now)
    while sign[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = keep(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        new_sign = _signature(new)
        forget(now)
        if new_sign == sign:
            now = new
            break
        now, sign = new, new_sign
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select("b", "b").distinct().toDF("node", "component"))
