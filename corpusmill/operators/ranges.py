"""Ranks and running sums of which no task sees a whole key.

A key may hold a third of all rows, and an order over a table without a key holds all. Above SMALL rows the rows are cut
in ranges of (key, order), each range sums up its part of a key, and only these sums meet in a window. A table of up to
SMALL rows takes the plain window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import scratch

SMALL = 1 << 20


def running(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, small: int | None = None) -> DataFrame:
    """rows with name: the sum of value over the key's rows that come before in the order; 0 for the first. The order must be total."""
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    if rows.limit((SMALL if small is None else small) + 1).count() <= (SMALL if small is None else small):
        return rows.withColumn(name, F.coalesce(F.sum(value).over(before(W.partitionBy(*keys).orderBy(*order))), F.lit(0)))
    cut = scratch.keep(rows.withColumn("_value", value).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = cut.groupBy("_range", *keys).agg(F.sum("_value").alias("_sum"))
    base = F.coalesce(F.sum("_sum").over(before(W.partitionBy(*keys).orderBy("_range"))), F.lit(0))
    sums = sums.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], base.alias("_base"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_range") == F.col("_r"))
    inner = F.coalesce(F.sum("_value").over(before(W.partitionBy("_range", *keys).orderBy(*order))), F.lit(0))
    return cut.join(sums, same).withColumn(name, F.col("_base") + inner).drop("_range", "_value", "_base", "_r", *[f"_k{i}" for i in range(len(keys))])


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str, small: int | None = None) -> DataFrame:
    """rows with name: the row's number in its key, from 0."""
    return running(rows, keys, order, F.lit(1).cast("long"), name, small)
