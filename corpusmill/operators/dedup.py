"""First-wins dedup, caps, top-N by hash, budgets, cycling, packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from . import ranges


def first_of(rows: DataFrame, key: str | Column, order: str) -> DataFrame:
    """The first row of each key by order; a hot key is limited in each task before the shuffle."""
    w = W.partitionBy(F.col(key) if isinstance(key, str) else key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def capped(rows: DataFrame, key: str, order: str, share: float, least: int = 0) -> DataFrame:
    """At most max(least, int(share * rows)) rows of each key, in order."""
    n = rows.agg(F.greatest(F.lit(least), F.floor(F.count("*") * share)).cast("long").alias("_cap"))
    return ranges.numbered(rows, [key], [F.col(order)], "_n").crossJoin(F.broadcast(n)).where("_n < _cap").drop("_n", "_cap")


def top_by_hash(rows: DataFrame, key: str, id_col: str, salt: str, n: int) -> DataFrame:
    """n rows of each key, drawn by salted hash of their id."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(T.hash_order(salt, F.col(id_col)), id_col))).where(F.col("_n") <= n).drop("_n")


def budget_prefix(rows: DataFrame, key: str, score: str, tie: str, cost: str, budget: float) -> DataFrame:
    """Rows of each key by falling score as long as the cost before them is under the budget."""
    return ranges.running(rows, [key], [F.desc(score), F.col(tie)], F.col(cost), "_before").where(F.col("_before") < budget).drop("_before")


def budget_skip(rows: DataFrame, key: str, rank: str, cost: str, budget: int) -> DataFrame:
    """Rows of each key that fit the budget one after another by rank, skipping those that would overflow.

    The rule looks at one row after another, so a key's rows are one task; a key is a pool of ranked passages, bounded by its depth.
    """

    def fill(key, pool: pd.DataFrame) -> pd.DataFrame:
        pool, left, taken = pool.sort_values(rank, kind="stable"), budget, []
        for i, c in enumerate(pool[cost]):
            if c <= left:
                left -= c
                taken.append(i)
        return pool.iloc[taken]

    return rows.groupBy(key).applyInPandas(fill, rows.schema)


def cycle(pool: DataFrame, id_col: str, times: float) -> DataFrame:
    """times as many rows as the pool has, rounded down: the pool in id order again and again, ids suffixed #round."""
    size = pool.agg(F.count("*").alias("_size"))
    ranked = ranges.numbered(pool, [], [F.col(id_col)], "_n").crossJoin(F.broadcast(size))
    left = F.floor(F.col("_size") * times) - 1 - F.col("_n")
    out = ranked.where(left >= 0).withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(left / F.col("_size")))))
    return out.withColumn("row_id", F.concat(F.col(id_col).cast("string"), F.lit("#"), F.col("round").cast("string"))).drop("_n", "_size")


def interleaved(rows: DataFrame, order: str, anchors: DataFrame, anchor_order: str, every: int) -> DataFrame:
    """place, kind, id: one anchor after every so many rows, the anchors again and again in their order."""
    n = anchors.agg(F.count("*").alias("_n"))
    own = ranges.numbered(rows, [], [F.col(order)], "_i").select(F.col(order).alias("id"), "_i")
    places = own.select((F.col("_i") + F.floor(F.col("_i") / every)).alias("place"), F.lit("row").alias("kind"), "id")
    gaps = own.where(F.pmod("_i", F.lit(every)) == every - 1).crossJoin(F.broadcast(n)).select(((F.col("_i") + 1) + F.floor(F.col("_i") / every)).alias("place"), F.pmod(F.floor(F.col("_i") / every), F.col("_n")).alias("_a"))
    listed = ranges.numbered(anchors, [], [F.col(anchor_order)], "_a").select("_a", F.col(anchor_order).alias("id"))
    return places.unionByName(gaps.join(listed, "_a").select("place", F.lit("anchor").alias("kind"), "id"))


def pack(sizes: str, target: int, most: int) -> Column:
    """Bin number of each entry of an array of sizes, packed greedily in order: a bin closes once it has target, and before it would pass most."""
    return F.expr(
        f"""aggregate({sizes}, named_struct('bin', 0, 'n', 0L, 'out', CAST(array() AS ARRAY<INT>)),
              (a, s) -> CASE WHEN a.n > 0 AND (a.n >= {target} OR a.n + s > {most}) THEN named_struct('bin', a.bin + 1, 'n', CAST(s AS BIGINT), 'out', array_append(a.out, a.bin + 1))
                             ELSE named_struct('bin', a.bin, 'n', a.n + s, 'out', array_append(a.out, a.bin)) END, a -> a.out)"""
    )


def blocks(rows: DataFrame, key: str, order: str, tokens: str, size: int) -> DataFrame:
    """first_block and last_block of each row's tokens when a key's rows are laid end to end and cut in blocks of size."""
    laid = ranges.running(rows, [key], [F.col(order)], F.col(tokens), "_b")
    return laid.withColumn("first_block", F.floor(F.col("_b") / size)).withColumn("last_block", F.floor((F.col("_b") + F.greatest(F.col(tokens), F.lit(1)) - 1) / size)).drop("_b")
