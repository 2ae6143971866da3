"""Splits, mixes and downsampling by keyed draws; results don't depend on row order or partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranges
from .gates import guard


def threshold_split(rows: DataFrame, key: str, share: float, salt: str) -> DataFrame:
    """Adds split: val where the key's draw is under the share. A key that several rows share never straddles."""
    return rows.withColumn("split", F.when(T.h01(salt, F.col(key)) < share, "val").otherwise("train"))


def stratified(rows: DataFrame, stratum: str, id_col: str, salt: str, n: int) -> DataFrame:
    """About n rows: max(1, round(n * stratum's size / all)) of each stratum, by hash."""
    sizes = rows.groupBy(F.col(stratum).alias("_stratum")).agg(F.count("*").alias("_size"))
    total = rows.agg(F.count("*").alias("_total"))
    ranked = ranges.numbered(rows, [stratum], [T.hash_order(salt, F.col(id_col)), F.col(id_col)], "_n")
    sized = ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("_stratum"))).crossJoin(F.broadcast(total))
    return sized.where(F.col("_n") < F.greatest(F.lit(1), F.round(F.lit(float(n)) * F.col("_size") / F.col("_total")))).drop("_total", "_size", "_n", "_stratum")


def by_hash(rows: DataFrame, id_col: str, salt: str, n: DataFrame) -> DataFrame:
    """The rows with the smallest hashes, as many as the one row of n says; a corpus's share is cut by ranges of the hash."""
    ranked = ranges.numbered(rows, [], [T.hash_order(salt, F.col(id_col)), F.col(id_col)], "_n")
    return ranked.crossJoin(F.broadcast(n.toDF("_most"))).where("_n < _most").drop("_n", "_most")


def replay_mix(knowledge: DataFrame, anchors: DataFrame, id_col: str, ratio: float, salt: str) -> DataFrame:
    """All knowledge rows and ratio as many anchors by hash, with role."""
    n = knowledge.agg(F.floor(F.count("*") * ratio).cast("long"))
    return knowledge.withColumn("role", F.lit("knowledge")).unionByName(by_hash(anchors, id_col, salt, n).withColumn("role", F.lit("anchor")))


def debias(rows: DataFrame, flag: str, id_col: str, share: float, salt: str) -> DataFrame:
    """All rows without the flag, and as many with it that they make up the share."""
    n = rows.where(~F.col(flag)).agg(F.floor(F.count("*") * share / (1 - share)).cast("long"))
    return rows.where(~F.col(flag)).unionByName(by_hash(rows.where(flag), id_col, salt, n))


def weighted_keep(rows: DataFrame, id_col: str, weight, salt: str = "keep") -> DataFrame:
    """Rows whose draw is under their weight (a column)."""
    return rows.where(T.h01(salt, F.col(id_col)) < weight)


def slice_rows(rows: DataFrame, order: str, offset: int, limit: int, batch: int = 1) -> DataFrame:
    """Rows [offset, offset + limit) of a declared order; an offset that isn't a multiple of the batch is an error."""
    if offset % batch:
        raise ValueError(f"offset {offset} isn't a multiple of the batch {batch}")
    return ranges.numbered(rows, [], [F.col(order)], "_n").where((F.col("_n") >= offset) & (F.col("_n") < offset + limit)).drop("_n")


def held_out(rows: DataFrame, key: str, id_col: str, salt: str, share: float) -> DataFrame:
    """Adds held: of each key's rows the first int(share * n) by hash."""
    sizes = rows.groupBy(F.col(key).alias("_key")).agg(F.floor(F.count("*") * share).cast("long").alias("_held"))
    ranked = ranges.numbered(rows, [key], [T.hash_order(salt, F.col(id_col)), F.col(id_col)], "_n")
    return ranked.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).withColumn("held", F.col("_n") < F.col("_held")).drop("_n", "_key", "_held")


def arms(real: DataFrame, teaches: DataFrame, anchors: DataFrame, id_col: str, salt: str, ratio: float) -> DataFrame:
    """A training file: all real and teaching rows, and anchors by hash, ratio as many as both; ids must be unique over the parts."""
    n = real.select(id_col).unionByName(teaches.select(id_col)).agg(F.floor(F.count("*") * ratio).cast("long"))
    parts = [real.withColumn("role", F.lit("real")), teaches.withColumn("role", F.lit("teaches")), by_hash(anchors, id_col, salt, n).withColumn("role", F.lit("anchor"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    twice = every.groupBy(id_col).agg(F.count("*").alias("n")).agg(F.max("n").alias("_most"))
    return guard(every.crossJoin(F.broadcast(twice)), F.col("_most") > 1, "an id is in two parts of the training file").drop("_most")
