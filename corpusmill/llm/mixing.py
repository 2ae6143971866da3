"""Mixing sources to target weights by a splitting tree of multivariate hypergeometric draws.

A source's documents are hashed to blocks of about BLOCK_WORDS words, so there are more blocks where there are more
words. Its target fixes how often each block is taken: all blocks the same number of times, then some blocks once more
in a permuted order, and from one last block single documents in hash order as long as they fit, which leaves less than
the smallest one passed over. The drawn blocks are dealt out to output shards by a tree: at each node the left half's
block counts by source are one multivariate hypergeometric draw of the node's counts, so the counts are exact in every
shard. A source's blocks are permuted and dealt to the shards by these counts, disjoint by construction, and a shard's
rows are shuffled locally by hash. All draws are seeded by names and numbers: reruns agree.

Sources, blocks and their sums are tables; an order over them is cut in ranges of its hash, so no task sees all of it.
The driver holds the tree's counts: those of the GROUPS sources with the most blocks, and all others' as one pool,
whose permuted blocks make up the pool's share of a shard; at most SHARDS shards.

Defined cases: a null text has size 0; a null source is one source, the last; sources without words have target 0;
rows of one doc_id and text are taken or passed over together; a null doc_id is hashed like any other; a document is
never cut, so one that is larger than a block is a block with it; an empty table gives an empty result. Columns of the
input keep their names and values, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import WORD, keep, numbered, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Words and documents of a block, about, and what the blocks of all sources come to at most before these grow.
BLOCK_WORDS, BLOCK_DOCS, BLOCKS = 32768, 256, 1 << 27
#: Words of an output shard, shards at most, sources that have counts of their own in the tree, blocks of a range.
SHARD_WORDS, SHARDS, GROUPS, RANGE = 5_000_000, 16384, 256, 1024
#: Shards of op3 at least, so that the tree draws for small tables, too.
LEAST_SHARDS = 8
#: Rows of a side that is broadcast; above, both sides are shuffled.
BROADCAST_ROWS = 250_000
SEED = 17


def fill_level(sources: DataFrame, most: float = MAX_REPEATS) -> float:
    """The level that gives sources (source_size, weight) the targets least(most * source_size, level * weight), which sum up to all sizes.

    Each round fixes the sources that are over most times their size and shares the rest anew by weight, until none is.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, fixed = 0.0, -1
    while total:
        over = most * F.col("source_size") < F.lit(level) * F.col("weight")
        n, taken, free = sources.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == fixed:
            break
        level, fixed = (total - most * taken) / free, n
    return level


def split_tree(counts: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """counts: blocks by source. Returns blocks by shard and source; the shards' totals differ by rounding only."""
    out = np.zeros((shards, len(counts)), dtype=np.int64)

    def part(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, int(have.sum()) * (mid - lo) // (hi - lo), method="marginals")
        part(lo, mid, left)
        part(mid, hi, have - left)

    part(0, shards, np.asarray(counts, dtype=np.int64))
    return out


@dataclass
class Mix:
    sized: DataFrame  # doc_id, hash (of the text), size, source
    sources: DataFrame  # source, place, blocks, source_size, target and more: one row a source
    blocks: DataFrame  # place, block, copies (how often the block is taken), residual (words that are taken from the last block)
    picks: DataFrame  # place, doc_id, hash: documents that are taken from the last blocks
    counts: dict[str, int]  # rows of the three tables


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("hash"), F.col("source").cast("string").alias("source"), *more)


def _join(left: DataFrame, right: DataFrame, rows: int, on, how: str = "inner") -> DataFrame:
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def _before(rows: DataFrame, key: str, at: Column, size: Column, value: Column) -> DataFrame:
    """rows with before: the sum of value over the key's rows that come earlier by at, a hash; size is about the number of the key's rows."""
    rows = rows.withColumn("_at", at).withColumn("_range", F.floor((F.col("_at").cast("double") / 2.0**64 + 0.5) * F.ceil(size / RANGE))).withColumn("_value", value)
    sums = rows.groupBy(key, "_range").agg(F.sum("_value").alias("_sum"))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(key, "_range", F.coalesce(F.sum("_sum").over(earlier(W.partitionBy(key).orderBy("_range"))), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum("_value").over(earlier(W.partitionBy(key, "_range").orderBy("_at"))), F.lit(0))
    return rows.join(sums, [key, "_range"]).withColumn("before", F.col("_base") + inner).drop("_at", "_range", "_value", "_base")


def _placed(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """rows (doc_id, hash, source and more) with their sources' columns and their block."""
    own = sources.withColumnRenamed("source", "_source")
    return _join(rows, own, n, rows["source"].eqNullSafe(own["_source"])).drop("_source").withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "hash"), "blocks"))


def _fill(key, group):
    """Documents of a block in hash order, as long as they fit what is left of the target."""
    left, taken = group.column("residual")[0].as_py(), []
    sizes = group.column("size").to_numpy()
    for i in np.lexsort((group.column("doc_id").fill_null(0).to_numpy(), group.column("h").to_numpy())):
        if sizes[i] <= left:
            left -= sizes[i]
            taken.append(i)
    return group.select(["place", "doc_id", "hash"]).take(np.array(taken, dtype=np.int64))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> Mix:
    """weights belong to the sources in order of code points, null last, and repeat."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = keep(_sized(docs, size.alias("size")), "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    found = numbered(found, [F.col("source").isNull(), F.col("source")], "place")
    found = keep(found.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))), "sources")
    rows, words, n = found.agg(F.sum("n"), F.sum("source_size"), F.count("*")).first()
    many = lambda c, each, all_: F.ceil(F.col(c) / max(each, (all_ or 0) // BLOCKS))
    level, own = fill_level(found), F.col("source_size")
    found = found.withColumn("blocks", F.greatest(F.lit(1), many("source_size", BLOCK_WORDS, words), many("n", BLOCK_DOCS, rows)))
    found = found.withColumn("target", F.least(MAX_REPEATS * own.cast("double"), F.lit(level) * F.col("weight")))
    found = found.withColumn("times", F.coalesce(F.floor(F.try_divide(F.col("target"), own)), F.lit(0)).cast("int"))
    sources = keep(found.select("source", "place", "blocks", "source_size", "target", "times", (F.col("target") - F.col("times") * own).alias("left")), "mix-sources")
    marked = _placed(sized, sources, n)
    sums = marked.groupBy("place", "block", "blocks", "times", "left").agg(F.sum("size").alias("words"))
    sums = _before(sums, "place", F.xxhash64(F.lit(SEED), "place", "block"), F.col("blocks"), F.col("words"))
    once, reached = (F.col("left") >= 1) & (F.col("before") <= F.col("left")), F.col("before") + F.col("words") <= F.col("left")
    blocks = keep(sums.select("place", "block", (F.col("times") + (once & reached).cast("int")).alias("copies"), F.when(once & ~reached, F.col("left") - F.col("before")).alias("residual")), "mix-blocks")
    last = blocks.where("residual IS NOT NULL")
    units = _join(marked, last, n, ["place", "block"]).groupBy("place", "doc_id", "hash").agg(F.sum("size").alias("size"), F.first("residual").alias("residual"))
    picks = keep(units.withColumn("h", F.xxhash64(F.lit(SEED + 1), "doc_id", "hash")).groupBy("place").applyInArrow(_fill, "place long, doc_id long, hash long"), "mix-picks")
    return Mix(sized, sources, blocks, picks, {"sources": n, "blocks": blocks.count(), "picks": picks.count()})


def _marked(mix: Mix, rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows with the columns of their sources and blocks, and picked."""
    rows = _join(_placed(rows, mix.sources, mix.counts["sources"]), blocks, mix.counts["blocks"], ["place", "block"])
    picks = mix.picks.select(F.col("place").alias("_place"), F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash"))
    same = (F.col("place") == F.col("_place")) & (F.col("hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    return _join(rows, picks, mix.counts["picks"], same, "left").withColumn("picked", F.col("_place").isNotNull()).drop("_place", "_doc", "_hash")


def _shards(mix: Mix) -> int:
    words = mix.sources.agg(F.sum("target")).first()[0] or 0
    return max(1, min(SHARDS, -(-int(words) // SHARD_WORDS)))


def _every() -> Column:
    """The shards of a marked row, one for each time it is taken."""
    return F.when(F.col("picked"), F.array_append("shards", F.col("edge"))).otherwise(F.col("shards"))


def taken(mix: Mix, shards: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (words: its size for each time the tree's draws deal it to a shard) of every document."""
    rows = _marked(mix, mix.sized, dealt(mix, shards or _shards(mix)))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size(_every())).alias("taken"))


def _to_shards(ends: np.ndarray):
    """ends: for each group the number of its blocks in each shard and those before."""

    def run(batches):
        for batch in batches:
            group, place = batch.column("group").to_numpy(), batch.column("before").to_numpy()
            shard = np.zeros(len(group), dtype=np.int32)
            for g in set(group.tolist()):
                at = group == g
                shard[at] = np.searchsorted(ends[:, g], place[at], "right")
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("block"), pa.array(shard)], names=["place", "block", "shard"])

    return run


def dealt(mix: Mix, shards: int) -> DataFrame:
    """place, block, shards (one for each time the block is taken), edge (the shard of documents that are taken from it alone)."""
    spark = mix.blocks.sparkSession
    sums = mix.blocks.groupBy("place").agg(F.sum("copies").alias("n"))
    top = [tuple(r) for r in sums.where("n > 0").orderBy(F.desc("n"), "place").limit(GROUPS).collect()]
    counts = [n for _, n in top]
    counts.append((sums.agg(F.sum("n")).first()[0] or 0) - sum(counts))
    ends = split_tree(np.array(counts), shards).cumsum(0)
    groups = spark.createDataFrame([(p, g, n) for g, (p, n) in enumerate(top)], "place long, group int, n long")
    drawn = mix.blocks.where("copies > 0").select("place", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).join(F.broadcast(groups), "place", "left")
    drawn = drawn.fillna({"group": len(top), "n": counts[-1]})
    drawn = _before(drawn, "group", F.xxhash64(F.lit(SEED + 1), "place", "block", "copy"), F.col("n"), F.lit(1))
    drawn = drawn.select("place", "block", "group", "before").mapInArrow(_to_shards(ends), "place long, block long, shard int").groupBy("place", "block").agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    edge = F.when(F.col("residual").isNotNull(), F.pmod(F.xxhash64(F.lit(SEED), "place"), F.lit(shards)).cast("int"))
    return keep(mix.blocks.join(drawn, ["place", "block"], "left").select("place", "block", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"), edge.alias("edge")), "mix-shards")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int | None = None, shard_column: str | None = None) -> DataFrame:
    """The mix's rows: the columns of docs, a row for each time it is taken; by shard (in shard_column, if named) and in the shard's order."""
    mix = plan(docs, weights)
    n = shards or _shards(mix)
    rows = _marked(mix, _sized(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), dealt(mix, n))
    out = rows.select("doc_id", "hash", "row", F.posexplode(_every()).alias("copy", "shard"))
    out = out.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.xxhash64(F.lit(SEED + 2), "doc_id", "hash", "copy"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], *([F.col("shard").alias(shard_column)] if shard_column else []))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = plan(table(spark, sf_dir, "documents"))
    return taken(mix, max(LEAST_SHARDS, _shards(mix)))
