"""Near copies by the Jaccard similarity of word shingles: candidates from SimHash and MinHash, each checked exactly.

Texts with one set of shingles are one class. Links come in three steps, and only links that the exact similarity
confirms count.

1. SimHash: the operator's vantage-point trees join the classes' fingerprints within its radius. That finds close
   copies; at similarity 0.8 about 10 of 64 bits differ, and no tree prunes at such a radius.
2. MinHash: classes that agree in a band of their signature share a bucket; at similarity 0.8 two miss each other in all
   of BANDS bands of ROWS values with a chance of 0.02 %. Each class is compared with one of each of its buckets: that which
   meets the most others, as a text does from which others were made.
3. Buckets that still hold classes of several components: in one of up to SMALL classes, each class outside of the
   largest component is compared with all that aren't in its own. Larger ones, such as those of texts that share a
   common passage, are not paired; their classes meet in a prefix join, which misses nothing: shingles are put in order
   of how many of these classes have them, rarest first; two sets of similarity s must share one of the first
   (1 - s) * size + 1 of each, and from the place of the first that they share follows how much they share at most.

So what is paired is what can be similar, and every pair of a bucket is compared, excluded or already connected.

Defined cases: words, null, empty and short texts as in simhash.fingerprint, but texts without words are copies of each
other; rows without a doc_id take part, and come after all others when a component's row is chosen; of rows with one
doc_id and text one stays; an empty table gives an empty result; other columns are carried along whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from xxhash import xxh64_intdigest

from . import simhash
from .components import connected_components
from .shared import forget, keep, small_batches

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 16, 4
#: Classes of a bucket that is paired; rows of a side that is broadcast; links that one task thins out.
SMALL, BROADCAST_ROWS, FOREST_LINKS = 32, 250_000, 1_000_000
_RNG = np.random.default_rng(SEED)
_A, _B = _RNG.integers(0, 2**32, (2, BANDS * ROWS, 1), dtype=np.uint64).astype(np.uint32)
_A |= np.uint32(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's shingles, distinct and sorted; one value stands for texts without words."""
    found = simhash.shingle_hashes(text, shingle)
    return np.unique(found) if len(found) else np.zeros(1, dtype="<u8")


def _bands(hashes: np.ndarray) -> list[int]:
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.min([(high[i : i + 4096] * _A + _B).min(axis=1) for i in range(0, len(high), 4096)], axis=0)
    return [xxh64_intdigest(part.tobytes()) for part in least.reshape(BANDS, ROWS)]


def _signed(numbers) -> np.ndarray:
    return np.array(numbers, dtype=np.uint64).view(np.int64)


def _sets(shingle):
    def run(batches):
        for batch in batches:
            raw = [simhash.shingle_hashes(t, shingle) for t in batch.column("text").to_pylist()]
            sets = [np.unique(h) if len(h) else np.zeros(1, dtype="<u8") for h in raw]
            bands = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, pa.array(_signed([b for s in sets for b in _bands(s)])))
            cells = [_signed([xxh64_intdigest(s.tobytes(), SEED) for s in sets]), np.array([len(s) for s in sets], dtype=np.int64), _signed([simhash.majority(h) for h in raw])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *map(pa.array, cells), bands], names=["doc_id", "hash", "class", "size", "fp", "bands"])

    return run


def _alike(shingle, similarity):
    known = lru_cache(4096)(lambda text: shingles(text, shingle))

    def run(batches):
        for batch in batches:
            sets = (map(known, batch.column(c).to_pylist()) for c in ("text_a", "text_b"))
            both = [(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))) for a, b in zip(*sets)]
            yield batch.select(["a", "b"]).filter(pa.array([n >= similarity * (x + y - n) for x, y, n in both], pa.bool_()))

    return run


def _linked(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that are alike."""
    side = lambda c: texts.select(F.col("class").alias(c), F.col("text").alias(f"text_{c}"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return keep(found.mapInArrow(lambda batches: _alike(shingle, similarity)(batches), "a long, b long"), "near-links")


def _forest(links: DataFrame) -> DataFrame:
    """a, b that connect what the links connect, hardly more of them than nodes: each task drops what closes a ring among its links."""

    def run(batches):
        ends = [np.concatenate(x) for x in zip(*[(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches])]
        if ends:
            nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
            forest = simhash.Forest(len(nodes))
            forest.link(*np.split(place, 2))
            root = forest.root(np.arange(len(nodes)))
            at = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[root[at]])], names=["a", "b"])

    return links.repartition(1 + links.count() // FOREST_LINKS).mapInArrow(run, "a long, b long")


def _each_shingle(shingle):
    def run(batches):
        for batch in batches:
            sets = [shingles(t, shingle) for t in batch.column("text").to_pylist()]
            number = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            found = pa.array(_signed(np.concatenate(sets)) if sets else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("class").take(number), found], names=["class", "shingle"])

    return run


def _pair(a: str, b: str):
    return F.greatest(a, b).alias("a"), F.least(a, b).alias("b")


def prefixes(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """class, size, at, shingle: the first shingles of each of the texts (class, text), rarest among them first, as many as a set of that similarity must share one of; those that only one text has are left out."""
    every = keep(texts.select("class", "text").mapInArrow(_each_shingle(shingle), "class long, shingle long"), "near-shingles")
    common = every.groupBy("shingle").agg(F.count("*").alias("df"))
    sets = every.join(common, "shingle").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s")).withColumn("size", F.size("s"))
    first = sets.select("class", "size", F.posexplode(F.slice("s", F.lit(1), (F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1).cast("int"))).alias("at", "x"))
    first = keep(first.where("x.df > 1").select("class", "size", "at", "x.shingle"), "near-prefixes")
    forget(every)
    return first


def prefix_pairs(first: DataFrame, parts: DataFrame, similarity: float, star: bool = False) -> DataFrame:
    """a, b: pairs of different components (parts: class, component; a class without one is its own) that share a shingle of their prefixes and may reach the similarity.

    star: only those with the one text of each shingle that has it first; that connects most components before all their pairs are asked for.
    """
    first = first.join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
    mixed = first.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct("at", "class", "component", "size")).alias("head")).where("lo <> hi")
    if star:
        met = first.join(mixed, "shingle").select("class", "component", "size", "at", *[F.col("head")[c].alias(n) for c, n in (("class", "x"), ("component", "own"), ("size", "size_x"), ("at", "at_x"))])
    else:
        first = first.join(mixed.select("shingle"), "shingle", "left_semi")
        met = first.join(first.select("shingle", F.col("class").alias("x"), F.col("component").alias("own"), F.col("size").alias("size_x"), F.col("at").alias("at_x")), "shingle").where("class > x")
    # What two sets share is what they share from their first common shingle on.
    enough = F.least(F.col("size") - F.col("at"), F.col("size_x") - F.col("at_x")) * (1 + similarity) >= similarity * (F.col("size") + F.col("size_x")) - 1e-6
    return met.where((F.col("component") != F.col("own")) & enough).select(*_pair("class", "x")).distinct()


def dropped(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """doc_id, hash (of the text) of rows that are near copies of another that stays, and of those that stay but stand in several rows.

    docs: doc_id, hash, text.
    """
    rows = keep(docs.mapInArrow(_sets(shingle), "doc_id long, hash long, class long, size long, fp long, bands array<long>"), "near-sets")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    classes = keep(rows.groupBy("class").agg(F.min(order).alias("first"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "near-classes")
    near = F.least("size", "other") >= similarity * F.greatest("size", "other")

    prints = keep(classes.groupBy("fp").agg(F.min(F.struct("class", "size")).alias("head")), "near-prints")
    alike = classes.join(prints, "fp").select(F.col("class").alias("x"), "size", F.col("head.class").alias("y"), F.col("head.size").alias("other"))
    end = lambda fp, c, n: prints.select(F.col("fp").alias(fp), F.col("head.class").alias(c), F.col("head.size").alias(n))
    trees = simhash.hamming_forest(prints.select("fp")).join(end("a", "x", "size"), "a").join(end("b", "y", "other"), "b").select("x", "size", "y", "other")

    spread = classes.select("class", "size", F.posexplode("bands").alias("band", "key"))
    shared = spread.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = keep(spread.join(shared, ["band", "key"]), "near-members")
    met = members.groupBy("class").agg(F.sum("n").alias("met"))
    heads = members.join(met, "class").groupBy("band", "key").agg(F.max(F.struct("met", "class", "size")).alias("head"))
    star = members.join(heads, ["band", "key"]).select(F.col("class").alias("x"), "size", F.col("head.class").alias("y"), F.col("head.size").alias("other"))
    pairs = keep(alike.unionByName(trees).unionByName(star).where((F.col("x") != F.col("y")) & near).select(*_pair("x", "y")).distinct(), "near-pairs")

    asked = members.select("class").unionByName(pairs.select(F.col("a").alias("class"))).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    asked = asked.join(classes.select("class", "first.doc_id", "first.hash"), "class").withColumnRenamed("hash", "_hash").withColumnRenamed("doc_id", "_doc")
    texts = docs.join(asked, (F.col("hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("class", "text").dropDuplicates(["class"])
    texts = keep(texts, "near-texts")
    links = _linked(pairs, texts, shingle, similarity)
    parts = connected_components(_forest(links)).select(F.col("node").alias("class"), "component")

    now = members.select("band", "key", "class", "size", "n").join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
    counted = now.groupBy("band", "key", "component").agg(F.count("*").alias("m"))
    largest = counted.groupBy("band", "key").agg(F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("band", "key", F.col("top.component").alias("top"))
    now = keep(now.join(largest, ["band", "key"]), "near-open")
    small = now.where(F.col("n") <= SMALL)
    minor = small.where("component <> top").select("band", "key", F.col("class").alias("x"), F.col("size").alias("other"), F.col("component").alias("own"))
    rest = small.join(minor, ["band", "key"]).where((F.col("component") != F.col("own")) & near).select(*_pair("class", "x"))
    large = prefixes(now.where(F.col("n") > SMALL).select("class").distinct().join(texts, "class"), shingle, similarity)
    asked = keep(prefix_pairs(large, parts, similarity, star=True).join(pairs, ["a", "b"], "left_anti"), "near-pairs")
    more = _linked(asked, texts, shingle, similarity)
    stars = lambda parts: parts.where(F.col("class") != F.col("component")).select(F.col("class").alias("a"), F.col("component").alias("b"))
    grown = connected_components(_forest(stars(parts).unionByName(more))).select(F.col("node").alias("class"), "component")
    rest = rest.unionByName(prefix_pairs(large, grown, similarity)).distinct().join(pairs.unionByName(asked), ["a", "b"], "left_anti")
    last = _linked(rest, texts, shingle, similarity)
    final = connected_components(_forest(stars(grown).unionByName(last))).select(F.col("node").alias("class"), "component")

    named = classes.select("class", "first").join(final, "class", "left").withColumn("component", F.coalesce("component", "class"))
    firsts = named.groupBy("component").agg(F.min("first").alias("stays")).join(named, "component").select("class", "stays")
    keys = rows.groupBy("class", "doc_id", "hash").agg(F.count("*").alias("n")).join(firsts, "class")
    stays = (F.col("hash") == F.col("stays.hash")) & F.col("doc_id").eqNullSafe(F.col("stays.doc_id"))
    found = keep(keys.withColumn("stays", stays).where("NOT stays OR n > 1").select("doc_id", "hash", "stays"), "near-dropped")
    for t in (rows, classes, prints, members, pairs, texts, links, parts, now, large, asked, more, grown, last, final):
        forget(t)
    return found.where("NOT stays").select("doc_id", "hash"), found.where("stays").select("doc_id", "hash")


def first_of_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but one row of each component: that of the smallest doc_id, nulls last, and then of the least hash."""
    small_batches(docs.sparkSession)
    key = F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("hash")
    gone, several = dropped(docs.select(*key, F.col("text").cast("string").alias("text")), shingle, similarity)
    rows = docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    side = lambda t: (F.broadcast(t) if t.count() <= BROADCAST_ROWS else t).select(F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash"))
    same = (F.col("hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    rows = rows.join(side(gone), same, "left_anti")
    if not several.isEmpty():  # equal rows: the first by all of its columns
        again = rows.join(side(several), same, "left_semi").withColumn("n", F.row_number().over(W.partitionBy("doc_id", "hash").orderBy(F.xxhash64("row")))).where("n = 1").drop("n")
        rows = rows.join(side(several), same, "left_anti").unionByName(again)
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
