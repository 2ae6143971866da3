"""SimHash near-duplicates: an exact Hamming join of fingerprints through vantage-point trees, and its components.

A fingerprint has 64 bits; two link if at most 4 differ. The bits are cut in three blocks: linked fingerprints differ
by at most one bit in one block at least. Each block has its vantage-point tree. Its upper levels are built from a
bounded sample of fingerprints and deal all of them out to shards: a fingerprint lives in one leaf, and as a query it
also visits each leaf beyond a boundary that its ball of radius one crosses (triangle bound). In each shard the tree
is continued in memory down to small blocks of pairs, which are compared exactly; a block that no vantage point parts
is worked off in balls, so that near copies of one text are linked without being paired. A shard returns a spanning
forest of its links, never more rows than it has fingerprints; connected components join the shards' forests.

Documents with equal fingerprints are one class, so copies are never paired with each other. Classes with more than
one in HOT_CLASSES of all rows, fewer than HOT_CLASSES by definition, are broadcast to name their rows; all others are joined.

Defined cases: a null or empty text has fingerprint zero; texts of fewer words than a shingle hash their whole word
sequence; repeated rows each get their row; rows with a null doc_id take part, and never name a component unless all
of it is null; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .components import connected_components
from .shared import keep, small_batches, table

SHINGLE, SEED, RADIUS = 4, 42, 4
#: (shift, bits) of the blocks; linked fingerprints differ by at most RADIUS // 3 bits in one of them.
BLOCKS = ((0, 21), (21, 21), (42, 22))
BLOCK_RADIUS = RADIUS // len(BLOCKS)
#: Fingerprints of the sample that the upper levels are built from, for each of their leaves, at least and about at most;
#: fingerprints that a shard should hold.
SAMPLE_LEAF, SAMPLE_ROWS, SAMPLE_MAX, SHARD_ROWS = 16, 4096, 1 << 20, 32768
HOT_CLASSES = 2000
#: Pairs that are compared at once.
PAIRS = 1 << 20


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's shingles, repeats included; of the whole word sequence, if it is shorter; none without words."""
    words = (text or "").encode().lower().split()
    if len(words) < shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)][: len(words)], dtype="<u8")
    return np.fromiter(map(partial(xxh64_intdigest, seed=SEED), map(b" ".join, zip(*(words[i:] for i in range(shingle))))), dtype="<u8", count=len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # a sum of 255 bits fits a byte
        ones += np.add.reduce(np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def _fingerprints(batches):
    for batch in batches:
        fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_fingerprints, "doc_id long, fp long")


def _distance(values: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(values ^ np.uint64(point)).astype(np.int16)


def _split(values: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point of values and the distance that parts them most evenly; None if all are alike."""
    best = None
    for point in rng.choice(values, size=min(4, len(values))):
        counts = np.cumsum(np.bincount(_distance(values, point), minlength=2))
        uneven = np.abs(2 * counts[:-1] - len(values))
        mu = int(np.argmin(uneven)) if len(uneven) else 0
        if counts[mu] < len(values) and (best is None or uneven[mu] < best[0]):
            best = (uneven[mu], np.uint64(point), mu)
    return best and best[1:]


def upper_tree(values: np.ndarray, depth: int, rng: np.random.Generator):
    """Nested (point, mu, near, far); a leaf is None."""
    values = np.unique(values)
    if depth <= 0 or len(values) < 8 or not (cut := _split(values, rng)):
        return None
    near = _distance(values, cut[0]) <= cut[1]
    return (*cut, upper_tree(values[near], depth - 1, rng), upper_tree(values[~near], depth - 1, rng))


def _deal(node, values, index, home, leaf=1):
    """(leaf, index, home) of every leaf that values visit; home: the leaf is where they live."""
    if not len(index):
        return
    if node is None:
        yield leaf, index, home
        return
    point, mu, near, far = node
    d = _distance(values[index], point)
    at = d - BLOCK_RADIUS <= mu
    yield from _deal(near, values, index[at], home[at] & (d[at] <= mu), 2 * leaf)
    at = d + BLOCK_RADIUS > mu
    yield from _deal(far, values, index[at], home[at] & (d[at] > mu), 2 * leaf + 1)


def _dealer(trees):
    def deal(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for t, (shift, bits) in enumerate(BLOCKS):
                values = (fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
                for leaf, index, home in _deal(trees[t], values, np.arange(len(fps)), np.ones(len(fps), dtype=bool)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), t * (1 << 40) + leaf)), pa.array(fps[index].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    return deal


class Forest:
    """Union of links between places of an array, in vectors; the memory is that of the array."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: np.ndarray) -> np.ndarray:
        p = self.parent[i]
        while True:
            q = self.parent[p]
            if np.array_equal(p, q):
                return p
            p = q

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root(i), self.root(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _links(fps, values, queries, data, forest, rng, depth=0):
    """Links the places of queries with those of data within RADIUS; both are places of fps and their block's values."""
    if not len(queries) or not len(data):
        return
    if len(queries) * len(data) > PAIRS and depth < 60 and (cut := _split(values[data], rng)):
        dq, dd = _distance(values[queries], cut[0]), _distance(values[data], cut[0])
        _links(fps, values, queries[dq - BLOCK_RADIUS <= cut[1]], data[dd <= cut[1]], forest, rng, depth + 1)
        _links(fps, values, queries[dq + BLOCK_RADIUS > cut[1]], data[dd > cut[1]], forest, rng, depth + 1)
        return
    if len(queries) * len(data) > PAIRS:
        _balls(fps, queries, data, forest)
    else:
        i, j = np.nonzero(np.bitwise_count(fps[queries][:, None] ^ fps[data][None, :]) <= RADIUS)
        forest.link(queries[i], data[j])


def _balls(fps, queries, data, forest):
    """Links as _links does, in balls around one point after another.

    What is within RADIUS of the point links to it. Beyond that, only queries within twice RADIUS can link to the ball
    (triangle bound), and only those that are not connected with it yet are compared with it.
    """
    while len(data):
        point = data[:1]
        q, d = _distance(fps[queries], fps[point[0]]), _distance(fps[data], fps[point[0]])
        ball, near = data[d <= RADIUS], queries[q <= RADIUS]
        forest.link(ball, np.broadcast_to(point, len(ball)))
        forest.link(near, np.broadcast_to(point, len(near)))
        ring = queries[(q > RADIUS) & (q <= 2 * RADIUS)]
        step = max(1, PAIRS // len(ball))
        while len(ring := ring[forest.root(ring) != forest.root(point)]):
            part, ring = ring[:step], ring[step:]
            i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[ball][None, :]) <= RADIUS)
            forest.link(part[i], ball[j])
        data = data[d > RADIUS]


def _solve(key, group):
    shift, bits = BLOCKS[key[0].as_py() >> 40]
    fps = group.column("fp").to_numpy().view(np.uint64)
    values = (fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    forest = Forest(len(fps))
    _links(fps, values, np.arange(len(fps)), np.flatnonzero(group.column("home").to_numpy()), forest, np.random.default_rng(SEED))
    root = forest.root(np.arange(len(fps)))
    at = np.flatnonzero(root != np.arange(len(fps)))
    return pa.table({"a": fps[at].view(np.int64), "b": fps[root[at]].view(np.int64)})


def hamming_forest(fps: DataFrame) -> DataFrame:
    """fps: fp, distinct. Returns a, b: links that connect whatever chains of links within RADIUS connect."""
    rows = fps.count()
    depth = max(2, int(np.ceil(np.log2(max(1, rows / SHARD_ROWS)))) + 1)
    every = max(1, rows // min(SAMPLE_MAX, max(SAMPLE_ROWS, SAMPLE_LEAF << depth)))
    sample = fps.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).toArrow().column("fp").to_numpy().astype(np.int64).view(np.uint64)
    rng = np.random.default_rng(SEED)
    trees = [upper_tree((sample >> np.uint64(shift)) & np.uint64((1 << bits) - 1), depth, rng) for shift, bits in BLOCKS]
    return fps.mapInArrow(_dealer(trees), "shard long, fp long, home boolean").groupBy("shard").applyInArrow(_solve, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    marked = keep(fingerprints(docs), "simhash")
    classes = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "simhash-classes")
    parts = connected_components(hamming_forest(classes.select("fp"))).withColumnRenamed("node", "fp")
    joined = parts.join(classes, "fp")
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = parts.join(least, "component").select("fp", "component_id")
    named = keep(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "doc_id").alias("component_id"), "n"), "simhash-named")
    hot = F.col("n") * HOT_CLASSES > marked.count()
    few = F.broadcast(named.where(hot).drop("n"))
    rest = marked.join(few, "fp", "left_anti").join(named.where(~hot).drop("n"), "fp")
    return marked.join(few, "fp").unionByName(rest)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
