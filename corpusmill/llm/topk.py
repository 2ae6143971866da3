"""Exact top-k search by inner product: a Voronoi kNN join with distance bounds from group summaries.

Vectors are quantised to integers. Pivots are the centres that a few rounds of k-means find on a bounded sample, about
as many as the square root of the number of vectors; each vector joins its nearest pivot's group. A group's summary is
its count, the least and the largest distance from the pivot and the largest norm N. First each query is solved in its
own group, whose k-th best product is a floor that its answers reach. For a vector d of another group, at distances
between r and R from its pivot p, the product q.d is at most the least of q.p + |q| R, |q| N, and
(|q|^2 + N^2 - g^2) / 2, where g = max(0, |q - p| - R, r - |q - p|) is what parts q from d at least. Only groups whose
bound reaches the floor get the query. Groups are cut in blocks of bounded size, and a block that very many queries
visit is given to several tasks with a share of them each; each solves its queries exactly, and the top k are merged.

What is pruned depends on the data: clustered vectors visit a few groups; for vectors of random directions in many
dimensions, bounds don't part groups, and their queries meet all blocks.

Products are taken in doubles where all are exact (below 2^53), else in Python integers.

Defined cases: vectors that are null or empty, or hold a null or a non-finite component, take no part; vectors of other lengths
than the query's are no candidates; equal scores go to the smaller vec_id; a query never finds rows of its own vec_id;
repeated rows are one query and several candidates; fewer candidates than k give fewer rows; null vec_ids take no part;
components and products beyond the range of a long are its ends; an empty table gives an empty result. Of more than
LENGTHS lengths of vectors the rarer ones have no pivots, and a query visits all of its length; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import keep, small_batches, table

#: Vectors in a block, about; queries that one task has for a block at most, about.
BLOCK, QUERIES = 8192, 65536
#: Lengths of vectors that have pivots; pivots of a length at most, their bytes at most; sampled vectors for each of them.
LENGTHS, PIVOTS, PIVOT_BYTES, SAMPLED = 16, 4096, 4 << 20, 8
ROUNDS, SEED = 4, 5
_LOW, _HIGH = -(2**63), 2**63 - 1
_ASSIGNED = "vec_id long, dim long, grp long, dist double, norm double, raw binary"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: the integers; only vectors whose components are all there and finite."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.when(x * scale >= 2.0**63, F.lit(_HIGH)).when(x * scale < -(2.0**63), F.lit(_LOW)).otherwise(F.floor(x * scale).cast("long"))
    return vectors.where((F.size("embedding") > 0) & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, whole).alias("v"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with those of b, exact up to the ends of a long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, _LOW, _HIGH).astype(np.int64)


def _pack(v: list[int]) -> bytes:
    """The integers in the fewest bytes that hold them all: their width follows from the length."""
    x = np.array(v, dtype="<i8")
    most, least = int(x.max()), int(x.min())
    return x.astype(next(f"<i{w}" for w in (2, 4, 8) if -(1 << 8 * w - 1) <= least and most < 1 << 8 * w - 1)).tobytes()


def _unpack(raws: list[bytes], dim: int) -> np.ndarray:
    if len({len(r) for r in raws}) == 1:
        return np.frombuffer(b"".join(raws), f"<i{len(raws[0]) // dim}").reshape(len(raws), dim).astype(np.int64)
    return np.array([np.frombuffer(r, f"<i{len(r) // dim}") for r in raws], dtype=np.int64).reshape(len(raws), dim)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None, :]))


def centres(sample: np.ndarray, k: int) -> np.ndarray:
    """k-means centres of the rows, at most k."""
    sample = np.unique(sample, axis=0)
    rng = np.random.default_rng(SEED)
    found = sample[rng.permutation(len(sample))[:k]]
    for _ in range(ROUNDS):
        near = _distances(sample, found).argmin(1)
        held, near = np.unique(near, return_inverse=True)
        sums = np.zeros((len(held), sample.shape[1]))
        np.add.at(sums, near, sample)
        found = sums / np.bincount(near)[:, None]
    return found


def _assign(pivots: dict[int, np.ndarray]):
    """Group of each vector: the nearest pivot of its length, or group 0 and the zero vector where there is none."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column("vec_id").to_numpy(), batch.column("v").to_pylist()
            for dim in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == dim]
                x, p = np.array([rows[i] for i in at], dtype=np.float64).reshape(len(at), dim), pivots.get(dim, np.zeros((1, dim)))
                g = np.concatenate([_distances(x[i : i + 1024], p).argmin(1) for i in range(0, len(x), 1024)])
                dist, norm = np.sqrt(((x - p[g]) ** 2).sum(1)), np.sqrt((x * x).sum(1))
                cells = [pa.array(ids[at]), pa.array(np.full(len(at), dim)), pa.array(g), pa.array(dist), pa.array(norm), pa.array([_pack(rows[i]) for i in at], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=[c.split()[0] for c in _ASSIGNED.split(", ")])

    return run


def _router(pivots: dict[int, np.ndarray], summary: dict[int, np.ndarray]):
    """Each query goes to the blocks of every group but its own that can hold one of its k best. summary: r, R, N and blocks of each group."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in set(dims[np.isin(dims, list(pivots))].tolist()):
                part = batch.filter(pa.array(dims == dim))
                raws, floor = part.column("raw").to_pylist(), part.column("floor").to_numpy(zero_copy_only=False)
                q, p, (low, high, most, blocks) = _unpack(raws, dim).astype(np.float64), pivots[dim], summary[dim].T
                apart, size = _distances(q, p), np.sqrt((q * q).sum(1))[:, None]
                gap = np.maximum(0, np.maximum(apart - high, low - apart)) * (1 - 1e-9)
                bound = np.minimum(np.minimum(q @ p.T + size * high, size * most), (size**2 + most**2 - gap**2) / 2)
                slack = 1 + 1e-9 * (size + np.sqrt((p * p).sum(1)) + high) ** 2  # for what doubles round
                go = (bound + slack >= floor[:, None]) & (blocks > 0)
                go[np.arange(len(q)), part.column("grp").to_numpy()] = False
                query, group = np.nonzero(go)
                many = blocks[group].astype(np.int64)
                query, group = np.repeat(query, many), np.repeat(group, many)
                block = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)
                for i in range(0, len(query), 16384):
                    at = pa.array(query[i : i + 16384])
                    yield pa.RecordBatch.from_arrays([part.column("vec_id").take(at), part.column("dim").take(at), pa.array(group[i : i + 16384]), pa.array(block[i : i + 16384]), part.column("raw").take(at)], names=["vec_id", "dim", "grp", "block", "raw"])

    return run


def _solver(k: int):
    def solve(key, queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out, dim = {"query_id": [], "raw": [], "vec_id": [], "score": []}, int(key[0])
        if len(queries) and len(data):
            data = data.sort_values("vec_id", kind="stable")
            ids, x = data["vec_id"].to_numpy(), _unpack(list(data["raw"]), dim)
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                raws = list(part["raw"])
                for q, raw, s in zip(part["vec_id"].to_numpy(), raws, products(_unpack(raws, dim), x)):
                    s, own = (s, ids) if not (ids == q).any() else (s[ids != q], ids[ids != q])
                    if len(s) > k:
                        near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                        s, own = s[near], own[near]
                    best = np.lexsort((own, ~s))[:k]  # ~s falls as s rises and never leaves the range
                    out["query_id"] += [q] * len(best)
                    out["raw"] += [raw] * len(best)
                    out["vec_id"] += own[best].tolist()
                    out["score"] += s[best].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    return solve


def _solved(asked: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """asked: vec_id, dim, grp, block, raw; data the same. The k best of each query in each of its blocks."""
    keys = ["dim", "grp", "block"]
    parts = asked.groupBy(*keys).agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
    asked = asked.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("vec_id", "raw"), "parts")).drop("parts")
    data = data.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return asked.groupBy(*keys, "part").cogroup(data.groupBy(*keys, "part")).applyInPandas(_solver(k), "query_id long, raw binary, vec_id long, score long")


def _pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Pivots of the LENGTHS commonest lengths."""
    sized = vectors.withColumn("dim", F.size("v"))
    out = {}
    for dim, n in sized.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect():
        want = max(1, min(int(n**0.5), PIVOTS, PIVOT_BYTES // (8 * dim)))
        some = sized.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(max(1, n // (SAMPLED * want)))) == 0)).limit(2 * SAMPLED * want)
        rows = [r["v"] for r in some.select("v").collect()] or [[0] * dim]
        out[dim] = centres(np.array(rows, dtype=np.float64), want)
    return out


def _routes(queries: DataFrame, vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The data in blocks, what queries find in their own groups, and the other blocks they must visit."""
    small_batches(vectors.sparkSession)
    pivots = _pivots(vectors)
    grouped = keep(vectors.mapInArrow(_assign(pivots), _ASSIGNED), "voronoi")
    facts = grouped.where(F.col("dim").isin(*pivots)).groupBy("dim", "grp").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("norm").alias("most"), F.count("*").alias("n")).collect()
    summary = {d: np.zeros((len(p), 4)) for d, p in pivots.items()}
    for r in facts:  # a row for each pivot
        summary[r["dim"]][r["grp"]] = (r["low"] * (1 - 1e-9), r["high"] * (1 + 1e-9), r["most"] * (1 + 1e-9), -(-r["n"] // BLOCK))
    counts = grouped.groupBy("dim", "grp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    data = grouped.join(counts, ["dim", "grp"]).select("vec_id", "dim", "grp", F.pmod(F.xxhash64("vec_id", "raw"), "blocks").alias("block"), "raw")
    asked = keep(queries.mapInArrow(_assign(pivots), _ASSIGNED).dropDuplicates(["vec_id", "raw"]), "asked")
    home = asked.join(counts, ["dim", "grp"]).select("vec_id", "dim", "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "raw")
    found = keep(_solved(home, data, k), "found-home")
    best = found.withColumn("n", F.row_number().over(W.partitionBy("query_id", "raw").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") == k)
    floor = best.select(F.col("query_id").alias("vec_id"), "raw", F.col("score").cast("double").alias("floor"))
    floored = asked.join(floor, ["vec_id", "raw"], "left").select("vec_id", "dim", "grp", "raw", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    return data, found, keep(floored.mapInArrow(_router(pivots, summary), "vec_id long, dim long, grp long, block long, raw binary"), "routed")


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Both: vec_id, v (array of long). Returns query_id, rank, vec_id, score."""
    data, found, routed = _routes(queries, vectors, k)
    found = found.unionByName(_solved(routed, data, k))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
