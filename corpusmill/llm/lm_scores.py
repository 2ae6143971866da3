"""Scoring by cross-entropy difference of two matched n-gram models.

The target model is learned from the documents that labels.quality marks as good, the background model from all
documents. Both share one vocabulary and one set of bigrams, and are smoothed alike: a bigram's probability is
(count + MU * unigram) / (history's count + MU), a unigram's has one added to its count. A document's score is the mean
over its words of target loss minus background loss; lower means more like the target.

Nothing is cut: the models have every word and every bigram of the corpus, and one unknown word besides. They are never
in one place. Documents are dealt out to blocks, labels with them; a block counts its words and bigrams and sends the
sorted keys with their counts to shards of the key space. A shard adds up the counts of all blocks, and answers each
block with the sums alone, in the order of the keys that the block sent. The block counts again, meets the same keys in
the same order and scores its documents with the sums. So a bigram costs some bytes for each block that has it, however
common it is; the driver sees the number of words and the models' totals only.

A key is 63 bits of a hash of the word or of the two words, and a bit that tells words from bigrams; two words or
bigrams with one key would be counted as one.

Defined cases: a null or empty text has no words and null losses; without labelled documents the target model is its
smoothing alone; repeated label rows count as good if one is; an empty table gives an empty result; rows without a
doc_id are scored, and have no label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .shared import keep, small_batches, table

MU = 200.0
#: Characters of a block and of the text behind a shard, about; and how many of each there are at least.
BLOCK_CHARS, SHARD_CHARS, BLOCKS, SHARDS = 8 << 20, 24 << 20, 256, 128
#: Words whose hashes a worker remembers.
REMEMBERED = 400_000


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all words, of all bigrams, the places of the bigrams' second words, and where each text begins, and the end."""
    parts, at = [], [0]
    for text in texts:
        found = words(text)
        parts.append(np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found)))
        at.append(at[-1] + len(found))
    hashes, at = np.concatenate([np.empty(0, np.uint64), *parts]), np.array(at)
    second = np.ones(len(hashes), dtype=bool)
    second[at[:-1][at[:-1] < len(hashes)]] = False
    second = np.flatnonzero(second)
    pairs = _mix(_mix(hashes[second - 1]) + hashes[second] * np.uint64(0x9E3779B97F4A7C15))
    return hashes | np.uint64(1), pairs & ~np.uint64(1), second, at


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers by bytes of equal weight, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


CHUNK = "shard long, block long, n long, keys binary, t binary, b binary"
SUMS = "block long, shard long, n long, t binary, b binary, words long, target long, background long"


def _arrow(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in ddl.split(", ")))
    return pa.table([pa.array(list(c), kinds[t]) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=list(names))


def _counter(shards: int):
    def count(key, docs, good):
        """The block's keys and counts, a row for each shard."""
        uni, pairs, second, at = _keys(docs.column("text").to_pylist())
        marks = np.isin(docs.column("doc_id").fill_null(0).to_numpy(), good.column("doc_id").to_numpy()) & docs.column("doc_id").is_valid().to_numpy()
        marks = np.repeat(marks, np.diff(at))
        unique, where = np.unique(np.concatenate([uni, pairs]), return_inverse=True)
        t = np.bincount(where, np.concatenate([marks, marks[second]]), minlength=len(unique)).astype(np.uint64)
        b = np.bincount(where, minlength=len(unique))
        shard = (unique >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        ends, rows = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64)), []
        for s in np.flatnonzero(np.diff(ends)):
            i, j = ends[s], ends[s + 1]
            rows.append((int(s), key[0].as_py(), int(j - i), _pack(np.diff(unique[i:j], prepend=np.uint64(0))), _pack(t[i:j]), _pack(b[i:j])))
        return _arrow(rows, CHUNK)

    return count


def _sum(key, chunks):
    """Counts of all blocks, for each block's keys; the shard's words and the models' totals of them are in one row."""
    rows = chunks.select(["block", "n", "keys", "t", "b"]).to_pylist()
    unique, where = np.unique(np.concatenate([np.cumsum(_unpack(r["keys"], r["n"]), dtype=np.uint64) for r in rows]), return_inverse=True)
    t, b = (np.bincount(where, np.concatenate([_unpack(r[c], r["n"]) for r in rows]), minlength=len(unique)).astype(np.uint64) for c in "tb")
    word = (unique & np.uint64(1)).astype(bool)
    totals, out, at = (int(word.sum()), int(t[word].sum()), int(b[word].sum())), [], 0
    for r in rows:
        own = where[at : at + r["n"]]
        at += r["n"]
        out.append((r["block"], key[0].as_py(), r["n"], _pack(t[own]), _pack(b[own]), *totals))
        totals = (0, 0, 0)
    return _arrow(out, SUMS)


def _scorer(size: int, totals: tuple[int, int]):
    def score(key, docs, sums):
        uni, pairs, second, at = _keys(docs.column("text").to_pylist())
        where = np.unique(np.concatenate([uni, pairs]), return_inverse=True)[1]
        rows = sorted(sums.select(["shard", "n", "t", "b"]).to_pylist(), key=lambda r: r["shard"])
        losses = []
        for c, total in zip("tb", totals):
            counts = np.concatenate([np.empty(0), *(_unpack(r[c], r["n"]) for r in rows)])[where]
            own, pair = counts[: len(uni)], counts[len(uni) :]
            p = (own + 1) / (total + size)
            loss = -np.log(p)
            loss[second] = -np.log((pair + MU * p[second]) / (own[second - 1] + MU))
            ends = np.concatenate([[0], np.cumsum(loss)])[at]
            losses.append(np.diff(ends))
        n, (t, b) = np.diff(at), losses
        none, per = n == 0, np.maximum(n, 1)
        return pa.table([docs.column("doc_id"), pa.array(n), *(pa.array(x / per, mask=none) for x in (t, b, t - b))], names=["doc_id", "n_words", "target_loss", "background_loss", "difference"])

    return score


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (means over words) and difference."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, shards = max(BLOCKS, chars // BLOCK_CHARS), max(SHARDS, chars // SHARD_CHARS)
    # Rows without a doc_id have no label to meet and are dealt out by their text.
    dealt = docs.withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks))).groupBy("block")
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = good.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).groupBy("block")
    sums = keep(dealt.cogroup(good).applyInArrow(_counter(shards), CHUNK).groupBy("shard").applyInArrow(_sum, SUMS), "lm-sums")
    n, *totals = (x or 0 for x in sums.agg(F.sum("words"), F.sum("target"), F.sum("background")).first())
    answers = sums.select("block", "shard", "n", "t", "b").groupBy("block")
    return dealt.cogroup(answers).applyInArrow(_scorer(n + 1, tuple(totals)), "doc_id long, n_words long, target_loss double, background_loss double, difference double")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
