"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of the last 16 bytes is taken at the end of each word; where it falls under a threshold, about every
fifth word, the text is cut. Cuts depend on the text around them only, so an insertion moves none but those beside it.
A chunk reaches from a cut to the first cut that is at least WORDS words on, and one reaches from the last cut where
that is possible to the text's end; chunks begin at every cut and so overlap. Chunks are deduplicated by digest: the
smallest doc_id that has a chunk keeps it, all others lose it. Since at every step the kept text stands in an earlier
document, no passage is lost altogether.

A digest is 64 bits of hash and the chunk's length. Sums by digest are partial before the shuffle, and the join that
brings keepers to chunks is one that adaptive execution can split, so a chunk that a third of all documents have is
no single task. What a row loses is gathered by doc_id and a hash of the text: rows that share a doc_id but not a text
lose what is in them, and equal rows are gathered once.

Defined cases: null and empty texts, and those of fewer than WORDS words, have no chunks and stay as they are; a chunk
that repeats within one document only, or between rows of one doc_id, stays; a null doc_id stays; an empty table gives
an empty result; other columns are carried along whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .shared import WORD, keep, let, small_batches, table

#: Words of a chunk at least, one cut in so many words, bytes that the gear hash sees, bytes of text handled at once.
WORDS, CUT_EVERY, GEAR_BYTES, BATCH_BYTES = 16, 5, 16, 1 << 21
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the GEAR_BYTES bytes up to each byte: the sum of the bytes' table values, each shifted by its age."""
    out, span = _GEAR[data], 1
    while span < GEAR_BYTES:
        older = out[:-span] << np.uint32(span)
        out = out.copy()
        out[span:] += older
        span *= 2
    return out


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """text number, begin, end (bytes of the text) and digest of every chunk."""
    gap = b"\n" * (GEAR_BYTES + 1)
    raw = gap + gap.join(texts) + gap
    begin = np.cumsum([len(gap)] + [len(t) + len(gap) for t in texts])[: len(texts)]
    data = np.frombuffer(raw, dtype=np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = np.flatnonzero(word[1:] & ~word[:-1]) + 1, np.flatnonzero(word[:-1] & ~word[1:])
    none = np.zeros(0, dtype=np.int64)
    if not len(first):
        return none, none, none, []
    text = np.searchsorted(begin, first, "right") - 1
    final = np.append(text[1:] != text[:-1], True)
    cut = (gear(data)[last] < np.uint32((1 << 32) // CUT_EVERY)) | final
    opens = np.flatnonzero(np.append(True, cut[:-1]))
    cuts, ends = np.flatnonzero(cut), np.flatnonzero(final)
    end = ends[np.searchsorted(ends, opens)]  # the last word of the text
    at = np.searchsorted(cuts, opens + WORDS - 1)
    fits = (at < len(cuts)) & (opens + WORDS - 1 <= end)
    opens, end, stop = opens[fits], end[fits], cuts[at[fits]]
    tail = np.flatnonzero(np.append(text[opens][1:] != text[opens][:-1], True)) if len(opens) else none
    tail = tail[stop[tail] != end[tail]]
    opens, stop = np.append(opens, opens[tail]), np.append(stop, end[tail])
    a, b, own = first[opens], last[stop] + 1, text[opens]
    return own, a - begin[own], b - begin[own], [xxh3_64_intdigest(raw[i:j]) for i, j in zip(a.tolist(), b.tolist())]


def _chunk_rows(batches):
    for batch in batches:
        ids, hashes, texts = batch.column("doc_id").to_numpy(), batch.column("hash").to_numpy(), [(t or "").encode() for t in batch.column("text").to_pylist()]
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH_BYTES):
                size += len(texts[to])
                to += 1
            own, a, b, digest = chunks(texts[at:to])
            if len(own):
                cells = [np.array(digest, dtype=np.uint64).view(np.int64), (b - a).astype(np.int32), ids[at:to][own], hashes[at:to][own], a.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["digest", "size", "doc_id", "hash", "begin"])
            at = to


#: SQL of the spans' runs: spans ascend, and so do their ends; a run ends before a span that begins beyond it.
_RUNS = let(
    "filter(sequence(0, size(s) - 1), i -> i = 0 OR s[i].begin > get(s, i - 1).end)",
    "opens",
    """transform(opens, (o, k) -> struct(s[o].begin AS begin, s[coalesce(get(opens, k + 1), size(s)) - 1].end AS end,
         array_min(transform(slice(s, o + 1, coalesce(get(opens, k + 1), size(s)) - o), x -> x.first_doc_id)) AS first_doc_id))""",
)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _lost(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), spans (begin, end, first_doc_id) of rows that lose something; spans ascend and are apart."""
    small_batches(docs.sparkSession)
    d = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(F.col("text")).alias("hash"), F.col("text").cast("string").alias("text"))
    rows = keep(d.mapInArrow(_chunk_rows, "digest long, size int, doc_id long, hash long, begin int"), "chunks")
    shared = rows.groupBy("digest", "size").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last")).where("first_doc_id < last").drop("last")
    lost = rows.join(shared, ["digest", "size"]).where("doc_id > first_doc_id").select("doc_id", "hash", F.struct("begin", (F.col("begin") + F.col("size")).alias("end"), "first_doc_id").alias("span"))
    return lost.groupBy("doc_id", "hash").agg(F.array_sort(F.collect_set("span")).alias("s")).select("doc_id", "hash", F.expr(_RUNS).alias("spans"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, begin, end (bytes of the UTF-8 text) of passages that doc_id loses, first_doc_id: the smallest document that has a chunk of it."""
    return _lost(docs).select("doc_id", F.explode("spans").alias("x")).select("doc_id", "x.*")


#: SQL of text without spans (begin, end in bytes; ascending and apart): the pieces between them.
_WITHOUT = let(
    "encode(text, 'UTF-8')",
    "raw",
    """array_join(transform(sequence(0, size(spans)), i -> decode(substring(raw,
         CASE WHEN i = 0 THEN 1 ELSE get(spans, i - 1).end + 1 END,
         coalesce(get(spans, i).begin, octet_length(text)) - CASE WHEN i = 0 THEN 0 ELSE get(spans, i - 1).end END), 'UTF-8')), '')""",
)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with text (and n_chars, if there) without repeated passages; a row that loses all its words goes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(F.col("text")).alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(_lost(docs), ["doc_id", "hash"], "left").select("row", "spans", F.col("row.text").cast("string").alias("text"))
    cut = F.col("spans").isNotNull()
    rows = rows.select("row", "spans", F.when(cut, F.expr(_WITHOUT)).alias("text")).where(~cut | F.col("text").rlike(WORD))
    put = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[F.when(cut, put[c]).otherwise(F.col("row")[c]).alias(c) if c in put else F.col("row")[c].alias(c) for c in docs.columns])


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "begin", "end", "first_doc_id")
