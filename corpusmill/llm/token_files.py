"""Token ids as raw binary shards with minimal perfect hash indexes.

File format, two tables in one folder. ``segments``, in ascending doc_id order: a segment holds the raw little-endian
ids of its documents (16 bits where the vocabulary allows it, else 32), its number and those of its first document and
ids, the keys, and an index: a minimal perfect hash over the keys, and at each key's slot a 32-bit fingerprint and the
place of its ids. ``directory``: the keys dealt by hash to buckets of bounded size; a bucket is a minimal perfect hash
with, at each key's slot, a fingerprint and the shard and segment where the key's first row stands.

The hash is the cascade of bit arrays of BBHash: each level marks the keys that alone hash to their bit, the others
go on to the next level; a slot is the rank of the key's bit. A lookup reads one bucket of the directory, one index of
a segment and the bytes of the document alone; in each it reads one bit per level, one fingerprint and one place,
whatever the number of keys. A key that was never written fails the fingerprints, but for one in 2^32.

Texts are encoded where they are read; what is shuffled is ids. Rows are dealt to shards by ranges of doc_id and a hash
of the text, whose bounds come from a bounded sample, so the rows of one doc_id, or of none, are cut like any others,
and a segment is cut after a bounded number of ids wherever that falls. Repeated doc_ids are consecutive, in the order
of that hash; indexes point at the first of their rows.

Defined cases: a null text counts as empty and has the end id alone; a null doc_id sorts first and is not indexed;
an empty table gives files without rows; other columns aren't read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import drop_path, keep, new_path, small_batches, table

END_ID, SEED = 2, 11
#: Bytes of text behind a shard, shards at most, rows that are sampled for their bounds, about.
SHARD_BYTES, SHARDS, SAMPLED = 16 << 20, 1 << 16, 1 << 16
#: Ids after which a segment is cut, keys of a bucket of the directory, segments that one task reads for their keys, and to give all back.
SEGMENT_IDS, BUCKET_KEYS, KEYS_TASK, READ_TASK = 1 << 20, 1 << 16, 64, 16
#: Encoded strings in a generation of those that a worker remembers.
CACHE = 400_000
#: A space between two other characters that aren't white space always begins a new token: what stands on its two sides is encoded apart.
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE, _ODD_ASCII = re.compile(r"[^\S \n]"), "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"


#: Letters with at most one space before them: whatever follows that is no letter begins a new token.
_LETTERS = re.compile(r" ?[^\W\d_]+")
#: The character that stands for each byte in the model's alphabet: itself where it can be printed, else one from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PRINTED))}


class Encoder:
    """Whole texts to ids by the tokenizers library; strings between lone spaces are encoded apart, once, and remembered.

    A string falls further apart at single line feeds and after its leading letters, where the library's pre-tokenizer
    always cuts; strings of letters are single pre-tokens and go to the library's model directly.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.model, self.code = self.tokenizer.model, "H" if self.dtype == "<u2" else "I"
        self.known, self.spaced = _Known(self, ""), _Known(self, " ")

    def parts(self, text: str) -> list[str]:
        odd = any(map(text.__contains__, _ODD_ASCII)) if text.isascii() else _ODD_SPACE.search(text)
        if odd or "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
            return _LONE_SPACE.split(text)
        return text.split(" ")

    def part(self, x: str) -> bytes:
        return self.spaced[x[1:]] if x[:1] == " " else self.known[x]

    def ids(self, x: str) -> bytes:
        """The ids of a string whose ends are ends of tokens."""
        lines, word = x.split("\n"), _LETTERS.match(x)
        if len(lines) > 1 and all(y and not y[-1].isspace() and (i == 0 or not y[0].isspace()) for i, y in enumerate(lines)):
            return self.known["\n"].join(map(self.part, lines))
        if word and word.end() < len(x) and word.group().lstrip(" ").isalpha() and not x[word.end()].isalpha():
            return self.part(word.group()) + self.known[x[word.end() :]]
        return array(self.code, self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of dtype."""
        out, known, spaced = [], self.known, self.spaced.__getitem__
        for text in texts:
            parts = self.parts(text)
            out.append(b"".join([known[parts[0]], *map(spaced, parts[1:])]))
        return out


class _Known(dict):
    """Ids of strings, or of strings with a space before them, made when first asked for; of two generations, the older one goes."""

    def __init__(self, encoder: Encoder, before: str):
        super().__init__()
        self.encoder, self.before, self.older = encoder, before, {}
        self.mark, self.code, self.tokenize = before and _BYTE_CHARS[ord(before)], encoder.code, encoder.model.tokenize

    def __missing__(self, x: str) -> bytes:
        found = self.older.get(x)
        if found is None:
            if x.isalpha():  # a single pre-token
                chars = self.mark + (x if x.isascii() else "".join([_BYTE_CHARS[b] for b in x.encode()]))
                found = array(self.code, [t.id for t in self.tokenize(chars)]).tobytes()
            elif x[:-1].isalpha() and x[-1] in ".,;:!?":
                found = self[x[:-1]] + self.encoder.known[x[-1]]
            else:
                found = self.encoder.ids(self.before + x)
        if len(self) >= CACHE:
            self.older = self.copy()
            self.clear()
        self[x] = found
        return found


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for a worker process, whatever the number of its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """splitmix64 of the keys, another function at each level."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bits of a level for each of its keys.
GAMMA = 2


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of bits, and the rank of each byte's first bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, total = levels, [], 0
        for bits in levels:
            counts = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(total + np.cumsum(counts) - counts)
            total += int(counts.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.asarray(keys, dtype=np.int64)
        while len(left):
            n = 8 * (GAMMA * len(left) // 8 + 1)
            at = (_mix(left, len(levels)) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has its bit."""
        keys = np.asarray(keys, dtype=np.int64)
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = (_mix(keys[left], level) % np.uint64(8 * len(bits))).astype(np.int64)
            byte, bit = bits[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> bit) & 1 == 1
            below = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1))).astype(np.int64)
            out[left[hit]] = (ranks[at >> 3] + below)[hit]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return b"".join([np.array([len(self.levels), *map(len, self.levels)], dtype="<i4").tobytes(), *[x.tobytes() for x in self.levels]])

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<i4", 1)[0])
        at, levels = 4 + 4 * n, []
        for size in np.frombuffer(raw, "<i4", n, 4):
            levels.append(np.frombuffer(raw, np.uint8, size, at))
            at += int(size)
        return cls(levels)


def key_fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(np.asarray(keys), 1000) >> np.uint64(32)).astype("<u4")


_SEGMENT = "shard int, segment int, first_key long, last_key long, n_docs long, n_ids long, id_bytes int, keys binary, starts binary, mphf binary, fingerprints binary, slots binary, payload binary"


def _segment(shard, number, keys, blobs, width) -> pa.RecordBatch:
    """One row: starts has the place of each document's ids, slots the document of each slot of the hash."""
    sizes = np.array([len(b) // width for b in blobs], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    named = np.array([i for i, k in enumerate(keys) if k is not None and (not i or keys[i - 1] != k)], dtype=np.int64)
    own = np.array([keys[i] for i in named], dtype=np.int64)
    mphf = PerfectHash.build(own)
    at = mphf.slots(own)
    slots, prints = np.zeros(len(own), dtype="<i4"), np.zeros(len(own), dtype="<u4")
    slots[at], prints[at] = named, key_fingerprint(own)
    row = {
        "shard": shard, "segment": number, "first_key": int(own[0]) if len(own) else None, "last_key": int(own[-1]) if len(own) else None, "n_docs": len(keys), "n_ids": int(starts[-1]), "id_bytes": width,
        "keys": pa.array(keys, pa.int64()).fill_null(0).to_numpy().astype("<i8").tobytes() + np.array([k is None for k in keys], dtype=np.uint8).tobytes(),
        "starts": starts.tobytes(), "mphf": mphf.to_bytes(), "fingerprints": prints.tobytes(), "slots": slots.tobytes(), "payload": b"".join(blobs),
    }
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in _SEGMENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([row[n]], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


class Bounds:
    """Where shards begin, in the order of doc_id (null first) and hash."""

    def __init__(self, rows: list[tuple[int | None, int]], shards: int):
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        rows = [rows[len(rows) * i // shards] for i in range(1, shards)] if rows else []
        self.null = np.array([h for k, h in rows if k is None], dtype=np.int64)
        self.keys = np.array([k for k, _ in rows if k is not None], dtype=np.int64)
        self.hashes = np.array([h for k, h in rows if k is not None], dtype=np.int64)

    def shard(self, keys: pa.Array, hashes: np.ndarray) -> np.ndarray:
        none, own = keys.is_null().to_numpy(zero_copy_only=False), keys.fill_null(0).to_numpy()
        lo, hi = np.searchsorted(self.keys, own, "left"), np.searchsorted(self.keys, own, "right")
        out = len(self.null) + lo
        for i in set(lo[(lo < hi) & ~none].tolist()):  # keys that several shards share
            at = (lo == i) & (lo < hi)
            out[at] += np.searchsorted(self.hashes[i : hi[at][0]], hashes[at], "right")
        out[none] = np.searchsorted(self.null, hashes[none], "right")
        return out.astype(np.int32)


def _encoded(tokenizer: str, end_id: int, bounds: Bounds):
    def run(batches):
        encoder = encoder_of(tokenizer)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in batches:
            shard = bounds.shard(batch.column("doc_id"), batch.column("hash").to_numpy())
            blobs = [ids + end for ids in encoder.encode([x or "" for x in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("doc_id"), batch.column("hash"), pa.array(blobs, pa.binary())], names=["shard", "doc_id", "hash", "ids"])

    return run


def _packer(width: int, most: int):
    def pack(batches):
        shard, number, keys, blobs, size = None, 0, [], [], 0
        for batch in batches:
            for s, k, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "ids"))):
                if keys and (s != shard or size >= most):
                    yield _segment(shard, number, keys, blobs, width)
                    number, keys, blobs, size = (number + 1) if s == shard else 0, [], [], 0
                shard = s
                keys.append(k)
                blobs.append(ids)
                size += len(ids) // width
        if keys:
            yield _segment(shard, number, keys, blobs, width)

    return pack


def _segment_keys(batches):
    """The keys of segments, each with the segment it stands in."""
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n_docs"]
            keys, null = np.frombuffer(row["keys"], "<i8", n), np.frombuffer(row["keys"], np.uint8, n, 8 * n)
            keys = np.unique(keys[null == 0])
            place = (row["shard"] << 32) + row["segment"]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), place, dtype=np.int64))], names=["key", "place"])


_BUCKET = "bucket long, buckets long, mphf binary, fingerprints binary, places binary"


def _bucket(buckets: int):
    def run(key, rows):
        keys, places = rows.column("key").to_numpy(), rows.column("place").to_numpy()
        mphf = PerfectHash.build(keys)
        at, out, prints = mphf.slots(keys), np.zeros(len(keys), dtype="<i8"), np.zeros(len(keys), dtype="<u4")
        out[at], prints[at] = places, key_fingerprint(keys)
        cells = [pa.array([x], pa.int64()) for x in (key[0].as_py(), buckets)] + [pa.array([x], pa.binary()) for x in (mphf.to_bytes(), prints.tobytes(), out.tobytes())]
        return pa.Table.from_arrays(cells, names=[c.split()[0] for c in _BUCKET.split(", ")])

    return run


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(np.asarray(keys, dtype=np.int64), 2000) % np.uint64(buckets)).astype(np.int64)


def _bucketed(buckets: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bucket_of(batch.column("key").to_numpy(), buckets)), batch.column("key"), batch.column("place")], names=["bucket", "key", "place"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encodes docs (doc_id, text) and writes the segments and their directory to path."""
    spark = docs.sparkSession
    small_batches(spark)
    width = np.dtype(encoder_of(tokenizer).dtype).itemsize
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    n = docs.count()
    some = docs.sample(min(1.0, SAMPLED / max(n, 1)), SEED).select("doc_id", "hash", F.octet_length("text")).limit(2 * SAMPLED).collect()
    size = sum(r[2] or 0 for r in some) / max(len(some), 1) * n
    shards = int(max(1, min(SHARDS, size // SHARD_BYTES + 1)))
    made = docs.mapInArrow(_encoded(tokenizer, end_id, Bounds([tuple(r)[:2] for r in some], shards)), "shard int, doc_id long, hash long, ids binary")
    dealt = made.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "hash")
    dealt.select("shard", "doc_id", "ids").mapInArrow(_packer(width, SEGMENT_IDS), _SEGMENT).write.option("compression", "none").parquet(f"{path}/segments")
    segments = spark.read.parquet(f"{path}/segments")
    keys = segments.select("shard", "segment", "n_docs", "keys").coalesce(1 + segments.count() // KEYS_TASK).mapInArrow(_segment_keys, "key long, place long").groupBy("key").agg(F.min("place").alias("place"))
    buckets = max(1, -(-(segments.agg(F.sum("n_docs")).first()[0] or 0) // BUCKET_KEYS))
    built = keys.mapInArrow(_bucketed(buckets), "bucket long, key long, place long").groupBy("bucket").applyInArrow(_bucket(buckets), _BUCKET)
    built.write.parquet(f"{path}/directory")


def _reader(batches):
    """Every document of a segment, each key looked up in the index."""
    for batch in batches:
        for row in batch.to_pylist():
            n, dtype = row["n_docs"], f"<u{row['id_bytes']}"
            keys, null = np.frombuffer(row["keys"], "<i8", n), np.frombuffer(row["keys"], np.uint8, n, 8 * n)
            starts, ids = np.frombuffer(row["starts"], "<i8"), np.frombuffer(row["payload"], dtype)
            at = find(row, keys)
            first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])])
            again = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
            at = np.where(null == 1, np.arange(n), at + again)
            if n and at.min() < 0:
                raise ValueError(f"a key of segment {row['shard']}/{row['segment']} isn't in its index")
            crc = [zlib.crc32(ids[starts[i] : starts[i + 1]].astype("<u4").tobytes()) for i in at]
            out = {"shard": pa.array([row["shard"]] * n, pa.int32()), "segment": pa.array([row["segment"]] * n, pa.int32()), "doc_id": pa.array(keys, mask=null == 1), "local": pa.array(starts[at]), "n_tokens": pa.array(starts[at + 1] - starts[at]), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def find(row: dict, keys: np.ndarray, values: str = "slots", dtype: str = "<i4") -> np.ndarray:
    """What the index of a segment (or of a bucket of the directory) has for each key, -1 for keys that it doesn't have."""
    slots, prints = np.frombuffer(row[values], dtype), np.frombuffer(row["fingerprints"], "<u4")
    at = PerfectHash.from_bytes(row["mphf"]).slots(keys)
    held = at >= 0
    held[held] = prints[at[held]] == key_fingerprint(np.asarray(keys)[held])
    out = np.full(len(at), -1, dtype=np.int64)
    out[held] = slots[at[held]]
    return out


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, segment, base: ids before the segment. Sums are made by shard first, so the last window has a row for each shard."""
    segments = spark.read.parquet(f"{path}/segments").select("shard", "segment", "n_ids")
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("_before", F.sum("n").over(W.orderBy("shard")) - F.col("n"))
    inner = F.sum("n_ids").over(W.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    return segments.withColumn("_inner", inner).join(shards, "shard").select("shard", "segment", (F.col("_before") + F.col("_inner")).alias("base"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents in the files."""
    segments = spark.read.parquet(f"{path}/segments")
    rows = segments.coalesce(1 + segments.count() // READ_TASK).mapInArrow(_reader, "shard int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(segment_starts(spark, path), ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: list[int]) -> dict[int, list[int]]:
    """The ids of a few keys: of the directory their buckets are read, of the segments that these name the indexes, of the payloads the keys' own bytes."""
    wanted = np.array(sorted(set(keys)), dtype=np.int64)
    directory, segments, out = spark.read.parquet(f"{path}/directory"), spark.read.parquet(f"{path}/segments"), {}
    known = directory.select("buckets").first()
    if not len(wanted) or not known:
        return out
    bucket, places = _bucket_of(wanted, known["buckets"]), {}
    for row in directory.where(F.col("bucket").isin(*set(bucket.tolist()))).toLocalIterator():
        own = wanted[bucket == row["bucket"]]
        places |= {int(k): int(p) for k, p in zip(own, find(row.asDict(), own, "places", "<i8")) if p >= 0}
    at = lambda p: (F.col("shard") == p >> 32) & (F.col("segment") == p & (1 << 32) - 1)
    for place in set(places.values()):
        own = np.array([k for k, p in places.items() if p == place], dtype=np.int64)
        row = segments.where(at(place)).select("id_bytes", "starts", "mphf", "fingerprints", "slots").first()
        starts, width = np.frombuffer(row["starts"], "<i8"), row["id_bytes"]
        found = [(k, int(starts[i]) * width, int(starts[i + 1] - starts[i]) * width) for k, i in zip(own.tolist(), find(row.asDict(), own)) if i >= 0]
        cells = segments.where(at(place)).select(*[F.substring("payload", a + 1, n) for _, a, n in found]).first()
        out |= {k: np.frombuffer(raw, f"<u{width}").tolist() for (k, _, _), raw in zip(found, cells)}
    return out


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    found = keep(read_tokens(spark, path), "token-digests")
    drop_path(spark, path)
    return found
