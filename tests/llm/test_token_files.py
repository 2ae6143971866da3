"""Token files against the library, with hot keys and keyed access."""

import zlib
from collections import Counter

import numpy as np
from odd_tables import ODD_TEXTS
from pyspark.sql import functions as F

from corpusmill.llm import token_files


def test_token_files(spark, odd, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [*ODD_TEXTS, "tabs\tand  spaces \n end", " x", "x ", "don't we'll 12 3,4", "a b c\x1fd e"]
    assert [np.frombuffer(b, "<u2").tolist() for b in token_files.Encoder(path).encode([t or "" for t in texts])] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    token_files.write_tokens(odd, str(tmp_path / "odd"), path)
    got = token_files.read_tokens(spark, str(tmp_path / "odd")).orderBy("start").collect()
    assert len(got) == odd.count() and got[0]["doc_id"] is None
    start = 0
    for r in got:
        text = "no id at all" if r["doc_id"] is None else ODD_TEXTS[r["doc_id"]] or ""
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.lookup(spark, str(tmp_path / "odd"), [3, 77, 0]) == {3: [*tokenizer.encode("one").ids, 2], 0: [2]}
    token_files.write_tokens(empty, str(tmp_path / "empty"), path)
    assert token_files.read_tokens(spark, str(tmp_path / "empty")).count() == 0
    assert token_files.lookup(spark, str(tmp_path / "empty"), [3]) == {}


def test_token_files_cut_inside_a_key(spark, tmp_path, monkeypatch):
    """Rows of one doc_id, and rows without one, fill many segments of several shards; other documents are found among them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "SHARD_BYTES", 200_000)
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 8_000)
    monkeypatch.setattr(token_files, "BUCKET_KEYS", 50)
    path, out = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "hot")
    n = F.col("id")
    rows = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.when(n % 2 == 0, "one and the same").otherwise(F.concat(F.lit("row "), n.cast("string"))).alias("text"))
    rows = rows.unionByName(spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("none "), (n % 10).cast("string")).alias("text")))
    rows = rows.unionByName(spark.range(1, 500).select((n * n).alias("doc_id"), F.concat(F.lit("document "), n.cast("string")).alias("text")).where("doc_id <> 7"))
    token_files.write_tokens(rows, out, path)
    segments = spark.read.parquet(f"{out}/segments")
    assert segments.agg(F.max("n_ids")).first()[0] < 8_100
    assert segments.where("first_key <= 7 AND last_key >= 7").select("shard").distinct().count() >= 3 and segments.where("first_key IS NULL").select("shard").distinct().count() >= 3
    got = token_files.read_tokens(spark, out).orderBy("start").collect()
    assert len(got) == 200_499 and [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys)
    tokenizer = Tokenizer.from_file(path)
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], dtype="<u4").tobytes())
    assert Counter(r["ids_crc32"] for r in got if r["doc_id"] == 7) == Counter(crc("one and the same" if i % 2 == 0 else f"row {i}") for i in range(100_000))
    found = token_files.lookup(spark, out, [9, 8, 249001, 7])
    assert found.keys() == {9, 249001, 7} and found[9] == [*tokenizer.encode("document 3").ids, 2] and found[249001] == [*tokenizer.encode("document 499").ids, 2]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(-(2**62), 2**62, 20000))
    h = token_files.PerfectHash.from_bytes(token_files.PerfectHash.build(keys).to_bytes())
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert token_files.PerfectHash.build(keys[:0]).slots(keys[:5]).tolist() == [-1] * 5
