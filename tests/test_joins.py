"""Joins by place and by text, substring joins, token blocks and streams on small cases."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusmill.operators import item_gates, joins, retrieval
from corpusmill.sources import io, scratch
from corpusmill.streaming import appends


def test_alignment(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y ")], "place int, text string")
    b = spark.createDataFrame([(1, " x", 10), (2, "y", 20)], "place int, text string, more int")
    assert sorted(map(tuple, joins.aligned(a, b, "place", "text").collect())) == [(1, "x", 10), (2, "y ", 20)]
    with pytest.raises(PySparkException, match="misaligned"):
        joins.aligned(a, b.withColumn("text", F.lit("z")), "place", "text").collect()


def test_containing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d x"), (3, "zz a b c d e")], "doc_id long, text string")
    strings = spark.createDataFrame([(7, "a b c d e"), (8, "b c d")], "string_id long, string string")
    assert sorted(map(tuple, joins.containing(docs, strings).collect())) == [(1, 7), (3, 7)]


def test_neighbours_of_a_hot_key(spark):
    edges = spark.range(500).select(F.col("id").alias("unit"), F.lit(1).alias("key")).unionByName(spark.createDataFrame([(1000, 2)], "unit long, key int"))
    got = joins.neighbours(edges, "unit", "key", "s").collect()
    assert len(got) == 1500 and all(r["unit"] != r["other"] for r in got)


def test_tightest_span(spark):
    rows = spark.createDataFrame([(1, 1, "aa .......... bb cc", ["aa", "bb", "cc"]), (1, 2, "x aa bb cc", ["aa", "bb", "cc"]), (1, 3, "aa bb", ["aa", "bb", "cc"])], "item_id long, doc_id long, text string, options array<string>")
    assert [tuple(r) for r in retrieval.tightest_spans(rows).collect()] == [(1, 2, 8, 3)]


def test_hard_negatives(spark):
    rows = spark.createDataFrame([(["", "Gold", "one two", "ONE two ", "a b c d e f g h i j k l m n", "three"], "gold")], "proposals array<string>, gold string")
    r = item_gates.hard_negatives(rows).first()
    assert [x["reason"] for x in r["judged"]] == ["empty", "equals_answer", None, "duplicate", "too_long", None] and r["kept"] == ["one two", "three"]


def test_token_blocks(spark):
    rows = spark.createDataFrame([("a", i, list(range(10 * i, 10 * i + i))) for i in range(8)] + [("b", 1, [1, 2])], "key string, at int, tokens array<int>")
    path = scratch.new_path(spark, "blocks")
    io.write_token_blocks(rows, path, "key", "at", "tokens", 5)
    got = {(r["key"], r["block"]): r["tokens"] for r in spark.read.parquet(path).collect()}
    flat = [10 * i + k for i in range(8) for k in range(i)]
    assert got == {("a", b): flat[5 * b : 5 * b + 5] for b in range(len(flat) // 5)}


def test_stream_goes_to_a_table(spark, tmp_path):
    spark.createDataFrame([(i % 4,) for i in range(9)], "id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    assert appends.run_to_end(stream, "t").count() == 9


def test_located_shuffles_no_runs(spark):
    """The corpus is met by a broadcast of the windows' keys; its runs reach no exchange."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j}" for j in range(30))) for i in range(40)], "doc_id long, text string")
    windows = docs.where("doc_id < 5").select(F.col("doc_id").alias("win_id"), "text").union(spark.createDataFrame([(9, "x " * 20), (10, "short")], "win_id long, text string"))
    got = joins.located(windows, docs)
    assert {r["win_id"]: r["found"] for r in got.collect()} == {0: True, 1: True, 2: True, 3: True, 4: True, 9: False}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "LeftSemi" not in plan
