"""Ranks and running sums in ranges against plain windows, with a hot key, null keys and ties of values."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dedup, ranges, sampling, scoring


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 50 == 1, None).otherwise(F.concat(F.lit("k"), (i % 17).cast("string")))
    return spark.range(6000).select(i, key.alias("key"), (i * 7919 % 101).alias("v")).repartition(6)


def test_running_sums(rows):
    order = [F.desc("v"), F.col("id")]
    a, b = (ranges.running(rows, ["key"], order, F.col("v"), "before", small=n).orderBy("id").collect() for n in (1 << 20, 0))
    assert a == b and len(a) == 6000
    a, b = (ranges.numbered(rows, [], [F.col("id")], "n", small=n).orderBy("id").collect() for n in (1 << 20, 0))
    assert a == b and [r["n"] for r in b] == list(range(6000))


def test_operators_by_ranges(rows, monkeypatch):
    cases = {
        "capped": lambda: dedup.capped(rows, "key", "id", 0.05, 5),
        "budget": lambda: dedup.budget_prefix(rows, "key", "v", "id", "v", 900),
        "blocks": lambda: dedup.blocks(rows, "key", "id", "v", 64),
        "cycle": lambda: dedup.cycle(rows.select("id"), "id", 2.5),
        "stratified": lambda: sampling.stratified(rows, "key", "id", "s", 500),
        "held": lambda: sampling.held_out(rows, "key", "id", "s", 0.05),
        "ranks": lambda: scoring.nearest_rank(rows, "key", "v", [0, 50, 99]),
        "debias": lambda: sampling.debias(rows.withColumn("f", F.col("v") > 30), "f", "id", 0.2, "s"),
        "slice": lambda: sampling.slice_rows(rows, "id", 640, 64, 64),
        "interleaved": lambda: dedup.interleaved(rows.select("id"), "id", rows.where("id < 7").select("id"), "id", 10),
    }
    plain = {name: sorted(map(str, f().collect())) for name, f in cases.items()}
    monkeypatch.setattr(ranges, "SMALL", 0)
    for name, f in cases.items():
        assert sorted(map(str, f().collect())) == plain[name] and plain[name], name
    assert len(plain["cycle"]) == 15000 and len(plain["interleaved"]) == 6600 and len(plain["slice"]) == 64
    with pytest.raises(ValueError, match="multiple"):
        sampling.slice_rows(rows, "id", 65, 64, 64)


def test_interleaved(spark):
    got = dedup.interleaved(spark.range(7), "id", spark.range(100, 102), "id", 3).orderBy("place").collect()
    assert [r["id"] for r in got] == [0, 1, 2, 100, 3, 4, 5, 101, 6]


def test_budget_skip(spark):
    rows = spark.createDataFrame([("a", i, c) for i, c in enumerate([4, 8, 5, 2, 1])], "key string, rank int, cost int")
    assert sorted(r["rank"] for r in dedup.budget_skip(rows, "key", "rank", "cost", 10).collect()) == [0, 2, 4]
