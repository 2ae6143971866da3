"""Source mixing against a plain statement of its rules."""

import numpy as np
import pytest
from odd_tables import CLASHES, DOCS
from pyspark.sql import functions as F

from corpusmill.llm import mixing, shared


def brute_targets(sizes, weights, most=3):
    """Shares by weight; what is over most times a source's size is fixed there, the rest shared anew."""
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free -= set(over)
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 100, 100], [0, 10], [0, 0], [1, 1, 1, 1000, 3, 7, 50, 2, 900]])
def test_targets(spark, sizes):
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    rows = spark.createDataFrame(list(zip(sizes, weights)), "source_size long, weight double")
    level = mixing.fill_level(rows)
    assert [min(3.0 * s, level * w) for s, w in zip(sizes, weights)] == pytest.approx(brute_targets(sizes, weights))


def test_split_tree():
    counts = np.array([1000, 37, 0, 5])
    out = mixing.split_tree(counts, 7)
    assert (out.sum(0) == counts).all() and out.sum(1).max() - out.sum(1).min() <= 3 and (mixing.split_tree(counts, 7) == out).all()
    left = np.array([mixing.split_tree(np.array([60, 30, 10]), 2, seed)[0] for seed in range(400)])
    assert np.abs(left.mean(0) - [30, 15, 5]).max() < 0.5 and (left.sum(1) == 50).all()


def test_numbered(spark):
    names = [f"s{i}" for i in range(3000)] + ["é", "漢", "🙂", "", "Z"]
    rows = spark.createDataFrame([(x,) for x in names] + [(None,)], "source string").repartition(7)
    got = {r["source"]: r["n"] for r in shared.numbered(rows, [F.col("source").isNull(), F.col("source")], "n").collect()}
    assert got == {x: i for i, x in enumerate([*sorted(names), None])}


def near_targets(docs, got, source):
    """What each source takes comes to its target, or short of it by less than one document."""
    sizes = {s: sum(r["size"] for r in got if source(r) == s) for s in {source(r) for r in got}}
    names = sorted(sizes)
    goal = dict(zip(names, brute_targets([sizes[s] for s in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))])))
    for s in names:
        own = [r for r in got if source(r) == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(goal[s]) for r in own)
        assert 0 <= goal[s] - sum(r["taken"] for r in own) < max(r["size"] for r in own) + 1
    assert all(r["taken"] == 0 or r["size"] and r["taken"] // r["size"] in (1, 2, 3) and r["taken"] % r["size"] == 0 for r in got)


def test_mix(spark, odd, empty):
    rows = [(i, "w " * (1 + i * 7919 % 97), "en", f"s{i % 4}", 0) for i in range(1200)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.taken(mixing.plan(docs)).collect()
    assert len(got) == 1200
    near_targets(docs, got, lambda r: f"s{r['doc_id'] % 4}")
    again = mixing.taken(mixing.plan(docs.repartition(5))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    mixed = mixing.mixed(docs, shards=4, shard_column="shard")
    count = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert count == {r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]}
    assert mixed.select("shard").distinct().count() == 4
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and all(r[c] == f"own {c}" for r in out.collect() for c in CLASHES)
    assert mixing.taken(mixing.plan(odd)).count() == odd.count()
    assert mixing.taken(mixing.plan(empty)).count() == 0 and mixing.mixed(empty).count() == 0


def test_mix_of_many_blocks(spark, monkeypatch):
    """Small blocks, ranges and groups: the tree's counts hold in every shard, blocks are bounded, sums stay exact."""
    for name, value in (("BLOCK_WORDS", 200), ("BLOCK_DOCS", 8), ("RANGE", 16), ("GROUPS", 3)):
        monkeypatch.setattr(mixing, name, value)
    docs = spark.createDataFrame([(i, "w " * (1 + i * 7919 % 37), "en", f"s{min(i % 11, 5)}", 0) for i in range(6000)], DOCS)
    mix = mixing.plan(docs)
    got = mixing.taken(mix).collect()
    near_targets(docs, got, lambda r: f"s{min(r['doc_id'] % 11, 5)}")
    placed = mixing._placed(mix.sized, mix.sources, 6)
    assert placed.groupBy("place", "block").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] < 1000
    blocks = mixing.dealt(mix, 9).collect()
    copies = {(r["place"], r["block"]): r["copies"] for r in mix.blocks.collect()}
    assert {(r["place"], r["block"]): len(r["shards"]) for r in blocks} == copies and len(copies) > 300
    per = np.zeros((9, 6), dtype=int)
    for r in blocks:
        for s in r["shards"]:
            per[s, r["place"]] += 1
    top = sorted(range(6), key=lambda p: (-per[:, p].sum(), p))[:3]
    tree = mixing.split_tree(np.array([*per[:, top].sum(0), per.sum() - per[:, top].sum()]), 9)
    assert (per[:, top] == tree[:, :3]).all() and (per.sum(1) == tree.sum(1)).all()
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, mixing.taken(mixing.plan(docs.repartition(3))).collect())) == sorted(map(tuple, got))


def test_mix_of_many_sources(spark, monkeypatch):
    """More sources than the driver would hold, each with a few words; and a doc_id that a third of all rows share."""
    docs = spark.range(15_000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("some words of "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("host"), (F.col("id") % 12_000).cast("string")).alias("source"))
    got = mixing.taken(mixing.plan(docs))
    assert got.count() == 15_000
    total = got.agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.sum(F.col("target") * F.col("size") / F.col("source_size")).alias("target")).first()
    assert total["target"] == pytest.approx(total["size"]) and 0.4 < total["taken"] / total["size"] <= 1
    assert mixing.mixed(docs, shards=5).count() == got.agg(F.sum(F.col("taken") / F.col("size"))).first()[0]


def test_op3_takes_what_the_tree_deals(spark, monkeypatch, tmp_path):
    """The query draws the tree and counts the shards that it deals a document to; a table without rows gives none."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 50), "en", f"s{i % 4}", 0) for i in range(2000)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    drawn, tree = [], mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda counts, shards, *a: drawn.append((counts.sum(), shards)) or tree(counts, shards, *a))
    got = mixing.op3_source_mix(spark, str(tmp_path)).collect()
    near_targets(docs, got, lambda r: f"s{r['doc_id'] % 4}")
    assert len(got) == 2000 and [n for _, n in drawn] == [mixing.LEAST_SHARDS] and drawn[0][0] > 0
    assert mixing.op3_source_mix(spark, f"{tmp_path}/none").count() == 0
