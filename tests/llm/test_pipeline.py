"""The pipeline on odd and planted documents, stage by stage."""

import numpy as np
import pytest
from odd_tables import CLASHES, DOCS

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(0, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf_dir):
    rng = np.random.default_rng(11)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(n))
    rows = [(i, text(120) + (" idiot moron scum you idiot" if i % 10 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(200)]
    passage = text(70)
    rows += [(1000, rows[1][1], "en", "s0", 0), (1001, f"{text(50)} {passage} {text(50)}", "en", "s1", 0), (1002, f"{text(60)} {passage}", "en", "s1", 0), (1003, "", "en", None, 0), (1004, None, None, None, None), (None, text(40), "en", "s2", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    clean = spark.createDataFrame(corpus_pipeline.toxicity_stage(spark, docs, sf_dir).collect(), docs.schema)
    ids = {r["doc_id"] for r in clean.collect()}
    assert not {i for i in ids if i is not None and i < 200 and i % 10 == 0} and {i for i in range(200) if i % 10} <= ids
    near = spark.createDataFrame(corpus_pipeline.near_dedup_stage(spark, clean, sf_dir).collect(), docs.schema)
    ids = [r["doc_id"] for r in near.collect()]
    assert 1000 not in ids and 1 in ids and len(ids) == len(set(ids)) and 1004 not in ids and None in ids
    cut = spark.createDataFrame(corpus_pipeline.substring_stage(spark, near, sf_dir).collect(), docs.schema)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert len(texts[1002].split()) < 100 and passage in texts[1001]
    mixed = corpus_pipeline.mix_stage(spark, cut, sf_dir)
    assert mixed.columns == docs.columns
    assert "ids" in corpus_pipeline.encode_stage(spark, mixed, sf_dir).columns


def test_near_dedup_meets_brute_force(spark, sf_dir):
    rng = np.random.default_rng(13)
    rows = []
    for k in range(120):
        base = [f"w{i}" for i in rng.integers(0, 50000, 200)]
        rows.append((2 * k, " ".join(base), "en", "s", 0))
        for n in range(k % 4):  # up to three copies of each with some words changed
            at = rng.choice(200, rng.integers(1, 9), replace=False)
            rows.append((2 * k + 1000 + 500 * n, " ".join("new" + str(n) if i in at else w for i, w in enumerate(base)), "en", "s", 0))
    sets = [{tuple(x.split()[i : i + 5]) for i in range(196)} for _, x, *_ in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    want = {min(rows[i][0] for i in range(len(rows)) if label[i] == c) for c in set(label)}
    assert 120 < len(want) < len(rows)
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, DOCS), sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)


def test_near_dedup_rows_without_or_with_one_doc_id(spark, sf_dir):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("a")), (None, text("b")), (7, text("b")), (1, text("c")), (5, text("c")), (5, text("d")), (6, text("e")), (6, text("f"))]
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS), sf_dir).collect()
    assert sorted((str(r["doc_id"]), r["text"][0]) for r in got) == [("1", "c"), ("5", "d"), ("6", "e"), ("6", "f"), ("7", "b"), ("None", "a")]


def test_near_dedup_meets_brute_force_on_texts_with_a_common_passage(spark, sf_dir, monkeypatch):
    """Buckets of very many texts that share most of their words are joined by their rare shingles."""
    from corpusmill.llm import near_copies

    monkeypatch.setattr(near_copies, "SMALL", 4)
    rng = np.random.default_rng(19)
    passage, rows = [f"p{i}" for i in range(80)], []
    for i in range(400):
        own = [f"w{x}" for x in rng.integers(0, 50000, rng.integers(5, 60))]
        rows.append((i, " ".join([*own, *passage]), "en", "s", 0))
        if i % 7 == 0:
            rows.append((1000 + i, " ".join([*own, *passage, *[f"x{x}" for x in rng.integers(0, 50000, rng.integers(1, 30))]]), "en", "s", 0))
    sets = [{tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for _, x, *_ in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    want = {min(rows[i][0] for i in range(len(rows)) if label[i] == c) for c in set(label)}
    assert len(want) < len(rows) - 30
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, DOCS), sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)


def test_prefix_pairs_miss_nothing(spark):
    from corpusmill.llm import near_copies

    rng = np.random.default_rng(20)
    texts = []
    for i in range(150):
        words = [f"w{x}" for x in rng.integers(0, 60, rng.integers(6, 40))]
        texts.append(" ".join(words))
        texts.append(" ".join(words[rng.integers(0, 3) :] + [f"v{x}" for x in rng.integers(0, 9, rng.integers(0, 3))]))
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "class long, text string")
    alone = spark.createDataFrame([], "class long, component long")
    first = near_copies.prefixes(df, 5, 0.8)
    got = {(r["a"], r["b"]) for r in near_copies.prefix_pairs(first, alone, 0.8).collect()}
    assert {(r["a"], r["b"]) for r in near_copies.prefix_pairs(first, alone, 0.8, star=True).collect()} <= got
    want = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) > 50 and want <= got and len(got) < 4 * len(want)


def test_stages_meet_odd_tables(spark, sf_dir, odd):
    """No column of the input is lost or changed, whatever its name; n_chars follows the text."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns, name
        assert out.count() and all(r[c] == f"own {c}" for r in out.collect() for c in CLASHES), name
    out = corpus_pipeline.encode_stage(spark, odd, sf_dir)
    assert out.columns == [c for c in odd.columns if c != "text"] + ["ids_"] and out.count() == odd.count()


def test_near_dedup_of_rows_without_words(spark, sf_dir, odd):
    got = corpus_pipeline.near_dedup_stage(spark, odd, sf_dir).select("doc_id").collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(map(str, [0, 3, 4, 5, 6, 7, 8, 9, None]))


def test_empty(spark, sf_dir):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
