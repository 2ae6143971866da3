"""Micro-cases with values that follow from the definitions."""

import math

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import stats
from corpusmill.functions import text as T
from corpusmill.operators import chunking, contamination, dedup, gates, joins
from corpusmill.sources import io, scorers


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "lenient", "official"),
    [("ANSWER: B", "B", "B"), ("think\nANSWER: A\nANSWER: C", "C", "C"), ("foo ANSWER: D.", "D", "D"), ("A) NOMA", "A", ""), ("ANSWER: B, C, E", "", ""), ("ANSWER: E", "", ""), (None, "", ""), ("", "", ""), ("answer: c\r\n", "C", "C")],
)
def test_parser(spark, said, lenient, official):
    c = F.lit(said).cast("string")
    assert one(spark, T.parse_letter(c, F.lit(4)), a=1) == lenient
    assert one(spark, T.parse_letter(c, F.lit(4), bare=False), a=1) == official


def test_normalisers(spark):
    assert one(spark, T.norm_ws(F.col("t")), t=" a  b\n") == "a b"
    assert one(spark, T.norm_tag_deleted(F.col("t")), t="What? [Release 18]") == one(spark, T.norm_tag_deleted(F.col("t")), t="what?")
    assert one(spark, T.norm_nfkc(F.col("t")), t="ﬁne ①") == "fine 1"
    assert one(spark, T.norm_tokens(F.col("t")), t="A-b, C3!") == "a b c3"


def test_rotation_is_a_permutation_and_keeps_gold(spark):
    for n in (2, 3, 4, 5):
        for shift in range(n):
            choices = [f"c{i}" for i in range(n)]
            left = one(spark, T.rotate_left("c", str(shift)), c=choices)
            assert left == choices[shift:] + choices[:shift]
            assert left[(1 - shift) % n] == choices[1]
            right = one(spark, T.rotate_right("c", str(shift)), c=choices)
            assert right[(1 + shift) % n] == choices[1]


def test_statistics(spark):
    for b, c, p in ((0, 0, 1.0), (5, 5, 1.0), (0, 5, 0.0625)):
        assert math.isclose(one(spark, stats.binomial_two_sided("b", "c"), b=b, c=c), p, rel_tol=1e-9)
    exact = min(1, 2 * sum(math.comb(1310, i) for i in range(555)) / 2**1310)
    assert math.isclose(one(spark, stats.binomial_two_sided("b", "c"), b=554, c=756), exact, rel_tol=1e-6)
    assert [one(spark, x, n=0) for x in stats.wilson(F.lit(0), F.col("n"))] == [0, 0]


def test_heuristic(spark):
    for choices, want in ((["a", "All of the above", "ccc"], 1), (["a", "Both x", "cccccccccc"], 1), (["aa", "bb", "None of the above"], 0), (["a", "bbb", "ccc"], 1)):
        assert one(spark, T.heuristic_index("c"), c=choices) == want


def test_draws(spark):
    import hashlib

    got = one(spark, T.h01("salt", F.col("k")), k="x")
    assert got == int.from_bytes(hashlib.sha256(b"salt|x").digest()[:8], "big") / 2**64


def test_packing_and_budgets(spark):
    assert one(spark, dedup.pack("s", 10, 15), s=[4, 4, 4, 9, 20, 1]) == [0, 0, 0, 1, 2, 3]


def test_token_overlap(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "c"])], "a array<string>, b array<string>")
    assert df.select(T.token_f1("a", "b")).first()[0] == pytest.approx(2 / 3)
    assert df.select(T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"), 1.0)).first()[0] == 1.0


def test_verbatim_item_raises_full_hits_by_one(spark):
    docs = spark.createDataFrame([(1, "some words that are not in any item at all today")], "doc_id long, text string")
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert contamination.tail_tiers(docs, items).count() == 0
    more = docs.union(spark.createDataFrame([(2, f"before {item.upper()} after")], "doc_id long, text string"))
    assert [tuple(r) for r in contamination.tail_tiers(more, items).collect()] == [(7, 1, 1, 0)]


def test_gates(spark):
    rows = spark.createDataFrame([(1, "a"), (2, ""), (3, "zz")], "id int, t string")
    rules = [("empty", F.col("t") == ""), ("short", F.length("t") < 2)]
    assert {r["id"]: r["reason"] for r in gates.first_reason(rows, rules).collect()} == {1: "short", 2: "empty", 3: None}
    assert {r["id"]: r["reasons"] for r in gates.all_reasons(rows, rules).collect()} == {1: ["short"], 2: ["empty", "short"], 3: []}


def test_sections_and_running_lines(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny\n# C\nz")], "doc_id long, text string")
    got = {r["section"]: (r["trail"], r["text"]) for r in chunking.sections(docs).collect()}
    assert got == {0: ([], "intro"), 1: (["A"], "x"), 2: (["A", "B"], "y"), 3: (["C"], "z")}
    pages = spark.createDataFrame([(1, p, f"HEAD\nbody{p} inter-\nnational\nrest\na\nb\nc") for p in range(4)], "doc_id long, page int, text string")
    texts = [r["text"] for r in chunking.without_running_lines(pages, edge=1).orderBy("page").collect()]
    assert texts[0] == "body0 international\nrest\na\nb"


def test_joins(spark):
    parent = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    retry = spark.createDataFrame([(2, None), (9, "q")], "id int, v string")
    assert sorted(map(tuple, joins.upsert(parent, retry, "id").collect())) == [(1, "x"), (2, None)]
    check = joins.partition_check([parent, parent.where("id = 1")], parent.union(spark.createDataFrame([(5, "z")], "id int, v string")), "id").first()
    assert tuple(check) == (1, 1, 0)


def test_sources(spark, tmp_path):
    from pyspark.sql import types as S

    row = S.StructType([S.StructField("sample_id", S.StringType()), S.StructField("correct", S.BooleanType())])
    for name, text in (("list", '[{"sample_id":"a","correct":true}]'), ("envelope", '{"summary":{},"results":[{"sample_id":"a","correct":true}]}'), ("keyed", '{"k":{"sample_id":"a","correct":true}}')):
        (tmp_path / name).write_text(text)
        assert [tuple(r) for r in io.read_results(spark, str(tmp_path / name), row).collect()] == [("a", True)]
    (tmp_path / "rows.jsonl").write_text('{"sample_id":"a","correct":true}\nnonsense\n')
    assert io.read_jsonl(spark, str(tmp_path / "rows.jsonl"), row).cache().where("_corrupt_record IS NOT NULL").count() == 1
    tiles = io.tiling(spark.createDataFrame([(0, 5), (5, 3), (9, 1)], "offset long, total long")).orderBy("offset")
    assert [r["tiles"] for r in tiles.collect()] == [True, True, False]


def test_scorer_retries_and_keeps_errors(spark):
    def fails(prompts):
        raise RuntimeError("down")

    rows = spark.createDataFrame([("a", "p")], "sample_id string, prompt string")
    assert [tuple(r) for r in scorers.score(rows, fails).collect()] == [("a", None, "down")]
    assert scorers.score(rows, lambda p: [x.upper() for x in p]).first()["completion"] == "P"
