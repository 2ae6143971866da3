"""Operators on ids that a run holds more than once: rows meet as SQL joins them, and ties have one outcome."""

import pytest

from corpusmill.operators import analysis, item_gates, scoring, voting
from corpusmill.plans import catalog, catalog_analysis


RUNS = [
    [("a", 0, 0), ("a", 0, 1), ("b", 2, 2), ("c", 1, 1)],
    [("a", 0, 0), ("a", 0, 0), ("a", 1, 1), ("b", 2, 1), ("d", 1, 1)],
    [("a", 0, 0), ("a", 1, 1), ("b", 2, 2), ("b", 2, 2)],
]


def runs_of(spark):
    rows = [[(i, answer, said, said == answer, "ABCD"[said], ["v", "w", "x", "y"]) for i, answer, said in r] for r in RUNS]
    return [spark.createDataFrame(r, "sample_id string, answer int, predicted int, correct boolean, letter string, choices array<string>") for r in rows]


def joined():
    """All triples of rows that share an id."""
    return [(x, y, z) for x in RUNS[0] for y in RUNS[1] for z in RUNS[2] if x[0] == y[0] == z[0]]


def test_agreement(spark):
    same = [t for t in joined() if len({r[2] for r in t}) == 1]
    assert tuple(voting.agreement(runs_of(spark)).first()) == (len(joined()), len(same), sum(t[0][1] == t[0][2] for t in same))
    assert tuple(voting.agreement([r.limit(0) for r in runs_of(spark)]).first()) == (0, 0, 0)


def test_stability(spark):
    k = [sum(r[1] == r[2] for r in t) for t in joined()]
    want = {"solid": k.count(3), "hard": k.count(0), "unstable": len(k) - k.count(3) - k.count(0)}
    got = {r["class"]: r["n"] for r in scoring.stability(runs_of(spark), "sample_id").collect()}
    assert got == {c: n for c, n in want.items() if n}


def test_paired_groups(spark):
    a, b, c = runs_of(spark)
    got = scoring.paired_groups(a, b, "sample_id", {"all": a["answer"] >= 0, "some": a["answer"] == 0}, [c]).collect()
    for r in got:
        own = [(x[1] == x[2], y[1] == y[2]) for x, y, _ in joined() if r["value"] == "all" or x[1] == 0]
        assert (r["n"], r["right_a"], r["right_b"]) == (len(own), sum(x for x, _ in own), sum(y for _, y in own))
        assert (r["only_a"], r["only_b"]) == (own.count((True, False)), own.count((False, True)))
    assert len(got) == 2


@pytest.fixture
def repeated(spark, tmp_path):
    """Parts whose keys have seven digits, so that ten of them share a sample_id."""
    rows = spark.range(1_000_000, 1_000_030).selectExpr("id AS p_partkey", "concat('part ', id % 7) AS p_name", "concat('Brand#', id % 3) AS p_brand", "concat('TYPE ', id % 2) AS p_type", "CAST(id % 50 AS INT) AS p_size")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def by_sql(folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    return sorted(con.execute(catalog.ORACLES[name]).fetchall())


def test_baselines(spark, repeated):
    r = catalog.m04_baselines(spark, repeated).first()
    assert [(r["total"], r["always_a"], r["heuristic"])] == by_sql(repeated, "m04_baselines") and r["total"] == 30


def test_deranged(spark, repeated):
    got = catalog_analysis.j18_derangement(spark, repeated)
    assert sorted(map(tuple, got.select("sample_id", "other").collect())) == by_sql(repeated, "j18_derangement") and got.count() == 30
    one = spark.createDataFrame([("g", "a"), ("h", "b"), ("h", "b")], "g string, id string")
    assert [tuple(r) for r in analysis.deranged(one, "g", "id", "s").collect()] == [("b", "b")] * 2


def test_reward(spark, repeated):
    got = catalog_analysis.m10_reward(spark, repeated).select("sample_id", "reward").collect()
    assert sorted(map(tuple, got)) == by_sql(repeated, "m10_reward") and len(got) == 30


def test_length_by_outcome(spark, repeated):
    got = catalog_analysis.a26_length_by_outcome(spark, repeated).select("outcome", "total", "mean_length").collect()
    assert sorted(map(tuple, got)) == by_sql(repeated, "a26_length_by_outcome") and sum(r["total"] for r in got) == 30


def test_cleaned_keeps_digits(spark):
    rows = spark.createDataFrame([("i", "Which?", [" 0 of 00", "1 or 11", "2 in 22 "], 0)], "item_id string, question string, choices array<string>, gold int")
    assert sorted(item_gates.cleaned(rows, "turn").first()["choices"]) == ["0 of 00", "1 or 11", "2 in 22"]


def test_hard_negatives_of_repeated_ids(spark):
    rows = [("a", "the red fox", ["", "one cat", "two dogs"]), ("a", "a blue whale", ["one cat", "THE RED FOX", "ONE CAT"]), ("b", "red house", ["green sea"])]
    got = item_gates.hard_negatives(spark.createDataFrame(rows, "id string, gold string, proposals array<string>").repartition(3), on="id")
    got = {r["id"]: ([j["reason"] or "ok" for j in r["judged"]], r["kept"]) for r in got.collect()}
    assert got["a"] == (["ok", "empty", "ok", "duplicate", "duplicate", "ok"], ["one cat", "THE RED FOX", "two dogs"])
    assert got["b"] == (["ok"], ["green sea"])


def test_votes_tie_at_one_place(spark):
    """Two rows of one id at one place: the outcome doesn't depend on partitions."""
    ids = spark.range(200).selectExpr("concat('q', id) AS sample_id", "explode(array(3, 1, 2, 0)) AS predicted", "0 AS k")
    for n in (1, 3, 7):
        assert {tuple(r) for r in voting.votes(ids.repartition(n)).select("winner", "n1", "n2", "total").collect()} == {(0, 1, 1, 4)}


def test_subset_votes_of_repeated_ids(spark):
    """An id counts once, whatever its rows."""
    runs = dict(zip("xyz", runs_of(spark)))
    got = {r["subset"]: r["right"] for r in voting.subset_votes(runs, [("x", "y"), ("y", "z"), ("x", "y", "z")]).collect()}
    # a: v by its rows of answer 0; b: x before y (first in x), y before x (first in y), x by 3 of 4; c and d: w.
    assert got == {"x+y": 4, "y+z": 3, "x+y+z": 4}


def test_text_majority_of_repeated_ids(spark):
    runs = runs_of(spark)
    for n in (1, 5):
        got = voting.text_majority([r.repartition(n) for r in runs]).collect()
        assert sorted(map(tuple, got)) == [("a", "v", 4, 7), ("b", "x", 3, 4), ("c", "w", 1, 1), ("d", "w", 1, 1)]
    one = spark.createDataFrame([(f"q{i}", said, "A", list("vwxy")) for i in range(100) for said in (2, 1, 3)], "sample_id string, predicted int, letter string, choices array<string>")
    assert {r["winner"] for r in voting.text_majority([one.repartition(7)]).collect()} == {"w"}


def test_label_tiers(spark, repeated):
    """Tied votes of an id are settled by the smallest choice, so tiers don't depend on partitions."""
    got = {r["tier"]: r["n"] for r in catalog_analysis.o11_label_tiers(spark, repeated).collect()}
    count = {}
    for r in catalog.rollouts(spark, repeated).collect():
        at = count.setdefault(r["sample_id"], {}).setdefault(r["predicted"], [0, 9])
        at[0], at[1] = at[0] + 1, min(at[1], r["k"])
    want = {}
    for r in catalog.run(spark, repeated, "base").collect():
        ranked = sorted((-n, first, c) for c, (n, first) in count[r["sample_id"]].items())
        margin = (-ranked[0][0] + (ranked[1][0] if len(ranked) > 1 else 0)) / -sum(n for n, _, _ in ranked)
        tier = "keep" if ranked[0][2] == r["predicted"] else "retain" if abs(margin) >= 0.5 else "flip"
        want[tier] = want.get(tier, 0) + 1
    assert got == want


def test_label_tiers_by_sql(spark, tmp_path):
    """What the SQL fixes is the SQL's; of choices that its ORDER BY leaves tied the smallest wins, as in the SQL with that order closed."""
    import duckdb

    rows = spark.range(998_000, 1_002_000).selectExpr("id AS p_partkey", "concat('part ', id % 7) AS p_name", "concat('Brand#', id % 3) AS p_brand", "concat('TYPE ', id % 2) AS p_type", "CAST(id % 50 AS INT) AS p_size")
    rows.repartition(5).write.parquet(f"{tmp_path}/part.parquet")
    got = {r["tier"]: r["n"] for r in catalog_analysis.o11_label_tiers(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    sql, order = catalog.ORACLES["o11_label_tiers"], "ORDER BY n DESC, first{})"
    assert sql.count(order.format("")) == 1
    of = lambda more: dict(con.execute(sql.replace(order.format(""), order.format(more))).fetchall())
    assert got == of(", predicted") and got != of(", predicted DESC")
    free = of("")
    assert got["retain"] == free["retain"] and sum(got.values()) == sum(free.values()) == 4000


def test_swapped_distractors_of_repeated_ids(spark):
    """One row an id, the same for all partitions and orders of rows."""
    rows = [("q", "s", ["w%d" % (4 * i + j) for j in range(4)], i % 4) for i in range(20)]
    rows = spark.createDataFrame(rows + [("q%d" % i, *r[1:]) for i, r in enumerate(rows)], "sample_id string, subject string, choices array<string>, answer int")
    got = [sorted(map(str, analysis.swapped_distractors(r, "swap").collect())) for r in (rows.coalesce(1), rows.coalesce(1).sort(*[rows["choices"].desc()]), rows.repartition(7))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 21
