"""Every registered query with a DuckDB form against it, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from corpusmill.plans import catalog, catalog_analysis, catalog_evidence, catalog_gates, catalog_texts  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    assert found == sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)


def test_result_is_independent_of_partitions(spark):
    from corpusmill.operators import dedup, sampling

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source")
    for f in (lambda d: dedup.top_by_hash(d, "source", "doc_id", "s", 3), lambda d: sampling.stratified(d, "source", "doc_id", "s", 30)):
        assert sorted(f(rows.repartition(1)).collect()) == sorted(f(rows.repartition(8)).collect())
