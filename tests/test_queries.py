"""Every registered query with SQL gives the SQL's rows; the others give rows, the same at any number of partitions."""

import duckdb
import pytest

from rankeval.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in values), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    df, want = catalog.queries()[name](spark, SF), duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert all(KINDS[k] == kinds[c] for c, k in df.dtypes)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_is_the_same_at_any_partitioning(spark, name):
    first = sorted(map(str, catalog.queries()[name](spark, SF).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(str, catalog.queries()[name](spark, SF).collect())) == first and first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_source_rules_reach_the_scan(spark):
    """Documents are read for the columns that are asked for; ranking them reads postings alone."""
    plan = lambda name: catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan("tokenize")
    assert not any(c in plan(name) for name in ("tokenize", "bm25_topk") for c in ("lang:string", "source:string", "n_chars:bigint")) and "text:string" not in plan("bm25_topk")
