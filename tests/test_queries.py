"""Every registered query that has SQL gives the SQL's rows."""

import math

import pytest

from tessella.jobs.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.7g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return f"{float(value):.7g}" if type(value).__name__ == "Decimal" else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    where = [found.columns.index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in where) for row in found.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in frame.collect()) == want


def test_rows_only_queries(spark, sf_dir):
    chunks = QUERIES["paragraph_chunks"](spark, sf_dir).collect()
    assert chunks and all(150 <= len(c.text) <= 1200 for c in chunks)
    numbers = {}
    for c in chunks:
        numbers.setdefault(c.doc_id, []).append(c.chunk_number)
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values())
    found = QUERIES["title_fuzzy_lookup"](spark, sf_dir).collect()
    assert found and all(r.p_partkey == r.query_id and r.score >= 86 for r in found)
    for r in QUERIES["bootstrap_ci"](spark, sf_dir).collect():
        assert r.low < r.mean < r.high
    hits = QUERIES["hybrid_search"](spark, sf_dir).collect()
    assert hits and all(1 <= h["rank"] <= 5 for h in hits)
    owners = {}
    for h in hits:
        owners.setdefault((h.query_id, h.doc_id), []).append(h)
    assert max(map(len, owners.values())) <= 2
