"""Every query with SQL agrees with DuckDB, and those without have rows and a stable schema."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
OWN = [n for n in QUERIES if not re.match(r"op\d", n) and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(v + 0.0) if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    want = sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", [n for n in OWN if n not in ORACLES])
def test_query_has_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
