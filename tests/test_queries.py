"""Every query with SQL gives the rows of that SQL in DuckDB."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import change_queries, ingest_queries  # noqa: F401
from tessera.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, data, sql, name):
    found = QUERIES[name](spark, data)
    columns = sorted(found.columns)
    cursor = sql.execute(ORACLES[name])
    own = [c[0] for c in cursor.description]
    assert sorted(own) == columns
    expected = Counter(repr(tuple(plain(r[own.index(c)]) for c in columns)) for r in cursor.fetchall())
    assert expected == Counter(repr(tuple(plain(r[c]) for c in columns)) for r in found.collect())
    assert expected


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
