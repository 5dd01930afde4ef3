"""The library's own queries against DuckDB over the same tables, and the entry point with and without its optional part."""

import datetime
import importlib
import math
import sys
from decimal import Decimal

import duckdb
import pytest

from palimpsest.plans import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float | Decimal):
        return "nan" if math.isnan(value) else f"{float(value):.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list | tuple):
        return [plain(x) for x in value]
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(row[k]) for k in order]) for row in rows)


@pytest.fixture(scope="module")
def db(sf):
    found = duckdb.connect()
    found.execute("SET timezone = 'UTC'")
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return found


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_query_equals_sql(spark, db, sf, name):
    got = own.QUERIES[name](spark, sf)
    want = db.execute(own.ORACLE_SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted_rows(got.columns, got.collect()) == sorted_rows(columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(own.ORACLE_SQL) <= set(own.QUERIES)


def test_entry_works_without_the_optional_part(spark, monkeypatch):
    import __spark_entry__ as entry

    try:
        monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
        importlib.reload(entry)
        assert set(entry.queries()) == set(own.QUERIES)
        assert set(entry.oracle_sql()) == set(own.ORACLE_SQL)
        assert entry.entry(spark).count() > 0
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
