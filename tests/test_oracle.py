"""Every registered query of the evidence operators against its SQL, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tessera.catalog import FLAGSHIP, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def _plain(v):
    if v is None or v != v:
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    assert got
    if name in ORACLE_SQL:
        rel = duck.sql(ORACLE_SQL[name])
        assert sorted(rel.columns) == sorted(df.columns)
        want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
        key = lambda r: tuple(_plain(r[c]) for c in sorted(df.columns))
        assert Counter(map(key, got)) == Counter(map(key, want))


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES


#: Queries whose feature is Python: a table function, keyed state, a data source.
PYTHON = {"support_passages", "answer_passages", "search_cache_stream", "payload_archive"}


def test_no_python_on_checked_queries(spark):
    for name in ORACLE_SQL.keys() - PYTHON:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, name
