"""Every registered query with SQL gives the rows of its SQL."""

import glob
import os

import duckdb
import pytest

from shelfmark.plans import registry

SF = "/root/testdata/sf0.001"


def rows(table, columns):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[columns.index(c)] for c in sorted(columns)))) for r in table)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_nothing_else_imports_the_llm_subpackage():
    found = [p for p in glob.glob("shelfmark/**/*.py", recursive=True) if "/llm/" not in p and "llm" in open(p).read()]
    assert found == []
