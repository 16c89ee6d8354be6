"""Queries with SQL that is brute force: all pairs, then what is reachable."""

import duckdb
import numpy as np
import pytest

from shelfmark.llm import capjoin, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ("op1_ngram_jaccard_join", "op4_embedding_near_dedup"))
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_embedding_sql_on_planted_links(spark):
    """The tables hold no link, so the SQL is also asked about some."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        v = rng.normal(size=16)
        rows += [(10 * k + j, k % 2, (v + 0.25 * j * rng.normal(size=16)).astype(np.float32).tolist()) for j in range(4)]
    rows += [(9000, None, rows[0][2]), (9001, 0, None), (9002, 0, [0.0] * 16), (9003, 0, rows[0][2]), (9004, 0, [float("nan")] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    con = duckdb.connect()
    embeddings = table.toArrow()  # noqa: F841
    want = {r[0]: r[1:] for r in con.sql(capjoin.ORACLE).fetchall()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in capjoin.join(table).collect()}
    assert sum(w[0] for w in want.values()) > 40
    assert got == want
