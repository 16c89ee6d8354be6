import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import lines, mixing, queries

from .helpers import docs_table, odd_table, sf

LONG = "this boilerplate line has many words in it"


def test_line_dedup(spark):
    rows = [(k, f"own text of document number {k}\n {LONG} \nshort one", f"s{k % 4}") for k in range(20, 40)]
    rows += [(50, "only two sites have this line\nx", "a"), (51, "only two sites have this line", "b"), (52, "only two sites have this line", "b"), (53, None, None), (None, LONG, "z")]
    docs = docs_table(spark, rows).unionByName(odd_table(spark))
    out = lines.dedup(docs.withColumnRenamed("n_chars", "n_lines"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_lines", "_n_lines", "_n_removed"]
    got = defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append((r["text"], r["_n_lines"], r["_n_removed"]))
    assert got[20] == [(rows[0][1], 3, 0)]
    assert got[21] == [("own text of document number 21\nshort one", 3, 1)]
    assert got[51] == [("only two sites have this line", 1, 0)]
    assert got[53] == [(None, 0, 0)] and got[2] == [("", 1, 0)]
    assert (LONG, 1, 0) in got[None]
    assert out.count() == docs.count()
    assert lines.dedup(docs_table(spark, [])).count() == 0


def test_short_lines_need_more_sites(spark):
    rows = [(k, f"own {k}\nAll rights reserved.\nThe.\ntwo words", f"s{k}") for k in range(15)] + [(k, "two words\nfew sites", f"s{k}") for k in range(20, 30)]
    docs = docs_table(spark, [r if r[0] < 14 else (r[0], r[1].replace("two words", "x"), r[2]) for r in rows])
    clash = docs.withColumnsRenamed({"lang": "_gone", "n_chars": "_id"}).withColumns({"_kept": F.lit(1), "key": F.lit(2), "_h": F.lit(3), "n_removed": F.lit(4)})
    for table in (docs, clash):
        out = lines.dedup(table)
        assert out.columns[: len(table.columns)] == table.columns
        text = {r["doc_id"]: r["text"] for r in out.collect()}
        assert text[0] == rows[0][1] and text[5] == "own 5\nThe.\ntwo words" and text[14] == "own 14\nThe.\nx" and text[25] == "x\nfew sites"
        assert out.select("doc_id", "n_lines").count() == len(rows) if table is docs else True


def test_line_dedup_equals_its_sql(spark):
    out = queries.op5_line_dedup(spark, "/root/testdata/sf0.01").collect()
    con = duckdb.connect()
    con.sql("create view documents as select * from read_parquet('/root/testdata/sf0.01/documents.parquet')")
    want = con.sql(f"select doc_id, n_lines, n_removed, text_md5 from ({lines.ORACLE})").fetchall()
    assert sorted(map(tuple, out)) == sorted(want)
    assert sum(r["n_removed"] for r in out) > 50


def brute_targets(size):
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.remove(s)
    return target


def check_mix(docs, tolerance):
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: tuple("" if v is None else v for v in (str(r["doc_id"]), r["size"], r["copies"], r["target"]))
    assert sorted(map(key, out)) == sorted(map(key, again))
    rows = docs.collect()
    assert len(out) == len(rows)
    size, count = defaultdict(int), {}
    for d in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
        size[d["source"]] += n
        count[d["doc_id"]] = (d["source"], n)
    want, taken = brute_targets(dict(size)), defaultdict(int)
    for r in out:
        if r["doc_id"] is not None:
            source, n = count[r["doc_id"]]
            assert abs(r["target"] - want[source]) < 1e-6 * max(1, want[source]) and r["source_size"] == size[source]
            assert r["size"] == n and 0 <= r["taken"] <= 2 * n
            taken[source] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= tolerance * t + 40, (s, taken[s], t)


def test_mix(spark):
    check_mix(sf(spark, "documents", "sf0.01"), 0.02)
    rows = [(k, "w " * (k % 7), "abc"[k % 3] if k % 5 else None) for k in range(100, 300)] + [(1, None, "é"), (2, "", "z"), (3, "one two", "Z")]
    check_mix(docs_table(spark, rows), 0.05)
    assert mixing.mix(docs_table(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_tilts_meet_their_targets(seed):
    rng = np.random.default_rng(seed)
    size = np.unique(rng.integers(1, 10 ** int(rng.integers(1, 6)), rng.integers(1, 200)))
    count = rng.integers(1, 1000, len(size))
    weight = count * size.astype(float)
    target = weight.sum() * rng.uniform(0.01, 1.99)
    scale, tilt = mixing.tilt_of(size, count, target)
    taken = lambda t: 2 * (weight / (1 + np.exp(-np.clip(t * size / scale, -700, 700)))).sum()
    low, high = -1e6, 1e6  # the dual's only root, by bisection
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if taken(middle) < target else (low, middle)
    assert abs(taken(tilt) - target) <= 1e-6 * weight.sum()
    rate = lambda t: 2 / (1 + np.exp(-np.clip(t * size / scale, -700, 700)))
    assert np.abs(rate(tilt) - rate(low)).max() < 1e-4


def test_mixed_repeats_whole_rows(spark):
    docs = sf(spark, "documents").limit(100).withColumns({"times": F.lit(1), "turn": F.lit(2), "key": F.lit(3), "copies": F.lit(4)})
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in copies.items() if n}
