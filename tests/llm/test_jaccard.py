import random
import re

import numpy as np
import pytest

from shelfmark.llm import graph, groups, jaccard, sigtree

from .helpers import docs_table, odd_table, sf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width, num, den):
    """{doc_id: component}, by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = {}
    for k, (i, s) in enumerate(sets):
        for other in {o for x in s for o in seen.get(x, ())}:
            j, t = sets[other]
            if den * len(s & t) >= num * len(s | t):
                a, b = sorted((find(i), find(j)))
                up[b] = a
        for x in s:
            seen.setdefault(x, []).append(k)
    return {i: find(i) for i in up}


def same(docs, width, num, den, **how):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows, width, num, den)
    out = jaccard.join(docs, width, num, den, **how).collect()
    assert len(out) == len(rows)
    sizes = sorted((str(i), len(shingles(t, width))) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_shingles"]) for r in out) == sizes
    for r in out:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
    return want


def test_documents_against_all_pairs(spark):
    want = same(sf(spark, "documents", "sf0.01"), 3, 90, 100)
    assert len(set(want.values())) < len(want)


def test_odd_rows_and_chains(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAGE_ROWS", 4)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows, passage = [], " ".join(f"p{i}" for i in range(40))
    for k in range(40):  # a chain of small edits, out of order, and a common passage
        base[rng.randrange(200)] = f"x{k}"
        rows.append((1000 - k, " ".join(base), "s"))
        rows.append((2000 + k, passage + f" own{k} " * rng.randint(1, 5), "s"))
    rows += [(7, "A b C", "s"), (8, "a B c", None), (9, "a b", "s"), (7, "other words with the same id", "s"), (6, "other words with the same id", "s")]
    docs = docs_table(spark, rows).unionByName(odd_table(spark))
    same(docs, 3, 90, 100)
    same(docs, 5, 80, 100)
    same(docs, 3, 90, 100, miss=0)
    assert jaccard.join(docs_table(spark, [])).count() == 0
    kept = jaccard.keep_one(docs, 3, 90, 100)
    assert {r["doc_id"] for r in kept.collect()} >= {None, 1, 2, 3, 6}


@pytest.mark.parametrize("seed", range(8))
def test_signature_trees_find_all_links(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(sigtree, "MAX_BITS", 128)
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(60):
        s = rng.choice(400, rng.integers(1, 60), replace=False) if not sets or rng.random() < 0.4 else sets[rng.integers(len(sets))].copy()
        s[rng.random(len(s)) < 0.05] = rng.integers(400, 900)
        sets.append(np.unique(s).astype(np.uint64))
    sets.append(np.empty(0, np.uint64))
    side = rng.random(len(sets)) < 0.5
    link = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) and len(sets[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert {(max(i, j), min(i, j)) for i, j in zip(*sigtree.links(sets, 80, 100))} == link
    across = {(i, j) for i, j in link if side[i] != side[j]}
    assert {(max(i, j), min(i, j)) for i, j in zip(*sigtree.links(sets, 80, 100, side))} == across
    for sides, all_links in ((None, link), (side, across)):
        some = {(max(i, j), min(i, j)) for i, j in zip(*sigtree.connections(sets, 80, 100, sides))}
        assert some <= all_links
        connected = lambda pairs: groups.labels(len(sets), *(np.array([p[k] for p in pairs], int) for k in (0, 1))).tolist()
        assert connected(sorted(some)) == connected(sorted(all_links))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(500, k) for k in range(400, 480)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(5, 5), (None, 3)]
    up = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a in up and b in up and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    out = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in out} == {x: find(x) for x in up}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
