import tracemalloc

import numpy as np
import pytest

from shelfmark.llm import capjoin

SCHEMA = "vec_id long, label int, embedding array<float>, rep string"


def planted(rng, n, dim, labels=3):
    """Random vectors, near copies around 0.93, exact copies, one large group."""
    base = rng.normal(size=(n, dim))
    rows, at = [], 0
    for v in base:
        label = int(rng.integers(labels))
        rows.append((at, label, v))
        at += 1
        for _ in range(int(rng.integers(0, 4))):
            rows.append((at, label, v + rng.normal(size=dim) * np.linalg.norm(v) / dim**0.5 * rng.uniform(0.2, 0.45)))
            at += 1
    centre = rng.normal(size=dim)
    for k in range(150):
        rows.append((at, 1, centre + (k % 50) * 0.01 * base[k % n]))
        at += 1
    order = rng.permutation(at)
    return [(int(order[i]), label, [float(np.float32(x)) for x in v], "clash") for i, label, v in rows]


def brute(rows, least):
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[1] for r in rows])
    link = (x @ x.T >= least) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    ids = np.array([r[0] for r in rows])
    component = ids.copy()
    while True:
        new = np.minimum(component, np.where(link, component[None], 1 << 60).min(1))
        if (new == component).all():
            return dict(zip(ids.tolist(), link.sum(1).tolist())), dict(zip(ids.tolist(), component.tolist()))
        component = new


def test_recall_and_no_wrong_links(spark, monkeypatch):
    monkeypatch.setattr(capjoin, "PAGE_ROWS", 16)
    total = found = 0
    for seed, dim in ((1, 64), (2, 24)):
        rows = planted(np.random.default_rng(seed), 200, dim)
        links, component = brute(rows, 0.93)
        out = {r["vec_id"]: r for r in capjoin.join(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert set(out) == set(links)
        assert all(out[i]["n_links"] <= n for i, n in links.items())
        total += sum(links.values())
        found += sum(r["n_links"] for r in out.values())
        right = sum(out[i]["component_id"] == c for i, c in component.items())
        assert right >= 0.99 * len(component)
        assert all(r["kept"] == (i == r["component_id"]) for i, r in out.items())
    assert total > 10_000 and found >= 0.99 * total


@pytest.mark.parametrize("dim, n", ((64, 1_000), (64, 100_000), (384, 100_000), (64, 10_000_000)))
def test_recall_of_pairs_that_just_link(dim, n):
    """The code for n vectors, and the sketches, on pairs of cosine 0.93 to 0.95."""
    rng = np.random.default_rng(6)
    x, y = (rng.normal(size=(1000, dim)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cosine = rng.uniform(0.93, 0.95, (1000, 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * y
    filters = capjoin.Filters(dim, n)
    lists = []
    for v in (x, y):
        who, code = filters.of(v)
        assert np.bincount(who, minlength=1000).min() >= capjoin.LEAST
        lists.append([set(c.tolist()) for c in np.split(code, np.searchsorted(who, np.arange(1, 1000)))])
    assert np.mean([bool(a & b) for a, b in zip(*lists)]) >= 0.98
    planes = np.random.default_rng(1).normal(size=(dim, capjoin.SKETCH))
    assert (((x @ planes > 0) != (y @ planes > 0)).sum(1) <= capjoin.sketch_bound(0.93)).all()


def test_a_unit_holds_little_memory():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1, 64)) + 0.05 * rng.normal(size=(2 * capjoin.PAGE_ROWS, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rep = np.arange(len(x))
    tracemalloc.start()
    a, _, links = capjoin._circle_links(rep, np.ones(len(x), int), x, rep * 0, [rng.integers(0, 99, 20) for _ in rep], 0.93)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == len(x) - 1 and peak < 150 << 20


def test_stored_doubles_and_clashing_columns(spark):
    rows = [(k, 0, [float(x) for x in v], 1) for k, v in enumerate(np.random.default_rng(1).normal(size=(20, 8)))]
    rows += [(100 + k, 0, [3.0 * x for x in r[2]], 1) for k, r in enumerate(rows[:5])]
    out = {r["vec_id"]: r["component_id"] for r in capjoin.join(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, raw int")).collect()}
    assert all(out[100 + k] == out[k] for k in range(5)) and len(out) == 25


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0, None, "x"), (2, 0, [], "x"), (3, 0, [0.0, 0.0], "x"), (4, 0, [1.0, None], "x"), (5, 0, [nan, 1.0], "x"), (6, 0, [inf, 1.0], "x"),
        (7, None, [1.0, 0.0], "x"), (None, 0, [1.0, 0.0], "x"), (8, 0, [1.0, 0.0], None), (9, 0, [2.0, 0.0], "x"), (10, 0, [1.0, 0.1], "x"),
        (11, 1, [1.0, 0.0], "x"), (12, 0, [1.0, 0.0, 0.0], "x"), (13, 0, [-1.0, 0.0], "x"), (14, 0, [1.0], "x"), (15, 0, [3.0], "x"), (20, 0, [1.0, 0.0], "x"), (20, 0, [0.0, 1.0], "x"),
    ]
    out = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in capjoin.join(spark.createDataFrame(rows, SCHEMA)).collect())
    alone = [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 7, 11, 12, 13)]
    assert out == sorted([*alone, (0, 0, None), (8, 3, 8), (9, 3, 8), (10, 3, 8), (20, 3, 8), (20, 0, 20), (14, 1, 14), (15, 1, 14)])
    assert capjoin.join(spark.createDataFrame([], SCHEMA)).count() == 0
