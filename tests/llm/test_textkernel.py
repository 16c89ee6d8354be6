import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import textkernel as k

TEXTS = ["", None, " \n\t ", "one", "word " * 3000, "été naïve 🙂 déjà\nété naïve 🙂 déjà\n\n", "x" * 7000 + " y", "a\nb\n\na\n" * 500, "", "z", "\n" * 2500, "w" * 1001]


def results(lower):
    sets, stats = [], []
    for _, _, chunk in k.chunks(pa.array(TEXTS), lower):
        sets += chunk.shingle_sets(3)
        stats.append(k.text_stats(chunk))
    return sets, {name: np.concatenate([s[name] for s in stats]) for name in stats[0]}


@pytest.mark.parametrize("lower", (False, True))
def test_blocks_and_chunks_change_nothing(lower, monkeypatch):
    want = results(lower)
    for block, chunk in ((1000, 1 << 20), (7, 4000), (64, 1)):
        monkeypatch.setattr(k, "BLOCK", block)
        monkeypatch.setattr(k, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(k, "STRIP", block)
        monkeypatch.setattr(k, "_UP", k._powers(k._R))
        monkeypatch.setattr(k, "_DOWN", k._powers(k._R_INV))
        sets, stats = results(lower)
        assert len(sets) == len(want[0]) and all(np.array_equal(a, b) for a, b in zip(sets, want[0]))
        assert all(np.array_equal(stats[name], want[1][name]) for name in stats)


@pytest.mark.parametrize("use, most", (("shingles", 10), ("statistics", 13)))
def test_one_long_text_costs_memory_in_proportion(use, most):
    rng = np.random.default_rng(3)
    column = pa.array([" ".join(f"w{i}" for i in rng.integers(0, 50_000, 2_500_000))])
    size = column.nbytes
    tracemalloc.start()
    for _, _, chunk in k.chunks(column, True):
        out = chunk.shingle_sets(5) if use == "shingles" else k.text_stats(chunk)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 14 << 20 and len(out) and peak < most * size
