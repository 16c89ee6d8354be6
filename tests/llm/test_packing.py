import random
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import bpe, packing
from shelfmark.llm.textkernel import chunks

from .helpers import docs_table, odd_table, sf

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_library(spark):
    texts = [r["text"] for r in sf(spark, "documents").select("text").limit(120).collect()]
    texts += ["", "it's DON'T we'll 'S á x́y é ſ İ ΣΑΣ", "x y\x85z\x0b<|endoftext|>b<|startoftext|>", "中文 日本 🙂🙂 ½²ª 12ab", "a" * 400 + " " + "!" * 99, "﻿ǅ ŉ"]
    model = bpe.WordBpe(PATH)
    for first, last, chunk in chunks(pa.array(texts)):
        ids, offsets = model.encode(chunk)
        for i in range(first, last):
            assert ids[offsets[i - first] : offsets[i - first + 1]].tolist() == model.library.encode(texts[i], add_special_tokens=False).ids


def test_word_table_is_bounded():
    model = bpe.WordBpe(PATH, table_bits=6)
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)]
    for _, _, chunk in chunks(pa.array(texts)):
        ids, offsets = model.encode(chunk)
    for text, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == model.library.encode(text, add_special_tokens=False).ids


def one_at_a_time(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 50, 100])
    lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 3)])) for _ in range(rng.randint(1, 300))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    scheme = packing.plan(histogram, capacity)
    bins = defaultdict(list)
    for n, rows in scheme.items():
        for rank in range(histogram[n]):
            first, each, start, offset = [r for r in rows if r[0] <= rank][-1]
            bins[start + (rank - first) // each].append((offset + (rank - first) % each * n, n))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in bins.values()) == one_at_a_time(lengths, capacity)


def check(packed, docs, capacity):
    rows = [r.asDict() for r in packed.collect()]
    model = bpe.load(PATH).library
    by_seq, want = defaultdict(list), []
    for d in docs.collect():
        ids = model.encode(d["text"] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((str(d["doc_id"]), k // capacity, k, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    for places in by_seq.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(by_seq) == len(one_at_a_time([r["length"] for r in rows], capacity))


def test_pack_documents(spark):
    for docs in (odd_table(spark), sf(spark, "documents").limit(150), docs_table(spark, [])):
        docs = docs.withColumn("part", F.lit(1)).withColumn("rank", F.lit("x"))
        pieces = packing.tokenize(docs, PATH, capacity=512).withColumn("ids_crc32", F.crc32("ids"))
        for rank_rows in (packing.RANK_ROWS, 2):
            packed = packing.pack(pieces.drop("ids").withColumn("part", F.lit(3)), capacity=512, rank_rows=rank_rows)
            check(packed, docs, 512)
            assert all((r["sequence_id"] < 0) == (r["length"] == 512) for r in packed.collect())


def test_sequences_hold_their_pieces(spark):
    pieces = packing.tokenize(odd_table(spark), PATH, capacity=64)
    packed = packing.pack(pieces, capacity=64)
    out = packing.sequences(packed).collect()
    assert sum(r["n_ids"] for r in out) == packed.agg(F.sum("length")).first()[0]
    assert all(len(r["ids"]) == 4 * r["n_ids"] <= 256 for r in out)


def test_documents_need_no_more_sequences_than_their_tokens():
    """Best-fit decreasing reaches the lower bound on this table."""
    import pyarrow.parquet as pq

    model = bpe.load(PATH)
    count = defaultdict(int)
    for _, _, chunk in chunks(pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"]):
        for n in (model.encode(chunk)[1][1:] - model.encode(chunk)[1][:-1] + 1).tolist():
            if n % 4096:
                count[n % 4096] += 1
    scheme = packing.plan(dict(count))
    used = set()
    for n, rows in scheme.items():
        for (rank, each, first, _), after in zip(rows, [r[0] for r in rows[1:]] + [count[n]]):
            used.update(range(first, first + -(-(after - rank) // each)))
    assert len(used) == -(-sum(n * k for n, k in count.items()) // 4096)
