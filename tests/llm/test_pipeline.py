from collections import Counter, defaultdict

import corpus_pipeline as c
from pyspark.sql import functions as F

from shelfmark.llm import bpe, mixing, rules
from shelfmark.storage import materialize

from .helpers import docs_table, odd_table, sf
from .test_jaccard import brute as brute_components
from .test_rules import brute as brute_stats

SF = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_last_kept(spark):
    docs = sf(spark, "documents")
    columns = docs.columns
    steps = dict(c.STAGES)
    assert list(steps) == ["quality_rules", "line_dedup", "near_duplicates", "source_mixing", "best_fit_packing"]

    one = materialize(steps["quality_rules"](spark, docs, SF), "t")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    learned = rules.learn_from(docs, sf(spark, "labels"))
    passed = {r["doc_id"] for r in rules.judge(docs, learned, ["doc_id"]).where("kept").collect()}
    assert one.columns == columns and {r["doc_id"]: r["text"] for r in one.collect()} == {i: texts[i] for i in passed}
    assert not any(brute_stats(texts[i])[-1] for i in passed)

    two = materialize(steps["line_dedup"](spark, one, SF), "t")
    spread, first = defaultdict(set), {}
    rows = one.collect()
    for r in rows:
        for line in r["text"].split("\n"):
            if len(line.split()) >= 2:
                spread[line.strip()].add(r["source"])
                first[line.strip()] = min(first.get(line.strip(), r["doc_id"]), r["doc_id"])
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not (len(spread.get(x.strip(), ())) >= (3 if len(x.split()) >= 5 else 15) and first[x.strip()] != r["doc_id"])) for r in rows}
    assert two.columns == columns and {r["doc_id"]: r["text"] for r in two.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())

    three = materialize(steps["near_duplicates"](spark, two, SF), "t")
    component = brute_components([(r["doc_id"], r["text"]) for r in two.collect()], 5, 80, 100)
    assert three.columns == columns and {r["doc_id"] for r in three.collect()} == {i for i, k in component.items() if i == k}

    four = materialize(steps["source_mixing"](spark, three, SF), "t")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(three).collect()}
    assert four.columns == columns and Counter(r["doc_id"] for r in four.collect()) == Counter({i: n for i, n in copies.items() if n})

    five = steps["best_fit_packing"](spark, four, SF).collect()
    library = bpe.load(c.TOKENIZER).library
    length = Counter()
    for r in four.collect():
        length[r["doc_id"]] += len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in five:
        got[r["doc_id"]] += r["length"]
    assert got == length


def test_run_ends_in_packed_pieces(spark):
    out = c.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    by_sequence = defaultdict(list)
    for r in out.collect():
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeats, other columns and no labels that help."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(100 + k, text + f" {k}", "a") for k in range(4)] + [(200, text + "\n" + text[::-1], None), (201, text[::-1], "b"), (201, text[::-1], "b"), (None, text.upper(), "c")]
    docs = odd_table(spark).unionByName(docs_table(spark, rows)).withColumns({"key": F.lit(1), "_id": F.lit("x"), "rank": F.lit(2), "copies": F.lit(3), "keys": F.lit(4), "_h": F.lit(None).cast("long")})
    folder = str(tmp_path)
    spark.createDataFrame([(None, 1, None), (100, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for table in (docs, docs.limit(0)):
        at, sizes = table, []
        for name, stage in c.STAGES:
            at = materialize(stage(spark, at, folder), name)
            sizes.append(at.count())
            if name != "best_fit_packing":
                assert at.columns == docs.columns
            if name == "quality_rules":
                kept = at.select("doc_id", "text").collect()
                assert all(not brute_stats(r["text"])[-1] for r in kept)
            if name == "near_duplicates" and sizes[0]:
                assert {r["doc_id"] for r in at.collect()} >= {None, 100} and not {101, 102, 103} & {r["doc_id"] for r in at.collect()}
        assert sizes[0] == (8 if table is docs else 0) and (sizes[-1] > 0) == (table is docs)
