import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import rules

from .helpers import docs_table, odd_table, sf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    cover = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(cover) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), failed


def test_base_statistics(spark):
    repeated = "a b c d e f g h i j\n" * 4
    docs = sf(spark, "documents").unionByName(odd_table(spark)).unionByName(docs_table(spark, [(77, repeated, "x"), (78, "x|y <b> &amp; 100% #1 *", "x")]))
    out = rules.judge(docs.withColumn("n_words", F.lit("clash")), [], ["doc_id", "text"]).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(r["text"])
        assert r["kept"] == (not r["base_failed"])


def test_learned_list_rejects_junk_and_keeps_clean(spark):
    docs, labels = sf(spark, "documents", "sf0.1"), sf(spark, "labels", "sf0.1")
    learned = rules.learn_from(docs, labels.where("doc_id % 2 = 0"))
    assert learned and not learned[-1].keep and all(r.tests for r in learned)
    out = rules.judge(docs, learned, ["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id")
    good = out.where("quality = 1 and not base_failed")
    bad = out.where("quality = 0")
    assert good.where("kept").count() > 0.97 * good.count()
    assert bad.where("not kept").count() > 0.9 * bad.count()


def test_order_of_the_list_matters():
    rng = np.random.default_rng(4)
    x, y = rng.random(6000), rng.random(6000)
    good = (x < 0.6) | (y > 0.8)  # a rule that rejects x >= 0.6 has to spare y > 0.8
    learned = rules.learn({"x": x, "y": y}, good, max_tests=1)
    assert [r.keep for r in learned][-1] is False and any(r.keep for r in learned)

    def verdict(a, b):
        for r in learned:
            if all((v >= t.cut) == t.above for t in r.tests for v in [{"x": a, "y": b}[t.feature]]):
                return r.keep
        return True

    assert np.mean([verdict(a, b) == g for a, b, g in zip(x, y, good)]) > 0.97


def test_expression_takes_the_first_rule(spark):
    T, R = rules.Test, rules.Rule
    listed = [R((T("mean_word", True, 6.0),), True), R((T("mean_word", True, 4.0), T("digit_ratio", False, 0.1)), False), R((T("words_a_line", True, 3.0),), False)]
    texts = ["longest words remain", "words about here", "w1 2 3", "aa bb", "", "seven 77777 1", "one two six ten"]
    out = rules.stats(docs_table(spark, [(k, t, "s") for k, t in enumerate(texts)]), ["doc_id"]).withColumn("v", rules.verdict(listed))
    for r in out.collect():
        want = True
        for rule in listed:
            value = {f: r[a] / r[b] if r[b] else 0.0 for f, (a, b) in rules.RATIOS.items()}
            if all((value[t.feature] >= t.cut) == t.above for t in rule.tests):
                want = rule.keep
                break
        assert r["v"] == want, texts[r["doc_id"]]
    assert len({r["v"] for r in out.collect()}) == 2


def test_without_usable_labels(spark):
    docs = odd_table(spark)
    labels = spark.createDataFrame([(1, None), (None, 1), (999, 0)], "doc_id long, quality int")
    assert rules.learn_from(docs, labels) == []
    assert rules.judge(docs_table(spark, []), [], ["doc_id"]).count() == 0
