"""Quality rules: fixed base rules, and a decision list learned from labels.

Sequential covering grows, for either verdict, a conjunction of thresholds on
ratio features by information gain over one part of the labelled rows and prunes
it on the other, where it must prove its precision. Of the two rules the more
precise one joins the list and takes the rows that it covers away; so a rule
holds for what the rules before it leave, and a rule that keeps shields its rows
from the rejecting rules behind it. A verdict whose rule fails the test is asked
again after the other has covered more. What no rule covers is kept. The ordered
list becomes one Spark conditional expression. Statistics come from whole texts.

Null and empty texts have no words and fail the base rules. Labels of null or
for absent documents are ignored; without usable labels the list is empty and
keeps what passes the base rules. Repeated rows are judged one by one; very long
texts cost memory in proportion (see ``textkernel``). Other columns pass through
``kept_rows`` whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import TEXT_STATS, map_texts, text_stats

STATS = [f.strip().split(" ")[0] for f in TEXT_STATS.split(",")]
#: feature: (numerator, denominator) of text statistics
RATIOS = {
    "symbol_ratio": ("n_symbols", "n_chars"),
    "symbol_end_ratio": ("n_symbol_ends", "n_words"),
    "bang_end_ratio": ("n_bang_ends", "n_words"),
    "pipe_ratio": ("n_pipes", "n_words"),
    "upper_ratio": ("n_upper", "n_chars"),
    "digit_ratio": ("n_digits", "n_chars"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "echo_ratio": ("n_echo", "n_words"),
    "distinct_ratio": ("n_distinct", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "mean_word": ("word_chars", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}
#: Labelled rows used for learning: at most this many, by the smallest hash of doc_id.
SAMPLE_ROWS = 20_000


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = ratio(self.feature)
        return value >= F.lit(self.cut) if self.above else value < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    keep: bool

    def column(self) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column()
        return out

    def __str__(self) -> str:
        return f"{' and '.join(map(str, self.tests))} -> {'keep' if self.keep else 'reject'}"


def ratio(feature: str) -> Column:
    a, b = RATIOS[feature]
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the statistics of each whole text."""
    return map_texts(docs, text_stats, TEXT_STATS, keep)


def _gain(x: np.ndarray, bad: np.ndarray, above: bool) -> tuple[float, float]:
    """Best FOIL gain of a cut on ``x`` for the rows ``bad``, and the cut."""
    order = np.argsort(-x if above else x, kind="stable")
    xs, ys = x[order], bad[order]
    p, n = np.cumsum(ys), np.cumsum(~ys)
    edge = np.append(xs[1:] != xs[:-1], False)
    if not edge.any() or not p[-1]:
        return 0.0, 0.0
    at = np.flatnonzero(edge)
    base = np.log2((p[-1] + 1e-9) / (p[-1] + n[-1]))
    gain = p[at] * (np.log2((p[at] + 1e-9) / (p[at] + n[at])) - base)
    i = at[int(np.argmax(gain))]
    # with a single value on both sides of a cut, the half-way point separates them
    return float(gain.max()), float((xs[i] + xs[i + 1]) / 2)


def learn(features: dict[str, np.ndarray], good: np.ndarray, max_rules: int = 12, max_tests: int = 3, precision: float = 0.95, support: int = 8) -> list[Rule]:
    """An ordered list of rules; what none covers is kept. A rule needs ``support``
    growing rows of its verdict, and to be right for at least ``precision`` of
    the pruning rows that it covers, of which there must be some."""
    rows = len(good)
    grow = np.arange(rows) % 3 != 2
    alive = np.ones(rows, bool)
    rules: list[Rule] = []

    def holds(t: Test) -> np.ndarray:
        x = features[t.feature]
        return x >= t.cut if t.above else x < t.cut

    def covered(tests: list[Test], on: np.ndarray) -> np.ndarray:
        hit = on.copy()
        for t in tests:
            hit &= holds(t)
        return hit

    def worth(hit: np.ndarray, wanted: np.ndarray) -> float:
        """Share of right rows, drawn to one half where there are few."""
        return ((hit & wanted).sum() + 1) / (hit.sum() + 2)

    def grown(wanted: np.ndarray) -> list[Test]:
        tests: list[Test] = []
        cover = alive & grow
        while len(tests) < max_tests and (cover & ~wanted).any():
            best, chosen = 0.0, None
            for name, x in features.items():
                for above in (True, False):
                    gain, cut = _gain(x[cover], wanted[cover], above)
                    if gain > best + 1e-9:
                        best, chosen = gain, Test(name, above, cut)
            if chosen is None:
                break
            tests.append(chosen)
            cover &= holds(chosen)
        prune = alive & ~grow
        while len(tests) > 1 and worth(covered(tests[:-1], prune), wanted) >= worth(covered(tests, prune), wanted):
            tests = tests[:-1]
        return tests

    while len(rules) < max_rules and (alive & ~good & grow).sum() >= support:
        found = []
        for keep in (False, True):
            wanted = good if keep else ~good
            tests = grown(wanted)
            if not tests:
                continue
            hit = covered(tests, alive)
            proof = hit & ~grow
            if (hit & grow & wanted).sum() < support or not proof.any() or (proof & wanted).sum() < precision * proof.sum():
                continue
            found.append((worth(proof, wanted), not keep, Rule(tuple(tests), keep), hit))
        if not found:
            break
        _, _, rule, hit = max(found, key=lambda f: f[:2])
        rules.append(rule)
        alive &= ~hit
    while rules and rules[-1].keep:  # the default says so anyway
        rules.pop()
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``limit`` labelled documents (doc_id, text, quality), those with
    the smallest hashes of doc_id: the bound of what learning reads."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def learn_from(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> list[Rule]:
    rows = stats(labelled_sample(docs, labels, limit), ["doc_id", "quality"])
    table = rows.select("doc_id", (F.col("quality") == 1).alias("good"), *[ratio(f).alias(f) for f in RATIOS]).toPandas()
    table = table.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    if not len(table):
        return []
    return learn({f: table[f].to_numpy(float) for f in RATIOS}, table["good"].to_numpy(bool))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(rule.keep)) if out is None else out.when(rule.column(), F.lit(rule.keep))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """``keep``, the statistics, base_failed and kept for each document."""
    return stats(docs, keep).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def kept_rows(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that the base rules and the list keep, unchanged."""
    hidden = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    named = docs.select(*[docs[c].alias(hidden.get(c, c)) for c in docs.columns])
    judged = stats(named, named.columns).where(~base_failed() & verdict(rules))
    return judged.select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])
