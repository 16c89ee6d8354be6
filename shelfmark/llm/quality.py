"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled 1; all other texts are unlabelled. A small network
over statistics of whole texts minimises the non-negative unbiased risk
    prior * E_P[loss(g, +)] + max(0, E_U[loss(g, -)] - prior * E_P[loss(g, -)])
with logistic losses. Labels, lang, source and doc_id are no inputs.

``prepared`` reads each text once; everything else works on its features. At most
SAMPLE_ROWS positives are used, the smallest hashes of doc_id. The network starts
from so many positives and as many unlabelled rows (again by hash); then the class
prior and the risk come from all unlabelled rows: the prior is the best bin (the
least ratio of unlabelled to positive mass above a threshold, with a confidence
term) of a histogram of a preliminary score over all of them, and ROUNDS steps on
the risk over all of them follow, one distributed pass each, of which the weights
of least risk stay. Rows that are held out take no part in learning.

Null and empty texts are scored from zero statistics. Without positives, or with
nothing unlabelled, every score is the prior of one half (and predicted 1).
Repeated rows are scored alike and, but for repeats of a positive, counted one by
one; very long texts cost memory in proportion (see ``textkernel``). Other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import RATIOS
from .textkernel import Chunk, map_texts, text_stats

SAMPLE_ROWS = 12_000
HIDDEN = 16
#: Steps over all unlabelled rows, and the bins of their preliminary score.
ROUNDS, BINS = 6, 4096
DECAY = 1e-4

Weights = list[np.ndarray]


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios and log sizes, one row for each text."""
    out = []
    for a, b in RATIOS.values():
        out.append(np.where(stats[b] > 0, stats[a] / np.maximum(stats[b], 1), 0.0))
    for name in ("n_words", "n_lines"):
        out.append(np.log1p(stats[name].astype(float)))
    return np.column_stack(out)


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id and ``features`` of each row's whole text."""

    def make(chunk: Chunk) -> dict[str, object]:
        x = features(text_stats(chunk)).astype(np.float32)
        return {"features": pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))}

    return map_texts(docs, make, "features array<float>", ["doc_id"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(float).reshape(len(column), -1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: Weights
    prior: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _outputs(self.weights, self.scaled(x))[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x))


def _outputs(w: Weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ w[0] + w[1])
    return h, h @ w[2] + w[3][0]


def losses(w: Weights, x: np.ndarray, positive: bool) -> tuple[float, Weights]:
    """The sum of logistic losses of ``x`` as positives or as negatives, and its gradient."""
    h, g = _outputs(w, x)
    slope = _sigmoid(g) - (1 if positive else 0)
    loss = np.logaddexp(0, -g if positive else g).sum()
    back = (slope[:, None] * w[2]) * (1 - h**2)
    return float(loss), [x.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()])]


def risk(prior: float, p_plus: tuple[float, Weights], p_minus: tuple[float, Weights], u_minus: tuple[float, Weights]) -> tuple[float, Weights]:
    """The non-negative risk of mean losses, and the direction to step against:
    where the part that can't be negative is, back on that part."""
    below = u_minus[0] - prior * p_minus[0]
    part = [u - prior * m for u, m in zip(u_minus[1], p_minus[1])]
    if below < 0:
        return prior * p_plus[0], [-d for d in part]
    return prior * p_plus[0] + below, [prior * a + d for a, d in zip(p_plus[1], part)]


def _mean(loss: tuple[float, Weights], n: int) -> tuple[float, Weights]:
    return loss[0] / n, [g / n for g in loss[1]]


class _Adam:
    def __init__(self, w: Weights, rate: float):
        self.rate, self.turn = rate, 0
        self.m, self.v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]

    def step(self, w: Weights, grads: Weights) -> Weights:
        self.turn += 1
        out = []
        for k, value in enumerate(grads):
            value = value + DECAY * w[k] if w[k].size > 1 else value
            self.m[k] = 0.9 * self.m[k] + 0.1 * value
            self.v[k] = 0.999 * self.v[k] + 0.001 * value**2
            out.append(w[k] - self.rate * (self.m[k] / (1 - 0.9**self.turn)) / (np.sqrt(self.v[k] / (1 - 0.999**self.turn)) + 1e-8))
        return out


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, seed: int, steps: int = 900, batch: int = 512, rate: float = 5e-3) -> Model:
    """The network; with ``prior`` None it tells positives from unlabelled rows."""
    rng = np.random.default_rng(seed)
    both = np.vstack([p, u])
    model = Model(both.mean(0), both.std(0) + 1e-6, [], prior or 0.5)
    P, U = model.scaled(p), model.scaled(u)
    d = P.shape[1]
    w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    adam = _Adam(w, rate)
    for _ in range(steps):
        xp, xu = P[rng.integers(len(P), size=batch)], U[rng.integers(len(U), size=batch)]
        plus, un = _mean(losses(w, xp, True), batch), _mean(losses(w, xu, False), batch)
        if prior is None:
            grads = [(a + b) / 2 for a, b in zip(plus[1], un[1])]
        else:
            grads = risk(prior, plus, _mean(losses(w, xp, False), batch), un)[1]
        w = adam.step(w, grads)
    model.weights = w
    return model


def best_bin(sp: np.ndarray, edges: np.ndarray, counts: np.ndarray) -> float:
    """The share of positives among rows whose scores have the histogram
    ``counts`` above ``edges``, from scores ``sp`` of positives."""
    above_u = np.cumsum(counts[::-1])[::-1] / max(counts.sum(), 1)
    above_p = 1 - np.searchsorted(np.sort(sp), edges) / len(sp)
    slack = np.sqrt(np.log(40) / (2 * len(sp))) + np.sqrt(np.log(40) / (2 * max(counts.sum(), 1)))
    use = above_p > 0
    best = int(np.argmin(np.where(use, (above_u + 1.01 * slack) / np.maximum(above_p, 1e-9), np.inf)))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.97))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null doc_id isn't one of them."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _over_all(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all ``rows`` (features) of the vectors of ``size`` that ``of``
    gives for a matrix of them; a task adds up its own, an aggregation the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                total += of(_matrix(batch.column(0).slice(at, 4096)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    summed = rows.select("features").mapInArrow(run, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("v"))
    out = np.zeros(size)
    for r in summed.collect():  # one row for each element of the vector
        out[r["pos"]] = r["v"]
    return out


def _histogram(rows: DataFrame, model: Model, edges: np.ndarray) -> np.ndarray:
    """How many rows have a score in each bin."""

    def of(x: np.ndarray) -> np.ndarray:
        at = np.clip(np.searchsorted(edges, model.logits(x), "right") - 1, 0, len(edges) - 1)
        return np.bincount(at, minlength=len(edges)).astype(float)

    return _over_all(rows, of, len(edges))


def _negative_losses(rows: DataFrame, model: Model) -> tuple[float, Weights]:
    """The mean loss of all rows as negatives, and its gradient."""

    def of(x: np.ndarray) -> np.ndarray:
        loss, grad = losses(model.weights, model.scaled(x), False)
        return np.concatenate([[len(x), loss], *(g.ravel() for g in grad)])

    sums = _over_all(rows, of, 2 + sum(w.size for w in model.weights))
    cuts = np.cumsum([w.size for w in model.weights])[:-1]
    grads = [part.reshape(w.shape) for part, w in zip(np.split(sums[2:], cuts), model.weights)]
    return _mean((sums[1], grads), max(sums[0], 1))


def learn(table: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS, seed: int = 3, rounds: int = ROUNDS) -> Model | None:
    """The model for the rows of ``table`` (from ``prepared``; write it before,
    as it is read many times)."""

    def bounded(ids: DataFrame, positive: int) -> DataFrame:
        ids = ids.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
        return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).withColumn("positive", F.lit(positive))

    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    chosen = bounded(good, 1).unionByName(bounded(table, 0))  # 2 * limit rows at most
    sample = table.join(F.broadcast(chosen), "doc_id").toPandas()
    sample = sample.sort_values(["positive", "doc_id"], kind="stable").drop_duplicates(["positive", "doc_id"])
    mark = sample["positive"].to_numpy() == 1
    if not mark.any() or mark.all():
        return None
    x = np.array(sample["features"].tolist(), float)
    p, u = x[mark], x[~mark]
    rows = table.where(~held_out(F.col("doc_id")))

    # the prior: a preliminary score, learnt from one half and asked about the other and all rows
    rng = np.random.default_rng(seed)
    p = p[rng.permutation(len(p))]
    half = len(p) // 2
    first = _train(p[:half] if half else p, u, None, seed, steps=400)
    sp = first.logits(p[half:])
    low, high = min(sp.min(), first.logits(u).min()), max(sp.max(), first.logits(u).max())
    edges = np.linspace(low, high + 1e-9, BINS)
    edges[0] = -np.inf
    prior = best_bin(sp, edges, _histogram(rows, first, edges))

    model = _train(p, u, prior, seed)
    P, adam = model.scaled(p), _Adam(model.weights, 2e-3)
    best, least = model.weights, np.inf
    for turn in range(rounds + 1):
        un = _negative_losses(rows, model)
        plus, minus = (_mean(losses(model.weights, P, positive), len(P)) for positive in (True, False))
        value, grads = risk(prior, plus, minus, un)
        if value < least:
            best, least = model.weights, value
        if turn < rounds:
            model.weights = adam.step(model.weights, grads)
    model.weights = best
    return model


def score(table: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``table`` (from ``prepared``)."""
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            value = np.full(len(x), 0.5) if model is None else model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], names=["doc_id", "score"])

    out = table.select("doc_id", "features").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
