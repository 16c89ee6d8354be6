"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector falls into all filters whose direction has an
inner product of at least ``alpha`` with it. Directions are structured: one of
``words`` random codewords for each block of coordinates, so that all exceeding
filters of a vector are list-decoded block by block, best codewords first, with
the rest bounded by the best of the later blocks.

Vectors join on filters. What is shuffled there is a filter, a number and a
sketch of SKETCH sign bits; in each filter, in pages of bounded size, sketches
tell which members may link (a link is lost there with odds below 1e-8), and
those that hang together make a circle. Equal circles of several filters are one.
Only the vectors in circles are then fetched, in single precision if that is
what the table holds, and compared in double precision; a linked pair counts in
its first common circle only. Vectors equal in every component form one class,
so copies never meet pair by pair; k vectors that all link are compared in the
order of k squared pairs, as their numbers of links demand.

The search is probabilistic. Each vector has about LISTED filters at every size
of the table; pairs of cosine 0.93 share one with a probability of 0.99 or more
for 220 to 10 million vectors of a label (64 and 384 dimensions, simulated), and
recall is measured against brute force in the tests.

Vectors that are null, empty, zero, or hold null or non-finite components, rows
without label and rows without vec_id link with nothing. Vectors of different
length are never compared. Rows that repeat a vec_id are vectors of their own
that share an id. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import groups
from .graph import components
from .textkernel import mix

#: Filters of a vector on average, the least that each gets, and vectors of a label in a filter.
LISTED, LEAST, SHARED = 20, 12, 16
#: Sign bits of a sketch, and how many standard deviations from the mean of a just linked pair may differ.
SKETCH, SPREAD = 128, 6.0
MAX_WORDS = 4096
PAGE_ROWS = 1024
#: One vector in so many counts when large filters are told.
COUNTED = 16


def cap_share(alpha: float, dim: int) -> float:
    """The share of the unit sphere within the cap of height ``alpha``."""
    t = np.linspace(-1, 1, 200_001)
    density = np.maximum(1 - t * t, 0) ** ((dim - 3) / 2) if dim >= 3 else 1 / np.sqrt(np.maximum(1 - t * t, 1e-12))
    return float(density[t >= alpha].sum() / density.sum())


class Filters:
    """Product code of random directions in ``dim`` dimensions for ``n`` vectors."""

    def __init__(self, dim: int, n: int, seed: int = 5):
        share = min(0.5, SHARED / max(n, 1))
        total = LISTED / share
        self.blocks = max(1, min(dim, next(m for m in range(2, 64) if total ** (1 / m) <= MAX_WORDS or m == 63)))
        self.words = max(2, math.ceil(total ** (1 / self.blocks)))
        rng = np.random.default_rng([seed, dim])
        self.parts = np.array_split(np.arange(dim), self.blocks)
        self.code = []
        for part in self.parts:
            c = rng.normal(size=(self.words, len(part)))
            self.code.append(c / np.linalg.norm(c, axis=1, keepdims=True) / self.blocks**0.5)
        low, high = -1.0, 1.0
        for _ in range(40):
            middle = (low + high) / 2
            low, high = (middle, high) if cap_share(middle, dim) > LISTED / self.words**self.blocks else (low, middle)
        self.alpha = low

    def _decode(self, scores: list[np.ndarray], alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) for all sums of one score a block of at least ``alpha``."""
        n = len(scores[0])
        rest = np.zeros((len(scores) + 1, n))
        for b in range(len(scores) - 1, -1, -1):
            rest[b] = rest[b + 1] + scores[b].max(1)
        who, so_far, code = np.arange(n), np.zeros(n), np.zeros(n, np.int64)
        for b, score in enumerate(scores):
            out = []
            step = max(1, (1 << 22) // score.shape[1])
            for k in range(0, len(who), step):
                w = who[k : k + step]
                value = so_far[k : k + step, None] + score[w]
                r, c = np.nonzero(value + rest[b + 1][w][:, None] >= alpha)
                out.append((w[r], value[r, c], code[k : k + step][r] * score.shape[1] + c))
            who, so_far, code = (np.concatenate(x) for x in zip(*out)) if out else (who, so_far, code)
        return who, code

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (row, filter) of the unit vectors ``x``, rows in order."""
        scores = [x[:, p] @ c.T for p, c in zip(self.parts, self.code)]
        who, code = self._decode(scores, self.alpha)
        alpha, short = self.alpha, np.flatnonzero(np.bincount(who, minlength=len(x)) < LEAST)
        while len(short):  # a vector in a thin part of the code lists by a lower bound
            alpha -= 0.05 * abs(self.alpha) + 1e-3
            w, c = self._decode([s[short] for s in scores], alpha)
            n = np.bincount(w, minlength=len(short))
            done = (n >= LEAST) | (alpha <= -1)
            gone = np.isin(who, short[done])
            who, code = np.concatenate([who[~gone], short[w[done[w]]]]), np.concatenate([code[~gone], c[done[w]]])
            short = short[~done]
        order = np.lexsort((code, who))
        return who[order], code[order]


def _prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, h1, h2 (128-bit hash of the unit vector), raw (bytes of
    the components as they are stored), ok."""
    item = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = np.float32 if item == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                column = part.column(2)
                sizes = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                begin = np.cumsum(sizes) - sizes
                dim = np.zeros(len(sizes), np.int32)
                h1, h2, raw = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), [None] * len(sizes)
                for n in np.unique(sizes[sizes > 0]).tolist():
                    rows = np.flatnonzero(sizes == n)
                    x = values[begin[rows][:, None] + np.arange(n)] + 0.0  # no negative zeros
                    fine = np.isfinite(x).all(1) & (x != 0).any(1)
                    rows, x = rows[fine], x[fine]
                    dim[rows] = n
                    for i, v, u in zip(rows.tolist(), x.astype(kind), _unit(x)):
                        raw[i] = v.tobytes()
                        h = xxhash.xxh3_128_digest(u.tobytes())
                        h1[i], h2[i] = int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(dim), pa.array(h1), pa.array(h2), pa.array(raw, pa.binary())], names=["vec_id", "label", "dim", "h1", "h2", "raw"])

    stored = "float" if kind is np.float32 else "double"
    chosen = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast(f"array<{stored}>"))
    out = chosen.mapInArrow(run, "vec_id long, label string, dim int, h1 long, h2 long, raw binary")
    return out.withColumn("ok", F.col("raw").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(raw: pa.Array, rows: list[int], dim: int) -> np.ndarray:
    """Unit vectors in double precision from their stored bytes."""
    data = b"".join(raw[i].as_py() for i in rows)
    kind = np.float32 if len(data) == 4 * dim * len(rows) else np.float64
    return _unit(np.frombuffer(data, kind).reshape(len(rows), dim).astype(np.float64))


def _listed(classes: DataFrame, largest: dict[int, int], seed: int) -> DataFrame:
    """(g, rep, s1, s2): each filter of each class, as a hash of label, length
    and filter, and the class's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[Filters, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                dims, rep = part.column("dim").to_numpy(), part.column("rep").to_numpy()
                label = np.array([xxhash.xxh3_64_intdigest(x.as_py()) for x in part.column("label")], np.uint64)
                for dim in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == dim)
                    if dim not in made:
                        made[dim] = Filters(dim, largest[dim], seed), np.random.default_rng([seed, dim, 1]).normal(size=(dim, SKETCH))
                    filters, planes = made[dim]
                    x = _matrix(part.column("raw"), own.tolist(), dim)
                    who, code = filters.of(x)
                    sketch = np.packbits(x @ planes > 0, axis=1).view(np.int64)
                    group = mix(mix(code.astype(np.uint64) + np.uint64(dim)) ^ label[own][who]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(rep[own][who]), pa.array(sketch[who, 0]), pa.array(sketch[who, 1])], names=["g", "rep", "s1", "s2"])

    return classes.mapInArrow(run, "g long, rep long, s1 long, s2 long")


def sketch_bound(least: float) -> int:
    """How many bits of the sketches of linked vectors may differ."""
    share = math.acos(least) / math.pi
    return math.ceil(SKETCH * share + SPREAD * math.sqrt(SKETCH * share * (1 - share)))


def _circles(units: DataFrame, least: float) -> DataFrame:
    """(circle, rep): the members of each unit (g, p, q) that hang together over
    sketches that may belong to linked vectors."""
    keys, most = ["g", "p", "q"], sketch_bound(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups.runs(batches, keys):
            rep = batch.column("rep").to_numpy()
            sketch = np.column_stack([batch.column(n).to_numpy() for n in ("s1", "s2")]).view(np.uint64)
            out = []
            for first, last in groups.bounds(batch, keys):
                if last - first < 2:
                    continue
                s, ids = sketch[first:last], rep[first:last]
                near = sum(np.bitwise_count(s[:, k, None] ^ s[None, :, k]).astype(np.int16) for k in (0, 1)) <= most
                i, j = np.nonzero(np.triu(near, 1))
                if not len(i):
                    continue
                label = groups.labels(last - first, i, j)
                used = np.unique(np.concatenate([i, j]))
                label, ids = label[used], ids[used]
                # a circle's number: the sum of its members' hashes
                total = np.zeros(last - first, np.uint64)
                np.add.at(total, label, mix(ids.view(np.uint64) + np.uint64(1)))
                out.append((mix(total)[label].view(np.int64), ids))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["circle", "rep"])

    return units.mapInArrow(run, "circle long, rep long")


def _circle_links(rep: np.ndarray, weight: np.ndarray, x: np.ndarray, kind: np.ndarray, before: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b) that connect what is linked, and the links that each row has
    here for the first time. ``before``: the smaller circles of each row;
    rows of different ``kind`` are never compared."""
    link = (x @ x.T >= least) & (kind[:, None] == kind)
    np.fill_diagonal(link, False)
    i, j = np.nonzero(np.triu(link))
    if not len(i):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(rep), np.int64)
    circle = np.concatenate(before)
    row = np.repeat(np.arange(len(rep)), [len(b) for b in before])
    order = np.argsort(circle, kind="stable")
    for met in np.split(row[order], np.flatnonzero(np.diff(circle[order])) + 1):
        if len(met) > 1:
            link[np.ix_(met, met)] = False  # counted there
    a, b = groups.stars(len(rep), i, j, rep)
    return a, b, link @ weight


def _compared(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, n): a row (rep, null, n) for links of rep, a row (a, b, null) for an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups.runs(batches, ["circle"]):
            rep, weight, dim = (batch.column(n).to_numpy() for n in ("rep", "weight", "dim"))
            label = np.unique(batch.column("label").to_numpy(zero_copy_only=False), return_inverse=True)[1]
            raw, circles, own = batch.column("raw"), batch.column("circles"), batch.column("circle").to_numpy()
            a, b, n = [], [], []
            for first, last in groups.bounds(batch, ["circle"]):
                for d in np.unique(dim[first:last]).tolist():  # one, unless hashes of filters collide
                    at = first + np.flatnonzero(dim[first:last] == d)
                    if len(at) < 2:
                        continue
                    lists = [c[c < own[first]] for c in (circles[i].values.to_numpy() for i in at.tolist())]
                    u, v, links = _circle_links(rep[at], weight[at], _matrix(raw, at.tolist(), d), label[at], lists, least)
                    some = links > 0
                    a += [u, rep[at][some]]
                    b += [pa.array(v), pa.nulls(int(some.sum()), pa.int64())]
                    n += [pa.nulls(len(u), pa.int64()), pa.array(links[some].astype(np.int64))]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.concat_arrays(b), pa.concat_arrays(n)], names=["a", "b", "n"])

    return rows.mapInArrow(run, "a long, b long, n long")


def join(vectors: DataFrame, least: float = 0.93, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id,
    label, embedding)."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prepared = _prepared(vectors)
    key = ["label", "dim", "h1", "h2"]
    rows = materialize(prepared.select("vec_id", *key, "ok"), "vectors")
    classes = prepared.where("ok").groupBy(*key).agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"), F.first("raw").alias("raw"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    # one row for each vector length in use
    largest = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    listed = materialize(_listed(classes.select("rep", "label", "dim", "raw"), {r["dim"]: r["n"] for r in largest}, seed), "filters")

    # only sets the size of pages: a filter of more than 2 * PAGE_ROWS is told from one vector in COUNTED
    told = listed.where(F.pmod(F.xxhash64("rep"), F.lit(COUNTED)) == 0).groupBy("g").agg((F.count("*") * COUNTED).alias("c"))
    told = groups.few(materialize(told.where(F.col("c") > PAGE_ROWS).select("g", F.ceil(F.col("c") / PAGE_ROWS).cast("int").alias("pages")), "large"))
    single = listed.join(told, "g", "left_anti").select("*", F.lit(0).alias("p"), F.lit(0).alias("q"))
    paged = listed.join(told, "g").withColumn("page", groups.page_of("rep"))
    paged = paged.select("g", "rep", "s1", "s2", F.explode(groups.page_pairs()).alias("u")).select("g", "rep", "s1", "s2", "u.p", "u.q")
    dealt = single.unionByName(paged).repartition(parts, "g", "p", "q").sortWithinPartitions("g", "p", "q")
    members = materialize(_circles(dealt, least).distinct(), "circles")

    lists = members.groupBy("rep").agg(F.collect_set("circle").alias("circles"))
    known = classes.select("rep", "label", "dim", "raw", "weight").join(lists, "rep")
    full = known.select("*", F.explode("circles").alias("circle"))
    found = materialize(_compared(full.repartition(parts, "circle").sortWithinPartitions("circle"), least), "links")

    links = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("far"))
    roots = components(found.where("b is not null").select("a", "b"))
    known = classes.drop("raw").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.withColumn("root", F.coalesce("component", "rep"))
    smallest = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = known.join(smallest, "root").select(*key, (F.col("weight") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), "component_id")
    same = rows["ok"]
    for k in key:
        same = same & (rows[k] == known[k])
    out = rows.join(known, same, "left")
    component = F.coalesce(known["component_id"], rows["vec_id"])
    return out.select(rows["vec_id"], F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(rows["vec_id"] == component, F.lit(False)).alias("kept"))


#: DuckDB's form of the query op4_embedding_near_dedup: all pairs of a label.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
f AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM f),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id, vec_id AS least FROM v UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.vec_id AND r.least < l.b),
c AS (SELECT vec_id, min(least) AS component_id FROM r GROUP BY vec_id)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""
