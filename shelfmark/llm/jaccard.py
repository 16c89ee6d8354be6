"""N-gram Jaccard join: which documents' word-shingle sets overlap enough.

Two documents link when den * |A and B| >= num * |A or B|. Sets are distinct
hashes of lower-cased (A-Z) word n-grams; equal sets form a class with one
representative. Representatives that share a key and a band of sizes meet at the
smallest representative with both (the pivot). Signature trees (see ``sigtree``)
over each pivot's members decide exactly what links.

A pivot's members that don't fit in a page of bounded rows and weight are dealt
out by hash. First each page is joined by itself, with the pivot as one more
row. Members that this connects to the pivot need no further comparison among
themselves; the others, in pages of their own, are joined with each other and
with all pages of the rest. Near copies of one text so cost in proportion to
their number; k members of which none is connected to the pivot cost the order
of k squared comparisons, in units of two pages each.

Keys are the first elements of a set in one global order: rare shingles first,
by hash, then shingles known to be frequent. A set gives its whole prefix, the
(1 - t) * n + 1 elements of which linked sets must share one, or fewer where the
first k of random order miss a link with a probability below ``miss`` (1e-12, far
below that of a hash collision; 0 always takes the whole prefix). Most sets get
their keys from the elements of the smallest hashes alone; a set with many
frequent ones among those is read whole again. Frequent shingles are counted
exactly, over those elements of all classes; the list that is broadcast has at
most FREQUENT_KEPT of them, the most frequent. It only moves them to the end of
the order, so it cannot change the result.

Null and empty texts have an empty set, link with nothing and are their own
component. Rows without doc_id link with nothing and get a null component; rows
that repeat a doc_id count as one document with several sets. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import groups, sigtree
from .graph import components
from .textkernel import chunks, mix, small_batches

#: Shingles in at least this many classes are frequent; so many are kept, the most frequent.
FREQUENT, FREQUENT_KEPT = 48, 1 << 16
MISS = 1e-12
#: A set gets its keys from its smallest hashes if so large a share of them is rare;
#: then at least RARE_LEAST of its whole set is, and that share but for RARE_DOUBT
#: (but for odds that, times those of a miss, are far below MISS).
RARE_SHARE, RARE_LEAST, RARE_DOUBT = 0.75, 0.6, 0.15
#: A band holds sizes within so many times the factor by which linked sizes differ at most.
BAND = 4
#: A page of a pivot's members: rows, and shingles in all.
PAGE_ROWS, PAGE_SHINGLES = 512, 1 << 17


def _drawn(num: int, den: int, miss: float) -> tuple[int, int]:
    """How many keys do for a set of mostly rare elements, and how many of its
    smallest hashes are kept to choose them from."""
    keys = _enough((1 - num / den) / RARE_LEAST, miss)
    return keys, min(256, math.ceil(keys / RARE_SHARE) + 2)


def _enough(share: float, miss: float) -> int:
    """How many rare elements miss a link with a probability of ``miss``, if this
    share of them may lack in a linked set."""
    return math.ceil(math.log(miss) / math.log(share)) if miss and 0 < share < 0.9 else 1 << 30


def _keys(own: np.ndarray, rank: np.ndarray, n: int, num: int, den: int, miss: float) -> np.ndarray | None:
    """The keys of a set of ``n`` elements, of which ``own`` holds the smallest in
    order, or all; ``rank`` is -1 for elements that aren't frequent. None if all
    elements are needed to tell."""
    whole = n - -(-num * n // den) + 1
    rare = own[rank < 0]
    if len(own) < n:
        share = (1 - num / den) / max(RARE_LEAST, len(rare) / len(own) - RARE_DOUBT)
        k = min(whole, _enough(share, miss))
        return rare[:k] if len(rare) >= max(k, RARE_SHARE * len(own)) else None
    k = min(whole, _enough(n * (1 - num / den) / max(len(rare), 1e-9), miss))
    if k <= len(rare):
        return rare[:k]
    often = np.flatnonzero(rank >= 0)
    return np.concatenate([rare, own[often[np.argsort(rank[often], kind="stable")]]])[:k]


def _listed(lists: list[np.ndarray | None]) -> pa.Array:
    """Arrays of hashes as a list column; None as null."""
    ends = np.append(0, np.cumsum([0 if x is None else len(x) for x in lists])).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.uint64), *(x for x in lists if x is not None)]).view(np.int64)
    gone = pa.array([x is None for x in lists], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=gone)


def _signatures(docs: DataFrame, width: int, kept: int) -> DataFrame:
    """doc_id, n, h1, h2 (size and two hashes of the set), its ``kept`` smallest
    elements, and the text, compressed: texts are what is shuffled most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for first, last, chunk in chunks(batch.column(1), lower=True):
                sets = chunk.shingle_sets(width)
                sums = []
                for salt in (0x51ED270B, 0xB492B66F):
                    sums.append(np.array([mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64))
                # the chunk's bytes are lower-cased, which shingles don't tell from the text
                raw, at = chunk.data.data, chunk.offsets.tolist()
                packed = [pack(raw[a:b]) if len(s) else None for s, a, b in zip(sets, at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, sums), _listed([s[:kept] for s in sets]), pa.array(packed, pa.binary())],
                    names=["doc_id", "n", "h1", "h2", "low", "text"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, low array<long>, text binary")


def _frequent(reps: DataFrame) -> np.ndarray:
    """Hashes of frequent shingles, the rarest of them first."""
    found = reps.select(F.explode("low").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    top = found.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(FREQUENT_KEPT).collect()
    return np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64)


def _keyed(rows: DataFrame, width: int, num: int, den: int, miss: float, frequent: np.ndarray) -> DataFrame:
    """rep, n, keys of ``rows`` (rep, n, low), or of (rep, n, text) from whole
    sets; null keys where ``low`` isn't enough."""
    order = np.argsort(frequent)
    shared = rows.sparkSession.sparkContext.broadcast((frequent[order], order.astype(np.int64)))
    from_text = "text" in rows.columns

    def sets_of(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        if from_text:
            for at in range(0, batch.num_rows, 64):
                yield [s for _, _, c in chunks(_unpacked(batch.column(2).slice(at, 64))) for s in c.shingle_sets(width)]
        else:
            low = batch.column(2)
            flat, ends = low.values.to_numpy().view(np.uint64), low.offsets.to_numpy()
            yield [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, often_rank = shared.value
        for batch in batches:
            first = 0
            for sets in sets_of(batch):
                flat = np.concatenate([np.empty(0, np.uint64), *sets])
                rank = np.full(len(flat), -1, np.int64)
                if len(often) and len(flat):
                    at = np.minimum(np.searchsorted(often, flat), len(often) - 1)
                    rank = np.where(often[at] == flat, often_rank[at], -1)
                own = batch.slice(first, len(sets))
                begin = np.cumsum([0, *map(len, sets)]).tolist()
                keys = [_keys(s, rank[a : a + len(s)], n, num, den, miss) for s, a, n in zip(sets, begin, own.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), _listed(keys)], names=["rep", "n", "keys"])
                first += len(sets)

    return rows.mapInArrow(run, "rep long, n long, keys array<long>")


def _unpacked(column: pa.Array) -> pa.Array:
    """The texts of a column of compressed texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(t.as_py()) for t in column], pa.large_binary()).cast(pa.large_string())


def _verified(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b) that connect what is linked inside each unit (pivot, p, q) of
    ``rows``, which also have rep, n, page and text."""
    unit = ["pivot", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups.runs(batches, unit):
            rep, size, page, p, q = (batch.column(n).to_numpy() for n in ("rep", "n", "page", "p", "q"))
            weight = np.append(0, np.cumsum(size))
            units = groups.bounds(batch, unit)
            text = batch.column("text")
            at = 0
            while at < len(units):  # as many units at a time as weigh little, one at least
                base, end = units[at][0], at + 1
                while end < len(units) and weight[units[end][1]] - weight[base] <= PAGE_SHINGLES:
                    end += 1
                sets = [s for _, _, c in chunks(_unpacked(text.slice(base, units[end - 1][1] - base))) for s in c.shingle_sets(width)]
                a, b = [], []
                for first, last in units[at:end]:
                    if last - first < 2:
                        continue
                    side = None if p[first] == q[first] else page[first:last] == q[first]
                    i, j = sigtree.connections(sets[first - base : last - base], num, den, side)
                    if len(i):
                        u, v = groups.stars(last - first, i, j, rep[first:last])
                        a.append(u)
                        b.append(v)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                at = end

    return rows.mapInArrow(run, "a long, b long")


def _joined(signed: DataFrame, units: DataFrame, width: int, num: int, den: int, some: bool = False) -> DataFrame:
    """The links found inside ``units`` (pivot, p, q, page, rep); with ``some``
    they ask for few of the texts, and the others aren't shuffled."""
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = signed.where("n > 0").select(F.col("doc_id").alias("rep"), "n", "text")
    if some:
        texts = texts.join(groups.few(materialize(units.select("rep").distinct(), "wanted")), "rep", "left_semi")
    # texts meet their units by a shuffle at every size, so costs grow in proportion
    texts = texts.join(units.hint("shuffle_merge"), "rep")
    dealt = texts.select("pivot", "p", "q", "page", "rep", "n", "text").repartition(parts, "pivot", "p", "q")
    return _verified(dealt.sortWithinPartitions("pivot", "p", "q"), width, num, den)


def _rest(members: DataFrame, found: DataFrame) -> DataFrame:
    """The units left for ``members`` (pivot, rep, n, page, pages) of large
    groups after ``found`` connects what is linked inside single pages. Members
    not connected to their pivot are dealt to the first pages anew."""
    roots = materialize(components(found), "roots")
    root = roots.select(F.col("node").alias("rep"), "component")
    rooted = members.join(root, "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    home = rooted.where("rep = pivot").select("pivot", F.col("root").alias("home"))
    rooted = materialize(rooted.join(groups.few(materialize(home, "homes")), "pivot").select("pivot", "rep", "n", "page", "pages", (F.col("root") != F.col("home")).alias("apart")), "rooted")
    apart = rooted.where("apart").groupBy("pivot").agg(F.count("*").alias("_n"), F.sum("n").alias("_w"))
    first = F.greatest(F.ceil(F.col("_n") / PAGE_ROWS), F.ceil(F.col("_w") / PAGE_SHINGLES)).cast("int")
    apart = materialize(apart.select("pivot", first.alias("first")), "apart")
    dealt = rooted.join(groups.few(apart), "pivot")
    page = F.when(F.col("apart"), groups.page_of("rep", "first")).otherwise(F.col("page") + F.col("first"))
    partners = F.when(F.col("apart"), F.col("first") + F.col("pages")).otherwise(F.col("first"))
    dealt = dealt.select("pivot", "rep", page.alias("page"), partners.alias("pages"))
    return dealt.select("pivot", "rep", "page", F.explode(groups.page_pairs()).alias("u")).select("pivot", "u.p", "u.q", "page", "rep")


def _uncontained(members: DataFrame) -> DataFrame:
    """``members`` (pivot, rep, n) without the groups all of whose members also
    meet at the smallest other pivot that their own pivot belongs to. That pivot
    is smaller, so every dropped group lies in one that stays."""
    home = members.where("rep <> pivot").groupBy(F.col("rep").alias("pivot")).agg(F.min("pivot").alias("home"))
    there = members.select(F.col("pivot").alias("home"), "rep", F.lit(True).alias("met"))
    inside = members.join(home, "pivot").join(there, ["home", "rep"], "left").groupBy("pivot").agg(F.bool_and(F.coalesce("met", F.lit(False))).alias("all"))
    return members.join(inside.where("all").select("pivot"), "pivot", "left_anti")


def join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, miss: float = MISS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles,
    component_id (smallest doc_id reachable over links)."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(_signatures(docs, width, _drawn(num, den, miss)[1]), "signatures")
    same = ["n", "h1", "h2"]
    filled = signed.where("n > 0 and doc_id is not null")
    reps = materialize(filled.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("low").alias("low")), "classes")
    classes = reps.select(*same, "rep")

    frequent = _frequent(reps)
    how = (width, num, den, miss, frequent)
    keyed = materialize(_keyed(reps.select("rep", "n", "low"), *how), "keys")
    unsure = materialize(classes.join(keyed.where("keys is null").select("rep"), "rep"), "unsure")
    again = signed.withColumnRenamed("doc_id", "rep").join(unsure.hint("shuffle_merge"), ["rep", *same]).select("rep", "n", "text")
    keyed = keyed.where("keys is not null").unionByName(materialize(_keyed(again, *how), "keys"))

    # linked sizes lie within a factor of den / num: a set is in its own band, and
    # also in the next one if it may link with something there
    reach = max(math.log(den / num), 1e-9) * (1 + 1e-9)
    band = lambda up: F.floor((F.log("n") + up) / (BAND * reach))
    banded = keyed.select("rep", "n", "keys", F.explode(F.array_distinct(F.array(band(0), band(reach)))).alias("band"))
    # an equal hash of two keys only makes them meet
    keyed = banded.select("rep", "n", "band", F.explode("keys").alias("key")).select("rep", "n", F.xxhash64("key", "band").alias("key"))
    pivots = keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("c")).where("c > 1").select("key", "pivot")
    members = materialize(keyed.join(pivots, "key").select("pivot", "rep", "n").distinct(), "members")
    large = groups.few(materialize(groups.large(members, "pivot", "n", PAGE_ROWS, PAGE_SHINGLES), "large"))
    small = _uncontained(materialize(members.join(large, "pivot", "left_anti"), "small"))
    big = materialize(members.join(large, "pivot").withColumn("page", groups.page_of("rep")), "big")
    # a large group's pivot is one more row of each of its pages
    pivot_rows = big.where("rep = pivot").select("pivot", "rep", F.col("page").alias("own"), F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"))
    alone = big.select("pivot", "rep", "page").unionByName(pivot_rows.where("page <> own").select("pivot", "rep", "page"))
    units = small.select("pivot", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("page"), "rep")
    units = units.unionByName(alone.select("pivot", F.col("page").alias("p"), F.col("page").alias("q"), "page", "rep"))
    found = materialize(_joined(signed, units, width, num, den), "links")
    if not big.isEmpty():
        more = materialize(_joined(signed, _rest(big, found), width, num, den, some=True), "links")
        found = found.unionByName(more)

    # a doc_id with several sets is one document
    several = filled.join(classes, same).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    twice = filled.join(classes, same).join(several.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b"))
    roots = materialize(components(found.unionByName(twice)), "components")

    rooted = classes.join(roots.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("root"))
    out = signed.select("doc_id", *same).join(rooted, same, "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the smallest doc_id
    of each. Documents without text or id are linked with nothing and stay."""
    found = join(docs, width, num, den)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


#: DuckDB's form of the query op1_ngram_jaccard_join: all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) < 3 THEN list_filter([array_to_string(words, ' ')], lambda x: x <> '')
      ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS least FROM n UNION SELECT k.b, r.least FROM r JOIN k ON k.a = r.doc_id AND r.least < k.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.least) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
