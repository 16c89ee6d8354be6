r"""Line dedup by distinct-site spread.

Lines are hashed after trimming; HyperLogLog sketches of the sites that hold a
line merge by aggregation. Lines whose estimate lies near the threshold get an
exact distinct count. A line of ``min_words`` words or more is boilerplate from
``min_sites`` sites on, a shorter one, of SHORT_WORDS at least, from
``short_sites`` on: short lines meet by chance. Lines of a single word stay.
Boilerplate goes from every document but the one with the smallest doc_id, so no
line is lost altogether. Words are runs of characters other than space and \t-\r;
lines are split at \n.

Hashes of boilerplate are broadcast while they are counted few; beyond, the join
on them shuffles, and a very common line's rows are split by adaptive execution.

Null texts stay null; lines without words always stay. A null source is a site
of its own. Rows without doc_id count for the spread and stay as they are; rows
that repeat a doc_id are treated alike. Other columns pass through, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .groups import few, free_name

MIN_WORDS, MIN_SITES = 5, 3
SHORT_WORDS, SHORT_SITES = 2, 15
LG_K = 10
#: Relative standard error of a sketch of 2**LG_K registers, times three.
BAND = 3 * 1.04 / 2 ** (LG_K / 2)
_BLANK = r"[\x20\x09-\x0D]"


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, rf"^{_BLANK}+|{_BLANK}+$", "")


def _words(least: int) -> str:
    """A pattern of trimmed lines of so many words or more."""
    return rf"^(?:[^\x20\x09-\x0D]+{_BLANK}+){{{least - 1}}}[^\x20\x09-\x0D]"


def boilerplate(docs: DataFrame, min_words: int = MIN_WORDS, min_sites: int = MIN_SITES, short_sites: int = SHORT_SITES) -> tuple[DataFrame, DataFrame]:
    """(lines, found): the countable lines of each document (_id, _site, _h), and
    the hashes of boilerplate lines with the document that keeps each (_h, _keeper)."""
    texts = F.filter(F.transform(F.split("text", "\n"), _trimmed), lambda x: x.rlike(_words(min(SHORT_WORDS, min_words))))
    hashes = F.array_distinct(F.transform(texts, lambda x: F.struct(F.xxhash64(x).alias("_h"), x.rlike(_words(min_words)).alias("_long"))))
    site = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    lines = docs.select(F.col("doc_id").alias("_id"), site.alias("_site"), F.explode(hashes).alias("_l")).select("_id", "_site", "_l.*")
    lines = materialize(lines, "lines")
    need = F.when(F.col("_long"), min_sites).otherwise(short_sites)
    spread = lines.groupBy("_h").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(LG_K))).alias("_sites"), F.min("_id").alias("_keeper"), F.count("*").alias("_n"), F.bool_or("_long").alias("_long")
    ).withColumn("_need", need)
    spread = materialize(spread.where("_n >= _need").drop("_n", "_long"), "spread")
    close = F.abs(F.col("_sites") - F.col("_need")) <= F.greatest(F.lit(1.0), BAND * F.col("_need"))
    near = spread.where(close).select("_h", "_keeper", "_need")
    exact = lines.join(few(materialize(near, "near")), "_h").groupBy("_h", "_keeper", "_need").agg(F.count_distinct("_site").alias("_exact"))
    sure = spread.where(~close & (F.col("_sites") > F.col("_need"))).select("_h", "_keeper")
    return lines, sure.unionByName(exact.where("_exact >= _need").select("_h", "_keeper"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_sites: int = MIN_SITES, short_sites: int = SHORT_SITES) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text``, and ``n_lines`` and
    ``n_removed`` (named with underscores before where ``docs`` has those)."""
    lines, found = boilerplate(docs, min_words, min_sites, short_sites)
    key, lost, kept = (free_name(n, docs.columns) for n in ("key", "lost", "kept"))
    gone = lines.join(few(materialize(found, "boilerplate")), "_h").where("_id <> _keeper").groupBy(F.col("_id").alias(key)).agg(F.collect_set("_h").alias(lost))
    joined = docs.join(gone, docs["doc_id"] == gone[key], "left")
    parts = F.split("text", "\n")
    left = F.filter(parts, lambda x: ~F.array_contains(lost, F.xxhash64(_trimmed(x))))
    prefix = ""
    while {f"{prefix}n_lines", f"{prefix}n_removed"} & set(docs.columns):
        prefix += "_"
    out = joined.withColumn(kept, F.when(F.col(lost).isNull(), parts).otherwise(left))
    columns = [F.when(F.col("text").isNotNull(), F.array_join(kept, "\n")).alias("text") if c == "text" else docs[c] for c in docs.columns]
    size = lambda c: F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    return out.select(*columns, size(parts).alias(f"{prefix}n_lines"), (size(parts) - size(F.col(kept))).alias(f"{prefix}n_removed"))


#: DuckDB's form of the query op5_line_dedup.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
p AS (SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM d),
t AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM p),
f AS (SELECT *, len(regexp_extract_all(key, '[^\x20\x09-\x0D]+')) AS words FROM t),
b AS (SELECT key, min(doc_id) AS keeper FROM f WHERE words >= {SHORT_WORDS} GROUP BY key
      HAVING count(DISTINCT coalesce('s' || source, '-')) >= CASE WHEN any_value(words) >= {MIN_WORDS} THEN {MIN_SITES} ELSE {SHORT_SITES} END),
k AS (SELECT f.doc_id, f.place, f.line, f.words >= {SHORT_WORDS} AND b.key IS NOT NULL AND f.doc_id <> b.keeper AS gone
      FROM f LEFT JOIN b ON f.key = b.key)
SELECT d.doc_id, len(any_value(d.parts)) AS n_lines, count(*) FILTER (WHERE k.gone) AS n_removed,
       md5(coalesce(string_agg(k.line, chr(10) ORDER BY k.place) FILTER (WHERE NOT k.gone), '')) AS text_md5
FROM d JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""
