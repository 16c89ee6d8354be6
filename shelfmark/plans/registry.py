r"""Registered queries over the driver tables, with SQL that gives the same rows.

An order stands for a kit, its line items for the files of a folder, joined to
parts for their names; region\nation\customer\order-key is its path; region and
nation prefixes are scan roots.
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as c
from ..functions import scalars as s
from ..functions.display import displayed
from ..operators import duplicates as dup
from ..operators import hydration, merge, relocate, reports, rollup, sources
from ..storage import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Our own rules, over the words of part names.
RULES = c.Rules(
    categories=[("Rings", r"\bring\b|gasket"), ("Gears", r"gear|gizmo"), ("Colours", r"red|blue|green|white")],
    factions=[("Large", r"\b(large|big)\b"), ("Small", r"small|mini")],
    types=[("standard", r"standard|promo"), ("economy", r"economy"), ("round", r"ring|widget")],
    war_pattern=r"widget|bolt",
    war_category="Hardware",
    default_category="Other",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# kits ----------------------------------------------------------------------
def kit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dir, name, size of the files of each order, as a listing gives them."""
    files = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("size"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower(F.concat("p_name", F.lit(".stl"))).alias("name"))
    return files.join(names, "l_partkey").select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("dir"), "name", "size")


def kits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ord, path, size_bytes, model_files, part_count, primary_file of each order."""
    key = F.substring("path", 7, 20).cast("long")
    return rollup.projects(kit_files(spark, sf_dir)).withColumns({"id": key, "ord": key, "part_count": F.col("part_count").cast("long")})


_KITS = """k AS (SELECT l_orderkey AS id, sum(CAST(l_quantity AS BIGINT))::BIGINT AS size_bytes, list_sort(list(lower(p_name) || '.stl')) AS files, count(*) AS n,
 min(struct_pack(k := -CAST(l_quantity AS BIGINT), n := lower(p_name) || '.stl')).n AS prim, 'order-' || l_orderkey AS path FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""
_PRINTS = _KITS + """, f AS (SELECT *, substr(md5(array_to_string(files, '|') || '::' || n || '::' || size_bytes), 1, 16) AS fp, substr(md5(array_to_string(files, '|') || '::' || n), 1, 16) AS loose FROM k)"""
_EXACT = _PRINTS + """, x AS (SELECT fp, count(*) AS copies, (sum(size_bytes) - arg_min(size_bytes, path))::BIGINT AS waste, min(id) AS first_ord FROM f GROUP BY fp HAVING count(*) >= 2)"""
_NEAR = _EXACT + """, l AS (SELECT loose, count(*) AS copies, (sum(size_bytes) - arg_min(size_bytes, path))::BIGINT AS waste, min(id) AS first_ord, bool_and(fp IN (SELECT fp FROM x)) AS covered
 FROM f GROUP BY loose HAVING count(*) >= 2), y AS (SELECT loose, copies, waste, first_ord FROM l WHERE NOT covered)"""


@query(f"WITH {_KITS} SELECT id, n AS part_count, size_bytes, array_to_string(files, '|') AS files, prim AS primary_file FROM k")
def kit_rollup(spark, sf_dir):
    return kits(spark, sf_dir).select("id", "part_count", "size_bytes", F.array_join("model_files", "|").alias("files"), "primary_file")


@query("""WITH f AS (SELECT l_orderkey AS id, CAST(l_quantity AS BIGINT) AS size, lower(p_name) || CASE WHEN l_linenumber % 3 = 0 THEN '_render' ELSE '' END || CASE WHEN l_linenumber % 2 = 0 THEN '.png' ELSE '.stl' END AS name, l_linenumber % 2 = 0 AS image
 FROM lineitem JOIN part ON l_partkey = p_partkey)
 SELECT id, count(*) FILTER (WHERE NOT image) AS part_count, arg_min(name, struct_pack(h := NOT contains(name, '_render'), s := -size, n := name)) FILTER (WHERE image) AS preview FROM f GROUP BY id HAVING count(*) FILTER (WHERE NOT image) > 0""")
def preview_choice(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    name = F.concat(F.lower("p_name"), F.when(n % 3 == 0, "_render").otherwise(""), F.when(n % 2 == 0, ".png").otherwise(".stl"))
    out = rollup.projects(files.select(F.col("l_orderkey").cast("string").alias("dir"), name.alias("name"), F.col("l_quantity").cast("long").alias("size")))
    return out.select(F.col("path").cast("long").alias("id"), F.col("part_count").cast("long").alias("part_count"), F.element_at(F.split("preview_file", "/"), -1).alias("preview"))


@query(f"WITH {_PRINTS} SELECT id, fp, loose FROM f")
def kit_fingerprints(spark, sf_dir):
    return dup.fingerprinted(kits(spark, sf_dir)).select("id", "fp", "loose")


@query(f"WITH {_EXACT} SELECT 'exact-' || row_number() OVER (ORDER BY waste DESC, first_ord) AS grp, fp, copies, waste FROM x")
def duplicates_exact(spark, sf_dir):
    return dup.ranked(dup.exact_groups(dup.fingerprinted(kits(spark, sf_dir))), "exact").select("grp", "fp", "copies", "waste")


@query(f"WITH {_NEAR} SELECT 'near-' || row_number() OVER (ORDER BY waste DESC, first_ord) AS grp, loose, copies, waste FROM y")
def duplicates_near(spark, sf_dir):
    return dup.ranked(dup.near_groups(dup.fingerprinted(kits(spark, sf_dir))), "near").select("grp", "loose", "copies", "waste")


@query(f"WITH {_EXACT} SELECT fp, id, row_number() OVER (PARTITION BY fp ORDER BY path, id) AS place, ((size_bytes + 50000) // 100000) / 10.0 AS size_mb FROM f SEMI JOIN x USING (fp)")
def duplicate_members(spark, sf_dir):
    prints = dup.fingerprinted(kits(spark, sf_dir))
    rows = dup.members(prints, dup.ranked(dup.exact_groups(prints), "exact"), "fp")
    return rows.select("fp", "id", F.col("place").cast("long").alias("place"), s.megabytes("size_bytes", 1).alias("size_mb"))


@query(f"""WITH {_NEAR} SELECT (SELECT count(*) FROM x) AS exact_groups, (SELECT coalesce(sum(copies - 1), 0)::BIGINT FROM x) AS exact_extra, (SELECT coalesce(sum(waste), 0)::BIGINT FROM x) AS exact_waste,
 (SELECT count(*) FROM y) AS near_groups, (SELECT coalesce(sum(copies - 1), 0)::BIGINT FROM y) AS near_extra, (SELECT coalesce(sum(waste), 0)::BIGINT FROM y) AS near_waste""")
def duplicate_totals(spark, sf_dir):
    prints = dup.fingerprinted(kits(spark, sf_dir))
    exact = dup.exact_groups(prints)
    return dup.totals(exact, dup.near_groups(prints, exact))


@query("""WITH d AS (SELECT doc_id, n_chars, substr(md5(md5(coalesce(text, '')) || '::1::' || n_chars), 1, 16) AS fp FROM documents)
 SELECT fp, count(*) AS copies, (sum(n_chars) - arg_min(n_chars, doc_id))::BIGINT AS waste FROM d GROUP BY fp HAVING count(*) >= 2""")
def doc_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("n_chars").alias("size_bytes"), F.array(F.md5(F.coalesce("text", F.lit("")))).alias("model_files"))
    return dup.exact_groups(dup.fingerprinted(docs)).select("fp", "copies", "waste")


@query(f"WITH {_EXACT}, r AS (SELECT *, row_number() OVER (ORDER BY waste DESC, first_ord) AS place FROM x) SELECT place, copies, waste, greatest((SELECT count(*) FROM x) - 20, 0) AS more FROM r WHERE place <= 20")
def duplicates_reported(spark, sf_dir):
    return dup.reported(dup.ranked(dup.exact_groups(dup.fingerprinted(kits(spark, sf_dir))), "exact"), 20).select("place", "copies", "waste", "more")


# scalars -------------------------------------------------------------------
@query("SELECT page_id, substr(sha1(rtrim(replace(lower(trim(url)), '/', chr(92)), chr(92))), 1, 16) AS id, len(list_filter(string_split(replace(url, '/', chr(92)), chr(92)), lambda x: x <> '')) AS n_segments FROM pages")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", s.stable_id("url").alias("id"), F.size(s.segments("url")).cast("long").alias("n_segments"))


@query("SELECT page_id, 'file:///' || replace(replace(replace(replace(replace(url_encode(url), '+', '%20'), '%2F', '/'), '%3A', ':'), '*', '%2A'), '%7E', '~') AS uri FROM pages")
def file_uris(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", s.file_uri("url").alias("uri"))


@query("""WITH t AS (SELECT l_orderkey, sum(CAST(l_extendedprice * 100 AS BIGINT))::BIGINT AS b FROM lineitem GROUP BY 1)
 SELECT l_orderkey, ((b + 50000) // 100000) / 10.0 AS mb1, ((b + 5000) // 10000) / 100.0 AS mb2,
 CASE WHEN b // 1000 < 90 THEN (b // 1000) || 's' WHEN b // 60000 < 90 THEN (b // 60000) || 'm' ELSE (b // 3600000) || 'h' || lpad(((b // 60000) % 60)::VARCHAR, 2, '0') || 'm' END AS took FROM t""")
def size_mb(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum((F.col("l_extendedprice") * 100).cast("decimal(20,0)").cast("long")).alias("b"))
    return b.select("l_orderkey", s.megabytes("b", 1).alias("mb1"), s.megabytes("b", 2).alias("mb2"), s.duration(F.floor(F.col("b") / 1000)).alias("took"))


@query("""WITH t AS (SELECT l_orderkey, sum(CAST(l_extendedprice * 100000 AS BIGINT))::BIGINT AS b FROM lineitem GROUP BY 1), g AS (SELECT *, (b + 5000000) // 10000000 AS c FROM t)
 SELECT l_orderkey, format('{:,}', b) AS grouped, format('{:,}', (b + 500000) // 1000000) AS mb, format('{:,}', c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS gb FROM g""")
def sizes_shown(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum((F.col("l_extendedprice") * 100000).cast("decimal(20,0)").cast("long")).alias("b"))
    return b.select("l_orderkey", s.thousands("b").alias("grouped"), s.whole_megabytes("b").alias("mb"), s.gigabytes("b").alias("gb"))


@query("SELECT event_id, 'catalog_' || strftime(ts, '%Y%m%d_%H%M%S') || '.json' AS name FROM events")
def stamped_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", s.stamped("catalog", F.col("ts"), ".json").alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/' || p_name || '.tar' WHEN 2 THEN '..' || p_name ELSE p_name END AS stem, CASE p_partkey % 4 WHEN 0 THEN 'stl' WHEN 2 THEN 'obj' ELSE '' END AS ext,
 CASE p_partkey % 4 WHEN 0 THEN p_name || '.tar.STL' WHEN 1 THEN p_name WHEN 2 THEN '..' || p_name || '.obj' ELSE p_name || '.' END AS base FROM part""")
def name_parts(spark, sf_dir):
    n = F.col("p_name")
    made = F.element_at(F.array(F.concat(F.lit("a/"), n, F.lit(".tar.STL")), n, F.concat(F.lit(".."), n, F.lit(".obj")), F.concat(n, F.lit("."))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("f")).select("p_partkey", s.stem("f").alias("stem"), s.extension("f").alias("ext"), s.last(s.segments("f")).alias("base"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS escaped, replace(html, '</', '<' || chr(92) || '/') AS scripted, to_base64(encode(url)) AS coded FROM pages""")
def escapes(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", s.html_escaped("html").alias("escaped"), s.script_safe("html").alias("scripted"), F.regexp_replace(F.base64(F.encode("url", "UTF-8")), r"\s", "").alias("coded"))


@query("""WITH t AS (SELECT p_partkey, ' #' || substr(md5(p_name), 1, CASE WHEN p_partkey % 3 = 0 THEN 3 WHEN p_partkey % 3 = 1 THEN 6 ELSE 5 END) || ' ' AS raw FROM part),
 c AS (SELECT p_partkey, CASE WHEN length(trim(raw)) IN (4, 7) THEN trim(raw) ELSE '#20242c' END AS colour FROM t),
 w AS (SELECT *, CASE WHEN length(colour) = 4 THEN colour[2] || colour[2] || colour[3] || colour[3] || colour[4] || colour[4] ELSE substr(colour, 2) END AS h FROM c)
 SELECT p_partkey, colour, round(('0x' || substr(h, 1, 2))::INT / 255.0, 6) AS red, round(('0x' || substr(h, 5, 2))::INT / 255.0, 6) AS blue FROM w""")
def hex_colours(spark, sf_dir):
    k = F.col("p_partkey") % 3
    raw = F.concat(F.lit(" #"), F.substring(F.md5("p_name"), F.lit(1), F.when(k == 0, 3).when(k == 1, 6).otherwise(5)), F.lit(" "))
    out = table(spark, sf_dir, "part").select("p_partkey", s.hex_colour(raw, "#20242c").alias("colour")).withColumn("rgb", s.rgb("colour"))
    return out.select("p_partkey", "colour", F.round(F.col("rgb")[0], 6).alias("red"), F.round(F.col("rgb")[2], 6).alias("blue"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.ref') AS ref, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, sf_dir):
    """Parsed, written again as the catalog writes its items, and read back."""
    keys = "struct<page:string,ref:string,k:string>"
    written = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.from_json("props", keys).alias("p")), {"ignoreNullFields": "false"}).alias("j"))
    return written.select("event_id", F.from_json("j", f"struct<p:{keys}>")["p"].alias("p")).select("event_id", "p.*")


# classification ------------------------------------------------------------
def _case(pairs: c.Pairs, hay: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({hay}, '(?i){p}') THEN '{label}'" for label, p in pairs) + " END"


def _types(hay: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({hay}, '(?i){p}') THEN 'type:{label}' END" for label, p in RULES.types) + "], lambda x: x IS NOT NULL)"


def _classes(source: str) -> str:
    """b: the columns of ``source`` (hay, inner_hay) with faction, category and types."""
    return f"""a AS (SELECT *, coalesce({_case(RULES.factions, 'hay')}, {_case(RULES.factions, 'inner_hay')}) AS faction FROM {source}),
 b AS (SELECT *, CASE WHEN faction IS NOT NULL OR regexp_matches(hay, '(?i){RULES.war_pattern}') OR regexp_matches(inner_hay, '(?i){RULES.war_pattern}') THEN '{RULES.war_category}'
   ELSE coalesce({_case(RULES.categories, 'hay')}, {_case(RULES.categories, 'inner_hay')}, '{RULES.default_category}') END AS category,
   CASE WHEN len({_types('hay')}) > 0 THEN {_types('hay')} ELSE {_types('inner_hay')} END AS types FROM a)"""


_HAY = "lower(p_brand || ' ' || p_name || ' ' || p_name)"
_CLASSED = f"""h AS (SELECT p_partkey, p_type, p_name, {_HAY} AS hay, lower(p_type) AS inner_hay FROM part),
 {_classes('h')}"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    path = F.concat("p_brand", F.lit(" "), "p_name")
    return part.select("p_partkey", "p_name", "p_type", "p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("size_bytes"), path.alias("path"), F.col("p_name").alias("name"),
                       F.array(F.concat("p_type", F.lit(".stl"))).alias("model_files"), F.col("p_partkey").alias("ord"))


def _labelled(rows: DataFrame, rules: c.Rules) -> DataFrame:
    return rows.withColumns(c.classified(rules, "path", "name", "model_files"))


@query(f"WITH {_CLASSED} SELECT p_partkey, category, faction, array_to_string(list_concat(CASE WHEN faction IS NULL THEN [] ELSE ['faction:' || faction] END, types), '|') AS tags FROM b")
def classify_parts(spark, sf_dir):
    return _labelled(_parts(spark, sf_dir), RULES).select("p_partkey", "category", "faction", F.array_join("labels", "|").alias("tags"))


@query(f"SELECT p_partkey, {_case(RULES.categories, 'p_name')} AS label FROM part")
def classify_first_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", c.first_match(RULES.categories, F.col("p_name")).alias("label"))


@query(f"SELECT p_partkey, array_to_string({_types('p_name')}, '|') AS labels FROM part")
def types_all_match(spark, sf_dir):
    labels = F.transform(c.all_matches(RULES.types, F.col("p_name")), lambda t: F.concat(F.lit("type:"), t))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(labels, "|").alias("labels"))


_CAP = 60


@query(f"""WITH {_KITS}, u AS (SELECT id, unnest(list_transform(files, lambda f: replace(f, '.stl', ''))) AS name, generate_subscripts(files, 1) AS pos FROM k),
 d AS (SELECT id, name, min(pos) AS pos FROM u GROUP BY id, name), r AS (SELECT *, coalesce(sum(length(name) + 1) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
 h AS (SELECT id, string_agg(name, ' ' ORDER BY pos) FILTER (WHERE before < {_CAP}) AS hay FROM r GROUP BY id)
 SELECT id, hay, {_case(RULES.factions, 'hay')} AS faction FROM h""")
def filename_fallback(spark, sf_dir):
    rows = kits(spark, sf_dir).select("id", c.haystack("model_files", _CAP).alias("hay"))
    return rows.withColumn("faction", c.first_match(RULES.factions, F.col("hay")))


@query(f"WITH {_CLASSED} SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS size_bytes FROM b JOIN part USING (p_partkey) WHERE category = '{RULES.default_category}' AND faction IS NULL ORDER BY size_bytes DESC, p_partkey LIMIT 25")
def unmatched_top(spark, sf_dir):
    return reports.unmatched_top(_labelled(_parts(spark, sf_dir), RULES), RULES.default_category).select("p_partkey", "size_bytes")


@query(f"WITH {_CLASSED} SELECT count(*) FILTER (WHERE category = '{RULES.default_category}' AND faction IS NULL) AS unmatched, count(*) AS total FROM b")
def unmatched_counts(spark, sf_dir):
    return reports.unmatched_counts(_labelled(_parts(spark, sf_dir), RULES), RULES.default_category)


_OTHER = c.Rules(categories=RULES.categories[::-1], factions=RULES.factions[:1], types=RULES.types, war_pattern="", default_category="Other", match_filenames=False)
_DIFF = f"""WITH {_CLASSED}, o AS (SELECT *, {_case(_OTHER.factions, 'hay')} AS f2 FROM b),
 n AS (SELECT *, CASE WHEN f2 IS NOT NULL THEN 'Wargaming' ELSE coalesce({_case(_OTHER.categories, 'hay')}, 'Other') END AS c2 FROM o)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _labelled(_parts(spark, sf_dir), RULES).drop("labels").withColumns({"source": F.lit("s"), "formats": F.array(F.lit("stl")), "packed": F.lit(False), "tags": F.array(F.lit("t"))})
    roots = spark.createDataFrame([], "root string, ord int")
    return reports.reclassified(old, _OTHER, roots)


@query(f"{_DIFF} SELECT p_partkey, category, c2 AS new_category, faction, f2 AS new_faction FROM n WHERE category IS DISTINCT FROM c2 OR faction IS DISTINCT FROM f2")
def reclassify_diff(spark, sf_dir):
    diff = _diff(spark, sf_dir).where(~F.col("category").eqNullSafe(F.col("new_category")) | ~F.col("faction").eqNullSafe(F.col("new_faction")))
    return diff.select("p_partkey", "category", "new_category", "faction", "new_faction")


@query(f"{_DIFF} SELECT count(*) FILTER (WHERE category IS DISTINCT FROM c2) AS category, count(*) FILTER (WHERE faction IS DISTINCT FROM f2) AS faction FROM n")
def reclassify_counts(spark, sf_dir):
    return reports.change_counts(_diff(spark, sf_dir)).select("category", "faction")


@query(f"""WITH t AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part)
 SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, ['zip']))), '|') AS formats, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), '|') AS added FROM t""")
def tag_arrays(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("new_tags"), F.split(F.lower("p_type"), " ").alias("tags"))
    diff = reports.tag_changes(part)
    return diff.select("p_partkey", F.array_join(F.array_sort(F.array_union("new_tags", F.array(F.lit("zip")))), "|").alias("formats"), F.array_join(F.array_sort("added"), "|").alias("added"))


# scan roots and display ----------------------------------------------------
_ROOTS = """g AS (SELECT r_name AS root, r_regionkey AS ord FROM region UNION ALL SELECT r_name || chr(92) || n_name, 100 + n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 AND r_regionkey < 4),
 p AS (SELECT c_custkey, r_name || chr(92) || n_name || chr(92) || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 m AS (SELECT c_custkey, path, root, ord FROM p LEFT JOIN g ON lower(path) = lower(root) OR starts_with(lower(path), lower(root) || chr(92)))"""


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    some = nation.where("n_nationkey % 2 = 0").join(region.where("r_regionkey < 4"), F.col("n_regionkey") == F.col("r_regionkey"))
    return region.select(F.col("r_name").alias("root"), F.col("r_regionkey").alias("ord")).unionByName(some.select(F.concat_ws("/", "r_name", "n_name").alias("root"), (F.col("n_nationkey") + 100).alias("ord")))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", F.concat_ws("\\", "r_name", "n_name", "c_name").alias("path"))


@query(f"WITH {_ROOTS} SELECT c_custkey, replace(arg_max(root, struct_pack(l := length(root), o := -ord)), chr(92), '/') AS root FROM m GROUP BY c_custkey")
def source_longest_prefix(spark, sf_dir):
    return sources.longest_root(_paths(spark, sf_dir), _roots(spark, sf_dir)).select("c_custkey", "root")


@query(f"WITH {_ROOTS}, f AS (SELECT c_custkey, arg_min(root, ord) AS root FROM m GROUP BY c_custkey) SELECT replace(g.root, chr(92), '/') AS root, count(f.c_custkey) AS n FROM g LEFT JOIN f ON f.root = g.root GROUP BY g.root")
def source_counts(spark, sf_dir):
    return sources.root_counts(_paths(spark, sf_dir), _roots(spark, sf_dir)).where("root is not null")


@query(f"WITH {_ROOTS} SELECT c_custkey, split_part(arg_max(root, struct_pack(l := length(root), o := -ord)), chr(92), -1) AS source FROM m GROUP BY c_custkey")
def source_labels(spark, sf_dir):
    placed = sources.longest_root(_paths(spark, sf_dir), _roots(spark, sf_dir))
    return placed.select("c_custkey", c.source_label(RULES, "path", F.col("root")).alias("source"))


@query("""WITH o AS (SELECT DISTINCT lower(n_name) AS k, n_name FROM nation) SELECT n_name AS root FROM nation WHERE n_nationkey % 3 <> 0 AND lower(n_name) NOT IN (SELECT lower(n_name) FROM nation WHERE n_nationkey % 5 = 0)""")
def source_edits(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    lines = nation.select(F.concat(F.lit(" "), "n_name", F.lit("\\")).alias("line"), F.col("n_nationkey").alias("ord")).where("ord % 3 <> 0")
    twice = lines.unionByName(nation.select(F.upper("n_name").alias("line"), (F.col("n_nationkey") + 100).alias("ord")).where("(ord - 100) % 3 <> 0"))
    gone = nation.where("n_nationkey % 5 = 0").select(F.lower("n_name").alias("root"))
    return sources.without_sources(sources.unique_sources(twice), gone).select("root")


_GENERIC = ("files", "parts", "stl")


@query("""WITH p AS (SELECT o_orderkey, r_name AS a, n_name AS b, c_name AS c, o_orderkey % 3 AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
 SELECT o_orderkey, CASE WHEN k = 2 THEN 'order-' || o_orderkey ELSE c END AS display_name, b AS collection, b || CASE WHEN k = 0 THEN '' ELSE ' › Files' END || CASE WHEN k = 2 THEN ' › ' || c ELSE '' END AS breadcrumb FROM p""")
def display_field_parts(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey") % 3
    # root\nation\customer\parts, root\nation\Files\customer\STL and root\nation\files\FILES\customer\order
    tail = F.when(k == 0, F.concat_ws("/", "c_name", F.lit("parts"))).when(k == 1, F.concat_ws("\\", F.lit("Files"), "c_name", F.lit("STL"))).otherwise(F.concat_ws("/", F.lit("Files"), F.lit("FILES"), "c_name", F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))))
    roots = [r["r_name"] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    rows = joined.select("o_orderkey", F.concat_ws("/", "r_name", "n_name", tail).alias("path"))
    return displayed(rows, "path", roots, _GENERIC).drop("path")


# merging -------------------------------------------------------------------
# ids that only one side has: users of even events alone get another name
@query("""WITH e AS (SELECT *, CASE WHEN event_id % 2 = 0 AND user_id % 7 = 0 THEN -user_id - 1 ELSE user_id END AS id FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY id, event_id % 2 ORDER BY event_id DESC) AS k FROM e),
 o AS (SELECT * FROM r WHERE k = 1 AND event_id % 2 = 0), n AS (SELECT *, CASE WHEN id % 3 = 0 THEN NULL ELSE event_type END AS et FROM r WHERE k = 1 AND event_id % 2 = 1)
 SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.et ELSE o.event_type END AS status, o.props AS note FROM o FULL JOIN n ON o.id = n.id""")
def catalog_upsert(spark, sf_dir):
    even, user = F.col("event_id") % 2 == 0, F.col("user_id")
    events = table(spark, sf_dir, "events").select(F.when(even & (user % 7 == 0), -user - 1).otherwise(user).alias("id"), F.col("event_id").alias("ord"), F.col("event_type").alias("status"), F.col("props").alias("note"))
    old = merge.last_write_wins(events.where("ord % 2 = 0")).drop("ord")
    new = merge.last_write_wins(events.where("ord % 2 = 1")).withColumn("status", F.when(F.col("id") % 3 != 0, F.col("status")))
    return merge.upsert(old, new.drop("ord"), ["status"])


@query("SELECT doc_id, source, row_number() OVER (ORDER BY n_chars, doc_id) AS place FROM documents ANTI JOIN labels USING (doc_id)")
def already_done_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.lit("project").alias("type"), F.col("n_chars").alias("size_bytes"), F.col("doc_id").alias("ord"))
    return merge.to_render(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))).select(F.col("id").alias("doc_id"), "source", "place")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN s WHEN s IN ('mesh', 'reused') THEN s ELSE 'existing' END AS status, CASE WHEN l.doc_id IS NOT NULL THEN d.doc_id || '.webp' END AS thumbnail
 FROM (SELECT *, ['mesh', 'pending', 'failed', 'reused'][1 + doc_id % 4] AS s FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def already_done_semi(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("mesh", "pending", "failed", "reused"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), status.alias("thumb_status"), F.lit(None).cast("string").alias("thumbnail"), F.lit("e").alias("thumb_error"))
    done = merge.mark_rendered(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id")))
    return done.select(F.col("id").cast("long").alias("doc_id"), F.col("thumb_status").alias("status"), "thumbnail")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.thumb ELSE s END AS status, CASE WHEN l.doc_id IS NOT NULL AND s <> 'mesh' THEN 'q' || d.doc_id WHEN l.doc_id IS NULL THEN 'old' END AS error,
 CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 3 > 0 THEN d.doc_id % 3 ELSE 9 END::INT AS part_count FROM (SELECT *, 'pending' AS thumb FROM documents) d LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'mesh' ELSE 'failed' END AS s FROM labels) l USING (doc_id)""")
def result_attach(spark, sf_dir):
    none = F.array().cast("array<string>")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("pending").alias("thumb_status"), F.lit("old").alias("thumb_error"), F.lit(None).cast("string").alias("thumbnail"),
                                                    F.lit(9).alias("part_count"), F.lit(0).cast("long").alias("inner_bytes"), none.alias("model_files"), none.alias("formats"))
    status = F.when(F.col("quality") == 1, "mesh").otherwise("failed")
    results = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), status.alias("status"), F.when(status != "mesh", F.concat(F.lit("q"), F.col("doc_id").cast("string"))).otherwise("").alias("detail"),
                                                    (F.col("doc_id") % 3).cast("int").alias("part_count"), F.lit(None).cast("long").alias("inner_bytes"), none.alias("model_files"), none.alias("formats"))
    out = merge.attach_results(docs, results)
    return out.select(F.col("id").cast("long").alias("doc_id"), F.col("thumb_status").alias("status"), F.col("thumb_error").alias("error"), "part_count")


@query("SELECT doc_id FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels) OR source IN ('src1', 'src2', 'src3')")
def prune_guarded(spark, sf_dir):
    path = F.concat_ws("\\", "source", F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), path.alias("path"), "source")
    known = docs.select(F.col("source").alias("root")).distinct().withColumns({"ord": F.lit(0), "reachable": ~F.col("root").isin("src1", "src2", "src3")})
    present = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select("path")
    kept, _ = merge.prune(sources.unreachable(docs.select("id", "path"), known), present)
    return kept.select(F.col("id").alias("doc_id"))


@query("""WITH t AS (SELECT doc_id, md5(text) AS fp, doc_id % 2 = 1 AS present FROM documents), p AS (SELECT fp, min(doc_id) AS new_id FROM t WHERE present GROUP BY fp HAVING count(*) = 1)
 SELECT fp, new_id, doc_id AS old_id, row_number() OVER (PARTITION BY fp ORDER BY doc_id DESC) = 1 AS survives FROM t JOIN p USING (fp) WHERE NOT present""")
def relocate_unique(spark, sf_dir):
    prints = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("fp"), (F.col("doc_id") % 2 == 1).alias("present"), F.col("doc_id").alias("ord"))
    return relocate.moves(prints).select("fp", "new_id", "old_id", "survives")


@query("""WITH t AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS id, md5(text) AS path, CASE WHEN doc_id % 3 = 0 THEN 'x' END AS thumb FROM documents)
 SELECT path, arg_max(id, struct_pack(c := id = substr(sha1(path), 1, 16), t := thumb IS NOT NULL, i := id)) AS id, bool_or(thumb IS NOT NULL) AS pictured FROM t GROUP BY path""")
def path_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("id"), F.lit("project").alias("type"), F.md5("text").alias("path"), F.when(F.col("doc_id") % 3 == 0, "x").alias("thumbnail"), F.lit("mesh").alias("thumb_status"))
    return merge.dedupe_paths(rows).select("path", "id", F.col("thumbnail").isNotNull().alias("pictured"))


# reports -------------------------------------------------------------------
def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("thumb_status"))


_STATUS = "s AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_type ELSE 'pending' END AS status FROM events)"


@query(f"WITH {_STATUS} SELECT status, count(*) AS n, row_number() OVER (ORDER BY status) AS place FROM s GROUP BY status")
def status_histogram(spark, sf_dir):
    return reports.status_summary(_statuses(spark, sf_dir))


@query(f"WITH {_STATUS} SELECT * FROM (SELECT status, event_id, row_number() OVER (PARTITION BY status ORDER BY event_id) AS place FROM s) WHERE place <= 3")
def status_examples(spark, sf_dir):
    out = reports.status_examples(_statuses(spark, sf_dir))
    return out.select("status", F.col("ord").alias("event_id"), F.col("place").cast("long").alias("place"))


def _doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), i.alias("ord"), F.when(i % 4 == 0, "archive").otherwise("project").alias("type"), F.when(i % 3 == 0, "t").alias("thumbnail"), "lang", "source", F.col("n_chars").alias("size_bytes"),
        F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("model_files"), (i % 2).alias("n_disk"), (i % 7).alias("n_cloud"), F.concat_ws("/", "source", "lang", i.cast("string")).alias("path"),
    )


@query("SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 4 <> 0) AS projects, count(*) FILTER (WHERE doc_id % 4 = 0) AS archives, count(*) FILTER (WHERE doc_id % 3 = 0) AS thumbnails_rendered FROM documents")
def header_counts(spark, sf_dir):
    return reports.header_counts(_doc_items(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id AS i, doc_id % 3 <> 0 AS p, doc_id % 5 = 0 AS z FROM documents WHERE doc_id % 4 <> 0)
 SELECT count(*) AS projects, count(*) FILTER (WHERE NOT p) AS with_picture, count(*) FILTER (WHERE p) AS pending, count(*) FILTER (WHERE p AND z) AS no_model_file, count(*) FILTER (WHERE p AND NOT z AND i % 2 > 0) AS hydrated,
 count(*) FILTER (WHERE p AND NOT z AND i % 2 = 0 AND i % 7 > 0) AS cloud, count(*) FILTER (WHERE p AND NOT z AND i % 2 = 0 AND i % 7 = 0) AS missing FROM d""")
def diagnose_counts(spark, sf_dir):
    return reports.diagnose_counts(_doc_items(spark, sf_dir))


@query("SELECT 'lang' AS facet, lang AS value FROM documents GROUP BY ALL UNION ALL SELECT 'source', source FROM documents GROUP BY ALL")
def facets(spark, sf_dir):
    return reports.facets(_doc_items(spark, sf_dir), ["lang", "source"])


def _gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_name").alias("n"), F.col("p_brand").alias("c"), F.lit("").alias("f"), F.col("p_type").alias("s"), F.concat(F.lit("k"), (F.col("p_size") % 5).cast("string")).alias("col"), (F.col("p_size") % 2).alias("p"),
                       F.when(F.col("p_partkey") % 3 == 0, "t").otherwise("").alias("t"), F.lit("failed").alias("ts"), F.concat_ws("/", "p_brand", "p_name").alias("path"), F.col("p_partkey").alias("ord"))


_ROWS = "r AS (SELECT p_partkey AS ord, p_name AS n, p_brand AS c, 'k' || p_size % 5 AS col, p_size % 2 AS p, p_partkey % 3 = 0 AS pic, p_brand || '/' || p_name AS path FROM part)"


@query(f"WITH {_ROWS} SELECT ord, n, c FROM r WHERE p = 1 AND NOT pic AND (contains(lower(n), 'ring') OR contains(lower(path), 'ring') OR contains(lower(col), 'ring'))")
def gallery_filter(spark, sf_dir):
    from .views import gallery_query

    return gallery_query(_gallery(spark, sf_dir), packed=True, picture=False, text="RING", whole=True).select("ord", "n", "c")


@query(f"""WITH {_ROWS}, q AS (SELECT ord, n, col FROM r ORDER BY col, n, ord LIMIT 120 OFFSET 120)
 SELECT ord, n, col, coalesce(col IS DISTINCT FROM lag(col) OVER (ORDER BY col, n, ord), true) AS header FROM q""")
def gallery_page(spark, sf_dir):
    from .views import gallery_query

    return gallery_query(_gallery(spark, sf_dir), group_by="col", page=1).select("ord", "n", "col", "header")


@query(f"WITH {_ROWS} SELECT ord, c, coalesce(c IS DISTINCT FROM lag(c) OVER (ORDER BY c, n, ord), true) AS header FROM r")
def group_headers(spark, sf_dir):
    from .views import gallery_query

    return gallery_query(_gallery(spark, sf_dir), group_by="c", whole=True).select("ord", "c", "header")


_STEP, _N = 7, 8


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS place, count(*) OVER () AS n FROM documents)
 SELECT doc_id, place FROM r WHERE (place - 1) % greatest(1, n // {_STEP}) = 0 AND place <= greatest(1, n // {_STEP}) * {_STEP - 1} + 1""")
def stride_sample(spark, sf_dir):
    out = reports.stride_sample(_doc_items(spark, sf_dir), _STEP, ["size_bytes", "ord"])
    return out.select(F.col("id").alias("doc_id"), F.col("place").cast("long").alias("place"))


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)
 SELECT doc_id, place FROM r WHERE place IN (SELECT round_even(i * (n - 1) / {_N - 1}.0, 0)::BIGINT FROM range({_N}) t(i))""")
def quantile_sample(spark, sf_dir):
    out = reports.quantile_sample(_doc_items(spark, sf_dir), _N, [F.desc("size_bytes"), F.col("ord")])
    return out.select(F.col("id").alias("doc_id"), F.col("place").cast("long").alias("place"))


_TIMED = """i AS (SELECT o_custkey % 50 AS run, o_orderkey, (o_orderkey % 37 + 1)::DOUBLE AS mb, (2 + o_custkey % 3 + o_orderkey % 37 // 4)::DOUBLE AS took FROM orders),
 t AS (SELECT *, row_number() OVER w::DOUBLE AS n, sum(mb) OVER w AS b, sum(took) OVER w AS t, count(*) OVER (PARTITION BY run)::DOUBLE AS na, sum(mb) OVER (PARTITION BY run) AS ba
  FROM i WINDOW w AS (PARTITION BY run ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 u AS (SELECT *, sum(n * n) OVER w AS nn, sum(n * b) OVER w AS nb, sum(b * b) OVER w AS bb, sum(n * t) OVER w AS nt, sum(b * t) OVER w AS bt
  FROM t WINDOW w AS (PARTITION BY run ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 d AS (SELECT *, nn * bb - nb * nb AS det FROM u), f AS (SELECT *, (bb * nt - nb * bt) / nullif(det, 0) AS a, (nn * bt - nb * nt) / nullif(det, 0) AS c FROM d),
 g AS (SELECT *, det > 0 AND a >= 0 AND c >= 0 AND (a > 0 OR c > 0) AS good FROM f),
 e AS (SELECT *, CASE WHEN n >= na THEN 0.0 WHEN n >= 8 AND t >= 5 THEN greatest(0.0, CASE WHEN good THEN a * (na - n) + c * (ba - b) ELSE (na - n) * t / n END) END AS fresh FROM g)"""


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time depends on the item's kind and its size: the fit has to find both."""
    o = F.col("o_orderkey") % 37
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("run"), "o_orderkey", ((o + 1) * 1_000_000).alias("size"), (2 + F.col("o_custkey") % 3 + F.floor(o / 4)).cast("double").alias("took"))
    elapsed = F.sum("took").over(Window.partitionBy("run").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    return reports.running_fit(orders.withColumn("elapsed", elapsed), "o_orderkey", "size", "elapsed")


@query(f"WITH {_TIMED} SELECT run, o_orderkey, CASE WHEN det > 0 THEN round(a, 6) END AS a, CASE WHEN det > 0 THEN round(c, 6) END AS c, round(fresh, 4) AS fresh FROM e")
def running_fit(spark, sf_dir):
    sure = F.col("det") > 0
    return _timed(spark, sf_dir).select("run", "o_orderkey", F.when(sure, F.round("a", 6)).alias("a"), F.when(sure, F.round("c", 6)).alias("c"), F.round("fresh", 4).alias("fresh"))


@query(f"WITH {_TIMED} SELECT run, round(list_reduce(list(fresh ORDER BY o_orderkey), lambda x, y: 0.75 * x + 0.25 * y), 3) AS eta FROM e WHERE fresh IS NOT NULL AND n < na GROUP BY run")
def smoothed_eta(spark, sf_dir):
    """The estimate before the last item: the last one's is always 0."""
    return reports.smoothed(_timed(spark, sf_dir).where("n < n_all"), "o_orderkey").select("run", F.round("eta", 3).alias("eta"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN md5(source || doc_id % 13) END AS digest FROM documents)
 SELECT doc_id, digest IS NULL OR row_number() OVER (PARTITION BY digest ORDER BY doc_id) < 3 AS accepted FROM d""")
def repeated_pictures(spark, sf_dir):
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(i.alias("id"), i.alias("ord"), F.when(i % 9 != 0, F.md5(F.concat("source", (i % 13).cast("string")))).alias("digest"))
    return reports.repeated_pictures(docs).select(F.col("id").alias("doc_id"), "accepted")


_BOXES = """p AS (SELECT l_orderkey AS id, l_linenumber AS part, (l_linenumber * (l_orderkey % 4))::DOUBLE AS x0, l_linenumber * (l_orderkey % 4) + 1.0 + l_linenumber % 2 AS x1, 0.0 AS y0, 1.0 AS y1, 0.0 AS z0, 2.0 AS z1 FROM lineitem)"""


@query(f"""WITH {_BOXES}, d AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + (z1 - z0) * (z1 - z0)) AS d FROM p),
 g AS (SELECT id, count(*) AS n, max(d) AS most, sqrt((max(x1) - min(x0)) ** 2 + 1 + 4) AS whole, arg_min(part, struct_pack(k := -d, p := part)) AS largest FROM d GROUP BY id)
 SELECT id, n, round(whole / most, 9) AS spread, n >= 3 AND whole / most > 2.2 AS apart, largest FROM g""")
def laid_out_kits(spark, sf_dir):
    n, k = F.col("l_linenumber"), F.col("l_orderkey") % 4
    x0 = (n * k).cast("double")
    one = {"y0": 0.0, "y1": 1.0, "z0": 0.0, "z1": 2.0}
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("part"), x0.alias("x0"), (x0 + 1.0 + n % 2).alias("x1"), *[F.lit(v).alias(c) for c, v in one.items()])
    return reports.laid_out(parts, 2.2).withColumn("spread", F.round("spread", 9))


# views ---------------------------------------------------------------------
_ITEMS = f"""w AS (SELECT l_orderkey AS ord, sum(CAST(l_extendedprice * 1000 AS BIGINT))::BIGINT AS size_bytes, list_sort(list(lower(p_name) || '.stl')) AS files, count(*) AS n,
 min(struct_pack(k := -CAST(l_extendedprice * 1000 AS BIGINT), n := lower(p_name) || '.stl')).n AS prim FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
 q AS (SELECT *, r_name || '/' || n_name || '/order-' || ord AS path, 'order-' || ord AS name FROM w JOIN orders ON o_orderkey = ord JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 h AS (SELECT *, substr(sha1(lower(replace(path, '/', chr(92)))), 1, 16) AS id, lower(path || ' ' || name) AS hay, array_to_string(list_sort(list_distinct(list_transform(files, lambda f: replace(f, '.stl', '')))), ' ') AS inner_hay FROM q),
 {_classes('h')},
 z AS (SELECT *, list_concat(list_concat(CASE WHEN faction IS NULL THEN [] ELSE ['faction:' || faction] END, types), ['format:stl', 'source:' || r_name, 'packed:false']) AS tags FROM b)"""


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Orders as scanned items, and the scan roots."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    files = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    listed = files.select(F.concat_ws("/", "r_name", "n_name", F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))).alias("dir"), F.lower(F.concat("p_name", F.lit(".stl"))).alias("name"), (F.col("l_extendedprice") * 1000).cast("decimal(20,0)").cast("long").alias("size"))
    names = [r["r_name"] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    out = rollup.items(listed, RULES, spark.createDataFrame([(n, k) for k, n in enumerate(names)], "root string, ord int"))
    key = F.element_at(F.split("path", "order-"), -1).cast("long")
    return out.withColumns({"ord": key, "inner_bytes": F.lit(None).cast("long"), "thumb_error": F.lit(None).cast("string")}), names


@query(f"""WITH {_ITEMS} SELECT id, 'project' AS type, name, name AS display_name, n_name AS collection, n_name AS breadcrumb, prim AS primary_file, array_to_string(files[1:25], '|') AS all_files,
 substr(md5(array_to_string(files, '|') || '::' || n || '::' || size_bytes), 1, 16) AS fingerprint, category, coalesce(faction, '') AS faction, r_name AS source, 'False' AS packed, n::VARCHAR AS part_count, 'stl' AS formats,
 size_bytes::VARCHAR AS size_bytes, (((size_bytes + 5000) // 10000) / 100.0)::VARCHAR AS size_mb, path, '' AS thumbnail, 'pending' AS thumb_status, '' AS thumb_error, array_to_string(tags, '|') AS tags FROM z""")
def catalog_csv(spark, sf_dir):
    from .views import csv_rows

    return csv_rows(*_items(spark, sf_dir), RULES)


@query(f"""WITH {_ITEMS} SELECT name AS n, category AS c, coalesce(faction, '') AS f, r_name AS s, n_name AS col, n_name AS bc, 0 AS p, n::INT AS pc, ((size_bytes + 50000) // 100000) / 10.0 AS mb, '' AS t, path, 'pending' AS ts, '' AS te, prim AS pf,
 n::INT AS nf, array_to_string(list_filter(tags, lambda t: starts_with(t, 'type:')), '|') AS tags, ord FROM z""")
def gallery_fields(spark, sf_dir):
    from .views import gallery_rows

    return gallery_rows(*_items(spark, sf_dir), RULES).withColumn("tags", F.array_join("tags", "|"))


@query(f"""WITH {_ITEMS} SELECT id, name, array_to_string(list_concat(tags, ['collection:' || n_name]), '|') AS tags, category || ' | source=' || r_name || ' | collection=' || n_name || ' | ' || n || ' parts | ' || path AS notes,
 'file:///' || replace(path, ' ', '%20') AS url FROM z""")
def tracker_models(spark, sf_dir):
    from .views import tracker_import

    models, _ = tracker_import(*_items(spark, sf_dir), RULES)
    return models.select("id", "name", F.array_join("tags", "|").alias("tags"), "notes", F.col("sources")[0]["url"].alias("url"))


@query(f"""WITH {_ITEMS}, f AS (SELECT *, substr(md5(array_to_string(files, '|') || '::' || n || '::' || size_bytes), 1, 16) AS fp, substr(md5(array_to_string(files, '|') || '::' || n), 1, 16) AS loose FROM z),
 x AS (SELECT fp FROM f GROUP BY fp HAVING count(*) >= 2),
 g AS (SELECT 'exact' AS match, fp AS key, count(*) AS copies, sum(size_bytes) - arg_min(size_bytes, struct_pack(p := lower(path), o := ord)) AS waste, min(ord) AS first FROM f GROUP BY fp HAVING count(*) >= 2
  UNION ALL SELECT 'same names', loose, count(*), sum(size_bytes) - arg_min(size_bytes, struct_pack(p := lower(path), o := ord)), min(ord) FROM f GROUP BY loose HAVING count(*) >= 2 AND NOT bool_and(fp IN (SELECT fp FROM x))),
 r AS (SELECT *, CASE match WHEN 'exact' THEN 'exact-' ELSE 'near-' END || row_number() OVER (PARTITION BY match ORDER BY waste DESC, first) AS grp FROM g)
 SELECT match, grp AS "group", name, n_name AS collection, copies, ((size_bytes + 50000) // 100000) / 10.0 AS size_mb, n::INT AS parts, path FROM r JOIN f ON key = CASE match WHEN 'exact' THEN fp ELSE loose END""")
def duplicates_csv(spark, sf_dir):
    from .views import duplicate_rows

    return duplicate_rows(*_items(spark, sf_dir), RULES)


@query(f"""WITH {_ITEMS} SELECT ord, prim AS listed, CASE ord % 3 WHEN 0 THEN prim WHEN 1 THEN files[1] ELSE name END AS file FROM z""")
def primary_files(spark, sf_dir):
    items, _ = _items(spark, sf_dir)
    k = F.col("ord") % 3
    bare = items.withColumns({"listed": F.col("primary_file"), "primary_file": F.when(k == 0, F.col("primary_file")).when(k == 1, ""), "model_files": F.when(k != 2, F.col("model_files")).otherwise(F.array().cast("array<string>"))})
    return bare.select("ord", "listed", s.primary_file().alias("file"))


@query(f"WITH {_ITEMS} SELECT ord FROM z WHERE ord % 4 <> 1")
def ignored_paths(spark, sf_dir):
    from .catalog import drop_ignored

    inner = F.when(F.col("ord") % 4 == 1, F.lit("/ Old Stuff /x")).when(F.col("ord") % 4 == 2, F.lit("/old stuff x")).otherwise("")
    items = _items(spark, sf_dir)[0].withColumn("path", F.concat("path", inner))
    rules = c.load_rules(spark, '{"ignore_folders": ["tmp"]}', '{"ignore_folders": [" OLD stuff ", 5]}')
    return drop_ignored(items, rules.ignored_dirs).select("ord")


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)gasket') THEN 'Seals' WHEN regexp_matches(p_name, '(?i)widget') THEN 'Widgets' ELSE 'Rest' END AS category FROM part""")
def rules_overlay(spark, sf_dir):
    """A local rules file replaces the keys it has, and a broken pattern is passed over."""
    rules = c.load_rules(spark, '{"categories": {"Gears": "gear"}, "default_category": "Rest", "factions": {}}', '{"categories": {"_note": "x", "Seals": "gasket", "Bad": "(", "Widgets": "widget"}}')
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", c.classified(rules, F.lit("none"), F.col("p_name"), None)["category"].alias("category"))


# files ---------------------------------------------------------------------
def _tree(spark: SparkSession) -> str:
    """A small folder tree with everything that a listing has to get right, below
    the folder that executors share."""
    root = Path(fresh_path(spark, "tree").removeprefix("file://"))
    for name, size in (("Kit A/body.stl", 184), ("Kit A/arm.STL", 284), ("Kit A/preview.png", 9), ("Kit A/notes.txt", 5), ("Kit A/._junk.stl", 3), ("Kit B/_under.stl", 20), (".hid/h.stl", 21), ("Kit B/100%.stl", 22), ("__MACOSX/x.stl", 1), ("top.obj", 7)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"0" * size)
    for pack, entries in (
        ("pack", (("a.stl", b"0" * 284), ("in/b.stl", b"0" * 384), ("c.obj", b"0" * 10), ("notes.txt", b"0000"), ("__MACOSX/._a.stl", b"0000"), ("render.png", b"no image"))),
        ("shown", (("x.stl", b"0" * 9), ("big.png", b"\x89PNG" + b"0" * 90), ("in/cover.png", b"\x89PNG" + b"0" * 9), ("thumb.jpg", b"broken" * 9))),
    ):
        with zipfile.ZipFile(root / f"Kit B/{pack}.zip", "w") as archive:
            for name, data in entries:
                archive.writestr(name, data)
    (root / "Kit B/broken.zip").write_bytes(b"no zip")
    (root / "Kit B/old.rar").write_bytes(b"Rar!")
    return str(root)


def _relative(column: str, root: str):
    return F.replace(column, F.lit(root), F.lit("~")).alias(column)


@query("""SELECT * FROM (VALUES ('~', 'top.obj', 7), ('~/.hid', 'h.stl', 21), ('~/Kit A', 'arm.STL', 284), ('~/Kit A', 'body.stl', 184), ('~/Kit A', 'preview.png', 9), ('~/Kit B', '100%.stl', 22), ('~/Kit B', '_under.stl', 20), ('~/Kit B', 'broken.zip', 6),
 ('~/Kit B', 'old.rar', 4)) t(dir, name, size)""")
def scan_tree(spark, sf_dir):
    from ..sources import tree

    root = _tree(spark)
    rows = tree.scan(spark, [root]).where("not unreadable and not is_symlink and name not in ('pack.zip', 'shown.zip')")
    return rows.select(_relative("dir", root), "name", F.col("size").cast("int").alias("size"))


@query("""SELECT * FROM (VALUES ('~/.hid', 'h.stl'), ('~/Kit A', 'arm.STL'), ('~/Kit A', '._junk.stl'), ('~/__MACOSX', 'x.stl'), ('~/Kit A', 'body.stl')) t(dir, name)""")
def scan_options(spark, sf_dir):
    """Other folders, prefixes and extensions than the defaults."""
    from ..sources import tree

    root = _tree(spark)
    rows = tree.scan(spark, [root], ignore_dirs="kit b, none", ignore_prefixes="~", extensions="stl")
    return rows.select(_relative("dir", root), "name")


@query("""SELECT * FROM (VALUES ('~/Kit B/pack.zip', 'packed', NULL, 3, 678, 'b.stl|a.stl|c.obj', 'obj|stl|zip', NULL), ('~/Kit B/shown.zip', 'reused', 'picture in the archive: cover.png', 1, 9, 'x.stl', 'stl|zip', 'cover.png'),
 ('~/Kit B/broken.zip', 'packed', 'not a readable zip (BadZipFile)', NULL, NULL, NULL, NULL, NULL), ('~/Kit B/old.rar', 'unsupported', '.rar is known by name only', NULL, NULL, NULL, NULL, NULL)) t(path, status, detail, part_count, inner_bytes, model_files, formats, preview)""")
def zip_rollup(spark, sf_dir):
    from ..sources import archives, tree

    root = _tree(spark)
    packed = tree.scan(spark, [root], extensions="zip,rar").select(F.concat_ws("/", "dir", "name").alias("path"))
    found = archives.contents(packed)
    return found.select(_relative("path", root), "status", "detail", "part_count", F.col("inner_bytes").cast("int").alias("inner_bytes"), F.array_join("model_files", "|").alias("model_files"), F.array_join("formats", "|").alias("formats"), "preview")


@query("""SELECT * FROM (VALUES ('~', 'project', 1, 7, 'top.obj', 'obj', 'pending'), ('~/.hid', 'project', 1, 21, 'h.stl', 'stl', 'pending'), ('~/Kit A', 'project', 2, 468, 'arm.STL', 'STL|stl', 'pending'), ('~/Kit B', 'project', 2, 42, '100%.stl', 'stl', 'pending'),
 ('~/Kit B/broken.zip', 'archive', NULL, 6, NULL, 'zip', 'packed'), ('~/Kit B/old.rar', 'archive', NULL, 4, NULL, 'rar', 'packed')) t(path, type, part_count, size_bytes, primary_file, formats, thumb_status)""")
def scanned_items(spark, sf_dir):
    from ..sources import tree

    root = _tree(spark)
    roots = spark.createDataFrame([(root, 0)], "root string, ord int")
    out = rollup.items(tree.scan(spark, [root]), RULES, roots).where("name not in ('pack', 'shown', 'pack.zip', 'shown.zip')")
    return out.select(_relative("path", root), "type", "part_count", F.col("size_bytes").cast("int").alias("size_bytes"), "primary_file", F.array_join("formats", "|").alias("formats"), "thumb_status")


@query("SELECT doc_id, CASE WHEN n_chars > 2000 THEN format('{:,}', (n_chars * 1000 + 500000) // 1000000) || ' MB, limit 2 MB' END AS detail, n_chars * 1000 > 2000000 AS too_big FROM documents")
def size_deferral(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 1000).alias("size_bytes"))
    return hydration.deferred(docs, 2).select("doc_id", F.col("too_big_detail").alias("detail"), "too_big")


@query("""WITH k AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, o_orderkey % 7 AS m FROM orders), d AS (SELECT id, k, list_filter([0, 1, 2], lambda j: k <> 0 AND (m + j) % 3 = 0) AS disk, list_filter([0, 1, 2], lambda j: k <> 0 AND (m + j) % 3 = 1 AND k <> 4) AS cloud FROM k)
 SELECT id, CASE WHEN k = 0 THEN 'no_model_file' WHEN k >= 3 AND len(cloud) > 0 THEN 'cloud_only' WHEN k >= 3 THEN 'missing' WHEN len(disk) > 0 THEN NULL END AS skip FROM d""")
def hydration_status(spark, sf_dir):
    i = F.col("o_orderkey")
    files = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda j: F.concat(F.lit("p"), j.cast("string")))
    items = table(spark, sf_dir, "orders").select(i.alias("id"), F.concat(F.lit("o"), i.cast("string")).alias("path"), F.lit("project").alias("type"), F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(files).alias("model_files"))
    parts = items.select("id", "path", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"))
    where = (F.col("id") % 7 + F.col("j")) % 3
    state = F.when((where == 0) & (F.col("id") % 5 < 3), True).when((where == 1) & (F.col("id") % 5 != 4), False)
    probe = parts.select(F.concat("path", F.lit("/p"), F.col("j").cast("string")).alias("path"), state.alias("hydrated")).where("hydrated is not null")
    return hydration.skip_status(items, probe).select("id", "skip")


_QUEUE = """k AS (SELECT o_orderkey AS id, 'o' || o_orderkey AS path, o_orderkey % 5 AS k, o_orderkey % 7 AS m, CAST(round(o_totalprice * 100) AS BIGINT) AS size FROM orders WHERE o_orderkey % 10 <> 3),
 d AS (SELECT *, list_filter([0, 1, 2], lambda j: k IN (1, 2) AND (m + j) % 3 = 0) AS disk, list_filter([0, 1, 2], lambda j: k IN (1, 2, 3) AND (m + j) % 3 = 1) AS cloud FROM k),
 e AS (SELECT *, 3 - len(disk) - len(cloud) AS gone, list_filter(disk, lambda j: j <> 1) AS readable, CASE WHEN k = 0 THEN 'no_model_file' WHEN len(disk) > 0 THEN NULL WHEN len(cloud) > 0 THEN 'cloud_only' ELSE 'missing' END AS skip FROM d),
 f AS (SELECT *, CASE WHEN skip IS NULL AND size > 20000000 THEN 'too_big' WHEN id % 8 = 0 THEN 'reused' WHEN skip IS NOT NULL THEN skip WHEN len(readable) = 0 THEN 'unsupported' ELSE 'mesh' END AS status, row_number() OVER (ORDER BY size, id) AS place FROM e)"""


def _rendered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items of three parts each, and the state of their files."""
    i = F.col("o_orderkey")
    names = F.array(F.lit("p0.stl"), F.lit("p1.step"), F.lit("p2.obj"))
    items = table(spark, sf_dir, "orders").select(
        i.alias("id"), i.alias("ord"), F.concat(F.lit("o"), i.cast("string")).alias("path"), F.lit("project").alias("type"), F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(names).alias("model_files"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("size_bytes"), (i % 4 == 0).alias("has_shipped_preview"), F.concat(F.lit("o"), i.cast("string"), F.lit("/show.png")).alias("preview_file"),
    )
    parts = items.where("id % 5 <> 0").select("id", F.posexplode("model_files").alias("j", "file"), "path")
    where, k = (F.col("id") % 7 + F.col("j")) % 3, F.col("id") % 5
    state = F.when((where == 0) & k.isin(1, 2), True).when((where == 1) & k.isin(1, 2, 3), False)
    probe = parts.select(F.concat_ws("/", "path", "file").alias("path"), state.alias("hydrated")).where("hydrated is not null")
    return items, probe.unionByName(items.where("id % 8 = 0").select(F.col("preview_file").alias("path"), F.lit(True).alias("hydrated")))


@query(f"""WITH {_QUEUE} SELECT id, CASE WHEN status IN ('reused', 'mesh') THEN place END AS place, status, CASE status WHEN 'too_big' THEN format('{{:,}}', (size + 500000) // 1000000) || ' MB, limit 20 MB' WHEN 'unsupported' THEN 'no reader for .step'
 WHEN 'mesh' THEN 'drawn from ' || len(readable) || ' of ' || (len(readable) + len(cloud) + gone) || ' part(s)' WHEN 'cloud_only' THEN len(cloud) || ' part(s) not downloaded' WHEN 'missing' THEN gone || ' part(s) gone from ' || path END AS detail FROM f""")
def render_queue(spark, sf_dir):
    items, probe = _rendered(spark, sf_dir)
    done = items.where("id % 10 = 3").select("id")
    return hydration.queue(items, probe, done, 20, engines=("mesh",)).select("id", "place", "status", "detail")


@query(f"WITH {_QUEUE.replace('WHERE o_orderkey % 10 <> 3', '')} SELECT id, array_to_string(list_transform(disk, lambda j: path || '/p' || j || ['.stl', '.step', '.obj'][j + 1]), '|') AS on_disk, len(cloud) AS n_cloud, CASE WHEN k = 0 THEN 0 ELSE gone END AS n_gone, id % 8 = 0 AS preview_ok, len(disk) > 0 AS model_ok FROM f")
def hydrated_parts(spark, sf_dir):
    return hydration.renderable_now(*_rendered(spark, sf_dir)).select("id", F.array_join("on_disk", "|").alias("on_disk"), "n_cloud", "n_gone", "preview_ok", "model_ok")


@query("""SELECT * FROM (VALUES ('h.stl', 'project', '.hid', '.hid', '1', 'stl', '0.0', 'pending', ''), ('arm.STL', 'project', 'Kit A', 'Kit A', '2', 'STL|stl', '0.0', 'pending', ''), ('100%.stl', 'project', 'Kit B', 'Kit B', '2', 'stl', '0.0', 'pending', ''),
 ('b.stl', 'archive', 'pack.zip', 'Kit B', '3', 'obj|stl|zip', '0.0', 'packed', ''), ('x.stl', 'archive', 'shown.zip', 'Kit B', '1', 'stl|zip', '0.0', 'reused', 'picture in the archive: cover.png'),
 ('broken.zip', 'archive', 'broken.zip', 'Kit B', '', 'zip', '0.0', 'packed', 'not a readable zip (BadZipFile)'), ('old.rar', 'archive', 'old.rar', 'Kit B', '', 'rar', '0.0', 'unsupported', '.rar is known by name only'))
 t(primary_file, type, display_name, collection, part_count, formats, size_mb, thumb_status, thumb_error)""")
def catalog_cycle(spark, sf_dir):
    """Scan, look inside archives, and list the catalog's CSV rows."""
    from .catalog import Catalog
    from .views import csv_rows

    root = _tree(spark)
    catalog = Catalog(spark, Path(fresh_path(spark, "catalog").removeprefix("file://")), RULES)
    catalog.scan([root])
    catalog.look_inside()
    rows = csv_rows(catalog.items(), catalog.sources(), RULES).where(F.col("path") != root)
    return rows.select("primary_file", "type", "display_name", "collection", "part_count", "formats", "size_mb", "thumb_status", "thumb_error")
