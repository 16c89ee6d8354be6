"""Keyed merging: upsert, duplicate ids and paths, results of rendering, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import norm_path, stable_id
from ..schema import OK_STATUS
from .numbering import numbered


def last_write_wins(rows: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """The row of each ``key`` with the largest ``order``."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_k", place).where("_k = 1").drop("_k")


def upsert(old: DataFrame, new: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """``old`` with ``columns`` overwritten, null by null, from rows of ``new``
    with the same ``key``; rows of ``new`` alone are added, other rows stay."""
    n = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_n_{c}") for c in columns], *([F.col("ord").alias("_n_ord")] if "ord" in new.columns and "ord" in old.columns else []))
    joined = old.join(n, old[key] == n["_key"], "full")
    matched = F.col("_key").isNotNull()
    out = []
    for c in old.columns:
        if c == key:
            out.append(F.coalesce(old[key], F.col("_key")).alias(key))
        elif c in columns:
            out.append(F.when(matched, F.col(f"_n_{c}")).otherwise(old[c]).alias(c))
        elif c == "ord" and "_n_ord" in n.columns:
            out.append(F.coalesce(old[c], F.col("_n_ord")).alias(c))
        else:
            out.append(old[c])
    return joined.select(*out)


def keep_known_contents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scan records of archives with the contents that an earlier look inside
    found, which a scan by name alone can't see (a deliberate deviation)."""
    known = old.where("type = 'archive' and part_count is not null").select(F.col("id").alias("_id"), F.col("part_count").alias("_pc"), F.col("formats").alias("_f"), F.col("model_files").alias("_m"))
    joined = new.join(known, new["id"] == known["_id"], "left")
    have = F.col("_id").isNotNull() & (F.col("type") == "archive")
    return joined.withColumns({"part_count": F.when(have, F.col("_pc")).otherwise(F.col("part_count")), "formats": F.when(have, F.col("_f")).otherwise(F.col("formats")),
                               "model_files": F.when(have, F.col("_m")).otherwise(F.col("model_files"))}).drop("_id", "_pc", "_f", "_m")


def dedupe_paths(items: DataFrame) -> DataFrame:
    """One project for each normalised path: the row whose id is its path's, else
    the last by id that has a thumbnail, else the last by id. The thumbnail of
    the path's last row that has one is carried over. Other rows stay."""
    rows = items.withColumn("_p", F.when(F.col("type") == "project", F.nullif(norm_path("path"), F.lit(""))))
    alone = rows.where("_p is null").drop("_p")
    own = Window.partitionBy("_p")
    rank = F.row_number().over(own.orderBy(F.desc(F.col("id") == stable_id("path")), F.desc(F.col("thumbnail").isNotNull()), F.desc("id")))
    carried = F.max(F.when(F.col("thumbnail").isNotNull(), F.struct("id", F.coalesce("thumb_status", F.lit("existing")).alias("s")))).over(own)
    kept = rows.where("_p is not null").withColumns({"_k": rank, "_c": carried}).where("_k = 1")
    take = F.col("thumbnail").isNull() & F.col("_c").isNotNull()
    kept = kept.withColumns({"thumb_status": F.when(take, F.col("_c.s")).otherwise(F.col("thumb_status")), "thumbnail": F.when(take, F.concat("id", F.lit(".webp"))).otherwise(F.col("thumbnail"))})
    return kept.drop("_k", "_c", "_p").unionByName(alone)


def attach_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """``items`` with outcomes (id, status, detail, part_count, inner_bytes,
    model_files, formats): status always, the error set or cleared, contents
    where something was learned."""
    r = results.select(F.col("id").alias("_id"), "status", "detail", *[F.col(c).alias(f"_r_{c}") for c in ("part_count", "inner_bytes", "model_files", "formats")])
    joined = items.join(r, items["id"] == r["_id"], "left")
    done = F.col("_id").isNotNull()
    sets = {"thumb_status": F.when(done, F.col("status")).otherwise(F.col("thumb_status")), "thumb_error": F.when(done, F.nullif("detail", F.lit(""))).otherwise(F.col("thumb_error")),
            "thumbnail": F.when(done & F.col("status").isin(*OK_STATUS), F.concat("id", F.lit(".webp"))).otherwise(F.col("thumbnail"))}
    for c in ("part_count", "inner_bytes"):
        sets[c] = F.coalesce(F.nullif(F.col(f"_r_{c}"), F.lit(0)), F.col(c))
    for c in ("model_files", "formats"):
        sets[c] = F.when(F.size(f"_r_{c}") > 0, F.col(f"_r_{c}")).otherwise(F.col(c))
    return joined.withColumns(sets).select(items.columns)


def mark_rendered(items: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """``items`` whose id is in ``thumbnails``: the picture is set, the error
    cleared, and a status that isn't a success becomes ``existing``."""
    have = thumbnails.select(F.col("id").alias("_id")).distinct()
    joined = items.join(have, items["id"] == have["_id"], "left")
    done = F.col("_id").isNotNull()
    status = F.when(done & ~F.coalesce(F.col("thumb_status").isin(*OK_STATUS), F.lit(False)), F.lit("existing")).otherwise(F.col("thumb_status"))
    return joined.withColumns({"thumb_status": status, "thumbnail": F.when(done, F.concat("id", F.lit(".webp"))).otherwise(F.col("thumbnail")), "thumb_error": F.when(~done, F.col("thumb_error"))}).select(items.columns)


def to_render(items: DataFrame, thumbnails: DataFrame, force: bool = False) -> DataFrame:
    """Renderable items without a picture yet, with their place: smallest first."""
    rows = items.where(F.col("type").isin("project", "archive"))
    if not force:
        rows = rows.join(thumbnails.select("id").distinct(), "id", "left_anti")
    return numbered(rows, [F.coalesce("size_bytes", F.lit(0)), F.col("ord")])


def prune(items: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, gone): items whose path isn't in ``present`` go, but for those
    flagged ``unreachable``."""
    here = present.select(norm_path("path").alias("_p")).distinct()
    absent = items.join(here, norm_path("path") == F.col("_p"), "left_anti")
    gone = absent.where("not unreachable")
    return items.join(gone.select("id"), "id", "left_anti"), gone
