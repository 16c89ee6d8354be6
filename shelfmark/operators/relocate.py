"""Moved items: a missing path and one present path with the same fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fingerprint, norm_path, stable_id


def moves(prints: DataFrame) -> DataFrame:
    """From ``prints`` (id, fp, present, ord): fp, new_id, old_id, old_ord of
    every move. A print must be present once; of several missing rows all move
    there in turn, and ``survives`` marks the last, which stays."""
    rows = prints.where("fp is not null")
    target = rows.where("present").groupBy("fp").agg(F.count("*").alias("n"), F.first("id").alias("new_id")).where("n = 1").drop("n")
    found = rows.where("not present").select("fp", F.col("id").alias("old_id"), F.col("ord").alias("old_ord")).join(target, "fp")
    last = F.row_number().over(Window.partitionBy("fp").orderBy(F.desc("old_ord"))) == 1
    return found.withColumn("survives", last)


def relocate(items: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items after all moves, the moves). The surviving row keeps its own
    fields but for path, id, files and preview, and comes last in the order."""
    here = present.select(norm_path("path").alias("_p")).distinct().withColumn("_here", F.lit(True))
    marked = items.join(here, norm_path("path") == F.col("_p"), "left").withColumn("present", F.coalesce("_here", F.lit(False)))
    prints = marked.where("type = 'project'").select("id", "ord", "present", fingerprint("model_files", "size_bytes").alias("fp"))
    found = moves(prints)
    new = items.select(F.col("id").alias("new_id"), *[F.col(c).alias(f"_n_{c}") for c in ("path", "model_files", "preview_file", "primary_file")])
    plan = found.where("survives").join(new, "new_id")
    touched = found.select(F.col("old_id").alias("id")).unionByName(found.select(F.col("new_id").alias("id"))).distinct()
    stay = items.join(touched, "id", "left_anti")
    top = items.agg(F.max("ord").alias("_top"))
    old = items.join(plan.drop("fp"), items["id"] == plan["old_id"]).crossJoin(top)  # one row
    new_id = stable_id("_n_path")
    sets = {
        "path": F.col("_n_path"), "model_files": F.col("_n_model_files"), "preview_file": F.col("_n_preview_file"), "primary_file": F.coalesce(F.nullif("_n_primary_file", F.lit("")), F.col("primary_file")),
        "thumb_status": F.coalesce("thumb_status", F.lit("pending")), "thumbnail": F.when(F.col("thumbnail").isNotNull(), F.concat(new_id, F.lit(".webp"))), "id": new_id, "ord": F.col("_top") + 1 + F.col("old_ord"),
    }
    moved = old.withColumns(sets).select(items.columns)
    thumbs = found.select("old_id", "new_id", "survives")
    return stay.unionByName(moved), thumbs
