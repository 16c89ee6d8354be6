"""Files of a folder rolled up into project and archive items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions.classify import Rules, classified, item_tags, source_label
from ..schema import ARCHIVE, IMAGE, MODEL, PREVIEW_HINT
from .sources import longest_root


def kind(name: Column | str) -> Column:
    ext = s.extension(name)
    return F.when(ext.isin(*MODEL), "model").when(ext.isin(*IMAGE), "image").when(ext.isin(*ARCHIVE), "archive")


def projects(files: DataFrame) -> DataFrame:
    """One row for each ``dir`` of ``files`` (dir, name, size) that holds a model
    file. Equal sizes go by name, the smaller first. A folder's names meet in
    one row, which is what an item is."""
    typed = files.withColumn("_kind", kind("name")).where("_kind in ('model', 'image')")
    model, image = F.col("_kind") == "model", F.col("_kind") == "image"
    hinted = F.col("name").rlike(f"(?iu){PREVIEW_HINT}")
    biggest = F.min(F.when(model, F.struct((-F.col("size")).alias("k"), F.col("name").alias("n"))))
    preview = F.min(F.when(image, F.struct((~hinted).alias("h"), (-F.col("size")).alias("k"), F.col("name").alias("n"))))
    out = typed.groupBy("dir").agg(
        F.count_if(model).cast("int").alias("part_count"),
        F.sum(F.when(model, F.col("size")).otherwise(0)).alias("size_bytes"),
        F.array_sort(F.collect_set(F.when(model, s.raw_extension("name")))).alias("formats"),
        F.array_sort(F.collect_list(F.when(model, F.col("name")))).alias("model_files"),
        biggest["n"].alias("primary_file"), preview["n"].alias("_preview"),
    )
    out = out.where("part_count > 0")
    folder = F.concat("dir", F.lit("/"), F.col("_preview"))
    return out.select(
        F.col("dir").alias("path"), F.coalesce(s.last(s.segments("dir")), F.col("dir")).alias("name"), "part_count", "size_bytes", "formats",
        "model_files", "primary_file", F.col("_preview").isNotNull().alias("has_shipped_preview"), F.when(F.col("_preview").isNotNull(), folder).alias("preview_file"),
    )


def archives(files: DataFrame) -> DataFrame:
    rows = files.where(kind("name") == "archive")
    return rows.select(F.concat("dir", F.lit("/"), "name").alias("path"), s.stem("name").alias("name"), F.array(s.extension("name")).alias("formats"), F.col("size").alias("size_bytes"))


def items(files: DataFrame, rules: Rules, roots: DataFrame) -> DataFrame:
    """Projects and archives as scan records; ``roots`` has (root, ord)."""
    none = F.lit(None).cast("string")
    one = projects(files).withColumns({"type": F.lit("project"), "packed": F.lit(False), "thumb_status": F.lit("pending")})
    two = archives(files).withColumns({"type": F.lit("archive"), "packed": F.lit(True), "thumb_status": F.lit("packed"), "part_count": F.lit(None).cast("int"),
                                       "model_files": F.array().cast("array<string>"), "primary_file": none, "has_shipped_preview": F.lit(None).cast("boolean"), "preview_file": none})
    both = longest_root(one.unionByName(two), roots, "path", "_root")
    labels = classified(rules, "path", "name", "model_files")
    out = both.withColumns({"source": source_label(rules, "path", F.col("_root")), "category": labels["category"], "faction": labels["faction"], "_labels": labels["labels"]})
    out = out.withColumns({"id": s.stable_id("path"), "thumbnail": none, "tags": item_tags(F.col("_labels"), F.col("formats"), F.col("source"), F.col("packed"))})
    return out.drop("_root", "_labels")


def zip_rollup(members: DataFrame, key: str = "path", cap: int = 200) -> DataFrame:
    """part_count, inner_bytes, model_files (largest first, ``cap`` of them) and
    formats of each archive from its ``members``, an array of (name, size, seq)."""
    models = F.filter("members", lambda m: s.extension(m["base"]).isin(*MODEL))
    ranked = F.array_sort(F.transform(models, lambda m: F.struct((-m["size"]).alias("k"), m["seq"].alias("q"), m["base"].alias("b"))))
    return members.select(
        key, F.nullif(F.size(models), F.lit(0)).cast("int").alias("part_count"),
        F.aggregate(models, F.lit(0).cast("long"), lambda a, m: a + m["size"]).alias("inner_bytes"),
        F.transform(F.slice(ranked, 1, cap), lambda r: r["b"]).alias("model_files"),
        F.array_sort(F.array_union(F.transform(models, lambda m: s.extension(m["base"])), F.array(F.lit("zip")))).alias("formats"),
    )
