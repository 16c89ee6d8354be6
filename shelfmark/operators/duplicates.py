"""Exact and near duplicate groups by content fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fingerprint, loose_fingerprint
from .numbering import numbered


def fingerprinted(items: DataFrame) -> DataFrame:
    """``items`` (id, path, size_bytes, model_files, ord) with fp and loose."""
    return items.withColumns({"fp": fingerprint("model_files", "size_bytes"), "loose": loose_fingerprint("model_files")})


def _groups(items: DataFrame, key: str) -> DataFrame:
    size = F.coalesce("size_bytes", F.lit(0))
    first = F.min_by(size, F.struct(F.lower("path"), "ord"))
    grouped = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies"), (F.sum(size) - first).alias("waste"), F.min("ord").alias("first_ord"))
    return grouped.where("copies >= 2")


def exact_groups(prints: DataFrame) -> DataFrame:
    """fp, copies, waste (bytes but for one copy), first_ord."""
    return _groups(prints, "fp")


def near_groups(prints: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """loose, copies, waste, first_ord of groups with equal names, but for those
    whose members all are exact duplicates already. One aggregation decides:
    rows are counted by both prints before groups form."""
    exact = exact_groups(prints) if exact is None else exact
    marked = prints.where("loose is not null").join(exact.select("fp", F.lit(True).alias("_x")), "fp", "left")
    left = marked.groupBy("loose").agg(F.bool_and(F.coalesce("_x", F.lit(False))).alias("_all")).where("not _all")
    return _groups(prints, "loose").join(left.select("loose"), "loose", "left_semi")


def ranked(groups: DataFrame, label: str) -> DataFrame:
    """``groups`` with ``grp``: label-1, label-2 ... by waste, then first seen."""
    placed = numbered(groups, [F.desc("waste"), F.col("first_ord")])
    return placed.withColumn("grp", F.concat(F.lit(f"{label}-"), F.col("place").cast("string")))


def members(prints: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """The items of each group, numbered by path."""
    rows = prints.join(groups.select(key, "grp", "copies"), key).drop("place")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.lower("path"), "ord"))
    return rows.withColumn("place", place)


def reported(groups: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` of ``ranked`` groups, and how many more there are."""
    shown = groups.where(F.col("place") <= most)
    return shown.crossJoin(groups.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more")))  # one row


def totals(exact: DataFrame, near: DataFrame) -> DataFrame:
    """groups, extra copies and waste of both kinds in one row."""
    count = lambda df, p: df.agg(F.count("*").alias(f"{p}_groups"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias(f"{p}_extra"), F.coalesce(F.sum("waste"), F.lit(0)).alias(f"{p}_waste"))
    return count(exact, "exact").crossJoin(count(near, "near"))  # one row each
