"""What can be rendered now: files on disk, online-only or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import extension, whole_megabytes
from .merge import to_render


def parts_state(items: DataFrame, probe: DataFrame) -> DataFrame:
    """``items`` with on_disk (the paths that are, in order), n_disk, n_cloud and
    n_gone over their model files. ``probe`` has (path, hydrated): true on disk,
    false online-only; absent paths are gone."""
    files = items.select("id", F.explode(F.transform("model_files", lambda f: F.concat("path", F.lit("/"), f))).alias("_f"))
    state = files.join(probe.select(F.col("path").alias("_f"), "hydrated"), "_f", "left")
    counted = state.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("hydrated"), F.col("_f")))).alias("on_disk"), F.count_if("hydrated").alias("n_disk"), F.count_if(~F.col("hydrated")).alias("n_cloud"), F.count_if(F.col("hydrated").isNull()).alias("n_gone"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_disk", "n_cloud", "n_gone")}
    zero["on_disk"] = F.coalesce("on_disk", F.array().cast("array<string>"))
    return items.join(counted, "id", "left").withColumns(zero)


def renderable_now(items: DataFrame, probe: DataFrame) -> DataFrame:
    """``items`` with preview_ok and model_ok: whether the shipped preview, and
    some model file, is on disk."""
    state = parts_state(items, probe)
    own = probe.select(F.col("path").alias("_v"), F.col("hydrated").alias("_seen"))
    joined = state.join(own, state["preview_file"] == own["_v"], "left")
    shown = F.coalesce("has_shipped_preview", F.lit(False)) & F.coalesce("_seen", F.lit(False))
    return joined.withColumns({"preview_ok": shown, "model_ok": F.col("n_disk") > 0}).drop("_v", "_seen")


def skip_status(items: DataFrame, probe: DataFrame) -> DataFrame:
    """``items`` with ``skip`` and ``skip_detail``: null if it can be rendered now."""
    state = parts_state(items, probe)
    own = probe.select(F.col("path").alias("_a"), F.col("hydrated").alias("_own"))
    state = state.join(own, state["path"] == own["_a"], "left")
    archive = F.col("type") == "archive"
    none = F.size(F.coalesce("model_files", F.array().cast("array<string>"))) == 0
    skip = (
        F.when(archive & F.col("_own"), None).when(archive & ~F.col("_own"), "cloud_only").when(archive, "missing")
        .when(none, "no_model_file").when(F.col("n_disk") > 0, None).when(F.col("n_cloud") > 0, "cloud_only").otherwise("missing")
    )
    out = state.withColumn("skip", skip)
    count = lambda c: F.col(c).cast("string")
    detail = (
        F.when(archive & (F.col("skip") == "cloud_only"), F.lit("archive not downloaded"))
        .when(archive & (F.col("skip") == "missing"), F.lit("archive gone from its path"))
        .when(F.col("skip") == "cloud_only", F.concat(count("n_cloud"), F.lit(" part(s) not downloaded")))
        .when(F.col("skip") == "missing", F.concat(count("n_gone"), F.lit(" part(s) gone from "), F.col("path")))
    )
    return out.withColumn("skip_detail", detail).drop("_a", "_own")


def deferred(items: DataFrame, max_mb: float) -> DataFrame:
    """``items`` with ``too_big`` and ``too_big_detail``: over the limit, put off."""
    size = F.coalesce("size_bytes", F.lit(0))
    over = size > F.lit(max_mb * 1e6)
    detail = F.concat(whole_megabytes(size), F.lit(f" MB, limit {max_mb:.0f} MB"))
    return items.withColumns({"too_big": over, "too_big_detail": F.when(over, detail)})


def outcome(items: DataFrame, engines: tuple[str, ...] = (), unrenderable: tuple[str, ...] = ("step", "stp"), drawn: str = "mesh") -> DataFrame:
    """``items`` (from ``skip_status``, with ``preview_ok``) with the status that
    rendering would give: a shipped preview first, then what blocks the item,
    then parts on disk that are all of kinds without a reader, then the first
    engine there is. ``drawn`` draws what is on disk and says if parts lack."""
    kinds = F.array_sort(F.array_distinct(F.transform("on_disk", lambda f: F.concat(F.lit("."), extension(f)))))
    readable = F.filter("on_disk", lambda f: ~extension(f).isin(*unrenderable))
    project = F.col("type") == "project"
    status = (
        F.when(project & F.coalesce("preview_ok", F.lit(False)), "reused")
        .when(F.col("skip").isNotNull(), F.col("skip")).when(project & (F.size(readable) == 0), "unsupported")
        .otherwise(F.lit(engines[0] if engines else "failed"))
    )
    lacking = F.col("n_cloud") + F.col("n_gone")
    part = F.concat(F.lit("drawn from "), F.size(readable).cast("string"), F.lit(" of "), (F.size(readable) + lacking).cast("string"), F.lit(" part(s)"))
    out = items.withColumn("outcome", status)
    detail = (
        F.when(F.col("outcome") == "unsupported", F.concat(F.lit("no reader for "), F.array_join(kinds, ", ")))
        .when((F.col("outcome") == drawn) & project & (lacking > 0), part)
        .when(F.col("outcome") == F.col("skip"), F.col("skip_detail"))
    )
    return out.withColumn("outcome_detail", detail)


def queue(items: DataFrame, probe: DataFrame, thumbnails: DataFrame, max_mb: float = 1500, force: bool = False, engines: tuple[str, ...] = ()) -> DataFrame:
    """id, place, status, detail of what has no picture yet (with ``force`` of
    all): what an engine is to draw now has its place, smallest first; the rest
    has none, and a status that says why."""
    rows = to_render(items, thumbnails, force)
    state = deferred(outcome(skip_status(rows, probe).drop("preview_ok").join(renderable_now(items, probe).select("id", "preview_ok"), "id"), engines), max_mb)
    late = F.col("skip").isNull() & F.col("too_big")
    status, detail = F.when(late, "too_big").otherwise(F.col("outcome")), F.when(late, F.col("too_big_detail")).otherwise(F.col("outcome_detail"))
    state = state.withColumns({"status": status, "detail": detail}).withColumn("now", F.col("status").isin("reused", *(engines or ("failed",))))
    return state.withColumn("place", F.when(F.col("now"), F.col("place"))).drop("now").select("id", "place", "status", "detail", "size_bytes")
