"""Counts, summaries, facets, samples and progress over items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import Rules, classified, item_tags, source_label
from ..schema import OK_STATUS
from .numbering import numbered
from .sources import longest_root


def status_counts(items: DataFrame) -> DataFrame:
    status = F.coalesce(F.nullif("thumb_status", F.lit("")), F.lit("pending"))
    return items.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def status_summary(items: DataFrame) -> DataFrame:
    """status, n, place: successes first in their fixed order, then by name."""
    known = F.array_position(F.array(*map(F.lit, OK_STATUS)), F.col("status"))
    place = F.row_number().over(Window.orderBy(F.when(known > 0, known).otherwise(99), "status"))  # one row a status
    return status_counts(items).withColumn("place", place.cast("long"))


def status_examples(items: DataFrame, n: int = 3, key: str = "thumb_status", order: str = "ord") -> DataFrame:
    """The first ``n`` items of each status that isn't a success."""
    status = F.coalesce(F.nullif(key, F.lit("")), F.lit("pending"))
    rows = items.withColumn("status", status).where(~F.col("status").isin(*OK_STATUS))
    place = F.row_number().over(Window.partitionBy("status").orderBy(order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def header_counts(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count("*").alias("total"), F.count_if(F.col("type") == "project").alias("projects"), F.count_if(F.col("type") == "archive").alias("archives"),
        F.count_if(F.coalesce(F.col("thumbnail"), F.lit("")) != "").alias("thumbnails_rendered"),
    )


def diagnose_counts(items: DataFrame) -> DataFrame:
    """From items with n_disk, n_cloud, n_gone: what is pending, and why."""
    pending = F.col("thumbnail").isNull()
    none = F.size(F.coalesce("model_files", F.array().cast("array<string>"))) == 0
    disk, cloud = F.col("n_disk") > 0, F.col("n_cloud") > 0
    return items.where("type = 'project'").agg(
        F.count("*").alias("projects"), F.count_if(~pending).alias("with_picture"), F.count_if(pending).alias("pending"), F.count_if(pending & none).alias("no_model_file"),
        F.count_if(pending & ~none & disk).alias("hydrated"), F.count_if(pending & ~none & ~disk & cloud).alias("cloud"), F.count_if(pending & ~none & ~disk & ~cloud).alias("missing"),
    )


def advice(libraries: bool, sources: int, counts: dict[str, int]) -> str:
    """One of the actions that a diagnosis ends in."""
    if not libraries:
        return "install the render libraries"
    if not sources:
        return "add a source folder"
    if not counts["projects"]:
        return "check the source folders"
    if counts["hydrated"]:
        return "render"
    return "wait for the cloud sync" if counts["cloud"] else "nothing to do"


def unmatched(items: DataFrame, default_category: str) -> DataFrame:
    return items.where((F.col("category") == default_category) & (F.coalesce("faction", F.lit("")) == ""))


def unmatched_top(items: DataFrame, default_category: str, n: int = 25) -> DataFrame:
    return unmatched(items, default_category).orderBy(F.desc("size_bytes"), "ord").limit(n)


def unmatched_counts(items: DataFrame, default_category: str) -> DataFrame:
    free = (F.col("category") == default_category) & (F.coalesce("faction", F.lit("")) == "")
    return items.agg(F.count_if(free).alias("unmatched"), F.count("*").alias("total"))


def facets(items: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value: the distinct values but empty ones of each column, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return items.select(pairs.alias("p")).select("p.*").where("value <> ''").distinct()


def problem_facet(items: DataFrame) -> DataFrame:
    rows = items.where("(thumbnail is null or thumbnail = '') and not packed and thumb_status <> ''")
    return rows.select(F.lit("problem").alias("facet"), F.col("thumb_status").alias("value")).distinct()


def reclassified(items: DataFrame, rules: Rules, roots: DataFrame) -> DataFrame:
    """``items`` with new_category, new_faction, new_source, new_tags, changed."""
    placed = longest_root(items, roots, "path", "_root")
    labels = classified(rules, "path", "name", "model_files")
    out = placed.withColumns({"new_category": labels["category"], "new_faction": labels["faction"], "new_source": source_label(rules, "path", F.col("_root")), "_l": labels["labels"]})
    out = out.withColumn("new_tags", item_tags(F.col("_l"), F.col("formats"), F.col("new_source"), F.coalesce("packed", F.lit(False))))
    differ = [~F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in ("category", "faction", "source", "tags")]
    changed = differ[0] | differ[1] | differ[2] | differ[3]
    return out.withColumn("changed", changed).drop("_root", "_l")


def change_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"new_{c}"))).alias(c) for c in ("category", "faction", "source", "tags")], F.count_if("changed").alias("items"))


def tag_changes(diff: DataFrame) -> DataFrame:
    return diff.withColumns({"added": F.array_except("new_tags", "tags"), "removed": F.array_except("tags", "new_tags")})


def stride_sample(items: DataFrame, n: int, order: list[Column | str], total: int | None = None) -> DataFrame:
    """Every max(1, N // n)-th item, ``n`` of them: a sample for looking at."""
    total = items.count() if total is None else total
    step = max(1, total // max(n, 1))
    last = step * (n - 1) + 1
    return numbered(items, order).where(((F.col("place") - 1) % step == 0) & (F.col("place") <= last))


def quantile_sample(items: DataFrame, n: int, order: list[Column | str], total: int | None = None) -> DataFrame:
    """Items at round(i * (N - 1) / (n - 1)), ties to even."""
    total = items.count() if total is None else total
    at = sorted({round(i * (total - 1) / (n - 1)) for i in range(n)}) if n > 1 and total > n else list(range(min(n, total)))
    return numbered(items, order, first=0).where(F.col("place").isin(*at))


def running_fit(items: DataFrame, order: str, size: str, elapsed: str) -> DataFrame:
    """After each item of a run: a, c of elapsed = a * n + c * MB by least
    squares without intercept, and the seconds that the rest will take; the
    mean of an item where the fit fails. Null before 8 items and 5 seconds.
    ``run`` tells runs apart, and each runs by itself."""
    w = Window.partitionBy("run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("run")
    base = items.withColumns({
        "n": F.row_number().over(Window.partitionBy("run").orderBy(order)).cast("double"), "b": F.sum(F.greatest(F.col(size), F.lit(0))).over(w) / 1e6, "t": F.col(elapsed).cast("double"),
        "n_all": F.count("*").over(whole).cast("double"), "b_all": F.sum(F.greatest(F.col(size), F.lit(0))).over(whole) / 1e6,
    })
    for name, x, y in (("snn", "n", "n"), ("snb", "n", "b"), ("sbb", "b", "b"), ("snt", "n", "t"), ("sbt", "b", "t")):
        base = base.withColumn(name, F.sum(F.col(x) * F.col(y)).over(w))
    det = F.col("snn") * F.col("sbb") - F.col("snb") * F.col("snb")
    a = (F.col("sbb") * F.col("snt") - F.col("snb") * F.col("sbt")) / F.nullif(F.col("det"), F.lit(0.0))
    c = (F.col("snn") * F.col("sbt") - F.col("snb") * F.col("snt")) / F.nullif(F.col("det"), F.lit(0.0))
    out = base.withColumn("det", det).withColumns({"a": a, "c": c})
    good = (F.col("det") > 0) & (F.col("a") >= 0) & (F.col("c") >= 0) & ((F.col("a") > 0) | (F.col("c") > 0))
    left = F.when(good, F.col("a") * (F.col("n_all") - F.col("n")) + F.col("c") * (F.col("b_all") - F.col("b"))).otherwise((F.col("n_all") - F.col("n")) * F.col("t") / F.col("n"))
    ready = (F.col("n") >= 8) & (F.col("t") >= 5)
    return out.withColumn("fresh", F.when(F.col("n") >= F.col("n_all"), 0.0).when(ready, F.greatest(F.lit(0.0), left)))


def smoothed(fit: DataFrame, order: str, weight: float = 0.25) -> DataFrame:
    """run, eta: the estimates of a run folded in order, each new one by ``weight``.
    A progress run is one job's queue, so its array is bounded by that queue."""
    rows = fit.where("fresh is not null").groupBy("run").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("fresh").alias("f"), (F.col("n") >= F.col("n_all")).alias("end")))).alias("x"))
    step = lambda a, x: F.when(x["end"], 0.0).when(a.isNull(), x["f"]).otherwise((1 - weight) * a + weight * x["f"])
    return rows.select("run", F.aggregate("x", F.lit(None).cast("double"), step).alias("eta"))


def repeated_pictures(pictures: DataFrame, limit: int = 3) -> DataFrame:
    """``pictures`` (id, digest, ord) with ``accepted``: a picture that comes for
    the ``limit``-th time is an icon. One without digest is accepted. Ranks are
    cut before the shuffle, so a picture that all items share is no burden."""
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("ord", "id"))
    first = pictures.where("digest is not null").select("id", "digest", "ord").withColumn("_k", rank).where(F.col("_k") < limit)
    first = first.select(F.col("id").alias("_id"), F.col("ord").alias("_ord"))
    joined = pictures.join(first, (pictures["id"] == first["_id"]) & (pictures["ord"] == first["_ord"]), "left")
    return joined.withColumn("accepted", F.col("digest").isNull() | F.col("_id").isNotNull()).drop("_id", "_ord")


def laid_out(parts: DataFrame, limit: float, key: str = "id") -> DataFrame:
    """Of each kit's ``parts`` (key, part, low and high corner as x0..z1): n,
    spread (the diagonal of all parts over the longest of one) and whether the
    parts lie apart rather than together: three or more, spread over ``limit``."""
    axes = ("x", "y", "z")
    length = lambda low, high: F.sqrt(sum((F.col(f"{high}{a}") - F.col(f"{low}{a}")) * (F.col(f"{high}{a}") - F.col(f"{low}{a}")) for a in axes))
    own = parts.select(key, "part", *[F.col(f"{a}{k}").alias(f"{'lh'[k]}{a}") for a in axes for k in (0, 1)])
    own = own.withColumn("_d", length("l", "h"))
    ends = [f(f"{side}{a}").alias(f"{side}{a}") for side, f in (("l", F.min), ("h", F.max)) for a in axes]
    out = own.groupBy(key).agg(F.count("*").alias("n"), F.max("_d").alias("_most"), F.min(F.struct((-F.col("_d")).alias("k"), "part"))["part"].alias("largest"), *ends)
    spread = length("l", "h") / F.greatest("_most", F.lit(1e-9))
    return out.withColumn("spread", spread).withColumn("apart", (F.col("n") >= 3) & (F.col("spread") > limit)).select(key, "n", "spread", "apart", "largest")
