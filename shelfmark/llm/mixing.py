"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) weigh 3, 1, 2 in turn and share
``share`` of all words; a target stops at ``most`` times its source's size and
the excess goes to the others by weight. Rates: of all rates between 0 and
``most`` that meet a source's target, those with the greatest entropy are
most * sigmoid(tilt * size). (Without the bound of ``most`` copies they would be
exp(tilt * size) up to a factor; with it the odds rate / (most - rate) are.)
The tilt of a source solves its convex dual, by safeguarded Newton iterations
that run distributed, a source a task at a time, over the histogram of its sizes:
a sufficient statistic that one aggregation gives, with one row for each size in
use however many documents there are. A tilt that doesn't meet its target raises.

Rounding: each document gets the whole part of its rate, and the fractions are
drawn by sequential Poisson sampling from a hash of doc_id, up to the document at
which the source's words come closest to its target; then one document, whose
size best closes what is left, is drawn or put back. Everything depends on rows
alone, so reruns agree.

Null and empty texts have size 0 and are taken never. A null source is a source.
Repeated rows are drawn one by one. Other columns, whatever their names, play no
part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..storage import materialize
from . import groups
from .groups import few
from .textkernel import map_texts

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Newton steps at most, and the gap that ends them, by source size.
STEPS, CLOSE = 200, 1e-9
#: Bins of one step of the search for a source's cut; two steps are taken.
BINS = 1024


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) of each row."""
    return map_texts(docs, lambda c: {"size": c.n_words.astype(np.int64)}, "size long", ["doc_id", "source"])


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sid, source, source_size, target: one row for each source."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "sid")
    table = materialize(table.withColumn("w", weight.cast("double")), "sources")
    whole = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    total = share * whole["s"]
    level, capped = (total / whole["w"] if whole["w"] else 0.0), -1
    while True:
        full = F.col("source_size") * most <= F.lit(level) * F.col("w")
        row = table.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)).alias("free"),
            F.count_if(full).alias("n"),
        ).first()
        if row["n"] == capped or not row["free"]:
            break
        capped, level = row["n"], (total - row["held"]) / row["free"]
    target = F.least(F.col("source_size") * float(most), F.lit(level) * F.col("w"))
    return table.select("sid", "source", "source_size", target.alias("target"))


def tilt_of(size: np.ndarray, count: np.ndarray, target: float, most: int = MOST) -> tuple[float, float]:
    """The scale and tilt of one source: most * sum(count * size * sigmoid(tilt *
    size / scale)) is ``target``, found by Newton steps inside a bracket."""
    weight = count * size.astype(float)
    total = weight.sum()
    scale = total / count.sum()
    if target >= most * total * (1 - 1e-9):
        return scale, np.inf
    x = size / scale
    tilt, low, high = 0.0, -np.inf, np.inf
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(tilt * x, -700, 700)))
        gap = most * (weight * p).sum() - target
        if abs(gap) <= CLOSE * total:
            return scale, tilt
        low, high = (tilt, high) if gap < 0 else (low, tilt)
        slope = most * (weight * x * p * (1 - p)).sum()
        step = tilt - gap / max(slope, 1e-300)
        if not (low < step < high and abs(step - tilt) <= 4 * (abs(tilt) + 1)):
            step = (low + high) / 2 if np.isfinite(low + high) else tilt - np.sign(gap) * (abs(tilt) + 1)
        tilt = step
    raise ArithmeticError(f"no tilt for a target of {target} words of {total}: {gap} are left")


def _tilts(histogram: DataFrame, table: DataFrame, most: int) -> DataFrame:
    """sid, scale, tilt of each source with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups.runs(batches, ["sid"]):
            sid, size, n, target = (batch.column(c).to_numpy() for c in ("sid", "size", "n", "target"))
            own = groups.bounds(batch, ["sid"])
            found = [tilt_of(size[a:b], n[a:b], target[a], most) for a, b in own]
            yield pa.RecordBatch.from_arrays([pa.array(sid[[a for a, _ in own]]), *(pa.array(x, pa.float64()) for x in zip(*found))], names=["sid", "scale", "tilt"])

    parts = int(histogram.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = histogram.join(few(table.select("sid", "target")), "sid").select("sid", "size", "n", "target")
    return rows.repartition(parts, "sid").sortWithinPartitions("sid").mapInArrow(run, "sid long, scale double, tilt double")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target,
    rate, copies (0..most) and the words taken, copies * size."""
    sized = materialize(sizes(docs), "sizes")
    table = materialize(targets(sized, weights, share, most), "targets")
    ided = sized.join(few(table), sized["source"].eqNullSafe(table["source"])).select("doc_id", "size", "sid", "source_size", "target")
    histogram = ided.where("size > 0").groupBy("sid", "size").agg(F.count("*").alias("n"))
    tilt = materialize(_tilts(histogram, table, most), "tilt")

    rate = F.when(F.col("size") == 0, 0.0).when(F.col("tilt") == np.inf, float(most)).otherwise(most / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("scale"))))
    uniform = (F.pmod(F.xxhash64("doc_id", "size"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rated = ided.join(few(tilt), "sid", "left").withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    # sequential Poisson sampling: by uniform / part, mapped to (0, 1)
    rated = rated.withColumn("q", F.when(F.col("part") > 1e-9, 1 / (1 + F.col("part") / uniform))).withColumn("row", F.monotonically_increasing_id())
    rated = materialize(rated.select("row", "doc_id", "sid", "size", "source_size", "target", "rate", "whole", "q"), "rates")
    bin1 = F.least(F.floor(F.col("q") * BINS), F.lit(BINS - 1))
    bin2 = F.least(F.floor((F.col("q") * BINS - F.col("bin1")) * BINS), F.lit(BINS - 1))
    binned = rated.withColumn("bin1", bin1).withColumn("bin2", bin2)

    source = Window.partitionBy("sid")
    before = F.coalesce(F.sum("words").over(source.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def cut(bins: DataFrame, room: Column) -> DataFrame:
        """sid, bin (in which the room of a source ends; null if it has none), room
        (what is left there), from (sid, bin, words, and what ``room`` reads)."""
        part = bins.withColumn("room", room).withColumn("before", before)
        fits = F.when(F.col("bin").isNotNull() & (F.col("before") <= F.col("room")), F.col("bin"))
        return part.groupBy("sid").agg(F.max(fits).alias("bin"), F.coalesce(F.max_by(F.col("room") - F.col("before"), fits), F.first("room")).alias("room"))

    # a row for each source and bin; what isn't drawn is in the bin null
    words = F.sum(F.when(F.col("q").isNotNull(), F.col("size")).otherwise(0))
    bins = binned.groupBy("sid", F.col("bin1").alias("bin")).agg(words.alias("words"), F.sum(F.col("whole") * F.col("size")).alias("sure"), F.first("target").alias("target"))
    one = materialize(cut(bins, F.first("target").over(source) - F.sum("sure").over(source)).withColumnRenamed("bin", "bin1_cut"), "cut")
    inner = binned.join(few(one), "sid").where("bin1 = bin1_cut").groupBy("sid", F.col("bin2").alias("bin")).agg(F.sum("size").alias("words"), F.first("room").alias("left"))
    two = cut(inner, F.col("left")).select("sid", F.col("bin").alias("bin2_cut"), F.col("room").alias("room2"))
    cuts = materialize(one.join(two, "sid", "left").select("sid", "bin1_cut", "bin2_cut", F.coalesce("room2", "room").alias("room")), "cut")

    edge = binned.join(few(cuts), "sid").where("bin1 = bin1_cut and bin2 = bin2_cut")
    upto = F.sum("size").over(source.orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("upto", upto).withColumn("drawn", (F.col("upto") - F.col("size") / 2 <= F.col("room")).cast("int"))
    edge = materialize(edge.select("row", "sid", "size", "drawn"), "edge")
    used = edge.groupBy("sid").agg(F.sum(F.col("drawn") * F.col("size")).alias("used"))
    gaps = materialize(cuts.join(used, "sid", "left").select("sid", "bin1_cut", "bin2_cut", (F.col("room") - F.coalesce("used", F.lit(0))).alias("gap")), "gaps")

    first = (F.col("bin1") < F.col("bin1_cut")) | ((F.col("bin1") == F.col("bin1_cut")) & (F.col("bin2") < F.col("bin2_cut")))
    drawn = F.coalesce("drawn", F.coalesce(first, F.lit(False)).cast("int"))
    placed = binned.join(few(gaps), "sid", "left").join(few(edge.select("row", "drawn")), "row", "left").withColumn("copies", (F.col("whole") + drawn).cast("int"))

    # what the cut leaves open closes best with one document more or less
    can = F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    after = F.abs(F.abs("gap") - F.col("size"))
    swap = placed.where((F.col("size") > 0) & can & (after < F.abs("gap"))).groupBy("sid").agg(F.min(F.struct(after, F.xxhash64("doc_id"), "doc_id", "row")).alias("best"), F.first(F.signum("gap")).alias("step"))
    swap = materialize(swap.select(F.col("best.row").alias("row"), F.col("step").cast("int").alias("step")), "swaps")
    done = placed.join(few(swap), "row", "left").withColumn("copies", (F.col("copies") + F.coalesce("step", F.lit(0))).cast("int"))
    return done.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies").cast("long") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken. Rows that
    share a doc_id are taken as often as the one taken most."""
    key, times, turn = (groups.free_name(c, docs.columns) for c in ("key", "times", "turn"))
    copies = mix(docs, **how).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(times))
    taken = docs.join(copies, docs["doc_id"].eqNullSafe(copies[key])).where(F.col(times) > 0)
    return taken.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)
