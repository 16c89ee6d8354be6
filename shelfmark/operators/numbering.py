"""Places over a whole table, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

_ROW_BITS = 33  # of a monotonically increasing id; the bits above tell the partition


def numbered(rows: DataFrame, order: list[Column | str], name: str = "place", first: int = 1) -> DataFrame:
    """``rows`` with ``name``, their place (long) in ``order``, which must tell
    all rows apart to be the same on each run. Range partitions are sorted and
    written; each is shifted by the rows of those before it. The driver sees one
    count for each partition."""
    at, part, before = (f"_{c}_{name}" for c in ("at", "part", "before"))
    kept = materialize(rows.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    own = F.shiftright(at, _ROW_BITS).cast("long")
    total, shifts = first, []
    for r in sorted(kept.groupBy(own.alias("p")).agg(F.count("*").alias("n")).collect()):
        shifts.append((r["p"], total))
        total += r["n"]
    table = rows.sparkSession.createDataFrame(shifts, f"{part} long, {before} long")
    joined = kept.join(F.broadcast(table), own == F.col(part))
    return joined.withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop(at, part, before)
