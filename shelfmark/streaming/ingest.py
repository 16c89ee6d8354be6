"""Continuous ingestion of file listings (an extension; batch scans need none of it).

Listings arrive as files of (dir, name, size); each micro-batch is rolled up and
merged into the catalog as a scan would be. A batch that is replayed after a
failure merges to the same state, since the merge is keyed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge, rollup
from ..plans.catalog import Catalog
from ..schema import SCANNED


def ingest(catalog: Catalog, folder: str, checkpoint: str) -> StreamingQuery:
    """A query that merges all listings in ``folder`` and then ends."""
    listings = catalog.spark.readStream.schema("dir string, name string, size long").json(folder)

    def merge_batch(batch: DataFrame, number: int) -> None:
        old = catalog.items()
        new = rollup.items(batch, catalog.rules, catalog.roots()).dropDuplicates(["id"])
        new = merge.keep_known_contents(old, new).withColumn("ord", F.lit(number).cast("long") * (1 << 32) + F.xxhash64("id") % (1 << 30))
        catalog._save(merge.upsert(old, new, SCANNED))

    return listings.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window with a watermark, for a stream or a table."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
