"""Files that arrive are ingested batch by batch, by the same plan as a batch run.

The stream's id, which its checkpoint keeps, and the batch number name the batch's folders in the store: a batch that
runs again after a failure replaces itself, and a stream with a new checkpoint replaces nothing."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.store import Store
from paperloom.plans.ingestion import Providers, process
from paperloom.sources.files import GLOB, scan_stream


def start(spark: SparkSession, path: str, store: Store, checkpoint: str, *, providers: Providers, glob: str = GLOB, files_per_batch: int = 1000, **trigger) -> StreamingQuery:
    """trigger: as of DataStreamWriter.trigger; by default all that is there, then stop."""

    def ingest(batch_df, batch_id: int) -> None:
        if not batch_df.isEmpty():
            own = batch_df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            process(batch_df, replace(store, run=own or store.run), batch_id, providers).filter(F.lit(False)).count()

    writer = scan_stream(spark, path, glob, files_per_batch).writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def event_counts(events, watermark: str = "1 hour", window: str = "1 day"):
    """Audit events of a stream by day and action, with late ones up to the watermark."""
    return events.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", window), "action").agg(F.count(F.lit(1)).alias("n"))
