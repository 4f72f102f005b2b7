"""Streaming ingest of vintages. An extension: the batch operators need none of it.

A revision is not late data, so no watermark drops rows: each micro-batch appends the vintages that the table doesn't have.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vintra.sources.sinks import append_absent


def ingest(spark: SparkSession, source: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes (series_id, observed_at, as_of, value, reconstructed) batches to the table once each key; a replayed batch adds nothing."""
    return source.writeStream.foreachBatch(lambda batch, _: append_absent(spark, table, batch, ["series_id", "observed_at", "as_of"]) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_means(events: DataFrame, length: str, slide: str | None, late: str) -> DataFrame:
    """Counts and means by event type over event-time windows; the watermark only bounds the state."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
