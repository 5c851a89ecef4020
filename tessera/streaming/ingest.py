"""Documents as they arrive: each micro-batch is one change set of the stored graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def ingest_stream(engine: Engine, documents: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Feeds (id, path, text) micro-batches to the engine. A batch that runs again upserts the same keys, so its rows are the same; empty ones change nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        if not rows.isEmpty():
            engine.ingest(rows)
        rows.unpersist()

    writer = documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(spark: SparkSession, folder: str, schema: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) of a folder counted by hour and type; those later than the watermark are dropped."""
    events = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
