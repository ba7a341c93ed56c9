"""Ingest of reads as a stream: each micro-batch of new record files becomes a chunk of a partitioned table.

This is an extension: chunks arrive in order of their batch and keep the order of their records within it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def chunks(spark: SparkSession, source: str, schema: str, target: str, state: str) -> StreamingQuery:
    """Copy new Parquet files of reads from `source` to `target`, partitioned by chunk (the batch number).

    A batch that is run again after a failure replaces its own partition only, so records appear once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("chunk", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def quality_by_window(events: DataFrame, time: str, value: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Count and mean of a value by event-time window; state older than the watermark is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
