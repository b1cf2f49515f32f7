"""Streaming daily counts that agree with the batch result whatever the order of arrival (2.13).

``readStream`` of raw event files -> ``foreachBatch`` counts each micro-batch per (day, key) and
writes these additive partial counts under the epoch's number.  Reading the table sums them, so a
late row adds to its day however late it is, nothing is dropped, and no state grows with the stream.

Recovery: the query checkpoint records offsets; an epoch that is replayed after a failure
overwrites its own ``batch_seq`` folder, so a replay never counts twice.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planwell.session import ensure_checkpoint_dir, path_exists

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


PARTIAL_SCHEMA = "date date, series_key string, cnt long, batch_seq long"


def event_stream(spark: SparkSession, source: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """File source over a table: one Parquet file or a folder of part files (explicit schema, no inference)."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    target = spark._jvm.org.apache.hadoop.fs.Path(source)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        # a stream reads folders: one file is its folder, narrowed to that name
        return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())
    return reader.parquet(source)


def daily_counts(events: DataFrame) -> DataFrame:
    """Partial counts of the given events per day and key."""
    return (events.where(F.col("ts").isNotNull() & F.col("event_type").isNotNull())
            .groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("series_key"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def run_to_table(spark: SparkSession, source: str, table_dir: str, checkpoint_dir: str,
                 available_now: bool = True, max_files_per_trigger: int | None = None):
    """Run the stream into ``table_dir`` (parquet, partitioned by batch_seq); returns the query."""

    def add_epoch(batch: DataFrame, epoch_id: int) -> None:
        # one directory per epoch: a replayed epoch overwrites its own output only
        daily_counts(batch).write.mode("overwrite").parquet(os.path.join(table_dir, f"batch_seq={epoch_id}"))

    writer = event_stream(spark, source, max_files_per_trigger).writeStream.foreachBatch(add_epoch)
    writer = writer.option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_table(spark: SparkSession, table_dir: str) -> DataFrame:
    """Current daily counts of the streamed table: the sum over its epochs; empty before the first."""
    if not path_exists(spark, table_dir):
        return spark.createDataFrame([], PARTIAL_SCHEMA).drop("batch_seq")
    partial = spark.read.schema(PARTIAL_SCHEMA).parquet(table_dir)
    return partial.groupBy("date", "series_key").agg(F.sum("cnt").alias("cnt"))


def stream_daily_counts(spark: SparkSession, source_dir: str, root: str | None = None) -> DataFrame:
    """Run the stream to completion over the events present now and return the resulting table."""
    root = root or os.path.join(ensure_checkpoint_dir(spark), "streams", uuid.uuid4().hex)
    table_dir, ckpt = os.path.join(root, "table"), os.path.join(root, "checkpoint")
    q = run_to_table(spark, f"{source_dir.rstrip('/')}/events.parquet", table_dir, ckpt)
    q.awaitTermination()
    return read_table(spark, table_dir)
