"""Streaming daily counts equal the batch result in any order of arrival, over a file or a folder."""

import os
import tempfile

from pyspark.sql import functions as F

from planwell.sources import tables as T
from planwell.streaming import volume_stream as VS

from conftest import SF_SMALL


def same(got, want):
    return got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def wanted(spark):
    return VS.daily_counts(T.table(spark, SF_SMALL, "events"))


def test_unordered_files_lose_no_rows(spark):
    root = tempfile.mkdtemp(prefix="planwell-stream-")
    src = os.path.join(root, "events.parquet")
    events = T.table(spark, SF_SMALL, "events")
    for part in (2, 0, 3, 1):  # each file spans all days
        events.where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(src)
    table_dir = os.path.join(root, "table")
    q = VS.run_to_table(spark, src, table_dir, os.path.join(root, "ckpt"), max_files_per_trigger=1)
    q.awaitTermination()
    assert spark.read.parquet(table_dir).select("batch_seq").distinct().count() == 4
    assert same(VS.read_table(spark, table_dir), wanted(spark))
    assert same(VS.stream_daily_counts(spark, root), wanted(spark))


def test_one_file_and_an_empty_folder(spark):
    assert same(VS.stream_daily_counts(spark, SF_SMALL), wanted(spark))
    root = tempfile.mkdtemp(prefix="planwell-stream-")
    os.mkdir(os.path.join(root, "events.parquet"))
    assert VS.stream_daily_counts(spark, root).collect() == []
