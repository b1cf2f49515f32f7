"""The stateful stream: late rows become corrections, state holds open days only, files stay few, replays change nothing."""

import os

from pyspark.sql import functions as F

from planwell.sources import tables as T
from planwell.streaming import event_time as ET
from planwell.streaming import volume_stream as VS

from conftest import SF_SMALL


def same(got, want):
    return got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def files_in_order(spark, path):
    """Five days a file, in order, and then one file with a row in ten of all days."""
    events = T.table(spark, SF_SMALL, "events")
    late = F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0
    for k in range(6):
        part = F.floor((F.dayofmonth("ts") - 1) / 5) == k
        events.where(part & ~late).coalesce(1).write.mode("append").parquet(path)
    events.where(late).coalesce(1).write.mode("append").parquet(path)
    return events


def test_late_rows_are_corrections_and_state_is_bounded(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path / "root")
    events = files_in_order(spark, source)
    query = ET.run(spark, source, root, max_files_per_trigger=1)
    query.awaitTermination()
    table = ET.CountTable(spark, f"{root}/table")
    assert same(table.read(), VS.daily_counts(events))
    kinds = {r["kind"]: r["n"] for r in table.changes().groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    assert kinds["late"] > 0 and kinds["closed"] > 0 and kinds["open"] > 0
    keys = events.select("event_type").distinct().count()
    open_days = 3 + 5  # the delay's days and those of one file
    rows = [p.stateOperators[0].numRowsTotal for p in query.recentProgress]
    assert max(rows) <= 2 * keys * ET.SALTS * open_days  # a count and a timer each
    assert rows[-1] < max(rows)
    # a second run sees nothing new; a new file is added to what is there
    ET.run(spark, source, root, max_files_per_trigger=1).awaitTermination()
    assert same(table.read(), VS.daily_counts(events))
    events.coalesce(1).write.mode("append").parquet(source)
    ET.run(spark, source, root, max_files_per_trigger=1).awaitTermination()
    assert same(table.read(), VS.daily_counts(events.unionByName(events)))


def test_compaction_keeps_counts_and_bounds_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ET, "COMPACT_EVERY", 2)
    source, root = str(tmp_path / "source"), str(tmp_path / "root")
    events = files_in_order(spark, source)
    ET.run(spark, source, root, max_files_per_trigger=1).awaitTermination()
    table = ET.CountTable(spark, f"{root}/table")
    assert same(table.read(), VS.daily_counts(events))
    assert len(table._numbers("base")) == 1 and len(table._numbers("epochs")) < 2
    assert len(os.listdir(f"{root}/table/base")) == 1
    before = {tuple(r) for r in table.read().collect()}
    table.compact()
    last = table._numbers("base")[-1]
    # an epoch that the base holds already may be written again after a failure: it does not count twice
    spark.createDataFrame([(None, "x", 0, "late", 99)], ET.OUTPUT).write.parquet(f"{root}/table/epochs/epoch={last}")
    # and one without a committed write does not count at all
    os.makedirs(f"{root}/table/epochs/epoch={last + 5}")
    assert {tuple(r) for r in table.read().collect()} == before


def test_a_replayed_epoch_overwrites_its_own_folder(spark, tmp_path):
    table = ET.CountTable(spark, str(tmp_path / "table"))
    assert table.read().collect() == []
    table.compact()
    day = spark.sql("select date'2025-01-01' date, 'A' series_key, 0 salt, 'late' kind, 3L n")
    table.add_epoch(day, 0)
    table.add_epoch(day, 0)
    assert [tuple(r)[1:] for r in table.read().collect()] == [("A", 3)]


def test_a_folder_without_rows(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path / "root")
    T.table(spark, SF_SMALL, "events").limit(0).write.parquet(source)
    ET.run(spark, source, root).awaitTermination()
    assert ET.CountTable(spark, f"{root}/table").read().collect() == []
