"""Validation of bad records, keyed upsert semantics and versioned writes."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

import pytest
from planwell.operators import ingest as IG

REC = "idx long, date string, course string, applicant_count long"


def test_documented_bad_rows_give_three_errors(spark):
    batch = spark.createDataFrame([(0, "invalid-date", "A", 1), (1, "2026-01-02", "Nope", 1),
                                   (2, "2026-01-03", "A", -1), (3, "2026-01-04", "A", 2)], REC)
    known = spark.createDataFrame([("A",)], "series_key string")
    errs = IG.validate_records(batch, known).orderBy("idx").collect()
    assert [(e.idx, e.rule) for e in errs] == [(0, "date"), (1, "course"), (2, "applicant_count")]
    assert errs[1].error == "Unknown course 'Nope'" and errs[1].field == "daily_volumes[1].course"
    s = IG.validation_summary(batch, IG.validate_records(batch, known)).first()
    assert (s.records_received, s.records_valid, s.accepted) == (4, 1, False)


def test_duplicates_future_and_implausible(spark):
    batch = spark.createDataFrame([(0, "2026-01-02", "A", 1), (1, "2026-01-02", "A", 2),
                                   (2, "2030-01-01", "A", 1), (3, "2026-01-05", "A", 5000)], REC)
    known = spark.createDataFrame([("A",)], "series_key string")
    rules = sorted((e.idx, e.rule) for e in IG.validate_records(batch, known, today="2026-06-01", max_count=1000).collect())
    assert rules == [(1, "duplicate"), (2, "future"), (3, "implausible")]


def rows(spark, data, seq):
    return spark.createDataFrame([(d, k, c, seq, i) for i, (d, k, c) in enumerate(data)],
                                 "date date, series_key string, cnt long, batch_seq long, idx long")


def test_incremental_upsert_last_wins_and_split_equals_whole(spark):
    d1, d2, d3 = (dt.date(2026, 1, i) for i in (1, 2, 3))
    stored = rows(spark, [(d1, "A", 1), (d2, "A", 2)], 0)
    new = rows(spark, [(d2, "A", 20), (d3, "A", 30)], 1)
    up = {(r.date, r.series_key): r.cnt for r in IG.upsert(stored, new).collect()}
    assert up == {(d1, "A"): 1, (d2, "A"): 20, (d3, "A"): 30}
    # incremental of a split batch == full upsert of the whole batch
    whole = rows(spark, [(d1, "A", 1), (d2, "A", 20), (d3, "A", 30)], 0)
    full = IG.upsert(stored, whole, "full").select("date", "series_key", "cnt")
    inc = IG.upsert(IG.upsert(rows(spark, [(d1, "A", 1)], 0), rows(spark, [(d2, "A", 20)], 1)),
                    rows(spark, [(d3, "A", 30)], 2)).select("date", "series_key", "cnt")
    assert full.exceptAll(inc).count() == 0 and inc.exceptAll(full).count() == 0
    # a full upsert is idempotent
    again = IG.upsert(IG.upsert(stored, whole, "full"), whole.withColumn("batch_seq", F.lit(5).cast("long")), "full")
    assert again.select("date", "series_key", "cnt").exceptAll(full).count() == 0


def test_versioned_write_switches_pointer(spark):
    root = tempfile.mkdtemp(prefix="planwell-ver-")
    assert IG.read_current(spark, root) is None
    IG.write_version(spark.createDataFrame([(1,)], "x int"), root)
    IG.write_version(spark.createDataFrame([(2,), (3,)], "x int"), root)
    assert sorted(r.x for r in IG.read_current(spark, root).collect()) == [2, 3]


def test_retrain_decision(spark):
    df = spark.createDataFrame([(29,), (30,)], "new_days long")
    for manual, sync, expect in ((False, "incremental", [False, True]), (True, "incremental", [True, True]),
                                 (False, "full", [True, True])):
        _, should, reason = IG.retrain_decision(F.col("new_days"), manual, sync)
        assert [r[0] for r in df.select(should).collect()] == expect
    _, _, reason = IG.retrain_decision(F.col("new_days"))
    assert df.select(reason).first()[0] == "No retraining needed (29 new days < 30 threshold)"


def test_json_payload_keeps_array_positions(spark):
    import json
    import os
    from planwell.sources.tables import ingest_payload
    root = tempfile.mkdtemp(prefix="planwell-payload-")
    doc = {"source": "sync", "sync_type": "incremental",
           "date_range": {"start_date": "2026-01-01", "end_date": "2026-01-02"},
           "daily_volumes": [{"date": "2026-01-01", "course": "A", "applicant_count": 3},
                             {"date": "invalid-date", "course": "A", "applicant_count": 1},
                             {"date": "2026-01-02", "course": "Z", "applicant_count": -1}]}
    with open(os.path.join(root, "batch.json"), "w", encoding="utf-8") as fh:
        json.dump(doc, fh, indent=2)
    header, records = ingest_payload(spark, root)
    h = header.first()
    assert (h.sync_type, h.start_date, h.data_version, h.manual_retrain) == ("incremental", "2026-01-01", "1.0", False)
    assert [r.idx for r in records.orderBy("idx").collect()] == [0, 1, 2]
    known = spark.createDataFrame([("A",)], "series_key string")
    errs = sorted((e.field, e.rule) for e in IG.validate_records(records.drop("source"), known).collect())
    assert errs == [("daily_volumes[1].date", "date"), ("daily_volumes[2].applicant_count", "applicant_count"),
                    ("daily_volumes[2].course", "course")]


def test_csv_sources_map_columns_and_check_headers(spark):
    import os

    import pytest as _pytest
    from planwell.sources import tables as TB
    root = tempfile.mkdtemp(prefix="planwell-csv-")
    vol = TB.ingest_batch(spark, "/root/testdata/sf0.001")
    (vol.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("series_key").alias("course"),
                F.col("cnt").alias("applicant_count"))
        .coalesce(1).write.option("header", True).csv(os.path.join(root, "volume")))
    back = TB.read_volume_csv(spark, os.path.join(root, "volume"))
    assert back.exceptAll(vol.select("date", "series_key", F.col("cnt").cast("long"))).count() == 0
    lr = TB.learners(spark, "/root/testdata/sf0.001")
    inv = {v: k for k, v in TB.LEARNER_CSV_COLUMNS.items()}
    lr.select(*[F.col(c).alias(inv[c]) for c in inv]).coalesce(1).write.option("header", True).csv(
        os.path.join(root, "learners"))
    got = TB.read_learners_csv(spark, os.path.join(root, "learners"))
    assert got.count() == lr.count() and got.select("record_id").distinct().count() == lr.count()
    assert got.drop("record_id").exceptAll(lr.drop("record_id")).count() == 0
    vol.select("date").coalesce(1).write.option("header", True).csv(os.path.join(root, "bad"))
    with _pytest.raises(ValueError):
        TB.read_volume_csv(spark, os.path.join(root, "bad"))


def test_a_failing_pointer_read_leaves_the_table_alone(spark, tmp_path, monkeypatch):
    """Only a missing pointer means "no table yet"; any other failure is raised."""
    root = str(tmp_path / "volume")
    assert IG.current_path(spark, root) is None
    IG.write_version(spark.createDataFrame([("2025-01-01", "A", 1)], "date string, series_key string, cnt long"), root)
    before = IG.current_path(spark, root)

    def fail(*_):
        raise OSError("store not reachable")

    with monkeypatch.context() as m:
        m.setattr(IG, "path_exists", fail)
        with pytest.raises(OSError):
            IG.read_current(spark, root)
    assert IG.current_path(spark, root) == before and IG.read_current(spark, root).count() == 1


def test_limits_are_off_unless_set(spark):
    batch = spark.range(10_001).select(F.col("id").alias("idx"), F.lit("2025-01-01").alias("date"),
                                       F.format_string("k%s", "id").alias("course"), F.lit(5000).cast("long").alias("applicant_count"))
    known = batch.select(F.col("course").alias("series_key"))
    s = IG.validation_summary(batch, IG.validate_records(batch, known)).first()
    assert s.accepted and s.n_implausible == 0 and not s.too_many_records
    s = IG.validation_summary(batch, IG.validate_records(batch, known, max_count=1000), 10_000).first()
    assert not s.accepted and s.n_implausible == 10_001 and s.too_many_records
