"""Payload files as a stream: whole batches or nothing, quarantine, replays, and lines that are no records."""

import json

import pytest

from planwell.sources import tables as T
from planwell.streaming.ingest_stream import IngestStream, write_payload

REC = "idx long, date string, course string, applicant_count long"


def payload(path, name, *lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), encoding="utf-8")


def record(date, course, n):
    return {"date": date, "course": course, "applicant_count": n}


@pytest.fixture
def flow(spark, tmp_path):
    keys = spark.createDataFrame([("A",), ("B",)], "series_key string")
    return IngestStream(spark, str(tmp_path / "flow"), keys, "2025-12-31", today="2025-12-31")


def state(flow):
    return (sorted(tuple(r) for r in flow.volume.read().collect()), sorted(map(str, flow.decisions().collect())),
            sorted(map(str, flow.quarantine().collect())), flow.volume.numbers())


def test_whole_batches_or_nothing_and_replays(spark, flow, tmp_path):
    src = tmp_path / "source"
    payload(src, "0.json", {"sync_type": "full", "daily_volumes": [record("2025-01-01", "A", 1), record("2025-01-08", "B", 2)]},
            {"offset": 2, "daily_volumes": [record("2025-01-15", "A", 4)]})
    flow.run(str(src)).awaitTermination()
    payload(src, "1.json", {"daily_volumes": [record("2025-02-01", "A", 5), record("2025-02-01", "Z", 5)]}, "{cut", "", "[1, 2]")
    flow.run(str(src)).awaitTermination()
    payload(src, "2.json", {"manual_retrain": True, "daily_volumes": [record("2025-01-15", "A", 40), record("2025-01-22", "B", 6)]})
    flow.run(str(src)).awaitTermination()
    volume, decisions, quarantine, numbers = state(flow)
    assert [(str(r[0]), r[1], r[2], r[3]) for r in volume] == [
        ("2025-01-01", "A", 1, 0), ("2025-01-08", "B", 2, 0), ("2025-01-15", "A", 40, 1), ("2025-01-22", "B", 6, 1)]
    assert {(r.epoch, r.rule) for r in flow.quarantine().collect()} == {(1, "course"), (1, "malformed")}
    told = {r.epoch: r for r in flow.decisions().collect()}
    assert (told[0].accepted, told[1].accepted, told[2].accepted) == (True, False, True)
    assert (told[1].received, told[2].received, told[2].new_days, told[2].total_records) == (4, 2, 1, 4)
    assert told[2].retraining_triggered and told[2].retraining_reason == "Manual retraining requested"
    for epoch, name in ((2, "2.json"), (2, "2.json")):
        flow.apply(spark.read.text(str(src / name)), epoch)
    assert state(flow) == (volume, decisions, quarantine, numbers)


def test_a_failure_between_commit_and_decision_is_made_good(spark, flow, tmp_path, monkeypatch):
    src = tmp_path / "source"
    payload(src, "0.json", {"sync_type": "full", "daily_volumes": [record("2025-01-01", "A", 1)]})
    from planwell.streaming import ingest_stream as IS
    with monkeypatch.context() as m:
        m.setattr(IS.TR, "refit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception):
            flow.run(str(src)).awaitTermination()
    assert flow.volume.numbers() == [0] and flow.decisions().count() == 0
    flow.run(str(src)).awaitTermination()
    assert flow.volume.numbers() == [0]
    told = flow.decisions().first()
    assert told.accepted and told.new_days == 999 and told.total_records == 1


def test_unknown_sync_type_is_quarantined(flow, spark, tmp_path):
    payload(tmp_path / "source", "0.json", {"sync_type": "partial", "daily_volumes": [record("2025-01-01", "A", 1)]})
    flow.run(str(tmp_path / "source")).awaitTermination()
    assert flow.volume.snapshot() is None and flow.quarantine().first().field == "sync_type"


def test_payload_round_trip(spark, tmp_path):
    rows = [(i, f"2025-01-{1 + i % 28:02d}", f"k {i} \"é\"", i * 7) for i in range(50)]
    df = spark.createDataFrame(rows, REC).repartition(5)
    write_payload(df, str(tmp_path / "p"), "incremental", source="me", manual_retrain=True, lines=7)
    lines = spark.read.text(str(tmp_path / "p"))
    header, records, broken = T.payload_lines(lines)
    assert lines.count() == 8 and broken.count() == 0
    assert sorted(tuple(r) for r in records.collect()) == rows
    h = header.first()
    assert (h.source, h.sync_type, h.manual_retrain, h.data_version) == ("me", "incremental", True, "1.0")


def test_lines_that_are_no_records(spark):
    lines = spark.createDataFrame([(x,) for x in (
        "", "  ", "null", "{}", '{"daily_volumes": 5}', '{"daily_volumes": []}', "nonsense", '{"sync_type": 7, "daily_volumes": [null, 1, {"date": 1}]}',
        '{"offset": "x", "daily_volumes": [{"date": "2025-01-01", "course": "A", "applicant_count": 1.5}, {"date": "d", "course": "A", "applicant_count": -1}]}')],
        "value string")
    header, records, broken = T.payload_lines(lines)
    assert [tuple(r) for r in records.collect()] == [(1, "d", "A", -1)]
    assert sorted((r.idx, r.field) for r in broken.collect()) == [
        (-1, "line"), (-1, "line"), (0, "daily_volumes[0]"), (0, "daily_volumes[0]"), (1, "daily_volumes[1]"), (2, "daily_volumes[2]")]
    assert header.count() == 1
    none = T.payload_lines(lines.limit(0))
    assert none[0].first().sync_type == "incremental" and none[1].count() == none[2].count() == 0
