"""Registered ingestion queries (F7-F9, G1, G3, M12, M13) and their SQL oracles.

The driver's ``events`` table plays the ingestion source: the stored table
holds daily event counts before 2024-01-20 (batch 0); the incoming batch
re-states every day from 2024-01-15 on with a corrected measure, distinct
users (batch 1).  Overlapping days therefore change value on upsert, which
makes "last one wins" observable.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwell import config as C
from planwell.operators import ingest as IG
from planwell.operators.snapshots import SnapshotTable
from planwell.plans import forecasting as FC
from planwell.plans.catalog import CUT, FCAST, FIT, VOL, WEEKLY, W, register, weekly
from planwell.plans import oracle as O
from planwell.session import checkpoint, ensure_checkpoint_dir
from planwell.sources import tables as T

STORED_BEFORE = "2024-01-20"
INCOMING_FROM = "2024-01-15"
TODAY = "2024-01-31"

S_SQL = f"""s AS (SELECT CAST(ts AS DATE) AS date, event_type AS series_key, count(*) AS cnt, 0 AS batch_seq
  FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL AND CAST(ts AS DATE) < DATE '{STORED_BEFORE}'
  GROUP BY 1, 2)"""
I_SQL = f"""i AS (SELECT CAST(ts AS DATE) AS date, event_type AS series_key, count(DISTINCT user_id) AS cnt,
  1 AS batch_seq
  FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL AND CAST(ts AS DATE) >= DATE '{INCOMING_FROM}'
  GROUP BY 1, 2)"""
U_SQL = """u AS (SELECT date, series_key, arg_max(cnt, batch_seq) AS cnt, max(batch_seq) AS batch_seq
  FROM (SELECT * FROM s UNION ALL SELECT * FROM i) GROUP BY date, series_key)"""


def stored_rows(spark, sf) -> DataFrame:
    ev = T.table(spark, sf, "events").select("ts", "event_type")
    daily = T.daily_volume_from_events(ev.where(F.to_date("ts") < F.lit(STORED_BEFORE).cast("date")),
                                       "ts", "event_type")
    return daily.select("date", "series_key", "cnt", F.lit(0).cast("long").alias("batch_seq"),
                        F.lit(0).cast("long").alias("idx"))


def incoming_daily(spark, sf) -> DataFrame:
    ev = T.table(spark, sf, "events").select("ts", "event_type", "user_id")
    ev = ev.where(F.col("ts").isNotNull() & F.col("event_type").isNotNull()
                  & (F.to_date("ts") >= F.lit(INCOMING_FROM).cast("date")))
    return ev.groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("series_key")) \
        .agg(F.countDistinct("user_id").alias("cnt"))


def incoming_records(spark, sf) -> DataFrame:
    return IG.records_from_daily(incoming_daily(spark, sf))


# A batch with every kind of fault: one record per event, faulty by a fixed rule on its id.
FAULTY_SQL = f"""f AS (SELECT event_id AS idx,
  CASE WHEN event_id % 97 = 0 THEN strftime(ts, '%d/%m/%Y') WHEN event_id % 79 = 0 THEN '2031-01-01' ELSE strftime(ts, '%Y-%m-%d') END AS date,
  CASE WHEN event_id % 83 = 0 THEN 'unknown ' || event_type ELSE event_type END AS course,
  CASE WHEN event_id % 89 = 0 THEN -1 WHEN event_id % 73 = 0 THEN {C.MAX_PLAUSIBLE_DAILY_COUNT + 1} ELSE event_id % 40 END AS n
  FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL AND event_id IS NOT NULL AND CAST(ts AS DATE) >= DATE '{INCOMING_FROM}'),
e AS (SELECT *, try_strptime(date, '%Y-%m-%d') IS NULL AS bad_date, n < 0 AS negative,
  course NOT IN (SELECT series_key FROM s) AS unknown, idx > min(idx) OVER (PARTITION BY date, course) AS repeated,
  coalesce(CAST(try_strptime(date, '%Y-%m-%d') AS DATE) > DATE '{TODAY}', FALSE) AS future,
  n > {C.MAX_PLAUSIBLE_DAILY_COUNT} AS implausible FROM f)"""


def faulty_records(spark, sf) -> DataFrame:
    ev = T.table(spark, sf, "events").select("event_id", "ts", "event_type").where(
        F.col("ts").isNotNull() & F.col("event_type").isNotNull() & F.col("event_id").isNotNull()
        & (F.to_date("ts") >= F.lit(INCOMING_FROM).cast("date")))

    def every(n):
        return F.col("event_id") % n == 0

    return ev.select(
        F.col("event_id").alias("idx"),
        F.when(every(97), F.date_format("ts", "dd/MM/yyyy")).when(every(79), F.lit("2031-01-01"))
        .otherwise(F.date_format("ts", IG.DATE_FORMAT)).alias("date"),
        F.when(every(83), F.concat(F.lit("unknown "), F.col("event_type"))).otherwise(F.col("event_type")).alias("course"),
        F.when(every(89), F.lit(-1)).when(every(73), F.lit(C.MAX_PLAUSIBLE_DAILY_COUNT + 1))
        .otherwise(F.col("event_id") % 40).cast("long").alias("applicant_count"))


@register("ingest_validation", "WITH " + S_SQL + ", " + FAULTY_SQL + f"""
SELECT CAST(count(*) AS BIGINT) AS records_received,
  CAST(count(*) FILTER (WHERE NOT (bad_date OR negative OR unknown OR repeated OR future OR implausible)) AS BIGINT) AS records_valid,
  CAST(count(*) FILTER (WHERE bad_date) AS BIGINT) AS n_date, CAST(count(*) FILTER (WHERE negative) AS BIGINT) AS n_applicant_count,
  CAST(count(*) FILTER (WHERE unknown) AS BIGINT) AS n_course, CAST(count(*) FILTER (WHERE repeated) AS BIGINT) AS n_duplicate,
  CAST(count(*) FILTER (WHERE future) AS BIGINT) AS n_future, CAST(count(*) FILTER (WHERE implausible) AS BIGINT) AS n_implausible,
  count(*) > {C.MAX_RECORDS_PER_BATCH} AS too_many_records,
  count(*) FILTER (WHERE bad_date OR negative OR unknown OR repeated OR future OR implausible) = 0
    AND count(*) <= {C.MAX_RECORDS_PER_BATCH} AS accepted FROM e""")
def q_ingest_validation(spark, sf):
    """A batch in which every rule fires."""
    batch = faulty_records(spark, sf)
    known = stored_rows(spark, sf).select("series_key").distinct()
    errors = IG.validate_records(batch, known, today=TODAY, max_count=C.MAX_PLAUSIBLE_DAILY_COUNT)
    return IG.validation_summary(batch, errors, C.MAX_RECORDS_PER_BATCH)


def upserted(spark, sf, sync_type="incremental") -> DataFrame:
    incoming = incoming_daily(spark, sf).select(
        "date", "series_key", F.col("cnt").cast("long").alias("cnt"),
        F.lit(1).cast("long").alias("batch_seq"), F.lit(0).cast("long").alias("idx"))
    return IG.upsert(stored_rows(spark, sf), incoming, sync_type)


@register("upsert_volume", "WITH " + S_SQL + ", " + I_SQL + ", " + U_SQL + """
SELECT date, series_key, CAST(cnt AS BIGINT) AS cnt, CAST(batch_seq AS BIGINT) AS batch_seq FROM u""")
def q_upsert_volume(spark, sf):
    return upserted(spark, sf).select("date", "series_key", F.col("cnt").cast("long").alias("cnt"), "batch_seq")


@register("upsert_metrics", "WITH " + S_SQL + ", " + I_SQL + ", " + U_SQL + """
SELECT 'incremental' AS sync_type, CAST(count(*) AS BIGINT) AS total_records,
  CAST((SELECT count(*) FROM i) AS BIGINT) AS new_records_added,
  strftime(min(date), '%Y-%m-%d') AS start_date, strftime(max(date), '%Y-%m-%d') AS end_date FROM u
UNION ALL
SELECT 'full', CAST(count(*) AS BIGINT), CAST(count(*) AS BIGINT),
  strftime(min(date), '%Y-%m-%d'), strftime(max(date), '%Y-%m-%d') FROM i""")
def q_upsert_metrics(spark, sf):
    inc = incoming_daily(spark, sf)
    out = []
    for sync in ("incremental", "full"):
        table = upserted(spark, sf, sync)
        out.append(IG.upsert_metrics(table, inc, sync).select(
            "sync_type", F.col("total_records").cast("long").alias("total_records"),
            F.col("new_records_added").cast("long").alias("new_records_added"), "start_date", "end_date"))
    return out[0].unionByName(out[1])


@register("new_days_since_data_end", "WITH " + S_SQL + ", " + I_SQL + ", " + U_SQL + """
SELECT CAST(count(DISTINCT date) AS BIGINT) AS new_days FROM u WHERE date > (SELECT max(date) FROM s)""")
def q_new_days_since_data_end(spark, sf):
    """G3 with the B9 fix: distinct dates after the stored data's last date."""
    data_end = stored_rows(spark, sf).select(F.max("date")).scalar()
    return upserted(spark, sf).where(F.col("date") > data_end).agg(
        F.countDistinct("date").alias("new_days"))


@register("retrain_decision", "WITH " + S_SQL + ", " + I_SQL + ", " + U_SQL + f""",
nd AS (SELECT count(DISTINCT date) AS n FROM u WHERE date > (SELECT max(date) FROM s)),
cases AS (SELECT 'incremental' AS sync_type, FALSE AS manual, n AS new_days FROM nd
  UNION ALL SELECT 'incremental', TRUE, n FROM nd
  UNION ALL SELECT 'full', FALSE, {C.FULL_SYNC_NEW_DAYS})
SELECT sync_type, manual, CAST(new_days AS BIGINT) AS new_days,
  manual OR new_days >= {C.RETRAIN_MIN_NEW_DAYS} AS should_retrain,
  CASE WHEN manual THEN 'Manual retraining requested'
       WHEN new_days >= {C.RETRAIN_MIN_NEW_DAYS} THEN 'Sufficient new data (' || new_days || ' new days >= {C.RETRAIN_MIN_NEW_DAYS} threshold)'
       ELSE 'No retraining needed (' || new_days || ' new days < {C.RETRAIN_MIN_NEW_DAYS} threshold)' END AS reason
FROM cases""")
def q_retrain_decision(spark, sf):
    """Manual request, >= 30 new days, or a full sync (counted as 999)."""
    nd = q_new_days_since_data_end(spark, sf)
    rows = []
    for sync, manual in (("incremental", False), ("incremental", True), ("full", False)):
        days, should, reason = IG.retrain_decision(F.col("new_days"), manual, sync)
        rows.append(nd.select(F.lit(sync).alias("sync_type"), F.lit(manual).alias("manual"),
                              days.cast("long").alias("new_days"), should.alias("should_retrain"),
                              reason.alias("reason")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@register("retrain_criteria", "WITH " + S_SQL + ", " + I_SQL + ", " + U_SQL + f""",
k AS (SELECT count(DISTINCT date) FILTER (WHERE date > (SELECT max(date) FROM s)) AS n,
  date_diff('day', (SELECT max(date) FROM s), max(date)) AS since FROM u),
d AS (SELECT (a.m - b.m) / b.m * 100.0 AS drift FROM
  (SELECT avg(c) AS m FROM (SELECT date, CAST(sum(cnt) AS DOUBLE) AS c FROM i GROUP BY date)) a,
  (SELECT avg(c) AS m FROM (SELECT date, CAST(sum(cnt) AS DOUBLE) AS c FROM s GROUP BY date)) b)
SELECT 'schedule' AS criterion, CAST(n AS BIGINT) AS new_days, n >= {C.RETRAIN_MIN_NEW_DAYS} OR since >= {C.RETRAIN_MAX_DAYS_SINCE_TRAINING} AS should_retrain,
  CASE WHEN n >= {C.RETRAIN_MIN_NEW_DAYS} THEN 'Sufficient new data (' || n || ' new days >= {C.RETRAIN_MIN_NEW_DAYS} threshold)'
    WHEN since >= {C.RETRAIN_MAX_DAYS_SINCE_TRAINING} THEN 'Scheduled retraining (' || since || ' days since last)'
    ELSE 'No retraining needed (' || n || ' new days < {C.RETRAIN_MIN_NEW_DAYS} threshold)' END AS reason FROM k
UNION ALL SELECT 'drift', CAST(n AS BIGINT), n >= {C.RETRAIN_MIN_NEW_DAYS} OR abs(drift) > {C.RETRAIN_DRIFT_PERCENT},
  CASE WHEN n >= {C.RETRAIN_MIN_NEW_DAYS} THEN 'Sufficient new data (' || n || ' new days >= {C.RETRAIN_MIN_NEW_DAYS} threshold)'
    WHEN abs(drift) > {C.RETRAIN_DRIFT_PERCENT} THEN 'Significant volume drift (' || printf('%+.1f', drift) || '%)'
    ELSE 'No retraining needed (' || n || ' new days < {C.RETRAIN_MIN_NEW_DAYS} threshold)' END FROM k, d""")
def q_retrain_criteria(spark, sf):
    """The days since the stored data ended, and the drift of the mean daily volume, as reasons."""
    stored, table = stored_rows(spark, sf), upserted(spark, sf)
    end = stored.select(F.max("date")).scalar()

    def mean_daily(df):
        return df.groupBy("date").agg(F.sum("cnt").cast("double").alias("c")).select(F.avg("c")).scalar()

    before = mean_daily(stored)
    facts = table.agg(F.countDistinct(F.when(F.col("date") > end, F.col("date"))).alias("new_days"),
                      F.max("date").alias("last")).select(
        "new_days", F.datediff("last", end).alias("since"),
        ((mean_daily(incoming_daily(spark, sf)) - before) / before * F.lit(100.0)).alias("drift"))
    out = []
    for name, given in (("schedule", {"days_since_training": F.col("since")}), ("drift", {"drift_percent": F.col("drift")})):
        days, should, reason = IG.retrain_decision(F.col("new_days"), **given)
        out.append(facts.select(F.lit(name).alias("criterion"), days.cast("long").alias("new_days"),
                                should.alias("should_retrain"), reason.alias("reason")))
    return out[0].unionByName(out[1])


@register("drift_check", W(VOL, WEEKLY, FIT, FCAST) + f""",
act AS (SELECT series_key, CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS week, SUM(cnt) AS y
  FROM volume WHERE date > DATE '{CUT}' GROUP BY ALL),
f4 AS (SELECT series_key, CAST(sum(CAST(round(y_hat * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) AS forecast_4w
  FROM fc WHERE step <= 4 GROUP BY series_key),
a4 AS (SELECT f.series_key, CAST(coalesce(sum(a.y), 0) AS DOUBLE) AS actual_4w
  FROM fc f LEFT JOIN act a ON a.series_key = f.series_key AND a.week = f.period
  WHERE f.step <= 4 GROUP BY f.series_key)
SELECT f4.series_key, round(forecast_4w, 2) AS forecast_4w, actual_4w,
  CASE WHEN forecast_4w = 0 THEN NULL ELSE round((actual_4w - forecast_4w) / forecast_4w * 100.0, 1) END AS drift_percentage,
  coalesce(abs((actual_4w - forecast_4w) / forecast_4w * 100.0) > {C.RETRAIN_DRIFT_PERCENT}, FALSE) AS drift_flag
FROM f4 JOIN a4 ON f4.series_key = a4.series_key""")
def q_drift_check(spark, sf):
    """Actual volume of the 4 weeks after the training end vs the stored forecast."""
    fc = FC.weekly_forecast(FC.params(weekly(spark, sf))).where(F.col("step") <= 4)
    after = T.volume(spark, sf).where(F.col("date") > F.lit(CUT).cast("date"))
    from planwell.functions.scalars import week_end
    act = after.groupBy("series_key", week_end("date").alias("period")).agg(F.sum("cnt").alias("y"))
    j = fc.join(act, ["series_key", "period"], "left")
    agg = j.groupBy("series_key").agg(
        (F.sum(FC.cents()) / F.lit(100.0)).alias("f"),
        F.coalesce(F.sum("y"), F.lit(0)).cast("double").alias("actual_4w"))
    drift = (F.col("actual_4w") - F.col("f")) / F.col("f") * F.lit(100.0)
    return agg.select("series_key", F.round("f", 2).alias("forecast_4w"), "actual_4w",
                      F.when(F.col("f") == 0, F.lit(None)).otherwise(F.round(drift, 1)).alias("drift_percentage"),
                      F.coalesce(F.abs(drift) > C.RETRAIN_DRIFT_PERCENT, F.lit(False)).alias("drift_flag"))


# Three batches into one table of month folders: everything up to a date, a restatement of its end with more
# days, and a correction of one old month.
V_UNTIL, V_FROM, V_MONTH = "2001-05-31", "2001-05-15", "1997-03"
V_SQL = f"""o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS series_key, o_custkey, o_orderstatus FROM orders
  WHERE o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL),
b AS (SELECT date, series_key, count(*) AS cnt, 0 AS batch_seq FROM o WHERE date <= DATE '{V_UNTIL}' GROUP BY ALL
  UNION ALL SELECT date, series_key, count(DISTINCT o_custkey), 1 FROM o WHERE date >= DATE '{V_FROM}' GROUP BY ALL
  UNION ALL SELECT date, series_key, count(*) FILTER (WHERE o_orderstatus = 'F'), 2 FROM o
    WHERE strftime(date, '%Y-%m') = '{V_MONTH}' GROUP BY ALL),
r AS (SELECT date, series_key, arg_max(cnt, batch_seq) AS cnt, max(batch_seq) AS batch_seq FROM b GROUP BY ALL),
w AS (SELECT strftime(date, '%Y-%m') AS month, max(batch_seq) AS written_by FROM b GROUP BY 1)"""


def version_batches(spark, sf) -> list[DataFrame]:
    o = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("series_key"),
                                            "o_custkey", "o_orderstatus")
    o = o.where(F.col("date").isNotNull() & F.col("series_key").isNotNull())
    key = ["date", "series_key"]
    out = [o.where(F.col("date") <= F.lit(V_UNTIL).cast("date")).groupBy(*key).agg(F.count(F.lit(1)).alias("cnt")),
           o.where(F.col("date") >= F.lit(V_FROM).cast("date")).groupBy(*key).agg(F.countDistinct("o_custkey").alias("cnt")),
           o.where(F.date_format("date", "yyyy-MM") == V_MONTH).groupBy(*key).agg(F.count_if(F.col("o_orderstatus") == "F").alias("cnt"))]
    return [b.select(*key, F.col("cnt").cast("long").alias("cnt"), F.lit(0).cast("long").alias("idx")) for b in out]


@register("upsert_versions", "WITH " + V_SQL + """
SELECT date, series_key, CAST(cnt AS BIGINT) AS cnt, CAST(batch_seq AS BIGINT) AS batch_seq, CAST(written_by AS BIGINT) AS written_by
FROM r JOIN w ON strftime(date, '%Y-%m') = month""")
def q_upsert_versions(spark, sf):
    """Three batches; each row with the batch that wrote its month's folder."""
    table = SnapshotTable(spark, f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}")
    for n, batch in enumerate(version_batches(spark, sf)):
        table.upsert(batch, "incremental" if n else "full")
    return table.read().join(table.months().select("month", "written_by"), F.date_format("date", "yyyy-MM") == F.col("month")).select(
        "date", "series_key", "cnt", "batch_seq", "written_by")


@register("stream_daily_counts", "WITH " + O.VIEWS["ingest_batch"]
          + " SELECT date, series_key, CAST(cnt AS BIGINT) AS cnt FROM ingest_batch")
def q_stream_daily_counts(spark, sf):
    """2.13: streaming daily counts (file source, additive partial counts per epoch)."""
    from planwell.streaming.volume_stream import stream_daily_counts
    return stream_daily_counts(spark, sf)


@register("stream_event_time", "WITH " + O.VIEWS["ingest_batch"]
          + " SELECT date, series_key, CAST(cnt AS BIGINT) AS cnt FROM ingest_batch")
def q_stream_event_time(spark, sf):
    """2.13: watermark, state of open days and corrections for late rows, over files out of order."""
    from planwell.streaming.event_time import stream_event_time
    return stream_event_time(spark, sf)


# A payload: daily counts with a number each; those whose last event's id is a multiple of seven lack their count.
P_SQL = """p AS (SELECT CAST(ts AS DATE) AS d, event_type AS course, count(*) AS n, max(event_id) AS m
  FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL),
raw AS (SELECT row_number() OVER (ORDER BY d, course) - 1 AS idx, course, strftime(d, '%Y-%m-%d') AS date,
  CASE WHEN m % 7 <> 0 THEN n END AS n FROM p)"""


def payload_table(spark, sf) -> DataFrame:
    """Daily counts as payload records (idx, date, course, applicant_count)."""
    from pyspark.sql import Window
    ev = T.table(spark, sf, "events").where(F.col("ts").isNotNull() & F.col("event_type").isNotNull())
    day = ev.groupBy(F.to_date("ts").alias("d"), F.col("event_type").alias("course")).agg(
        F.count(F.lit(1)).alias("n"), F.max("event_id").alias("m"))
    # one row a day and key, numbered as a client that writes one payload numbers them
    idx = (F.row_number().over(Window.orderBy("d", "course")) - 1).cast("long")
    return day.select(idx.alias("idx"), F.date_format("d", IG.DATE_FORMAT).alias("date"), "course",
                      F.when(F.col("m") % 7 != 0, F.col("n")).alias("applicant_count"))


@register("ingest_payload", "WITH " + P_SQL + """
SELECT CAST(idx AS BIGINT) AS idx, CASE WHEN n IS NOT NULL THEN date END AS date, CASE WHEN n IS NOT NULL THEN course END AS course,
  CAST(n AS BIGINT) AS applicant_count, n IS NULL AS malformed FROM raw
UNION ALL SELECT -1, NULL, NULL, NULL, TRUE""")
def q_ingest_payload(spark, sf):
    """A line-delimited payload made from ``events``, with a line that is no JSON and records without a number."""
    from planwell.streaming.ingest_stream import write_payload
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    write_payload(payload_table(spark, sf), path, "full", lines=20)
    spark.createDataFrame([("this line was cut {",)], "value string").coalesce(1).write.mode("append").text(path)
    _, records, broken = T.payload_lines(spark.read.text(path))
    return records.select("idx", "date", "course", "applicant_count", F.lit(False).alias("malformed")).unionByName(broken.select(
        "idx", F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("course"),
        F.lit(None).cast("long").alias("applicant_count"), F.lit(True).alias("malformed")))


# Three payload files: the stored days, a restatement with unknown keys (rejected whole), the restatement; then its replay.
@register("ingest_flow", "WITH " + S_SQL + ", " + I_SQL + ", " + U_SQL + f""",
nd AS (SELECT count(DISTINCT date) AS n FROM i WHERE date > (SELECT max(date) FROM s))
SELECT 'volume' AS part, CAST(batch_seq AS BIGINT) AS number, date, series_key, CAST(cnt AS BIGINT) AS cnt, CAST(NULL AS VARCHAR) AS note FROM u
UNION ALL SELECT 'quarantine', 1, NULL, 'no ' || series_key, count(*), 'course' FROM i GROUP BY series_key
UNION ALL SELECT 'decision', 0, (SELECT max(date) FROM s), NULL, (SELECT count(*) FROM s),
  'Sufficient new data ({C.FULL_SYNC_NEW_DAYS} new days >= {C.RETRAIN_MIN_NEW_DAYS} threshold)'
UNION ALL SELECT 'decision', 2, (SELECT max(date) FROM u), NULL, (SELECT count(*) FROM u),
  CASE WHEN n >= {C.RETRAIN_MIN_NEW_DAYS} THEN 'Sufficient new data (' || n || ' new days >= {C.RETRAIN_MIN_NEW_DAYS} threshold)'
    ELSE 'No retraining needed (' || n || ' new days < {C.RETRAIN_MIN_NEW_DAYS} threshold)' END FROM nd""")
def q_ingest_flow(spark, sf):
    """G2 as a stream: a full payload, a rejected one, an incremental one and a replay of it."""
    from planwell.streaming.ingest_stream import IngestStream, write_payload
    root = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    stored = IG.records_from_daily(stored_rows(spark, sf).select("date", "series_key", "cnt"))
    again = checkpoint(incoming_records(spark, sf))
    flow = IngestStream(spark, root, stored.select(F.col("course").alias("series_key")), CUT, TODAY)
    wrong = again.withColumn("course", F.concat(F.lit("no "), F.col("course")))
    for records, sync in ((stored, "full"), (wrong, "incremental"), (again, "incremental")):
        write_payload(records, f"{root}/source", sync)
        flow.run(f"{root}/source").awaitTermination()
    write_payload(again, f"{root}/again", "incremental")
    flow.apply(spark.read.text(f"{root}/again"), 2)
    key = F.regexp_extract("error", "'(.*)'", 1)
    bad = flow.quarantine().groupBy("epoch", key.alias("series_key"), "rule").agg(F.count(F.lit(1)).alias("cnt"))
    volume = flow.volume.read().select(F.lit("volume").alias("part"), F.col("batch_seq").alias("number"), "date", "series_key", "cnt",
                                       F.lit(None).cast("string").alias("note"))
    bad = bad.select(F.lit("quarantine").alias("part"), F.col("epoch").alias("number"), F.lit(None).cast("date").alias("date"),
                     "series_key", "cnt", F.col("rule").alias("note"))
    said = flow.decisions().where("accepted").select(
        F.lit("decision").alias("part"), F.col("epoch").alias("number"), F.to_date("end_date").alias("date"),
        F.lit(None).cast("string").alias("series_key"), F.col("total_records").alias("cnt"), F.col("retraining_reason").alias("note"))
    return volume.unionByName(bad).unionByName(said)
