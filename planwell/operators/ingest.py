"""Ingestion: record validation, keyed upsert, versioned writes, retrain decision.

A batch is a DataFrame of records ``(idx, date, course, applicant_count)``
with ``date`` still a string.  Validation emits one error row per failed
rule; a batch with any error is rejected whole.  The upsert keeps, per
(date, key), the row of the latest batch and, inside a batch, the latest
record (``batch_seq`` then ``idx``), which is what "keep last" means once
rows have no arrival order.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwell import config as C
from planwell.session import path_exists

DATE_FORMAT = "yyyy-MM-dd"


def records_from_daily(daily: DataFrame) -> DataFrame:
    """Turn daily counts into ingest records; ``idx`` is a unique record id."""
    return daily.select(
        F.monotonically_increasing_id().alias("idx"),
        F.date_format("date", DATE_FORMAT).alias("date"),
        F.col("series_key").alias("course"),
        F.col("cnt").cast("long").alias("applicant_count"))


RULES = ["malformed", "date", "applicant_count", "course", "duplicate", "future", "implausible"]
ERROR_SCHEMA = "idx long, field string, rule string, error string"


def validate_records(batch: DataFrame, known_keys: DataFrame, today: str | None = None,
                     max_count: int | None = None) -> DataFrame:
    """F7 + F8 + F9: (idx, field, rule, error) for every failed rule.

    * date not in yyyy-MM-dd            (rule ``date``)
    * applicant_count missing or < 0    (rule ``applicant_count``)
    * unknown course                    (rule ``course``)
    * duplicate (date, course)          (rule ``duplicate``), every record after the first
    * date after ``today``              (rule ``future``)
    * applicant_count > ``max_count``   (rule ``implausible``; off unless the caller sets a limit)

    One pass: each record meets its key's mark and the first idx of its (date, course) pair, its failed rules
    become an array, and the array's entries become rows.  A hot pair is combined map-side by the
    aggregate, and AQE splits a skewed join partition, so no group is held whole.
    """
    known = known_keys.select(F.col("series_key").alias("_known")).distinct()
    firsts = batch.groupBy("date", "course").agg(F.min("idx").alias("_first")).select(
        F.col("date").alias("_date"), F.col("course").alias("_course"), "_first")
    rows = batch.withColumn("_d", F.try_to_date(F.col("date"), DATE_FORMAT))
    rows = rows.join(known, F.col("course") == F.col("_known"), "left").join(
        firsts, (F.col("date") == F.col("_date")) & (F.col("course") == F.col("_course")), "left")

    def failed(cond, rule: str, message):
        error = F.lit(message) if isinstance(message, str) else message
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), error.alias("error")))

    rules = [failed(F.col("_d").isNull(), "date", "Date must be in YYYY-MM-DD format"),
             failed(F.coalesce(F.col("applicant_count") < 0, F.lit(True)), "applicant_count",
                    "ensure this value is greater than or equal to 0"),
             failed(F.col("_known").isNull(), "course", F.format_string("Unknown course '%s'", F.col("course"))),
             failed(F.col("idx") > F.col("_first"), "duplicate", "Duplicate (date, course) pair in batch")]
    if today:
        rules.append(failed(F.col("_d") > F.lit(today).cast("date"), "future", "Date is in the future"))
    if max_count is not None:
        rules.append(failed(F.col("applicant_count") > max_count, "implausible", f"applicant_count above {max_count} per day"))
    found = rows.select("idx", F.explode(F.array_compact(F.array(*rules))).alias("e"))
    return found.select("idx", F.format_string("daily_volumes[%d].%s", F.col("idx"), F.col("e.rule")).alias("field"),
                        F.col("e.rule").alias("rule"), F.col("e.error").alias("error"))


def validation_summary(batch: DataFrame, errors: DataFrame,
                       max_records: int | None = None) -> DataFrame:
    """One row: received, valid, per-rule error counts, accepted flag (whole batch or nothing).

    A batch size limit applies only if the caller sets ``max_records``.
    """
    received = batch.select(F.count(F.lit(1))).scalar()
    bad_ids = errors.select(F.countDistinct("idx")).scalar()
    counts = errors.groupBy().pivot("rule", ["date", "applicant_count", "course", "duplicate", "future",
                                             "implausible"]).count()
    out = counts.select(
        received.alias("records_received"),
        (received - bad_ids).alias("records_valid"),
        *[F.coalesce(F.col(r), F.lit(0)).cast("long").alias(f"n_{r}") for r in
          ["date", "applicant_count", "course", "duplicate", "future", "implausible"]])
    too_many = F.lit(False) if max_records is None else F.col("records_received") > max_records
    return out.withColumn("too_many_records", too_many).withColumn(
        "accepted", (F.col("records_valid") == F.col("records_received")) & ~too_many)


def parse_records(batch: DataFrame, batch_seq: int) -> DataFrame:
    """Valid records to the volume schema with their arrival keys."""
    return batch.select(
        F.to_date("date", DATE_FORMAT).alias("date"), F.col("course").alias("series_key"),
        F.col("applicant_count").cast("long").alias("cnt"),
        F.lit(batch_seq).cast("long").alias("batch_seq"), F.col("idx").cast("long").alias("idx"))


def keep_last(rows: DataFrame) -> DataFrame:
    """One row per (date, key): highest batch_seq, then highest idx.

    ``max_by`` is a partial aggregate: every map task keeps only its latest
    row per key before the shuffle, so a hot key is never held whole.
    """
    latest = F.max_by(F.struct("cnt", "batch_seq", "idx"), F.struct("batch_seq", "idx"))
    return (rows.groupBy("date", "series_key").agg(latest.alias("_l"))
            .select("date", "series_key", "_l.cnt", "_l.batch_seq", "_l.idx"))


def upsert(stored: DataFrame, incoming: DataFrame, sync_type: str = "incremental") -> DataFrame:
    """Full replaces the table; incremental unions and keeps the last row per key.

    Both inputs carry (date, series_key, cnt, batch_seq, idx).  Full sync is
    deduplicated as well (B11 fixed): duplicates inside one batch never
    survive.
    """
    if sync_type not in ("full", "incremental"):
        raise ValueError("sync_type must be 'full' or 'incremental'")
    rows = incoming if sync_type == "full" else stored.unionByName(incoming)
    return keep_last(rows)


def upsert_metrics(table: DataFrame, incoming: DataFrame, sync_type: str) -> DataFrame:
    """Metrics of G1: total rows, rows in the batch (not net new), first / last date."""
    n_in = incoming.select(F.count(F.lit(1))).scalar()
    return table.agg(
        F.lit(sync_type).alias("sync_type"),
        F.count(F.lit(1)).alias("total_records"),
        n_in.alias("new_records_added"),
        F.date_format(F.min("date"), DATE_FORMAT).alias("start_date"),
        F.date_format(F.max("date"), DATE_FORMAT).alias("end_date"))


def retrain_decision(new_days, manual: bool = False, sync_type: str = "incremental",
                     days_since_training=None, drift_percent=None):
    """M12 + M13 as Column expressions: (effective new days, should_retrain, reason).

    Full sync counts as 999 new days.  The documented extra criteria
    (>= 7 days since training, |drift| > 20 %) apply when given.
    """
    nd = F.lit(C.FULL_SYNC_NEW_DAYS).cast("long") if sync_type == "full" else F.col(new_days) \
        if isinstance(new_days, str) else new_days
    thr = C.RETRAIN_MIN_NEW_DAYS
    reason = F.when(F.lit(manual), F.lit("Manual retraining requested")).when(
        nd >= thr, F.format_string(f"Sufficient new data (%d new days >= {thr} threshold)", nd))
    if days_since_training is not None:
        reason = reason.when(days_since_training >= C.RETRAIN_MAX_DAYS_SINCE_TRAINING,
                             F.format_string("Scheduled retraining (%d days since last)", days_since_training))
    if drift_percent is not None:
        reason = reason.when(F.abs(drift_percent) > C.RETRAIN_DRIFT_PERCENT,
                             F.format_string("Significant volume drift (%+.1f%%)", drift_percent))
    should = reason.isNotNull()
    reason = F.coalesce(reason, F.format_string(
        f"No retraining needed (%d new days < {thr} threshold)", nd))
    return nd, should, reason


# ---------------------------------------------------------------------------
# versioned table writes
# ---------------------------------------------------------------------------

def write_version(df: DataFrame | list[DataFrame], root: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as a new immutable version under ``root``, then publish a pointer to it.

    A list of tables is one version too: they are written one after the other, and the pointer follows the last.

    Everything goes through Spark's writers, so ``root`` may be any
    Hadoop-compatible store (HDFS, object stores, a shared mount).  The data
    lands in ``v_<version>``; only after that write has committed is a
    one-row pointer written to ``_pointers/p_<version>`` (append-only, never
    overwritten).  Readers take the newest committed pointer, so they see
    either the old or the new version, never a partial one, and a job that
    dies mid-write leaves the current version untouched.  Rewriting a table
    that is being read is safe: a new version never overwrites the input.
    """
    tables = df if isinstance(df, list) else [df]
    spark = tables[0].sparkSession
    version = f"{int(time.time() * 1000):013d}_{uuid.uuid4().hex[:12]}"
    path = f"{root.rstrip('/')}/v_{version}"
    for i, table in enumerate(tables):
        writer = table.write.mode("append" if i else "errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    pointer = spark.createDataFrame([(version, path)], POINTER_SCHEMA)
    pointer.coalesce(1).write.mode("errorifexists").json(f"{root.rstrip('/')}/_pointers/p_{version}")
    return path


POINTER_SCHEMA = "version string, path string"


def current_path(spark: SparkSession, root: str) -> str | None:
    """Path of the newest committed version under ``root`` (None when there is none).

    Only a missing pointer folder means that there is none; any other error is raised.
    """
    if not path_exists(spark, f"{root.rstrip('/')}/_pointers"):
        return None
    ptr = (spark.read.schema(POINTER_SCHEMA).option("recursiveFileLookup", "true")
           .json(f"{root.rstrip('/')}/_pointers"))
    row = ptr.orderBy(F.desc("version")).limit(1).collect()
    return row[0].path if row else None


def read_current(spark: SparkSession, root: str, schema=None) -> DataFrame | None:
    """(re)read the current version of a versioned table; None if there is none."""
    path = current_path(spark, root)
    if path is None:
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)
