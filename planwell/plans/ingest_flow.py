"""One batch from records to a published snapshot and a retrain decision (G2), for the API and for the stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwell.operators import ingest as IG
from planwell.operators.snapshots import SnapshotTable
from planwell.session import checkpoint, discard

METRICS = ("sync_type string, total_records long, new_records_added long, start_date string, end_date string, "
           "new_days long, retraining_triggered boolean, retraining_reason string")


@dataclass
class Ingested:
    """What became of a batch; ``errors`` holds the error rows of a rejected one."""
    accepted: bool
    received: int
    too_many: bool = False
    errors: DataFrame | None = None
    sync_type: str = "incremental"
    total: int = 0
    first: str | None = None
    last: str | None = None
    new_days: int = 0
    should_retrain: bool = False
    reason: str | None = None
    snapshot: int | None = None

    def metrics(self, spark: SparkSession) -> DataFrame:
        """The one-row answer of G2."""
        return spark.createDataFrame([(self.sync_type, self.total, self.received, self.first, self.last, self.new_days,
                                       self.should_retrain, self.reason)], METRICS)


def ingest_batch(table: SnapshotTable, batch: DataFrame, sync_type: str = "incremental", manual_retrain: bool = False,
                 today: str | None = None, known_keys: DataFrame | None = None, max_count: int | None = None,
                 max_records: int | None = None, writer: str | None = None, batch_number: int | None = None,
                 malformed: DataFrame | None = None) -> Ingested:
    """Validate the records (idx, date, course, applicant_count) as a whole, publish them, decide on retraining.

    Totals and dates come from the snapshot's manifest and new days from the batch, so an incremental batch reads no
    month that it does not touch.  With ``writer`` and ``batch_number`` a replayed batch publishes nothing.
    ``malformed`` holds error rows of what could not be read as a record; one of them rejects the batch too.
    """
    if sync_type not in ("full", "incremental"):
        raise ValueError("sync_type must be 'full' or 'incremental'")
    spark = table.spark
    # a replayed batch is judged by the table as it was before it
    base = table.snapshot() if writer is None else table.before(writer, batch_number)
    if known_keys is None:
        if base is None:
            raise ValueError("a first batch needs known_keys: the keys that it may hold")
        known_keys = table.read(number=base.number)
    batch = checkpoint(batch.select("idx", "date", "course", "applicant_count"))
    errors = IG.validate_records(batch, known_keys.select("series_key"), today=today, max_count=max_count)
    if malformed is not None:
        errors = malformed.unionByName(errors)
    errors = checkpoint(errors)
    checked = IG.validation_summary(batch, errors, max_records).first()
    broken = 0 if malformed is None else errors.where("rule = 'malformed'").count()
    if not checked.accepted or broken:
        discard(batch)
        return Ingested(False, checked.records_received + broken, checked.too_many_records, errors, sync_type)
    discard(errors)
    incoming = IG.parse_records(batch, 0).drop("batch_seq")
    before = base.last if base else None
    snap = table.upsert(incoming, sync_type, writer, batch_number)
    fresh = incoming.where(F.col("date") > F.lit(before).cast("date")) if before else incoming
    days = fresh.agg(F.countDistinct("date").alias("new_days"))
    nd, should, reason = IG.retrain_decision(F.col("new_days"), manual_retrain, sync_type)
    said = days.select(nd.cast("long").alias("n"), should.alias("s"), reason.alias("r")).first()
    discard(batch)
    return Ingested(True, checked.records_received, False, None, sync_type, snap.rows, snap.first, snap.last, said.n, said.s, said.r, snap.number)
