"""Payload batches as a stream: each file is validated, published or quarantined as a whole, once.

``readStream`` takes one line-delimited payload file an epoch.  Its records are published to the snapshot table in
one commit that names the stream and the epoch, so a replayed epoch finds itself there and publishes nothing; its
other results (error rows, the decision on retraining) go to a folder named by the epoch, which a
replay overwrites with the same rows; a refit is by digest, so a second one fits nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwell.operators import ingest as IG, series as SR
from planwell.operators.snapshots import SnapshotTable
from planwell.plans import training as TR
from planwell.plans.ingest_flow import METRICS, ingest_batch
from planwell.session import path_exists
from planwell.sources import tables as T

WRITER = "payload-stream"
DECISIONS = f"epoch long, accepted boolean, received long, {METRICS}"
QUARANTINE = f"epoch long, {IG.ERROR_SCHEMA}"


class IngestStream:
    """Folders under ``root``: ``volume`` (snapshots), ``quarantine``, ``decisions`` and ``params``."""

    def __init__(self, spark: SparkSession, root: str, known_keys: DataFrame, cutoff: str, today: str | None = None,
                 max_count: int | None = None, retrain: bool = True):
        self.spark, self.root, self.known_keys = spark, root.rstrip("/"), known_keys
        self.cutoff, self.today, self.max_count, self.retrain = cutoff, today, max_count, retrain
        self.volume = SnapshotTable(spark, f"{self.root}/volume")

    def apply(self, lines: DataFrame, epoch: int) -> None:
        """What one epoch does to the tables; calling it again changes nothing."""
        header, records, broken = T.payload_lines(lines)
        head = header.first()
        if head.sync_type not in ("full", "incremental"):
            problem = f"sync_type must be 'full' or 'incremental', not '{head.sync_type}'"
            wrong = self.spark.createDataFrame([(-1, "sync_type", "malformed", problem)], IG.ERROR_SCHEMA)
            broken = broken.unionByName(wrong)
        sync = "full" if head.sync_type == "full" else "incremental"
        done = ingest_batch(self.volume, records, sync, head.manual_retrain, self.today, self.known_keys, self.max_count,
                            writer=WRITER, batch_number=epoch, malformed=broken)
        errors = done.errors if done.errors is not None else self.spark.createDataFrame([], IG.ERROR_SCHEMA)
        errors.select(F.lit(epoch).cast("long").alias("epoch"), "*").write.mode("overwrite").parquet(f"{self.root}/quarantine/batch={epoch}")
        if self.retrain and done.accepted and done.should_retrain:
            daily = self.volume.read().select("date", "series_key", "cnt")
            TR.refit(SR.weekly_series(daily, self.cutoff), TR.WEEKLY_KEYS, f"{self.root}/params", "week")
        row = (epoch, done.accepted, done.received, *[getattr(done.metrics(self.spark).first(), c.split(" ")[0]) for c in METRICS.split(", ")])
        self.spark.createDataFrame([row], DECISIONS).write.mode("overwrite").parquet(f"{self.root}/decisions/batch={epoch}")

    def run(self, source: str, available_now: bool = True):
        """Start the stream over a folder of payload files; returns the query."""
        lines = self.spark.readStream.option("maxFilesPerTrigger", 1).text(source)
        writer = lines.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.root}/checkpoint")
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
        return writer.start()

    def _read(self, folder: str, schema: str) -> DataFrame:
        path = f"{self.root}/{folder}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)

    def decisions(self) -> DataFrame:
        """One row an epoch: accepted or not, the metrics, and whether and why models were trained."""
        return self._read("decisions", DECISIONS)

    def quarantine(self) -> DataFrame:
        """The error rows of rejected batches."""
        return self._read("quarantine", QUARANTINE)


def write_payload(records: DataFrame, path: str, sync_type: str, source: str = "events", manual_retrain: bool = False,
                  lines: int = 500) -> None:
    """Records (idx, date, course, applicant_count) as one line-delimited payload file, about ``lines`` records a line."""
    part = F.floor(F.col("idx") / lines)
    record = F.struct("date", "course", "applicant_count")
    rows = records.groupBy(part.alias("p")).agg(F.sort_array(F.collect_list(F.struct("idx", record.alias("r")))).alias("all"))
    rows = rows.select(F.to_json(F.struct(
        F.lit(source).alias("source"), F.lit(sync_type).alias("sync_type"), F.lit(manual_retrain).alias("manual_retrain"),
        (F.col("p") * lines).alias("offset"), F.transform("all", lambda x: x["r"]).alias("daily_volumes"))).alias("value"))
    rows.coalesce(1).write.mode("append").text(path)
