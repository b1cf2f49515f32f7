"""Daily counts with event-time state: open days live in the state store, late rows become corrections (2.13).

A watermark follows the largest event time seen, ``DELAY`` behind it.  A day is open until the watermark
passes its end: its count per key is state and goes out again whenever it changes (update mode).  Then it is closed
and its state removed, so the state holds the open days only, however long the stream runs.  A row that comes for a
closed day is not lost: it goes out as an additive correction.  A hot key is spread over ``SALTS`` groups.

Each epoch's output is a folder of its own, which a replayed epoch overwrites.  Every ``COMPACT_EVERY`` epochs
the folders become one base table, in which closed days are plain sums, and are deleted, so the number of files
is bounded too.
"""

from __future__ import annotations

import calendar
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from planwell.session import ensure_checkpoint_dir, path_exists
from planwell.streaming.volume_stream import event_stream

DELAY, SALTS, COMPACT_EVERY = "2 days", 8, 8
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: kind: 'open' and 'closed' give the day's count so far, 'late' one to be added
OUTPUT = "date date, series_key string, salt int, kind string, n long"


class DayCount(StatefulProcessor):
    """The state of one (day, key, salt): its count while the day is open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    @staticmethod
    def _row(key, kind: str, n: int) -> pd.DataFrame:
        date, series_key, salt = key
        return pd.DataFrame({"date": [date], "series_key": [series_key], "salt": [salt], "kind": [kind], "n": [n]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = sum(len(b) for b in rows)
        end = (calendar.timegm(key[0].timetuple()) + 86_400) * 1000
        if self.count.exists():
            n += self.count.get()[0]
        elif end <= timerValues.getCurrentWatermarkInMs():
            yield self._row(key, "late", n)  # the day is closed: a correction, and no state
            return
        else:
            self.handle.registerTimer(end)
        self.count.update((n,))
        yield self._row(key, "open", n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0]
        self.count.clear()
        yield self._row(key, "closed", n)

    def close(self) -> None:
        pass


def counted(events: DataFrame, delay: str = DELAY, salts: int = SALTS) -> DataFrame:
    """The stream of changes to the daily counts of a stream of events (event_id, ts, event_type)."""
    rows = events.where(F.col("ts").isNotNull() & F.col("event_type").isNotNull()).withWatermark("ts", delay)
    # only the day goes on, not the time that carries the watermark: Spark drops late rows by that column, and
    # here they shall come to the state function as well
    rows = rows.select(F.to_date(F.col("ts")).alias("date"), F.col("event_type").alias("series_key"),
                       F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int").alias("salt"))
    return rows.groupBy("date", "series_key", "salt").transformWithStateInPandas(
        statefulProcessor=DayCount(), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")


class CountTable:
    """The output folders under ``root``: ``epochs/epoch=<n>`` and ``base/through=<n>``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self, folder: str) -> list[int]:
        """Numbers of the folders whose write has been committed."""
        top = f"{self.root}/{folder}"
        if not path_exists(self.spark, top):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(top)
        names = [s.getPath().getName() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]
        return sorted(int(n.split("=")[1]) for n in names if "=" in n and path_exists(self.spark, f"{top}/{n}/_SUCCESS"))

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def add_epoch(self, batch: DataFrame, epoch: int) -> None:
        batch.hint("rebalance").write.mode("overwrite").parquet(f"{self.root}/epochs/epoch={epoch}")
        if len(self._numbers("epochs")) >= COMPACT_EVERY:
            self.compact()

    def changes(self) -> DataFrame:
        """All rows that count: the newest base and the epochs after it."""
        base = self._numbers("base")
        through = base[-1] if base else -1
        paths = [f"{self.root}/base/through={through}"] if base else []
        paths += [f"{self.root}/epochs/epoch={n}" for n in self._numbers("epochs") if n > through]
        if not paths:
            return self.spark.createDataFrame([], OUTPUT)
        return self.spark.read.schema(OUTPUT).parquet(*paths)

    def compact(self) -> None:
        """Fold all epochs into one base: closed days become sums, open days keep their latest count."""
        done = self._numbers("epochs")
        if not done:
            return
        bases = self._numbers("base")
        day = self.changes().groupBy("date", "series_key", "salt").agg(
            F.max(F.when(F.col("kind") != "late", F.col("n"))).alias("latest"), F.sum(F.when(F.col("kind") == "late", F.col("n"))).alias("late"),
            F.bool_or(F.col("kind") == "closed").alias("closed"))
        closed = F.coalesce(F.col("closed"), F.lit(False))
        sums = day.select("date", "series_key", F.coalesce("late", F.lit(0)).alias("late"),
                          F.when(closed, F.col("latest")).otherwise(0).alias("final"))
        sums = sums.groupBy("date", "series_key").agg(F.sum(F.col("late") + F.col("final")).alias("n")).where("n > 0").select(
            "date", "series_key", F.lit(-1).alias("salt"), F.lit("late").alias("kind"), "n")
        still = day.where(~closed & F.col("latest").isNotNull()).select("date", "series_key", "salt", F.lit("open").alias("kind"), F.col("latest").alias("n"))
        sums.unionByName(still).hint("rebalance").write.mode("overwrite").parquet(f"{self.root}/base/through={done[-1]}")
        # readers that planned on the old files finish or read again: what they name goes only now
        for n in done:
            self._delete(f"{self.root}/epochs/epoch={n}")
        for n in bases:
            if n != done[-1]:
                self._delete(f"{self.root}/base/through={n}")

    def read(self) -> DataFrame:
        """(date, series_key, cnt) as of the last epoch."""
        day = self.changes().groupBy("date", "series_key", "salt").agg(
            F.coalesce(F.max(F.when(F.col("kind") != "late", F.col("n"))), F.lit(0)).alias("latest"),
            F.coalesce(F.sum(F.when(F.col("kind") == "late", F.col("n"))), F.lit(0)).alias("late"))
        return day.groupBy("date", "series_key").agg(F.sum(F.col("latest") + F.col("late")).alias("cnt"))


def run(spark: SparkSession, source: str, root: str, max_files_per_trigger: int | None = None, available_now: bool = True,
        delay: str = DELAY):
    """Run the stream of ``source`` into ``CountTable(root/table)``; returns the query."""
    table = CountTable(spark, f"{root}/table")
    writer = counted(event_stream(spark, source, max_files_per_trigger), delay).writeStream.outputMode("update").foreachBatch(table.add_epoch)
    writer = writer.option("checkpointLocation", f"{root}/checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # timers need this store; a query keeps the setting that it starts with
    try:
        return writer.start()
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def unordered_copy(events: DataFrame, path: str, files: int) -> str:
    """The events as so many files, each with rows of all days: a source in which most rows come late."""
    for part in range(files):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(files)) == part).coalesce(1).write.mode("append").parquet(path)
    return path


def stream_event_time(spark: SparkSession, sf_dir: str, files: int = 4) -> DataFrame:
    """Daily counts by the stateful stream over the events table, dealt into files out of order."""
    root = os.path.join(ensure_checkpoint_dir(spark), "streams", uuid.uuid4().hex)
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    source = unordered_copy(events, f"{root}/source", files)
    run(spark, source, root, max_files_per_trigger=1).awaitTermination()
    return CountTable(spark, f"{root}/table").read()
