"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: bytes of one batch on its way to or from a Python worker, unless the session says otherwise: rows with whole texts
#: would fill Spark's own default of 64 MB several times over in each running task
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def bound_batches(spark: SparkSession) -> None:
    """Set ``BATCH_CONF`` where neither the cluster nor the user has."""
    if BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "planwell", driver_memory: str | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings every job here assumes.

    On a cluster, pass no master: the launcher decides.  ``shuffle_partitions``
    should be sized so one partition of the largest shuffle fits an executor;
    AQE coalesces small ones at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory and master and master.startswith("local"):
        # in local mode the driver JVM is the only executor; on a cluster the launcher sizes it
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for cut lineage and written tables; the same path on every call.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a folder already
    registered on the context is used; a local master (tests, a laptop) gets a fresh one,
    registered once.  Any other master must name a folder that all executors share.
    """
    bound_batches(spark)
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.getCheckpointDir():
        if not re.match(r"local(\[[^-]*\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="planwell-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


#: Spark deletes the shuffle files of a query when it ends, not when the driver's JVM collects its plan
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Inside, each query's shuffle files are deleted when it ends: for writes, whose plans nobody runs again."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF)
        if before is not None:
            spark.conf.set(CLEANUP_CONF, before)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver's JVM collect what nothing refers to any more: only then does Spark delete the shuffle files and
    broadcasts of jobs that are no SQL queries (all passes of a forest)."""
    spark._jvm.System.gc()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system that Spark would read it with; other errors are raised."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def checkpoint(df, compression: str = "zstd"):
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and cut its lineage.

    A written table (rather than ``DataFrame.checkpoint``'s serialized row
    blocks) keeps later reads columnar: they prune columns and push filters
    into the scan.  The table survives lost executors; ``discard`` removes it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.planwell_path = path
    return out


def discard(*tables) -> None:
    """Delete tables made by ``checkpoint`` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "planwell_path", None)
        if path:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
