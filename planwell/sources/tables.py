"""Scans of the input tables and the derived views every operator reads.

All views are lazy DataFrames; selecting only the needed columns up front
lets Catalyst prune the Parquet ReadSchema, and filters applied later are
pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planwell import config as C
from planwell.session import path_exists

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Schemas of the canonical long tables (T1, T2); never inferred.
VOLUME_SCHEMA = T.StructType([
    T.StructField("date", T.DateType(), False),
    T.StructField("series_key", T.StringType(), False),
    T.StructField("cnt", T.LongType(), False),
])
LEARNER_SCHEMA = T.StructType([
    T.StructField("record_id", T.LongType(), False),
    T.StructField("site", T.StringType(), True),
    T.StructField("course", T.StringType(), True),
    T.StructField("age", T.IntegerType(), True),
    T.StructField("sex", T.StringType(), True),
    T.StructField("education", T.StringType(), True),
    T.StructField("employment", T.StringType(), True),
    T.StructField("skill", T.StringType(), True),
    T.StructField("career", T.StringType(), True),
    T.StructField("classification", T.StringType(), True),
    T.StructField("outcome", T.StringType(), True),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one input table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def require_columns(df: DataFrame, required: list[str] | set[str]) -> DataFrame:
    """raise when a required column is missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"dataset is missing columns: {missing}")
    return df


def optional_table(spark: SparkSession, path: str | None, schema: T.StructType,
                   required: str | None = None) -> DataFrame:
    """A missing path, or a table without ``required``, yields an empty frame."""
    empty = spark.createDataFrame([], schema)
    if not path:
        return empty
    if not path_exists(spark, path):
        return empty
    df = spark.read.schema(schema).parquet(path)
    if required and required not in df.columns:
        return empty
    return df


def daily_volume_from_events(raw: DataFrame, ts: str, key: str, until: str | None = None) -> DataFrame:
    """Raw rows to daily counts per key; rows with a null key or time are dropped.

    ``until`` (a date, inclusive) is applied to the raw timestamp as
    ``ts < until + 1 day`` so the Parquet scan can prune on it.
    """
    if until:
        # the bound takes the column's own type (TIMESTAMP or TIMESTAMP_NTZ), so the
        # comparison means the same calendar day in any session time zone
        bound = F.date_add(F.lit(until).cast("date"), 1).cast(raw.schema[ts].dataType)
        raw = raw.where(F.col(ts) < bound)
    return (raw.where(F.col(ts).isNotNull() & F.col(key).isNotNull())
            .groupBy(F.to_date(ts).alias("date"), F.col(key).alias("series_key"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def volume(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """Main daily volume: date = ship date, series key = part brand, cnt = lines.

    lineitem is the fact side; part is joined on its key.  Spark decides the
    join strategy from the scan sizes (broadcast only under
    ``autoBroadcastJoinThreshold``, otherwise sort-merge with AQE skew
    splitting), and the count is partially aggregated before its shuffle.
    """
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = li.join(part, li.l_partkey == part.p_partkey)
    return daily_volume_from_events(joined, "l_shipdate", "p_brand", until)


def volume_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quick daily volume: order date by order priority (5 keys)."""
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderpriority")
    return daily_volume_from_events(orders, "o_orderdate", "o_orderpriority")


def volume_two_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy monthly volume with two keys: month start, site = nation, key = order status (T4)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (orders.join(customer, orders.o_custkey == customer.c_custkey)
              .join(nation, F.col("c_nationkey") == nation.n_nationkey))
    return (joined.where(F.col("o_orderdate").isNotNull())
            .groupBy(F.trunc(F.to_date("o_orderdate"), "MM").alias("date"),
                     F.col("n_name").alias("site"),
                     F.col("o_orderstatus").alias("series_key"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts from ``events`` (the ingestion source): date, key = event type, cnt."""
    events = table(spark, sf_dir, "events").select("ts", "event_type")
    return daily_volume_from_events(events, "ts", "event_type")


def completed_expr(quantity: Column, discount: Column) -> Column:
    """Derived, deterministic completion of one learner record."""
    return quantity * (F.lit(1.0) - discount) >= F.lit(24.0)


def outcome_expr(completed: Column) -> Column:
    """The outcome's label; a completion that is not known counts as none."""
    return F.when(completed, F.lit(C.GRADUATE_LABEL)).otherwise(F.lit(C.DROPOUT_LABEL))


def learners(spark: SparkSession, sf_dir: str, piece: tuple[int, int] | None = None) -> DataFrame:
    """Learner records (T2) from (lineitem x part) x (orders x customer x nation).

    ``piece`` = (i, n) gives the records of the i-th of n parts of the orders, dealt by the hash of their key: both sides
    are narrowed before their shuffles, and the n pieces together are the view.

    ``record_id`` = orderkey * 8 + linenumber is unique per line and gives the
    split a stable order.  Every foreign key matches, so inner joins keep all
    lines.
    """
    def dealt(df: DataFrame, key: str) -> DataFrame:
        return df if piece is None else df.where(F.pmod(F.xxhash64(key), F.lit(piece[1])) == piece[0])

    li = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus",
        # a flag is shuffled instead of the two numbers behind it
        completed_expr(F.col("l_quantity"), F.col("l_discount")).alias("_completed"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    orders = dealt(table(spark, sf_dir, "orders"), "o_orderkey").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Join order for scale: the customer side is resolved at orders size first
    # (orders x customer x nation), so the lineitem-sized rows are shuffled only
    # twice (by part key, then by order key) instead of three times.
    order_side = (orders.join(customer, orders.o_custkey == customer.c_custkey)
                  .join(nation, F.col("c_nationkey") == nation.n_nationkey)
                  .select("o_orderkey", "o_orderpriority", "o_orderstatus", "c_mktsegment", "n_name"))
    line_side = li.join(part, li.l_partkey == part.p_partkey)
    joined = line_side.join(order_side, line_side.l_orderkey == order_side.o_orderkey)
    return joined.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("record_id"),
        F.col("n_name").alias("site"),
        F.col("p_brand").alias("course"),
        F.col("p_size").cast("int").alias("age"),
        F.when(F.col("l_linestatus") == "O", C.MALE_LABEL).when(F.col("l_linestatus") == "F", C.FEMALE_LABEL).alias("sex"),
        F.col("o_orderpriority").alias("education"),
        F.col("l_returnflag").alias("employment"),
        F.col("p_type").alias("skill"),
        F.col("c_mktsegment").alias("career"),
        F.col("o_orderstatus").alias("classification"),
        outcome_expr(F.col("_completed")).alias("outcome"),
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration events (site, course): one per order, site = nation, course = order priority."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == nation.n_nationkey)
            .select(F.col("n_name").alias("site"), F.col("o_orderpriority").alias("course")))


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learner records without those of every fifth nation: sites that have registrations only."""
    nation = table(spark, sf_dir, "nation")
    without = nation.where(F.col("n_nationkey") % 5 == 0).select(F.col("n_name").alias("_without"))
    records = learners(spark, sf_dir)
    return records.join(without, records.site == F.col("_without"), "left_anti")


def ml_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: label = quality, features lang, source, n_chars."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return labels.join(docs, "doc_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed prediction table (label, score, pred) so metrics have an SQL oracle."""
    base = ml_labelled(spark, sf_dir)
    score = (F.col("toxic") * F.lit(0.5)
             + F.lit(0.5) * (F.col("n_chars") / (F.col("n_chars") + F.lit(20000.0))))
    return base.select(
        "doc_id",
        F.col("quality").cast("int").alias("label"),
        score.alias("score"),
    ).withColumn("pred", (F.col("score") >= F.lit(0.25)).cast("int"))


# Ingest payload (S9): header fields plus an array of daily records.
PAYLOAD_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("data_version", T.StringType()),
    T.StructField("sync_type", T.StringType()),
    T.StructField("date_range", T.StructType([
        T.StructField("start_date", T.StringType()), T.StructField("end_date", T.StringType())])),
    T.StructField("daily_volumes", T.ArrayType(T.StructType([
        T.StructField("date", T.StringType()), T.StructField("course", T.StringType()),
        T.StructField("applicant_count", T.LongType())]))),
    T.StructField("manual_retrain", T.BooleanType()),
])


def ingest_payload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read batch payload documents (multi-line JSON) with an explicit schema.

    Returns (header, records).  ``records`` keeps each record's position in
    its array as ``idx`` (``posexplode``), which is what error messages cite;
    the payload's ``source`` travels with every record.  A document is one row, so this form is for
    batches that fit one; ``payload_lines`` reads batches of any size.
    """
    raw = spark.read.schema(PAYLOAD_SCHEMA).option("multiLine", True).json(path)
    header = raw.select("source", F.coalesce("data_version", F.lit("1.0")).alias("data_version"), "sync_type",
                        "date_range.start_date", "date_range.end_date",
                        F.coalesce("manual_retrain", F.lit(False)).alias("manual_retrain"))
    records = raw.select("source", F.posexplode("daily_volumes").alias("idx", "r")).select(
        "source", F.col("idx").cast("long").alias("idx"), "r.date", "r.course", "r.applicant_count")
    return header, records


HEADER_FIELDS = {"source": "string", "data_version": "string", "sync_type": "string", "manual_retrain": "boolean"}


def payload_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S9 for line-delimited payloads: (header, records, broken) of the lines (column ``value``) of one batch.

    Each line is a JSON object with a part of the batch's ``daily_volumes`` and the ``offset`` of its first
    record (0 if missing), so a batch is as many rows as it has lines and is read by as many tasks; the
    header fields may stand in any of the lines (the largest value counts).  Lines are parsed into VARIANT
    values without a schema: a line that is no JSON, and a record that is no object with a date, a course and a whole
    number, become rows of ``broken`` (idx, field, rule, error) instead of failing the file.  Fields that
    nobody asked for are ignored.  Empty lines are skipped.
    """
    spark = lines.sparkSession
    parsed = lines.where(F.trim("value") != "").select("value", F.try_parse_json("value").alias("v"))
    bad_line = F.col("v").isNull() | (F.schema_of_variant("v").substr(1, 6) != "OBJECT")
    good = parsed.where(~bad_line).select("v")
    header = good.agg(*[F.max(F.try_variant_get("v", f"$.{name}", kind)).alias(name) for name, kind in HEADER_FIELDS.items()],
                      F.min(F.try_variant_get("v", "$.date_range.start_date", "string")).alias("start_date"),
                      F.max(F.try_variant_get("v", "$.date_range.end_date", "string")).alias("end_date"))
    header = header.select("source", F.coalesce("data_version", F.lit("1.0")).alias("data_version"),
                           F.coalesce("sync_type", F.lit("incremental")).alias("sync_type"), "start_date", "end_date",
                           F.coalesce("manual_retrain", F.lit(False)).alias("manual_retrain"))
    each = spark.sql("SELECT coalesce(try_variant_get(v, '$.offset', 'bigint'), 0) + pos AS idx, value AS r "
                     "FROM {good}, LATERAL variant_explode(try_variant_get(v, '$.daily_volumes', 'variant'))", good=good)
    text = F.try_variant_get("r", "$.date", "string")
    # a number given as text, or with a fraction, is not a whole number
    whole = F.schema_of_variant(F.try_variant_get("r", "$.applicant_count", "variant")) == "BIGINT"
    records = each.select("idx", text.alias("date"), F.try_variant_get("r", "$.course", "string").alias("course"),
                          F.when(whole, F.try_variant_get("r", "$.applicant_count", "bigint")).alias("applicant_count"),
                          F.to_json(F.col("r")).alias("_json"))
    unusable = F.col("date").isNull() | F.col("course").isNull() | F.col("applicant_count").isNull()
    broken = parsed.where(bad_line).select(F.lit(-1).cast("long").alias("idx"), F.lit("line").alias("field"), F.lit("malformed").alias("rule"),
                                           F.concat(F.lit("Not a JSON object: "), F.substring("value", 1, 80)).alias("error"))
    broken = broken.unionByName(records.where(unusable).select(
        "idx", F.format_string("daily_volumes[%d]", "idx").alias("field"), F.lit("malformed").alias("rule"),
        F.concat(F.lit("Not a record: "), F.substring("_json", 1, 80)).alias("error")))
    return header, records.where(~unusable).drop("_json"), broken


# CSV layouts of the service's own files (header names as they appear in those files).
VOLUME_CSV_COLUMNS = {"date": "date", "course": "series_key", "applicant_count": "cnt"}
LEARNER_CSV_COLUMNS = {
    "barangay": "site", "course_applied": "course", "age": "age", "sex": "sex",
    "educational_attainment": "education", "employment_status": "employment",
    "current_skill": "skill", "desired_career": "career",
    "learner_classification": "classification", "training_outcome": "outcome",
}


def read_volume_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily volume CSV -> (date, series_key, cnt); required columns checked.

    Columns are read as text (no schema inference) and parsed explicitly.
    """
    raw = require_columns(spark.read.option("header", True).csv(path), list(VOLUME_CSV_COLUMNS))
    return raw.select(F.to_date("date", "yyyy-MM-dd").alias("date"), F.col("course").alias("series_key"),
                      F.col("applicant_count").cast("long").alias("cnt"))


def read_learners_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: learner CSV -> the learner schema; ``record_id`` is a per-row id assigned at read time."""
    raw = require_columns(spark.read.option("header", True).csv(path), list(LEARNER_CSV_COLUMNS))
    cols = [F.col(src).cast("int").alias(dst) if dst == "age" else F.col(src).alias(dst)
            for src, dst in LEARNER_CSV_COLUMNS.items()]
    return raw.select(F.monotonically_increasing_id().alias("record_id"), *cols)
