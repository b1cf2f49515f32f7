"""Ordered statistics without a global window: running sums over range partitions, medians and modes from counts.

Values are counted first, so a value that a third of all rows share is one row with a count.  The counts are then
range-partitioned by value; each partition adds up its own and the partition totals (one row a partition) give the
offsets.  No key and no partition holds more than its range of distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planwell.session import checkpoint

PART = "_part"


def running_sums(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """``<v>_before``: the sum of ``v`` over all rows that come earlier in the global order.

    The order must be unique for a definite result.  Rows are sampled and sorted by ranges; ``Window`` works inside a
    range only, and the ranges' totals are few enough for the driver (a row a shuffle partition).
    """
    spark = df.sparkSession
    ranged = checkpoint(df.repartitionByRange(*[F.col(c) for c in order]).withColumn(PART, F.spark_partition_id()))
    totals = ranged.groupBy(PART).agg(*[F.sum(v).alias(v) for v in values]).orderBy(PART).collect()
    rows, base = [], dict.fromkeys(values, 0)
    for r in totals:
        rows.append((r[PART], *[base[v] for v in values]))
        base = {v: base[v] + (r[v] or 0) for v in values}
    offsets = spark.createDataFrame(rows, f"{PART} int, " + ", ".join(f"_o_{v} long" for v in values))
    inside = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_i_{v}") for v in values])
    out = here.join(F.broadcast(offsets), PART)
    return out.select(*df.columns, *[(F.col(f"_o_{v}") + F.col(f"_i_{v}")).cast("long").alias(f"{v}_before") for v in values])


def label_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, dimension, label, n): how often each non-null label of each column comes in each group, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("label")) for c in columns])
    long = df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.dimension", "_p.label")
    return long.where(F.col("label").isNotNull()).groupBy(*keys, "dimension", "label").agg(F.count(F.lit(1)).alias("n"))


def modes(counts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per group the most frequent label of every column (the smallest of equal ones), null if it has none.

    ``counts`` is ``label_counts``: the maximum is an ordinary partial aggregate over the counted labels.
    """
    best = [F.min_by("label", F.when(F.col("dimension") == c, F.struct(-F.col("n"), F.col("label")))).alias(c) for c in columns]
    # min_by skips rows whose order is null: those of the other columns
    return counts.groupBy(*keys).agg(*best)


def medians(counts: DataFrame, keys: list[str], value: str = "value", n: str = "n") -> DataFrame:
    """(keys, median): exact medians of the values counted in ``counts`` (keys, value, n), null values left out.

    Rows are ordered by key and value over all keys together, so a large key is spread over many partitions.
    """
    rows = counts.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.col(n).cast("long").alias("_n"))
    rows = running_sums(rows, [*keys, "_v"], ["_n"])
    ends = rows.groupBy(*keys).agg(F.min("_n_before").alias("_start"), F.sum("_n").alias("_all"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    placed = rows.join(ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_start", "_all"), on)
    at = F.col("_n_before") - F.col("_start")
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)

    def covers(place):
        return (at <= place) & (place < at + F.col("_n"))

    return placed.where(covers(low) | covers(high)).groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias("median"))
