"""Regular series and ordered-series operators over the daily volume table.

Input is the long daily table (date, series_key, cnt).  Aggregation to a
coarser grain is a partial + final hash aggregate; the regular index is a
per-key spine ``explode(sequence(lo, hi, step))`` left-joined to the
observations.  Every window here runs over aggregated periods of one key
(bounded by the number of periods, not by raw rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planwell import config as C
from planwell.functions.scalars import month_start, week_end

GRAINS = {
    "day": ("INTERVAL 1 DAY", lambda c: c),
    "week": ("INTERVAL 7 DAYS", week_end),
    "month": ("INTERVAL 1 MONTH", month_start),
}


def _shift(col, grain: str, n: int):
    """Move a period ``n`` steps of its grain."""
    if grain == "month":
        return F.add_months(col, n)
    return F.date_add(col, n * (7 if grain == "week" else 1))


def _position(col, first, grain: str):
    """0-based index of a period counted from the first period of its series."""
    if grain == "month":
        return F.months_between(col, first).cast("int")
    days = F.datediff(col, first)
    return (days / 7).cast("int") if grain == "week" else days.cast("int")


def filter_key(df: DataFrame, key: str, value: str, column: str = "series_key") -> DataFrame:
    """F1 / F2: equality filter (pushed into the scan where the column is stored)."""
    return df.where(F.col(column) == F.lit(value))


def until(df: DataFrame, cutoff: str, column: str = "date") -> DataFrame:
    """``date <= cutoff`` (inclusive)."""
    return df.where(F.col(column) <= F.lit(cutoff).cast("date"))


def since(df: DataFrame, start: str, column: str = "date") -> DataFrame:
    """``date > start`` (strict)."""
    return df.where(F.col(column) > F.lit(start).cast("date"))


def regularise(obs: DataFrame, keys: list[str], period: str, grain: str,
               fill: float | None = 0.0, value: str = "y") -> DataFrame:
    """Regular index from each key's first to last period, gaps filled.

    ``obs`` holds keys, ``period`` and ``value`` (one row per key and period).
    One pass, no join: a window gives every observed period its successor,
    and each row emits itself plus the missing periods up to that successor.
    Output adds ``t`` (0-based position).  ``fill=None`` keeps gaps null.
    """
    interval = GRAINS[grain][0]
    ordered = Window.partitionBy(*keys).orderBy(period) if keys else Window.orderBy(period)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    x = obs.select(*keys, F.col(period).alias("_p"), F.col(value).cast("double").alias("_v"),
                   F.lead(period).over(ordered).alias("_next"), F.min(period).over(whole).alias("_first"))
    start, stop = _shift(F.col("_p"), grain, 1), _shift(F.col("_next"), grain, -1)
    gaps = F.when(F.col("_next").isNotNull() & (stop >= start),
                  F.sequence(start, stop, F.expr(interval))).otherwise(F.array().cast("array<date>"))
    filler = F.lit(fill).cast("double") if fill is not None else F.lit(None).cast("double")
    items = F.concat(F.array(F.struct(F.col("_p").alias("p"), F.col("_v").alias("v"))),
                     F.transform(gaps, lambda d: F.struct(d.alias("p"), filler.alias("v"))))
    out = x.select(*keys, "_first", F.explode(items).alias("_i"))
    y = F.col("_i.v")
    if fill is not None:
        y = F.coalesce(y, F.lit(float(fill)))
    return out.select(*keys, F.col("_i.p").alias(period),
                      _position(F.col("_i.p"), F.col("_first"), grain).alias("t"), y.alias(value))


def resample(daily: DataFrame, grain: str, keys: list[str] | None = None,
             cutoff: str | None = None, fill: float | None = 0.0) -> DataFrame:
    """A2-A5: sum daily counts per key (or in total when ``keys`` is empty) to a grain.

    Weekly periods end on Sunday; monthly periods are month starts.
    """
    keys = list(keys or [])
    src = until(daily, cutoff) if cutoff else daily
    to_period = GRAINS[grain][1]
    obs = (src.groupBy(*keys, to_period(F.col("date")).alias(grain))
           .agg(F.sum("cnt").alias("y")))
    return regularise(obs, keys, grain, grain, fill=fill)


def weekly_series(daily: DataFrame, cutoff: str = C.DEFAULT_CUTOFF, drop_partial_weeks: bool = False) -> DataFrame:
    """A2: weekly series per key up to the cutoff (zero-filled).

    By default the last week may be partial, as in the service (B2): a
    cutoff on a Wednesday leaves a week labelled by the following Sunday
    that holds only Monday-Wednesday.  ``drop_partial_weeks`` drops weeks
    that end after the cutoff.
    """
    out = resample(daily, "week", ["series_key"], cutoff=cutoff)
    return out.where(F.col("week") <= F.lit(cutoff).cast("date")) if drop_partial_weeks else out


def weekly_total(daily: DataFrame, cutoff: str = C.DEFAULT_CUTOFF) -> DataFrame:
    """A3: weekly series of the sum over keys up to the cutoff."""
    return resample(daily, "week", [], cutoff=cutoff)


def monthly_series(daily: DataFrame) -> DataFrame:
    """A4: monthly series per key over all dates (no cutoff)."""
    return resample(daily, "month", ["series_key"])


def monthly_total(daily: DataFrame) -> DataFrame:
    """A4: monthly series of the total over all dates."""
    return resample(daily, "month", [])


def daily_regular(daily: DataFrame) -> DataFrame:
    """A5: daily total with every day present (0 filled), all dates."""
    return resample(daily, "day", [])


def totals_rollup(daily: DataFrame) -> DataFrame:
    """Total per key and the grand total (``series_key`` null) in one pass."""
    return (daily.rollup("series_key")
            .agg(F.sum("cnt").alias("total"), F.grouping("series_key").alias("is_grand_total")))


def key_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("series_key").agg(F.sum("cnt").alias("total"))


def most_popular(daily: DataFrame) -> DataFrame:
    """Key with the largest total; first alphabetically on ties."""
    return key_totals(daily).orderBy(F.desc("total"), F.asc("series_key")).limit(1)


def available_keys(daily: DataFrame, column: str = "series_key") -> DataFrame:
    """Distinct sorted labels."""
    return daily.select(column).distinct().orderBy(column)


def new_data_count(daily: DataFrame, since_date: str) -> DataFrame:
    """Number of distinct dates strictly after ``since_date``."""
    return since(daily, since_date).agg(F.countDistinct("date").alias("new_days"))


def data_range(daily: DataFrame, cutoff: str = C.DEFAULT_CUTOFF) -> DataFrame:
    """A10: training range: first date up to the cutoff, and the cutoff itself.

    Empty (no row up to the cutoff) gives empty strings.
    """
    first = until(daily, cutoff).agg(F.min("date").alias("lo"))
    return first.select(
        F.coalesce(F.date_format("lo", "yyyy-MM-dd"), F.lit("")).alias("start_date"),
        F.when(F.col("lo").isNull(), F.lit("")).otherwise(F.lit(cutoff)).alias("end_date"),
        F.lit(cutoff).alias("cutoff"))


def with_position_from_end(series: DataFrame, keys: list[str], period: str) -> DataFrame:
    """Reverse position (1 = last period) and series length per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(period)) if keys else Window.orderBy(F.desc(period))
    wall = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return (series.withColumn("rpos", F.row_number().over(w))
            .withColumn("n", F.count(F.lit(1)).over(wall)))


def tail_stats(series: DataFrame, keys: list[str], period: str = "week") -> DataFrame:
    """Last value, sums of the last 1/4/13 periods, mean of the last 4.

    A series shorter than the window uses all of it.
    """
    s = with_position_from_end(series, keys, period)
    grouped = s.groupBy(*keys) if keys else s.groupBy()
    return grouped.agg(
        F.max_by("y", period).alias("last_value"),
        F.max(period).alias("last_period"),
        F.count(F.lit(1)).alias("n_periods"),
        F.sum(F.when(F.col("rpos") <= C.STEPS_NEXT_MONTH, F.col("y"))).alias("tail4_sum"),
        F.sum(F.when(F.col("rpos") <= C.STEPS_NEXT_QUARTER, F.col("y"))).alias("tail13_sum"),
        F.avg(F.when(F.col("rpos") <= C.RECENT_PERIODS_FOR_TREND, F.col("y"))).alias("recent_avg"),
        F.sum("y").alias("all_sum"),
    )


def tail_sum(series: DataFrame, keys: list[str], steps: int, period: str = "week") -> DataFrame:
    """W2 for an arbitrary window: sum of the last ``steps`` periods (all if shorter)."""
    s = with_position_from_end(series, keys, period)
    grouped = s.groupBy(*keys) if keys else s.groupBy()
    return grouped.agg(F.sum(F.when(F.col("rpos") <= steps, F.col("y"))).alias("tail_sum"))


def tail(series: DataFrame, keys: list[str], n: int, period: str) -> DataFrame:
    """Last ``n`` periods of each series."""
    s = with_position_from_end(series, keys, period)
    return s.where(F.col("rpos") <= n).drop("rpos", "n")


def chrono_split(series: DataFrame, keys: list[str], period: str = "week",
                 train_ratio: float = C.DEFAULT_TRAIN_RATIO) -> DataFrame:
    """W10 + W15: split index, and the train / test period ranges per series.

    split = max(1, min(floor(n * ratio), n - 1)); a series with n < 2 has a
    null split and 'N/A' ranges.
    """
    wall = Window.partitionBy(*keys) if keys else Window.partitionBy()
    n = F.count(F.lit(1)).over(wall)
    s = series.withColumn("n", n).withColumn(
        "split", F.when(F.col("n") >= 2, F.greatest(
            F.lit(1), F.least(F.floor(F.col("n") * F.lit(train_ratio)).cast("int"), F.col("n") - 1))))
    grouped = s.groupBy(*keys) if keys else s.groupBy()
    out = grouped.agg(
        F.first("n").alias("n"), F.first("split").alias("split"),
        F.min(period).alias("first_period"), F.max(period).alias("last_period"),
        F.max(F.when(F.col("t") == F.col("split") - 1, F.col(period))).alias("train_end"),
        F.max(F.when(F.col("t") == F.col("split"), F.col(period))).alias("test_start"))

    def rng(a, b):
        return F.when(a.isNull() | b.isNull(), F.lit("N/A")).otherwise(
            F.concat_ws(" to ", F.date_format(a, "yyyy-MM-dd"), F.date_format(b, "yyyy-MM-dd")))

    return out.select(*keys, F.col("n").cast("long").alias("n"), "split",
                      rng(F.col("first_period"), F.col("train_end")).alias("training_period"),
                      rng(F.col("test_start"), F.col("last_period")).alias("testing_period"))
