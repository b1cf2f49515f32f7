"""Forecast plans: params -> forecast table -> horizon sums -> reports.

Everything below the parameter table is plain DataFrame algebra over
small per-key tables; the heavy work (scan + join + aggregation of the raw
rows) happens once in the daily volume and its weekly roll-up.

Forecast values are rounded to 2 dp, so sums are taken in integer cents:
the result does not depend on the order in which Spark adds rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwell import config as C
from planwell.functions import scalars as S
from planwell.operators import arima, series as SR

KEY = ["series_key"]


def params(weekly: DataFrame) -> DataFrame:
    """M1 on the weekly series per key."""
    return arima.fit_params(weekly, KEY, "week")


def weekly_forecast(prm: DataFrame, steps: int = C.STEPS_PRECOMPUTE) -> DataFrame:
    """M2: (series_key, step, period, y_hat), clipped at 0 and rounded to 2 dp."""
    return arima.forecast(prm, KEY, steps=steps, period_step="week")


def cents(col: str = "y_hat"):
    return F.round(F.col(col) * 100).cast("long")


def horizon_sums(fc: DataFrame) -> DataFrame:
    """M3: per key, exact sums of the first 1 / 4 / 13 / 26 / 52 steps (in units, not rounded)."""
    agg = [F.sum(F.when(F.col("step") <= s, cents())).alias(f"c{s}")
           for s in (1, 4, 13, 26, 52)]
    out = fc.groupBy(*KEY).agg(*agg)
    return out.select(*KEY, *[(F.col(f"c{s}") / F.lit(100.0)).alias(f"sum{s}")
                              for s in (1, 4, 13, 26, 52)])


def horizon_sums_report(fc: DataFrame) -> DataFrame:
    """M3 / A30 as a report: per key and the total over keys, each rounded to 1 dp."""
    agg = [F.sum(F.when(F.col("step") <= s, cents())).alias(f"c{s}") for s in (1, 4, 13)]
    out = fc.rollup(*KEY).agg(*agg, F.grouping("series_key").alias("is_total"))
    names = {1: "next_week", 4: "next_month", 13: "next_quarter"}
    return out.select(*KEY, F.col("is_total").cast("int").alias("is_total"),
                      *[F.round(F.col(f"c{s}") / F.lit(100.0), 1).alias(names[s]) for s in (1, 4, 13)])


def growth_trend(weekly: DataFrame, sums: DataFrame, period: str = "next_month") -> DataFrame:
    """M4 + M5: growth percent and trend label of every key for a period."""
    steps = C.FORECAST_PERIODS[period]
    tails = SR.tail_stats(weekly, KEY, "week")
    comparable = F.col(f"sum{steps}") / F.lit(float(steps))
    joined = sums.join(tails, KEY)
    growth, trend = S.growth_and_trend(F.col("recent_avg"), comparable)
    return joined.select(*KEY, F.round(F.col("recent_avg"), 4).alias("recent_avg"),
                         F.round(comparable, 4).alias("comparable_forecast"),
                         growth.alias("growth_percentage"), trend.alias("trend"))


def course_forecasts(daily: DataFrame, weekly: DataFrame, fc: DataFrame,
                     period: str = "next_month") -> DataFrame:
    """Per key totals, current count, three horizons, chosen horizon, growth, trend, rank.

    J1 joins four per-key tables on the key (all at most one row per key).
    """
    if period not in C.FORECAST_PERIODS:
        raise ValueError(f"Unsupported period '{period}'. Use: {', '.join(C.FORECAST_PERIODS)}")
    steps = C.FORECAST_PERIODS[period]
    sums = horizon_sums(fc)
    tails = SR.tail_stats(weekly, KEY, "week")
    totals = SR.key_totals(daily)
    j = sums.join(tails, KEY).join(totals, KEY, "left")
    growth, trend = S.growth_and_trend(F.col("recent_avg"), F.col(f"sum{steps}") / F.lit(float(steps)))
    fw, fm, fq = (F.round(F.col(f"sum{s}"), 1) for s in (1, 4, 13))
    chosen = {1: fw, 4: fm, 13: fq}[steps]
    out = j.select(
        F.col("series_key").alias("course"),
        F.coalesce(F.col("total"), F.lit(0)).cast("long").alias("historical_total_applicants"),
        S.round_int(F.col("last_value")).alias("current_applicant_count"),
        chosen.alias("forecasted_applicant_count"),
        fw.alias("forecast_next_week"), fm.alias("forecast_next_month"), fq.alias("forecast_next_quarter"),
        trend.alias("trend"), growth.alias("growth_percentage"),
        F.lit(period).alias("period"))
    # Ranked by forecast, then key; a distributed sort, no single-partition window
    return out.orderBy(F.desc("forecasted_applicant_count"), F.asc("course"))


def forecast_buckets(fc: DataFrame, monthly_last: DataFrame | None = None,
                     buckets: int = C.CHART_BUCKETS) -> DataFrame:
    """Sums of 4-week buckets of the forecast, per key, rounded to 1 dp."""
    b = F.floor((F.col("step") - 1) / F.lit(C.WEEKS_PER_BUCKET)).cast("int")
    out = (fc.where(F.col("step") <= buckets * C.WEEKS_PER_BUCKET)
           .groupBy(*KEY, (b + 1).alias("bucket")).agg(F.sum(cents()).alias("c")))
    return out.select(*KEY, "bucket", F.round(F.col("c") / F.lit(100.0), 1).alias("applicants"))


def total_forecast_by_step(fc: DataFrame) -> DataFrame:
    """Cross-key sum of the forecast at each step (exact, then 1 dp)."""
    return (fc.groupBy("step").agg(F.sum(cents()).alias("c"))
            .select("step", (F.col("c") / F.lit(100.0)).alias("y_sum"),
                    F.round(F.col("c") / F.lit(100.0), 1).alias("y_total")))


def peak_step(fc: DataFrame, keys: list[str] = KEY, value: str = "y_hat",
              steps: int = C.STEPS_NEXT_QUARTER) -> DataFrame:
    """First step with the largest forecast within the horizon."""
    src = fc.where(F.col("step") <= steps)
    g = src.groupBy(*keys) if keys else src.groupBy()
    best = F.min_by(F.col("step"), F.struct(-F.col(value), F.col("step")))
    return g.agg(best.alias("peak_step"), F.max(value).alias("peak_value"))
