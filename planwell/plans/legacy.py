"""The legacy monthly answer (R11): growth summary, chart series and sentences from all (site, key) models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwell import config as C
from planwell.functions import scalars as S
from planwell.operators import arima, series as SR

KEYS = ["site", "series_key"]


def step_totals(fc: DataFrame) -> DataFrame:
    """(step, p): the forecast of each month over all models, exact sums, 1 dp."""
    return fc.groupBy("step").agg(F.sum(F.round(F.col("y_hat") * 10000).cast("long")).alias("c")) \
        .select("step", F.round(F.col("c") / F.lit(10000.0), 1).alias("p"))


def by_period(steps: DataFrame) -> DataFrame:
    """Every planning period's steps."""
    periods = F.create_map(*[x for k, v in C.LEGACY_PERIODS.items() for x in (F.lit(k), F.lit(v))])
    return steps.select("*", F.explode(periods).alias("forecast_period", "steps")).where(F.col("step") <= F.col("steps"))


def report(series: DataFrame, hist: DataFrame, fc: DataFrame) -> DataFrame:
    """A row a planning period: total, previous total, growth, confidence and peak."""
    agg = by_period(step_totals(fc)).groupBy("forecast_period", "steps").agg(
        (F.sum(F.round(F.col("p") * 10).cast("long")) / F.lit(10.0)).alias("total"),
        F.min_by("step", F.struct(-F.col("p"), F.col("step"))).alias("peak_month"),
        F.max("p").alias("peak_value"))
    pos = SR.with_position_from_end(hist, [], "month")
    tails = pos.agg(*[F.round(F.coalesce(F.sum(F.when(F.col("rpos") <= n, F.col("y"))), F.lit(0.0)), 1).alias(f"t{n}")
                      for n in sorted(set(C.LEGACY_PERIODS.values()))])
    prev = None
    for n in sorted(set(C.LEGACY_PERIODS.values())):
        v = tails.select(f"t{n}").scalar()
        prev = F.when(F.col("steps") == n, v) if prev is None else prev.when(F.col("steps") == n, v)
    h = arima.holdout(series, KEYS, "month")
    e = F.col("actual") - F.col("predicted")
    per_series = h.groupBy(*KEYS).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    mae = per_series.where(F.col("mae").isNotNull() & F.col("rmse").isNotNull()).select(F.avg("mae")).scalar()
    mean = hist.select(F.avg("y")).scalar()
    growth = S.growth_pct(F.round("total", 1), F.col("previous_period_total"))
    out = agg.withColumn("previous_period_total", prev)
    return out.select(
        "forecast_period", F.col("steps").cast("int").alias("steps"),
        F.round("total", 1).alias("total_predicted_applicants"), "previous_period_total",
        growth.alias("growth_percentage"), S.growth_direction(growth).alias("growth_direction"),
        S.confidence_by_error_legacy(mae, mean).alias("confidence_level"),
        F.col("peak_month").cast("int").alias("peak_month"), "peak_value")


def charts(hist: DataFrame, fc: DataFrame) -> DataFrame:
    """(forecast_period, series, ord, period, applicants): the last months of history and the forecast months."""
    names = F.explode(F.array(*[F.lit(k) for k in C.LEGACY_PERIODS])).alias("forecast_period")
    n = hist.select(F.count(F.lit(1))).scalar()
    old = SR.with_position_from_end(hist, [], "month").where(F.col("rpos") <= C.CHART_MONTHS)
    first = F.least(n, F.lit(C.CHART_MONTHS))
    old = old.select(names, F.lit("historical_volume").alias("series"), (first - F.col("rpos") + 1).cast("int").alias("ord"),
                     S.month_label("month").alias("period"), F.round("y", 1).alias("applicants"))
    last = hist.select(F.max("month")).scalar()
    new = by_period(step_totals(fc)).select(
        "forecast_period", F.lit("forecast_volume").alias("series"), F.col("step").cast("int").alias("ord"),
        S.month_label(F.add_months(last, F.col("step"))).alias("period"), F.col("p").alias("applicants"))
    return old.unionByName(new)


def insights(answers: DataFrame, subject: str = "The organisation") -> DataFrame:
    """(forecast_period, ord, text): the sentences on total, direction, peak month and use."""
    labels = F.create_map(*[x for k, v in C.LEGACY_LABELS.items() for x in (F.lit(k), F.lit(v))])
    change = F.abs("growth_percentage").cast("string")
    texts = F.array(
        F.format_string(C.INSIGHT_TOTAL, F.lit(subject), S.fmt_int("total_predicted_applicants"), F.lower(labels[F.col("forecast_period")])),
        F.when(F.col("growth_direction") == "growth", F.format_string(C.LEGACY_INCREASE, change))
        .when(F.col("growth_direction") == "decline", F.format_string(C.LEGACY_DECREASE, change)).otherwise(F.lit(C.LEGACY_STABLE)),
        F.when(F.col("steps") > 1, F.format_string(C.LEGACY_PEAK, F.col("peak_month").cast("string"), S.fmt_int("peak_value"))),
        F.lit(C.LEGACY_USE))
    rows = answers.select("forecast_period", F.posexplode(texts).alias("pos", "text"))
    return rows.where(F.col("text").isNotNull()).select("forecast_period", (F.col("pos") + 1).alias("ord"), "text")
