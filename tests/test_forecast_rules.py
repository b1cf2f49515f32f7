"""Horizon sums, growth and trend with injected forecasts (the service's own expected numbers)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from planwell.plans import forecasting as FC

WEEKLY_PREDS = [120.0, 115.0, 112.0, 110.0, 108.0, 106.0, 105.0, 104.0, 103.0, 102.0, 101.0, 100.0, 99.0]


def frames(spark, preds):
    start = dt.date(2025, 10, 5)
    weekly = spark.createDataFrame(
        [("Test Course", start + dt.timedelta(weeks=i), i, 100.0) for i in range(12)],
        "series_key string, week date, t int, y double")
    fc = spark.createDataFrame(
        [("Test Course", i + 1, start + dt.timedelta(weeks=12 + i), p) for i, p in enumerate(preds)],
        "series_key string, step int, period date, y_hat double")
    daily = weekly.select(F.col("week").alias("date"), "series_key", F.lit(700).cast("long").alias("cnt"))
    return daily, weekly, fc


@pytest.mark.parametrize("period, value, growth, trend", [
    ("next_week", 120.0, 20.0, "Increasing"),
    ("next_month", 457.0, 14.2, "Increasing"),
    ("next_quarter", 1385.0, 6.5, "Increasing"),
])
def test_growth_uses_weekly_units(spark, period, value, growth, trend):
    daily, weekly, fc = frames(spark, WEEKLY_PREDS)
    row = FC.course_forecasts(daily, weekly, fc, period).first()
    assert row.forecasted_applicant_count == value
    assert row.growth_percentage == growth
    assert row.trend == trend
    assert row.current_applicant_count == 100
    assert row.forecast_next_week == 120.0 and row.forecast_next_month == 457.0


def test_stable_and_decreasing(spark):
    daily, weekly, fc = frames(spark, [99.6, 99.0, 98.0, 97.0, 96.0, 95.0, 94.0, 93.0, 92.0, 91.0, 90.0, 89.0, 88.0])
    row = FC.course_forecasts(daily, weekly, fc, "next_week").first()
    assert row.trend == "Stable" and abs(row.growth_percentage) <= 5.0
    daily, weekly, fc = frames(spark, [90.0, 88.0, 86.0, 84.0, 82.0, 80.0, 78.0, 76.0, 74.0, 72.0, 70.0, 68.0, 66.0])
    row = FC.course_forecasts(daily, weekly, fc, "next_week").first()
    assert row.trend == "Decreasing" and row.growth_percentage < -5.0


def test_unknown_period_is_rejected(spark):
    daily, weekly, fc = frames(spark, WEEKLY_PREDS)
    with pytest.raises(ValueError):
        FC.course_forecasts(daily, weekly, fc, "next_year")


def test_buckets_drop_trailing_steps(spark):
    _, _, fc = frames(spark, WEEKLY_PREDS)
    rows = FC.forecast_buckets(fc).orderBy("bucket").collect()
    assert [r.applicants for r in rows] == [457.0, 423.0, 406.0]
