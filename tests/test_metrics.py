"""Backtest metrics and split rules with the service's expected numbers."""

import math

import pytest
from pyspark.sql import functions as F

from planwell.functions import scalars as S
from planwell.operators import series as SR, stats as ST


def metrics(spark, actuals, preds):
    df = spark.createDataFrame(list(zip(actuals, preds)), "actual double, predicted double")
    return ST.forecast_metrics(df, []).first()


def test_known_values(spark):
    m = metrics(spark, [100.0, 200.0, 50.0], [110.0, 180.0, 40.0])
    assert m.test_periods == 3 and m.mape_periods == 3
    assert m.mae == round(40.0 / 3.0, 2)
    assert m.rmse == round(math.sqrt(600.0 / 3.0), 2)
    assert m.mape == round((0.1 + 0.1 + 0.2) / 3.0 * 100.0, 2)


def test_mape_excludes_zero_actuals(spark):
    m = metrics(spark, [0.0, 100.0, 0.0, 50.0], [5.0, 120.0, 3.0, 40.0])
    assert m.test_periods == 4 and m.mape_periods == 2
    assert m.mape == round((0.2 + 0.2) / 2.0 * 100.0, 2)


def test_mape_all_zero_is_null(spark):
    m = metrics(spark, [0.0, 0.0], [1.0, 2.0])
    assert m.mape is None and m.mape_periods == 0 and m.mae is not None


@pytest.mark.parametrize("mape, label", [(4.9, "Excellent"), (5.0, "Good"), (9.9, "Good"), (10.0, "Acceptable"),
                                         (19.9, "Acceptable"), (20.0, "Needs Improvement"),
                                         (None, "Needs Improvement")])
def test_mape_classes(spark, mape, label):
    df = spark.createDataFrame([(mape,)], "m double")
    assert df.select(S.mape_class("m")).first()[0] == label


@pytest.mark.parametrize("n, split", [(100, 80), (10, 8), (2, 1), (3, 2)])
def test_chronological_split(spark, n, split):
    import datetime as dt
    rows = [("k", dt.date(2020, 1, 5) + dt.timedelta(weeks=i), i, float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "series_key string, week date, t int, y double")
    r = SR.chrono_split(df, ["series_key"], "week").first()
    assert r.split == split and r.n == n


def test_confidence_labels(spark):
    df = spark.createDataFrame([(7.0, 100.0), (10.0, 100.0), (20.0, 100.0), (None, 100.0), (5.0, 0.0)],
                               "mae double, mean double")
    got = [r[0] for r in df.select(S.confidence_by_error("mae", "mean")).collect()]
    assert got == ["High", "Medium", "Low", "High", "Low"]
    probs = spark.createDataFrame([(95.0,), (85.0,), (75.0,), (10.0,)], "p double")
    assert [r[0] for r in probs.select(S.confidence_by_probability("p")).collect()] == [
        "Very High Confidence", "High Confidence", "Moderate Confidence", "Low Confidence"]
    assert df.select(F.lit(1)).count() == 5
