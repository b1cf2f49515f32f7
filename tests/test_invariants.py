"""Invariants: horizon sums vs the forecast table, no look-ahead in the backtest, partial weeks."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from planwell.operators import arima, series as SR
from planwell.plans import forecasting as FC
from planwell.sources import tables as T

from conftest import SF_SMALL


def test_horizon_sums_agree_with_forecast_table(spark):
    fc = FC.weekly_forecast(FC.params(SR.weekly_series(T.volume(spark, SF_SMALL))))
    sums = {r.series_key: r for r in FC.horizon_sums(fc).collect()}
    table = fc.toPandas()
    for key, g in table.groupby("series_key"):
        g = g.sort_values("step")
        assert abs(sums[key].sum4 - g.y_hat.iloc[:4].sum()) < 1e-9
        assert abs(sums[key].sum13 - g.y_hat.iloc[:13].sum()) < 1e-9


def test_backtest_uses_no_future_rows(spark):
    rng = np.random.default_rng(11)
    y = np.round(np.abs(np.cumsum(rng.normal(size=40))) * 5 + 20)
    weeks = pd.date_range("2021-01-03", periods=len(y), freq="W-SUN").date

    def run(values):
        pdf = pd.DataFrame({"series_key": "k", "week": weeks, "t": np.arange(len(values), dtype=np.int32),
                            "y": values})
        out = arima.walk_forward(spark.createDataFrame(pdf), ["series_key"], "week", min_training=12).toPandas()
        return dict(zip(out.t, out.predicted))

    base = run(y)
    cut = 36
    changed = y.copy()
    changed[cut:] = changed[cut:] * 3 + 100
    other = run(changed)
    for t, p in base.items():
        if t <= cut:                      # prediction of t uses points [0, t) only
            assert other[t] == p


def test_drop_partial_weeks(spark):
    rows = [(dt.date(2025, 12, 1) + dt.timedelta(days=i), "C", 1) for i in range(45)]
    df = spark.createDataFrame(rows, "date date, series_key string, cnt long")
    keep = SR.weekly_series(df, "2025-12-31").agg(F.max("week")).first()[0]
    drop = SR.weekly_series(df, "2025-12-31", drop_partial_weeks=True).agg(F.max("week")).first()[0]
    assert keep == dt.date(2026, 1, 4) and drop == dt.date(2025, 12, 28)
