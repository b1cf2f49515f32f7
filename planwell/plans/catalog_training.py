"""Registered queries on saved parameters and incremental refits (M11, S10, S11, S15) and their SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planwell.operators import arima
from planwell.plans import oracle as O
from planwell.plans import training as TR
from planwell.plans.catalog import CUT, FCAST, FIT, VOL, WEEKLY, W, register, weekly
from planwell.plans.catalog_backtest import FIT9, M2, V2, two_key_series
from planwell.session import checkpoint

#: keys whose last weeks arrive only after the first training
LATE_KEYS, LATE_WEEKS = "%3", 8


@register("saved_forecast", W(VOL, WEEKLY, FIT, FCAST) + "SELECT series_key, step, period, y_hat FROM fc")
def q_saved_forecast(spark, sf):
    """The forecast from the saved parameters; only series that changed since they were saved are fitted."""
    fc = TR.weekly_forecast(weekly(spark, sf), f"weekly:{sf}:{CUT}")
    return fc.select("series_key", F.col("step").cast("long").alias("step"), "period", "y_hat")


@register("saved_forecast_two_key", W(V2, M2, FIT9, O.forecast_cte("fc9", "m9_fit", TR.TWO_KEYS, steps=12, grain="month", clip=False, digits=4)) +
          "SELECT site, series_key, step, period, y_hat FROM fc9")
def q_saved_forecast_two_key(spark, sf):
    """The same with two keys: monthly models of (site, key)."""
    prm = TR.saved_params(checkpoint(two_key_series(spark, sf)), TR.TWO_KEYS, "month", f"two-key:{sf}")
    fc = arima.forecast(prm, TR.TWO_KEYS, steps=12, period_step="month", clip=False, digits=4)
    return fc.select(*TR.TWO_KEYS, F.col("step").cast("long").alias("step"), "period", "y_hat")


def earlier(series: DataFrame) -> DataFrame:
    """The weekly series as it was before the last weeks of some keys arrived."""
    n = F.count(F.lit(1)).over(Window.partitionBy("series_key"))
    return series.withColumn("_n", n).where(~F.col("series_key").like(LATE_KEYS) | (F.col("t") < F.col("_n") - LATE_WEEKS)).drop("_n")


@register("retrain_incremental", W(VOL, WEEKLY, FIT) + f"""SELECT series_key, phi, theta, round(sse, 4) AS sse, n_obs,
  last_y, last_d, round(last_e, 6) AS last_e, data_start, data_end, series_key LIKE '{LATE_KEYS}' AS refitted FROM m_fit""")
def q_retrain_incremental(spark, sf):
    """All series are fitted once, the last weeks of some arrive, and only these are fitted again."""
    root = TR.params_root(spark, uuid.uuid4().hex)
    series = checkpoint(weekly(spark, sf))
    TR.refit(earlier(series), TR.WEEKLY_KEYS, root, "week")
    TR.refit(series, TR.WEEKLY_KEYS, root, "week")
    return TR.load(spark, root).select("series_key", "phi", "theta", F.round("sse", 4).alias("sse"), "n_obs", "last_y", "last_d",
                                       F.round("last_e", 6).alias("last_e"), "data_start", "data_end", (F.col("fit_number") == 1).alias("refitted"))
