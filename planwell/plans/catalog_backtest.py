"""Registered backtest and legacy-model queries (M6-M10, A23, A24, C8) with SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwell import config as C
from planwell.functions import scalars as S
from planwell.operators import arima, series as SR, stats as ST
from planwell.plans import oracle as O, reports as RP
from planwell.plans.catalog import CUT, VOL, WEEKLY, WTOTAL, W, daily_table, register, weekly
from planwell.sources import tables as T

TWO = ["site", "series_key"]
V2 = O.VIEWS["volume_two_key"]
M2 = O.series_cte("m2", "volume_two_key", TWO, "month", fill=False)


def wf_sql(name: str, series: str, keys: list[str]) -> str:
    """CTEs ending in ``{name}``(keys, t, week, actual, predicted, phi, theta), unrounded."""
    part = ", ".join(f"r.{k}" for k in keys)
    pk = f"PARTITION BY {part}, r.t" if keys else "PARTITION BY r.t"
    on_m = " AND ".join(f"r.{k} = m.{k}" for k in keys) or "TRUE"
    on_c = "".join(f"c.{k} = r.{k} AND " for k in keys)
    on_w = "".join(f"w.{k} = b.{k} AND " for k in keys)
    on_p = "".join(f"wp.{k} = b.{k} AND " for k in keys)
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    kk = "".join(f"{k}, " for k in keys)
    return O.arima_ctes(f"{name}x", series, keys) + f""",
{name}_meta AS (SELECT {kk}count(*) AS n,
  greatest(1, least(CAST(floor(count(*) * 0.8) AS INTEGER), CAST(count(*) - 1 AS INTEGER))) AS split
  FROM {series} {grp}),
{name}_cell AS (SELECT * FROM (SELECT r.*, row_number() OVER ({pk} ORDER BY r.sse, abs(r.phi), abs(r.theta), r.phi, r.theta) AS rn
  FROM {name}x_rec r JOIN {name}_meta m ON {on_m} WHERE m.split >= {C.MIN_TRAINING_PERIODS} AND r.t + 1 >= m.split) WHERE rn = 1),
{O.refine_ctes(f"{name}x", f"{name}_cell", keys)},
{name}_best AS (SELECT * FROM (SELECT r.*, row_number() OVER ({pk} ORDER BY r.sse, abs(r.phi), abs(r.theta), r.phi, r.theta) AS rn
  FROM {name}x_rec2 r JOIN {name}_cell c ON {on_c}c.t = r.t AND c.phi = r.phi0 AND c.theta = r.theta0) WHERE rn = 1),
{name} AS (SELECT {''.join(f'b.{k}, ' for k in keys)}CAST(b.t + 1 AS INTEGER) AS t, w.week, w.y AS actual,
  greatest(0.0, wp.y + (b.phi * b.dlag + b.theta * b.e)) AS predicted, b.phi, b.theta
  FROM {name}_best b JOIN {series} w ON {on_w}w.t = b.t + 1 JOIN {series} wp ON {on_p}wp.t = b.t)"""


def metrics_sql(src: str, keys: list[str]) -> str:
    kk = "".join(f"{k}, " for k in keys)
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {kk}round(avg(abs(actual - predicted)), 2) AS mae,
  round(sqrt(avg((actual - predicted) * (actual - predicted))), 2) AS rmse,
  round(avg(abs((actual - predicted) / actual)) FILTER (WHERE actual > 0) * 100.0, 2) AS mape,
  count(*) AS test_periods, count(*) FILTER (WHERE actual > 0) AS mape_periods
  FROM {src} {grp}"""


WF = wf_sql("wf", "weekly", ["series_key"])
WFT = wf_sql("wft", "wtotal", [])


def walk_forward_keys(spark, sf) -> DataFrame:
    return arima.walk_forward(weekly(spark, sf), ["series_key"], "week")


def weekly_total(spark, sf) -> DataFrame:
    return SR.weekly_total(T.volume(spark, sf, until=CUT), CUT)


def walk_forward_total(spark, sf) -> DataFrame:
    return arima.walk_forward(weekly_total(spark, sf), [], "week")


@register("walk_forward", W(VOL, WEEKLY, WF) +
          "SELECT series_key, t, week, actual, round(predicted, 4) AS predicted, phi, theta FROM wf")
def q_walk_forward(spark, sf):
    return walk_forward_keys(spark, sf).withColumn("predicted", F.round("predicted", 4))


@register("walk_forward_total", W(VOL, WTOTAL, WFT) +
          "SELECT t, week, actual, round(predicted, 4) AS predicted, phi, theta FROM wft")
def q_walk_forward_total(spark, sf):
    return walk_forward_total(spark, sf).withColumn("predicted", F.round("predicted", 4))


@register("forecast_metrics", W(VOL, WEEKLY, WF) + metrics_sql("wf", ["series_key"]))
def q_forecast_metrics(spark, sf):
    return ST.forecast_metrics(walk_forward_keys(spark, sf), ["series_key"])


def split_ranges_sql(name: str, series: str, keys: list[str]) -> str:
    """``{name}``(keys, split, training_period, testing_period) like ``series.chrono_split``."""
    kk = "".join(f"{k}, " for k in keys)
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    on = " AND ".join(f"w.{k} = s.{k}" for k in keys) or "TRUE"
    sel = "".join(f"s.{k}, " for k in keys)
    return f"""{name}_s AS (SELECT {kk}count(*) AS n, min(week) AS first_period, max(week) AS last_period,
  CASE WHEN count(*) >= 2 THEN greatest(1, least(CAST(floor(count(*) * 0.8) AS INTEGER), CAST(count(*) - 1 AS INTEGER))) END AS split
  FROM {series} {grp}),
{name} AS (SELECT {sel}s.split,
  CASE WHEN max(w.week) FILTER (WHERE w.t = s.split - 1) IS NULL THEN 'N/A'
       ELSE strftime(min(s.first_period), '%Y-%m-%d') || ' to ' || strftime(max(w.week) FILTER (WHERE w.t = s.split - 1), '%Y-%m-%d') END AS training_period,
  CASE WHEN max(w.week) FILTER (WHERE w.t = s.split) IS NULL THEN 'N/A'
       ELSE strftime(max(w.week) FILTER (WHERE w.t = s.split), '%Y-%m-%d') || ' to ' || strftime(max(s.last_period), '%Y-%m-%d') END AS testing_period
  FROM {series} w JOIN {name}_s s ON {on} GROUP BY {sel}s.split)"""


MAPE_CLASS_SQL = """CASE WHEN mape IS NULL THEN 'Needs Improvement' WHEN mape < 5.0 THEN 'Excellent'
  WHEN mape < 10.0 THEN 'Good' WHEN mape < 20.0 THEN 'Acceptable' ELSE 'Needs Improvement' END"""


@register("backtest_report", W(VOL, WEEKLY, WTOTAL, WF, WFT) + f""",
km AS ({metrics_sql("wf", ["series_key"])}),
om AS ({metrics_sql("wft", [])}),
{split_ranges_sql("sp", "weekly", ["series_key"])},
{split_ranges_sql("spt", "wtotal", [])}
SELECT 'overall' AS scope, NULL AS series_key, mape, mae, rmse, CAST(test_periods AS BIGINT) AS test_periods,
  CAST(mape_periods AS BIGINT) AS mape_periods, {MAPE_CLASS_SQL} AS assessment, 'evaluated' AS status,
  CAST(NULL AS VARCHAR) AS reason, (SELECT training_period FROM spt) AS training_period,
  (SELECT testing_period FROM spt) AS testing_period
FROM om
UNION ALL
SELECT 'series', sp.series_key, km.mape, km.mae, km.rmse, CAST(coalesce(km.test_periods, 0) AS BIGINT),
  CAST(coalesce(km.mape_periods, 0) AS BIGINT),
  CASE WHEN km.series_key IS NULL THEN NULL ELSE (CASE WHEN km.mape IS NULL THEN 'Needs Improvement'
    WHEN km.mape < 5.0 THEN 'Excellent' WHEN km.mape < 10.0 THEN 'Good' WHEN km.mape < 20.0 THEN 'Acceptable'
    ELSE 'Needs Improvement' END) END,
  CASE WHEN sp.split < {C.MIN_TRAINING_PERIODS} OR km.series_key IS NULL THEN 'skipped' ELSE 'evaluated' END,
  CASE WHEN sp.split < {C.MIN_TRAINING_PERIODS}
       THEN 'Insufficient training history (' || sp.split || ' < {C.MIN_TRAINING_PERIODS} weeks).'
       WHEN km.series_key IS NULL THEN 'No successful walk-forward forecasts were produced.' END,
  sp.training_period, sp.testing_period
FROM sp LEFT JOIN km ON sp.series_key = km.series_key""")
def q_backtest_report(spark, sf):
    """M7: overall (total series fitted on its own) + every key, with skip reasons."""
    # keyed and total series both come from one materialised daily table (one raw scan)
    d = daily_table(spark, sf)
    return RP.evaluation(SR.weekly_series(d, CUT), SR.weekly_total(d, CUT))


@register("confidence_level", W(VOL, WTOTAL, WFT) + f""", om AS ({metrics_sql("wft", [])})
SELECT om.mae AS mae, round((SELECT avg(y) FROM wtotal), 4) AS mean_volume,
  round(coalesce(om.mae, 0.0) / CASE WHEN (SELECT avg(y) FROM wtotal) = 0 THEN 1.0 ELSE (SELECT avg(y) FROM wtotal) END, 4) AS ratio,
  CASE WHEN coalesce(om.mae, 0.0) / CASE WHEN (SELECT avg(y) FROM wtotal) = 0 THEN 1.0 ELSE (SELECT avg(y) FROM wtotal) END < 0.08 THEN 'High'
       WHEN coalesce(om.mae, 0.0) / CASE WHEN (SELECT avg(y) FROM wtotal) = 0 THEN 1.0 ELSE (SELECT avg(y) FROM wtotal) END < 0.15 THEN 'Medium'
       ELSE 'Low' END AS confidence_level
FROM om""")
def q_confidence_level(spark, sf):
    return confidence_table(spark, sf)


def confidence_table(spark, sf, wtotal: DataFrame | None = None) -> DataFrame:
    """Overall backtest MAE relative to the mean weekly total."""
    wt = wtotal if wtotal is not None else weekly_total(spark, sf)
    om = ST.forecast_metrics(arima.walk_forward(wt, [], "week"), [])
    mean = wt.select(F.avg("y")).scalar()
    denom = F.when(mean == 0, F.lit(1.0)).otherwise(mean)
    return om.select(F.col("mae"), F.round(mean, 4).alias("mean_volume"),
                     F.round(F.coalesce("mae", F.lit(0.0)) / denom, 4).alias("ratio"),
                     S.confidence_by_error(F.col("mae"), mean).alias("confidence_level"))


# ---------------------------------------------------------------------------
# legacy two-key monthly models
# ---------------------------------------------------------------------------

def two_key_series(spark, sf) -> DataFrame:
    """Monthly series per (site, key); gaps stay null (the legacy regularisation)."""
    return SR.resample(T.volume_two_key(spark, sf), "month", TWO, fill=None)


FIT9 = O.fit_ctes("m9", "m2", TWO, "month")


@register("arima_monthly_two_key", W(V2, M2, FIT9) + """SELECT site, series_key, phi, theta,
  round(sse, 4) AS sse, n_obs, last_y, last_d, round(last_e, 6) AS last_e, data_start, data_end FROM m9_fit""")
def q_arima_monthly_two_key(spark, sf):
    p = arima.fit_params(two_key_series(spark, sf), TWO, "month")
    return p.select(*TWO, "phi", "theta", F.round("sse", 4).alias("sse"), "n_obs", "last_y", "last_d",
                    F.round("last_e", 6).alias("last_e"), "data_start", "data_end")


@register("legacy_forecast", W(V2, M2, FIT9, O.forecast_cte("fc9", "m9_fit", TWO, steps=12, grain="month",
                                                            clip=False, digits=4)) +
          "SELECT site, series_key, step, period, y_hat FROM fc9")
def q_legacy_forecast(spark, sf):
    """1..12 month forecasts of every (site, key) model (unclipped, 4 dp)."""
    p = arima.fit_params(two_key_series(spark, sf), TWO, "month")
    fc = arima.forecast(p, TWO, steps=12, period_step="month", clip=False, digits=4)
    return fc.select(*TWO, F.col("step").cast("long").alias("step"), "period", "y_hat")


HOLD = O.arima_ctes("h", "m2", TWO) + f""",
hmeta AS (SELECT site, series_key, count(*) AS n FROM m2 GROUP BY site, series_key
  HAVING count(*) > {C.HOLDOUT_MONTHS + C.HOLDOUT_MIN_EXTRA}),
hcell AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.site, r.series_key
    ORDER BY r.sse, abs(r.phi), abs(r.theta), r.phi, r.theta) AS rn
  FROM h_rec r JOIN hmeta m ON r.site = m.site AND r.series_key = m.series_key AND r.t = m.n - {C.HOLDOUT_MONTHS + 1})
  WHERE rn = 1),
{O.refine_ctes("h", "hcell", TWO)},
hbest AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.site, r.series_key
    ORDER BY r.sse, abs(r.phi), abs(r.theta), r.phi, r.theta) AS rn
  FROM h_rec2 r JOIN hmeta m ON r.site = m.site AND r.series_key = m.series_key AND r.t = m.n - {C.HOLDOUT_MONTHS + 1})
  WHERE rn = 1),
hlast AS (SELECT s.site, s.series_key, arg_max(s.y, s.t) FILTER (WHERE s.y IS NOT NULL) AS last_y
  FROM m2 s JOIN hmeta m ON s.site = m.site AND s.series_key = m.series_key
  WHERE s.t <= m.n - {C.HOLDOUT_MONTHS + 1} GROUP BY s.site, s.series_key),
hpred AS (SELECT b.site, b.series_key, CAST(hh AS INTEGER) AS h, m.n - {C.HOLDOUT_MONTHS + 1} + hh AS tt,
  l.last_y + (b.phi * b.dlag + b.theta * b.e) * ((1.0 - pow(b.phi, CAST(hh AS DOUBLE))) / (1.0 - b.phi)) AS predicted
  FROM hbest b JOIN hlast l ON b.site = l.site AND b.series_key = l.series_key
  JOIN hmeta m ON b.site = m.site AND b.series_key = m.series_key, range(1, {C.HOLDOUT_MONTHS + 1}) r(hh)),
hold AS (SELECT p.site, p.series_key, p.h, s.month, s.y AS actual, p.predicted
  FROM hpred p JOIN m2 s ON s.site = p.site AND s.series_key = p.series_key AND s.t = p.tt)"""


def holdout_table(spark, sf) -> DataFrame:
    return arima.holdout(two_key_series(spark, sf), TWO, "month")


@register("holdout_backtest", W(V2, M2, HOLD) +
          "SELECT site, series_key, h, month, actual, round(predicted, 4) AS predicted FROM hold")
def q_holdout_backtest(spark, sf):
    return holdout_table(spark, sf).withColumn("predicted", F.round("predicted", 4))


@register("holdout_metrics", W(V2, M2, HOLD) + """, per AS (SELECT site, series_key,
  avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse
  FROM hold GROUP BY site, series_key)
SELECT round(avg(mae) FILTER (WHERE mae IS NOT NULL AND rmse IS NOT NULL), 4) AS mae,
  round(avg(rmse) FILTER (WHERE mae IS NOT NULL AND rmse IS NOT NULL), 4) AS rmse,
  CAST(count(*) FILTER (WHERE mae IS NOT NULL AND rmse IS NOT NULL) AS BIGINT) AS n_series FROM per""")
def q_holdout_metrics(spark, sf):
    """Unweighted mean over series of per-series MAE / RMSE (gaps and empty series skipped)."""
    h = holdout_table(spark, sf)
    e = F.col("actual") - F.col("predicted")
    per = h.groupBy(*TWO).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    ok = per.where(F.col("mae").isNotNull() & F.col("rmse").isNotNull())
    return ok.agg(F.round(F.avg("mae"), 4).alias("mae"), F.round(F.avg("rmse"), 4).alias("rmse"),
                  F.count(F.lit(1)).cast("long").alias("n_series"))
