"""Registry of the named queries: Spark builder + independent SQL oracle.

Each entry is ``name -> (fn(spark, sf_dir) -> DataFrame, sql or None)``.
Column names and types are aligned between both sides so results can be
compared by value.  Queries run over whole tables; parameters such as the
cutoff are the data's analogue of the service's settings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwell import config as C
from planwell.functions import scalars as S
from planwell.operators import series as SR
from planwell.plans import forecasting as FC
from planwell.plans import oracle as O
from planwell.plans import training as TR
from planwell.session import checkpoint
from planwell.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CUT = C.DEFAULT_CUTOFF


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared SQL fragments
# ---------------------------------------------------------------------------
VOL = O.VIEWS["volume"]
WEEKLY = O.series_cte("weekly", "volume", ["series_key"], "week", cutoff=CUT)
WTOTAL = O.series_cte("wtotal", "volume", [], "week", cutoff=CUT)
MTOTAL = O.series_cte("mtotal", "volume", [], "month")
MSERIES = O.series_cte("mseries", "volume", ["series_key"], "month")
FIT = O.fit_ctes("m", "weekly", ["series_key"], "week")
FCAST = O.forecast_cte("fc", "m_fit", ["series_key"])
SUMS = """sums AS (
  SELECT series_key,
         CAST(sum(c) FILTER (WHERE step <= 1) AS DOUBLE) / CAST(100 AS DOUBLE) AS s1,
         CAST(sum(c) FILTER (WHERE step <= 4) AS DOUBLE) / CAST(100 AS DOUBLE) AS s4,
         CAST(sum(c) FILTER (WHERE step <= 13) AS DOUBLE) / CAST(100 AS DOUBLE) AS s13,
         CAST(sum(c) FILTER (WHERE step <= 26) AS DOUBLE) / CAST(100 AS DOUBLE) AS s26,
         CAST(sum(c) FILTER (WHERE step <= 52) AS DOUBLE) / CAST(100 AS DOUBLE) AS s52
  FROM (SELECT series_key, step, CAST(round(y_hat * 100) AS BIGINT) AS c FROM fc) GROUP BY series_key)"""
TAILS = """tails AS (
  SELECT series_key, arg_max(y, t) AS last_value,
         avg(y) FILTER (WHERE t >= n - 4) AS recent_avg,
         sum(y) FILTER (WHERE t >= n - 4) AS tail4_sum,
         sum(y) FILTER (WHERE t >= n - 13) AS tail13_sum
  FROM (SELECT *, count(*) OVER (PARTITION BY series_key) AS n FROM weekly) GROUP BY series_key)"""


def growth_sql(base: str, comp: str) -> tuple[str, str]:
    g = (f"CASE WHEN {base} <= 0 THEN 0.0 ELSE round(({comp} - {base}) / {base} * 100.0, 1) END")
    t = (f"CASE WHEN {base} <= 0 THEN (CASE WHEN {comp} > 0 THEN 'Increasing' ELSE 'Stable' END) "
         f"WHEN round(({comp} - {base}) / {base} * 100.0, 1) > 5.0 THEN 'Increasing' "
         f"WHEN round(({comp} - {base}) / {base} * 100.0, 1) < -5.0 THEN 'Decreasing' ELSE 'Stable' END")
    return g, t


def W(*ctes: str) -> str:
    return O.with_(*ctes, recursive=True)


# ---------------------------------------------------------------------------
# cached building blocks (per session + sf_dir, lazily built, never collected)
# ---------------------------------------------------------------------------

def daily(spark, sf):
    return T.volume(spark, sf)


def daily_table(spark, sf):
    """The daily volume (T1: keys x days) materialised once for reports that read it many
    times; a reliable checkpoint in the shared folder, so it also cuts the lineage."""
    return checkpoint(T.volume(spark, sf))


def weekly(spark, sf):
    return SR.weekly_series(T.volume(spark, sf, until=CUT), CUT)


def forecast_table(spark, sf):
    return FC.weekly_forecast(FC.params(weekly(spark, sf)))


# ---------------------------------------------------------------------------
# 2.1 / 2.4 / 2.5 series operators
# ---------------------------------------------------------------------------

@register("daily_volume", W(VOL) + "SELECT date, series_key, CAST(cnt AS BIGINT) AS cnt FROM volume")
def q_daily_volume(spark, sf):
    return daily(spark, sf)


@register("daily_volume_orders", W(O.VIEWS["volume_orders"]) +
          "SELECT date, series_key, CAST(cnt AS BIGINT) AS cnt FROM volume_orders")
def q_daily_volume_orders(spark, sf):
    return T.volume_orders(spark, sf)


@register("weekly_series", W(VOL, WEEKLY) + "SELECT series_key, week, t, y FROM weekly")
def q_weekly_series(spark, sf):
    return weekly(spark, sf)


@register("weekly_total", W(VOL, WTOTAL) + "SELECT week, t, y FROM wtotal")
def q_weekly_total(spark, sf):
    return SR.weekly_total(T.volume(spark, sf, until=CUT), CUT)


@register("monthly_series", W(VOL, MSERIES) + "SELECT series_key, month, t, y FROM mseries")
def q_monthly_series(spark, sf):
    return SR.monthly_series(daily(spark, sf))


@register("monthly_total", W(VOL, MTOTAL) + "SELECT month, t, y FROM mtotal")
def q_monthly_total(spark, sf):
    return SR.monthly_total(daily(spark, sf))


@register("daily_regular", W(VOL, O.series_cte("dreg", "volume", [], "day")) +
          "SELECT day, t, y FROM dreg")
def q_daily_regular(spark, sf):
    return SR.daily_regular(daily(spark, sf))


@register("totals_rollup", W(VOL) + """SELECT series_key, CAST(SUM(cnt) AS BIGINT) AS total,
  CAST(grouping(series_key) AS INTEGER) AS is_grand_total FROM volume GROUP BY ROLLUP (series_key)""")
def q_totals_rollup(spark, sf):
    out = SR.totals_rollup(daily(spark, sf))
    return out.select("series_key", F.col("total").cast("long").alias("total"),
                      F.col("is_grand_total").cast("int").alias("is_grand_total"))


@register("most_popular", W(VOL) + """SELECT series_key, CAST(SUM(cnt) AS BIGINT) AS total FROM volume
  GROUP BY series_key ORDER BY total DESC, series_key LIMIT 1""")
def q_most_popular(spark, sf):
    return SR.most_popular(daily(spark, sf)).select("series_key", F.col("total").cast("long").alias("total"))


@register("available_keys", W(VOL) + "SELECT DISTINCT series_key FROM volume")
def q_available_keys(spark, sf):
    return SR.available_keys(daily(spark, sf))


@register("new_data_count", W(VOL) + f"""SELECT CAST(COUNT(DISTINCT date) AS BIGINT) AS new_days
  FROM volume WHERE date > DATE '{CUT}'""")
def q_new_data_count(spark, sf):
    return SR.new_data_count(daily(spark, sf), CUT)


@register("data_range", W(VOL) + f"""SELECT coalesce(strftime(min(date), '%Y-%m-%d'), '') AS start_date,
  CASE WHEN min(date) IS NULL THEN '' ELSE '{CUT}' END AS end_date, '{CUT}' AS cutoff
  FROM volume WHERE date <= DATE '{CUT}'""")
def q_data_range(spark, sf):
    return SR.data_range(daily(spark, sf), CUT)


@register("previous_totals", W(VOL, WTOTAL) + """SELECT round(arg_max(y, t), 1) AS previous_week_total,
  round(sum(y) FILTER (WHERE t >= n - 4), 1) AS previous_month_total,
  round(sum(y) FILTER (WHERE t >= n - 13), 1) AS previous_quarter_total,
  round(avg(y) FILTER (WHERE t >= n - 4), 4) AS recent_weekly_avg
  FROM (SELECT *, count(*) OVER () AS n FROM wtotal)""")
def q_previous_totals(spark, sf):
    tails = SR.tail_stats(SR.weekly_total(T.volume(spark, sf, until=CUT), CUT), [], "week")
    return tails.select(F.round("last_value", 1).alias("previous_week_total"),
                        F.round("tail4_sum", 1).alias("previous_month_total"),
                        F.round("tail13_sum", 1).alias("previous_quarter_total"),
                        F.round("recent_avg", 4).alias("recent_weekly_avg"))


@register("chart_monthly", W(VOL, MTOTAL) + f"""SELECT month, strftime(month, '%b %Y') AS label,
  round(y, 1) AS applicants FROM mtotal WHERE t >= (SELECT max(t) FROM mtotal) - {C.CHART_MONTHS - 1}""")
def q_chart_monthly(spark, sf):
    t = SR.tail(SR.monthly_total(daily(spark, sf)), [], C.CHART_MONTHS, "month")
    return t.select("month", S.month_label("month").alias("label"), F.round("y", 1).alias("applicants"))


@register("chart_weekly", W(VOL, WTOTAL) + f"""SELECT week, strftime(week, '%Y-%m-%d') AS label,
  round(y, 1) AS applicants FROM wtotal WHERE t >= (SELECT max(t) FROM wtotal) - {C.CHART_WEEKS - 1}""")
def q_chart_weekly(spark, sf):
    t = SR.tail(SR.weekly_total(T.volume(spark, sf, until=CUT), CUT), [], C.CHART_WEEKS, "week")
    return t.select("week", F.date_format("week", "yyyy-MM-dd").alias("label"),
                    F.round("y", 1).alias("applicants"))


@register("chrono_split", W(VOL, WEEKLY) + """, sp AS (
  SELECT series_key, count(*) AS n, min(week) AS first_period, max(week) AS last_period,
         CASE WHEN count(*) >= 2 THEN greatest(1, least(CAST(floor(count(*) * 0.8) AS INTEGER), CAST(count(*) - 1 AS INTEGER))) END AS split
  FROM weekly GROUP BY series_key),
ends AS (
  SELECT w.series_key, max(w.week) FILTER (WHERE w.t = sp.split - 1) AS train_end,
         max(w.week) FILTER (WHERE w.t = sp.split) AS test_start
  FROM weekly w JOIN sp ON w.series_key = sp.series_key GROUP BY w.series_key)
SELECT sp.series_key, CAST(sp.n AS BIGINT) AS n, sp.split,
  CASE WHEN train_end IS NULL THEN 'N/A' ELSE strftime(first_period, '%Y-%m-%d') || ' to ' || strftime(train_end, '%Y-%m-%d') END AS training_period,
  CASE WHEN test_start IS NULL THEN 'N/A' ELSE strftime(test_start, '%Y-%m-%d') || ' to ' || strftime(last_period, '%Y-%m-%d') END AS testing_period
FROM sp JOIN ends ON sp.series_key = ends.series_key""")
def q_chrono_split(spark, sf):
    return SR.chrono_split(weekly(spark, sf), ["series_key"], "week")


# ---------------------------------------------------------------------------
# 2.9 forecasting
# ---------------------------------------------------------------------------

@register("arima_params", W(VOL, WEEKLY, FIT) + """SELECT series_key, phi, theta, round(sse, 4) AS sse, n_obs,
  last_y, last_d, round(last_e, 6) AS last_e, data_start, data_end FROM m_fit""")
def q_arima_params(spark, sf):
    p = FC.params(weekly(spark, sf))
    return p.select("series_key", "phi", "theta", F.round("sse", 4).alias("sse"), "n_obs",
                    "last_y", "last_d", F.round("last_e", 6).alias("last_e"), "data_start", "data_end")


@register("arima_forecast", W(VOL, WEEKLY, FIT, FCAST) + "SELECT series_key, step, period, y_hat FROM fc")
def q_arima_forecast(spark, sf):
    return forecast_table(spark, sf).select("series_key", F.col("step").cast("long").alias("step"),
                                            "period", "y_hat")


@register("horizon_sums", W(VOL, WEEKLY, FIT, FCAST) + """SELECT series_key,
  CAST(grouping(series_key) AS INTEGER) AS is_total,
  round(CAST(sum(c) FILTER (WHERE step <= 1) AS DOUBLE) / CAST(100 AS DOUBLE), 1) AS next_week,
  round(CAST(sum(c) FILTER (WHERE step <= 4) AS DOUBLE) / CAST(100 AS DOUBLE), 1) AS next_month,
  round(CAST(sum(c) FILTER (WHERE step <= 13) AS DOUBLE) / CAST(100 AS DOUBLE), 1) AS next_quarter
  FROM (SELECT series_key, step, CAST(round(y_hat * 100) AS BIGINT) AS c FROM fc)
  GROUP BY ROLLUP (series_key)""")
def q_horizon_sums(spark, sf):
    return FC.horizon_sums_report(forecast_table(spark, sf))


_G4, _T4 = growth_sql("recent_avg", "s4 / 4.0")


@register("growth_trend", W(VOL, WEEKLY, FIT, FCAST, SUMS, TAILS) + f"""SELECT s.series_key,
  round(recent_avg, 4) AS recent_avg, round(s4 / 4.0, 4) AS comparable_forecast,
  {_G4} AS growth_percentage, {_T4} AS trend
  FROM sums s JOIN tails t ON s.series_key = t.series_key""")
def q_growth_trend(spark, sf):
    return FC.growth_trend(weekly(spark, sf), FC.horizon_sums(forecast_table(spark, sf)), "next_month")


COURSE_FORECASTS_SQL = f"""SELECT s.series_key AS course,
  CAST(coalesce(v.total, 0) AS BIGINT) AS historical_total_applicants,
  CAST(round(t.last_value) AS INTEGER) AS current_applicant_count,
  round(s4, 1) AS forecasted_applicant_count, round(s1, 1) AS forecast_next_week,
  round(s4, 1) AS forecast_next_month, round(s13, 1) AS forecast_next_quarter,
  {_T4} AS trend, {_G4} AS growth_percentage, 'next_month' AS period
  FROM sums s JOIN tails t ON s.series_key = t.series_key
  LEFT JOIN (SELECT series_key, SUM(cnt) AS total FROM volume GROUP BY series_key) v ON s.series_key = v.series_key"""


@register("course_forecasts", W(VOL, WEEKLY, FIT, FCAST, SUMS, TAILS) + COURSE_FORECASTS_SQL)
def q_course_forecasts(spark, sf):
    # totals need every date, the fit only dates up to the cutoff: reading the
    # materialised daily table serves both from one scan of the raw rows
    d = daily_table(spark, sf)
    wk = SR.weekly_series(d, CUT)
    return FC.course_forecasts(d, wk, TR.weekly_forecast(wk, f"weekly:{sf}:{CUT}"))


@register("forecast_buckets", W(VOL, WEEKLY, FIT, FCAST) + """SELECT series_key,
  CAST(floor((step - 1) / 4) AS INTEGER) + 1 AS bucket,
  round(CAST(sum(CAST(round(y_hat * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE), 1) AS applicants
  FROM fc WHERE step <= 12 GROUP BY ALL""")
def q_forecast_buckets(spark, sf):
    return FC.forecast_buckets(forecast_table(spark, sf))


@register("peak_step", W(VOL, WEEKLY, FIT, FCAST) + """SELECT series_key,
  CAST(min(step) FILTER (WHERE y_hat = mx) AS INTEGER) AS peak_step, max(mx) AS peak_value
  FROM (SELECT *, max(y_hat) OVER (PARTITION BY series_key) AS mx FROM fc WHERE step <= 13)
  GROUP BY series_key""")
def q_peak_step(spark, sf):
    out = FC.peak_step(forecast_table(spark, sf))
    return out.select("series_key", F.col("peak_step").cast("int").alias("peak_step"), "peak_value")


# ---------------------------------------------------------------------------
# fixture variants: a mid-week cutoff (partial last week) and the quick source
# ---------------------------------------------------------------------------
PARTIAL_CUT = "2000-12-28"


@register("weekly_series_partial_week", W(VOL, O.series_cte("wp", "volume", ["series_key"], "week",
                                                            cutoff=PARTIAL_CUT)) +
          "SELECT series_key, week, t, y FROM wp")
def q_weekly_series_partial_week(spark, sf):
    """A2 / B2: a Thursday cutoff keeps the week ending Sunday 2000-12-31 with Monday-Thursday only."""
    return SR.weekly_series(T.volume(spark, sf, until=PARTIAL_CUT), PARTIAL_CUT)


@register("arima_params_orders", W(O.VIEWS["volume_orders"],
                                   O.series_cte("wo", "volume_orders", ["series_key"], "week", cutoff=CUT),
                                   O.fit_ctes("mo", "wo", ["series_key"], "week")) +
          """SELECT series_key, phi, theta, round(sse, 4) AS sse, n_obs, last_y, last_d,
  round(last_e, 6) AS last_e, data_start, data_end FROM mo_fit""")
def q_arima_params_orders(spark, sf):
    """M1 on the quick source: weekly order counts per order priority."""
    w = SR.weekly_series(T.volume_orders(spark, sf), CUT)
    p = FC.params(w)
    return p.select("series_key", "phi", "theta", F.round("sse", 4).alias("sse"), "n_obs",
                    "last_y", "last_d", F.round("last_e", 6).alias("last_e"), "data_start", "data_end")


# registration side effects of the other catalog modules
from planwell.plans import catalog_stats  # noqa: E402,F401
from planwell.plans import catalog_backtest  # noqa: E402,F401
from planwell.plans import catalog_ingest  # noqa: E402,F401
from planwell.plans import catalog_training  # noqa: E402,F401
from planwell.plans import catalog_reports  # noqa: E402,F401
from planwell.plans import catalog_ml  # noqa: E402,F401
