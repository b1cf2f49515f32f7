"""Registered composite reports (R2, R3, R4, R6, R10, R11) and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from planwell import config as C
from planwell.functions import scalars as S
from planwell.operators import arima, series as SR, stats as ST
from planwell.plans import forecasting as FC
from planwell.plans import legacy as LG
from planwell.plans import reports as RP
from planwell.plans import training as TR
from planwell.plans.catalog import (COURSE_FORECASTS_SQL, CUT, FCAST, FIT, MSERIES, MTOTAL, SUMS, TAILS, VOL,
                                    WEEKLY, WTOTAL, W, daily, daily_table, growth_sql, register, ORACLE)
from planwell.plans.catalog_backtest import (M2, TWO, V2, WFT, HOLD, confidence_table, metrics_sql)
from planwell.plans.catalog_stats import LEARN, ORG_DIMS, age_sql, dist_sql
from planwell.plans import oracle as O
from planwell.sources import tables as T
from planwell.session import checkpoint

CF = "cf AS (" + COURSE_FORECASTS_SQL + ")"
TOT = """tot AS (SELECT
  round(CAST(sum(c) FILTER (WHERE step <= 1) AS DOUBLE) / CAST(100 AS DOUBLE), 1) AS nw,
  round(CAST(sum(c) FILTER (WHERE step <= 4) AS DOUBLE) / CAST(100 AS DOUBLE), 1) AS nm,
  round(CAST(sum(c) FILTER (WHERE step <= 13) AS DOUBLE) / CAST(100 AS DOUBLE), 1) AS nq
  FROM (SELECT step, CAST(round(y_hat * 100) AS BIGINT) AS c FROM fc))"""
RANKED = """top AS (SELECT * FROM cf ORDER BY forecasted_applicant_count DESC, course LIMIT 1),
fast AS (SELECT * FROM cf ORDER BY growth_percentage DESC, forecasted_applicant_count DESC, course LIMIT 1),
low AS (SELECT * FROM cf ORDER BY forecasted_applicant_count ASC, course DESC LIMIT 1)"""


def inputs(spark, sf):
    """Shared inputs of the multi-part reports: the daily table read once, weekly series,
    saved parameters (only series that changed since are fitted) and the forecast table."""
    d = daily_table(spark, sf)
    wk = checkpoint(SR.weekly_series(d, CUT))
    prm = TR.saved_params(wk, TR.WEEKLY_KEYS, "week", f"weekly:{sf}:{CUT}")
    return d, wk, SR.weekly_total(d, CUT), prm, FC.weekly_forecast(prm)


@register("forecast_summary", W(VOL, WEEKLY, WTOTAL, FIT, FCAST, SUMS, TAILS, CF, TOT, RANKED) + """,
prev AS (SELECT round(arg_max(y, t), 1) AS pw, round(sum(y) FILTER (WHERE t >= n - 4), 1) AS pm,
                round(sum(y) FILTER (WHERE t >= n - 13), 1) AS pq
         FROM (SELECT *, count(*) OVER () AS n FROM wtotal))
SELECT nw AS expected_applicants_next_week, nm AS expected_applicants_next_month,
  nq AS expected_applicants_next_quarter, pw AS previous_week_total, pm AS previous_month_total,
  pq AS previous_quarter_total,
  (SELECT CAST(SUM(cnt) AS BIGINT) FROM volume) AS total_historical_applicants,
  (SELECT course FROM top) AS highest_forecasted_course,
  (SELECT forecast_next_month FROM top) AS highest_forecasted_count,
  (SELECT course FROM fast) AS highest_growth_course,
  (SELECT growth_percentage FROM fast) AS highest_growth_percentage,
  (SELECT series_key FROM volume GROUP BY series_key ORDER BY SUM(cnt) DESC, series_key LIMIT 1) AS most_popular_course,
  (SELECT count(*) FROM m_fit) AS courses_modeled
FROM tot, prev""")
def q_forecast_summary(spark, sf):
    d, wk, wt, prm, fc = inputs(spark, sf)
    return RP.forecast_summary(d, wk, wt, fc, prm)


@register("forecast_insights", W(VOL, WEEKLY, FIT, FCAST, SUMS, TAILS, CF, RANKED) + """
SELECT 1 AS ord, course || ' has the highest projected applicant volume (' || format('{:,.0f}', forecasted_applicant_count) || ') for the selected period.' AS text FROM top
UNION ALL SELECT 2, course || ' is the fastest growing course (' || printf('%+.1f', growth_percentage) || '% versus recent weekly average).' FROM fast
UNION ALL SELECT 3, course || ' has the lowest projected applicant volume (' || format('{:,.0f}', forecasted_applicant_count) || ').' FROM low WHERE (SELECT count(*) FROM cf) > 1
UNION ALL SELECT 4, 'The most popular course historically is ' || (SELECT series_key FROM volume GROUP BY series_key ORDER BY SUM(cnt) DESC, series_key LIMIT 1) || '.'""")
def q_forecast_insights(spark, sf):
    d, wk, _, _, fc = inputs(spark, sf)
    return RP.forecast_insights(d, FC.course_forecasts(d, wk, fc))


def _tail_select(sql: str) -> tuple[str, str]:
    """Split 'tail of CTEs + final SELECT' text into (ctes, select)."""
    i = sql.rindex("\nSELECT ")
    return sql[:i], sql[i + 1:]


_OD_CTES, _OD_SEL = _tail_select(dist_sql("learners", ORG_DIMS, {"site": 10}))
_AG_CTES, _AG_SEL = _tail_select(age_sql("learners"))
CHARTS_SQL = W(VOL, WEEKLY, WTOTAL, MTOTAL, FIT, FCAST, SUMS, TAILS, CF, TOT, LEARN) + _OD_CTES + _AG_CTES + f""",
od AS ({_OD_SEL}
  UNION ALL
  SELECT 'course' AS dimension, series_key AS label, CAST(SUM(cnt) AS BIGINT) AS count,
    round(SUM(cnt) / (SELECT SUM(cnt) FROM volume) * 100.0, 1) AS percentage,
    CAST(row_number() OVER (ORDER BY SUM(cnt) DESC, series_key) AS INTEGER) AS rank
  FROM volume GROUP BY series_key),
ag AS ({_AG_SEL})
SELECT 'applicant_trend_over_time' AS chart, CAST(t AS INTEGER) AS ord, strftime(month, '%b %Y') AS label,
  round(y, 1) AS value, CAST(NULL AS DOUBLE) AS percentage
  FROM mtotal WHERE t >= (SELECT max(t) FROM mtotal) - {C.CHART_MONTHS - 1}
UNION ALL SELECT 'weekly_applicant_trend', CAST(t AS INTEGER), strftime(week, '%Y-%m-%d'), round(y, 1), NULL
  FROM wtotal WHERE t >= (SELECT max(t) FROM wtotal) - {C.CHART_WEEKS - 1}
UNION ALL SELECT 'forecast_curve', bucket, strftime(CAST((SELECT max(month) FROM mtotal) + to_months(bucket) AS DATE), '%b %Y'),
  round(CAST(c AS DOUBLE) / CAST(100 AS DOUBLE), 1), NULL
  FROM (SELECT CAST(floor((step - 1) / 4) AS INTEGER) + 1 AS bucket, sum(CAST(round(y_hat * 100) AS BIGINT)) AS c
        FROM fc WHERE step <= {C.CHART_BUCKETS * C.WEEKS_PER_BUCKET} GROUP BY 1)
UNION ALL SELECT 'top_courses', CAST(row_number() OVER (ORDER BY forecasted_applicant_count DESC, course) AS INTEGER) AS r,
  course, forecasted_applicant_count, NULL FROM cf QUALIFY r <= {C.TOP_COURSES_CHART}
UNION ALL SELECT 'summary_points', 1, 'Next Week', nw, NULL FROM tot
UNION ALL SELECT 'summary_points', 2, 'Next Month (~4 weeks)', nm, NULL FROM tot
UNION ALL SELECT 'summary_points', 3, 'Next Quarter (~13 weeks)', nq, NULL FROM tot
UNION ALL SELECT dimension || '_distribution', CAST(rank AS INTEGER), label, CAST(count AS DOUBLE), percentage FROM od
UNION ALL SELECT 'age_distribution', ord, label, CAST(count AS DOUBLE), percentage FROM ag"""


@register("forecast_charts", CHARTS_SQL)
def q_forecast_charts(spark, sf):
    d, wk, wt, _, fc = inputs(spark, sf)
    return charts(spark, sf, d, wt, fc, FC.course_forecasts(d, wk, fc))


def charts(spark, sf, d, wt, fc, cf):
    """R4 with the learners counted in one pass."""
    from pyspark.sql import Window
    demo, ages = ST.distributions_and_ages(T.learners(spark, sf), ORG_DIMS, {"site": 10})
    course = ST.weighted_distribution(d).select(
        F.lit("course").alias("dimension"), "label", "count", "percentage",
        F.row_number().over(Window.orderBy(F.desc("count"), F.asc("label"))).alias("rank"))
    return RP.forecast_charts(d, wt, fc, cf, demo.unionByName(course), ages)


_G1, _T1 = growth_sql("recent_avg", "s1")


@register("course_detail", W(VOL, WEEKLY, MSERIES, FIT, FCAST, SUMS, TAILS) + f""",
lm AS (SELECT series_key, max(month) AS last_month FROM mseries GROUP BY series_key),
bk AS (SELECT series_key, CAST(floor((step - 1) / 4) AS INTEGER) + 1 AS bucket,
  round(CAST(sum(CAST(round(y_hat * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE), 1) AS applicants
  FROM fc WHERE step <= 12 GROUP BY ALL)
SELECT s.series_key AS course, CAST(round(t.last_value) AS INTEGER) AS current_applicant_count,
  round(s1, 1) AS forecast_next_week, round(s4, 1) AS forecast_next_month, round(s13, 1) AS forecast_next_quarter,
  {_T1} AS trend,
  (SELECT applicants FROM bk WHERE bk.series_key = s.series_key AND bucket = 1) AS month_1,
  (SELECT applicants FROM bk WHERE bk.series_key = s.series_key AND bucket = 2) AS month_2,
  (SELECT applicants FROM bk WHERE bk.series_key = s.series_key AND bucket = 3) AS month_3,
  strftime(CAST(lm.last_month + to_months(1) AS DATE), '%b %Y') AS month_1_label,
  strftime(CAST(lm.last_month + to_months(2) AS DATE), '%b %Y') AS month_2_label,
  strftime(CAST(lm.last_month + to_months(3) AS DATE), '%b %Y') AS month_3_label
FROM sums s JOIN tails t ON s.series_key = t.series_key LEFT JOIN lm ON lm.series_key = s.series_key""")
def q_course_detail(spark, sf):
    d, wk, _, _, fc = inputs(spark, sf)
    return RP.course_detail(wk, d, fc)


@register("course_detail_history", W(VOL, MSERIES) + f"""SELECT series_key, month, strftime(month, '%b %Y') AS label,
  round(y, 1) AS applicants FROM mseries m
  WHERE t >= (SELECT max(t) FROM mseries m2 WHERE m2.series_key = m.series_key) - {C.CHART_MONTHS - 1}""")
def q_course_detail_history(spark, sf):
    t = SR.tail(SR.monthly_series(daily(spark, sf)), ["series_key"], C.CHART_MONTHS, "month")
    return t.select("series_key", "month", S.month_label("month").alias("label"), F.round("y", 1).alias("applicants"))


PERIODS_SQL = " UNION ALL ".join(
    f"SELECT '{k}' AS forecast_period, {v} AS steps, '{C.PREDICT_LABELS[k]}' AS label"
    for k, v in C.PREDICT_PERIODS.items())
CONF_SQL = f"""om AS ({metrics_sql("wft", [])}),
conf AS (SELECT CASE WHEN coalesce(om.mae, 0.0) / CASE WHEN (SELECT avg(y) FROM wtotal) = 0 THEN 1.0
    ELSE (SELECT avg(y) FROM wtotal) END < 0.08 THEN 'High'
  WHEN coalesce(om.mae, 0.0) / CASE WHEN (SELECT avg(y) FROM wtotal) = 0 THEN 1.0
    ELSE (SELECT avg(y) FROM wtotal) END < 0.15 THEN 'Medium' ELSE 'Low' END AS level FROM om)"""


@register("volume_forecast", W(VOL, WEEKLY, WTOTAL, FIT, FCAST, WFT) + f""", {CONF_SQL},
st AS (SELECT step, round(CAST(sum(CAST(round(y_hat * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE), 1) AS p
  FROM fc GROUP BY step),
per AS ({PERIODS_SQL}),
ps AS (SELECT per.*, st.step, st.p, max(st.p) OVER (PARTITION BY per.forecast_period) AS mx
  FROM per JOIN st ON st.step <= per.steps),
agg AS (SELECT forecast_period, steps, label, CAST(sum(CAST(round(p * 10) AS BIGINT)) AS DOUBLE) / 10.0 AS total,
  min(step) FILTER (WHERE p = mx) AS peak_week, max(p) AS peak_value FROM ps GROUP BY ALL),
hist AS (SELECT *, count(*) OVER () AS n FROM wtotal),
prev AS (SELECT per.forecast_period, round(sum(h.y) FILTER (WHERE h.t >= h.n - per.steps), 1) AS pt
  FROM per, hist h GROUP BY per.forecast_period)
SELECT a.forecast_period, a.label AS planning_period_label, CAST(a.steps AS INTEGER) AS steps,
  round(a.total, 1) AS total_predicted_applicants, coalesce(p.pt, 0.0) AS previous_period_total,
  CASE WHEN p.pt = 0 THEN 0.0 ELSE round((round(a.total, 1) - p.pt) / p.pt * 100.0, 1) END AS growth_percentage,
  CASE WHEN (CASE WHEN p.pt = 0 THEN 0.0 ELSE round((round(a.total, 1) - p.pt) / p.pt * 100.0, 1) END) > 1 THEN 'growth'
       WHEN (CASE WHEN p.pt = 0 THEN 0.0 ELSE round((round(a.total, 1) - p.pt) / p.pt * 100.0, 1) END) < -1 THEN 'decline'
       ELSE 'stable' END AS growth_direction,
  (SELECT level FROM conf) AS confidence_level,
  CAST(CASE WHEN a.steps > 1 THEN a.peak_week END AS INTEGER) AS peak_week,
  CASE WHEN a.steps > 1 THEN a.peak_value END AS peak_value,
  CAST(greatest(1, floor(a.steps / 4)) AS INTEGER) AS n_buckets
FROM agg a LEFT JOIN prev p ON a.forecast_period = p.forecast_period""")
def q_volume_forecast(spark, sf):
    """R10 for the four planning periods (organisation-wide)."""
    _, _, wt, _, fc = inputs(spark, sf)
    return RP.volume_forecast(wt, fc, confidence_table(spark, sf, wt))


@register("volume_insights", ORACLE["volume_forecast"].replace("\nSELECT a.forecast_period, a.label", ",\nvf AS (SELECT a.forecast_period, a.label", 1) + """)
SELECT forecast_period, CAST(1 AS INTEGER) AS ord, 'The organisation is projected to receive ' || format('{:,.0f}', total_predicted_applicants)
  || ' applicants during the ' || lower(planning_period_label) || ' planning window.' AS text FROM vf
UNION ALL SELECT forecast_period, 2, CASE growth_direction
  WHEN 'growth' THEN 'Applicant volume is expected to increase by ' || CAST(abs(growth_percentage) AS VARCHAR) || '% compared with the equivalent previous period.'
  WHEN 'decline' THEN 'Applicant volume is expected to decrease by ' || CAST(abs(growth_percentage) AS VARCHAR) || '% compared with the equivalent previous period.'
  ELSE 'Applicant volume is expected to remain stable compared with the equivalent previous period.' END FROM vf
UNION ALL SELECT forecast_period, 3, 'Peak weekly demand is projected in week ' || peak_week || ' with approximately '
  || format('{:,.0f}', peak_value) || ' applicants.' FROM vf WHERE peak_week IS NOT NULL""")
def q_volume_insights(spark, sf):
    """The planning sentences of every planning period."""
    return RP.volume_insights(q_volume_forecast(spark, sf))


BUCKETS_PERIODS = " UNION ALL ".join(
    f"SELECT '{k}' AS forecast_period, {v} AS steps" for k, v in C.PREDICT_PERIODS.items())


@register("volume_forecast_buckets", W(VOL, WEEKLY, MTOTAL, FIT, FCAST) + f""",
st AS (SELECT step, round(CAST(sum(CAST(round(y_hat * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE), 1) AS p
  FROM fc GROUP BY step),
per AS ({BUCKETS_PERIODS})
SELECT forecast_period, CAST(floor((step - 1) / 4) AS INTEGER) + 1 AS bucket,
  strftime(CAST((SELECT max(month) FROM mtotal) + to_months(CAST(floor((step - 1) / 4) AS INTEGER) + 1) AS DATE), '%b %Y') AS period,
  round(CAST(sum(CAST(round(p * 10) AS BIGINT)) AS DOUBLE) / 10.0, 1) AS applicants
FROM per JOIN st ON st.step <= per.steps
WHERE CAST(floor((step - 1) / 4) AS INTEGER) + 1 <= greatest(1, CAST(floor(steps / 4) AS INTEGER))
GROUP BY ALL""")
def q_volume_forecast_buckets(spark, sf):
    """R10 month-equivalent buckets (organisation-wide) for every planning period."""
    d, _, _, _, fc = inputs(spark, sf)
    return RP.volume_forecast_buckets(fc, SR.monthly_total(d))


LEG_FC = O.forecast_cte("fc9", "m9_fit", TWO, steps=12, grain="month", clip=False, digits=4)
LEG_PERIODS = " UNION ALL ".join(f"SELECT '{k}' AS forecast_period, {v} AS steps" for k, v in C.LEGACY_PERIODS.items())
M2T = O.series_cte("m2t", "volume_two_key", [], "month", fill=False)


@register("volume_forecast_monthly", W(V2, M2, M2T, O.fit_ctes("m9", "m2", TWO, "month"), LEG_FC, HOLD) + f""",
st AS (SELECT step, round(CAST(sum(CAST(round(y_hat * 10000) AS BIGINT)) AS DOUBLE) / CAST(10000 AS DOUBLE), 1) AS p
  FROM fc9 GROUP BY step),
per AS ({LEG_PERIODS}),
ps AS (SELECT per.*, st.step, st.p, max(st.p) OVER (PARTITION BY per.forecast_period) AS mx
  FROM per JOIN st ON st.step <= per.steps),
agg AS (SELECT forecast_period, steps, CAST(sum(CAST(round(p * 10) AS BIGINT)) AS DOUBLE) / 10.0 AS total,
  min(step) FILTER (WHERE p = mx) AS peak_month, max(p) AS peak_value FROM ps GROUP BY ALL),
hist AS (SELECT *, count(*) OVER () AS n FROM m2t),
prev AS (SELECT per.forecast_period, round(coalesce(sum(h.y) FILTER (WHERE h.t >= h.n - per.steps), 0.0), 1) AS pt
  FROM per, hist h GROUP BY per.forecast_period),
hm AS (SELECT avg(mae) FILTER (WHERE mae IS NOT NULL AND rmse IS NOT NULL) AS mae FROM (SELECT site, series_key,
  avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse
  FROM hold GROUP BY site, series_key)),
conf AS (SELECT CASE WHEN hm.mae IS NULL OR (SELECT avg(y) FROM m2t) IS NULL OR (SELECT avg(y) FROM m2t) <= 0 THEN 'Medium'
  WHEN hm.mae / (SELECT avg(y) FROM m2t) < 0.08 THEN 'High'
  WHEN hm.mae / (SELECT avg(y) FROM m2t) < 0.15 THEN 'Medium' ELSE 'Low' END AS level FROM hm)
SELECT a.forecast_period, CAST(a.steps AS INTEGER) AS steps, round(a.total, 1) AS total_predicted_applicants,
  p.pt AS previous_period_total,
  CASE WHEN p.pt = 0 THEN 0.0 ELSE round((round(a.total, 1) - p.pt) / p.pt * 100.0, 1) END AS growth_percentage,
  CASE WHEN (CASE WHEN p.pt = 0 THEN 0.0 ELSE round((round(a.total, 1) - p.pt) / p.pt * 100.0, 1) END) > 1 THEN 'growth'
       WHEN (CASE WHEN p.pt = 0 THEN 0.0 ELSE round((round(a.total, 1) - p.pt) / p.pt * 100.0, 1) END) < -1 THEN 'decline'
       ELSE 'stable' END AS growth_direction,
  (SELECT level FROM conf) AS confidence_level,
  CAST(a.peak_month AS INTEGER) AS peak_month, a.peak_value
FROM agg a JOIN prev p ON a.forecast_period = p.forecast_period""")
def q_volume_forecast_monthly(spark, sf):
    """The legacy monthly answer for 1 / 3 / 6 / 12 months from all (site, key) models."""
    return LG.report(*legacy_inputs(spark, sf))


def legacy_inputs(spark, sf):
    """The monthly series (made once), its total and the saved models' 12-month forecast."""
    monthly = checkpoint(T.volume_two_key(spark, sf))
    series = checkpoint(SR.resample(monthly, "month", TWO, fill=None))
    prm = TR.saved_params(series, TWO, "month", f"two-key:{sf}")
    fc = arima.forecast(prm, TWO, steps=12, period_step="month", clip=False, digits=4)
    return series, SR.resample(monthly, "month", [], fill=None), fc


LEGACY_STEPS = """st AS (SELECT step, round(CAST(sum(CAST(round(y_hat * 10000) AS BIGINT)) AS DOUBLE) / CAST(10000 AS DOUBLE), 1) AS p
  FROM fc9 GROUP BY step)"""


@register("volume_monthly_charts", W(V2, M2, M2T, O.fit_ctes("m9", "m2", TWO, "month"), LEG_FC) + f""", {LEGACY_STEPS},
per AS ({LEG_PERIODS}), hist AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS back FROM m2t),
old AS (SELECT month, y, CAST(row_number() OVER (ORDER BY month) AS INTEGER) AS ord FROM hist WHERE back <= {C.CHART_MONTHS})
SELECT per.forecast_period, 'historical_volume' AS series, ord, strftime(month, '%b %Y') AS period, round(y, 1) AS applicants FROM per, old
UNION ALL SELECT per.forecast_period, 'forecast_volume', CAST(step AS INTEGER),
  strftime(CAST((SELECT max(month) FROM m2t) + to_months(CAST(step AS INTEGER)) AS DATE), '%b %Y'), p FROM per JOIN st ON step <= per.steps""")
def q_volume_monthly_charts(spark, sf):
    """The history of 18 months and the forecast series of every planning period."""
    _, total, fc = legacy_inputs(spark, sf)
    return LG.charts(total, fc)


@register("volume_monthly_insights", ORACLE["volume_forecast_monthly"].replace("\nSELECT a.forecast_period", ",\nvf AS (SELECT a.forecast_period", 1) + """),
lab AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS k, '{v}' AS label" for k, v in C.LEGACY_LABELS.items()) + """)
SELECT forecast_period, 1 AS ord, 'The organisation is projected to receive ' || format('{:,.0f}', total_predicted_applicants)
  || ' applicants during the ' || lower(label) || ' planning window.' AS text FROM vf JOIN lab ON k = forecast_period
UNION ALL SELECT forecast_period, 2, CASE growth_direction
  WHEN 'growth' THEN 'Applicant volume is expected to increase by ' || CAST(abs(growth_percentage) AS VARCHAR) || '% compared with the previous period of the same length.'
  WHEN 'decline' THEN 'Applicant volume is expected to decrease by ' || CAST(abs(growth_percentage) AS VARCHAR) || '% compared with the previous period of the same length.'
  ELSE 'Applicant volume is expected to remain stable compared with the previous period of the same length.' END FROM vf
UNION ALL SELECT forecast_period, 3, 'Peak demand is projected in month ' || peak_month || ' with approximately '
  || format('{:,.0f}', peak_value) || ' applicants.' FROM vf WHERE steps > 1
UNION ALL SELECT forecast_period, 4, 'Use this forecast to plan instructor allocation, training schedules, and barangay coordination across all programs.' FROM vf""")
def q_volume_monthly_insights(spark, sf):
    """The planning sentences of every planning period."""
    return LG.insights(q_volume_forecast_monthly(spark, sf))


_KPIS = ["expected_applicants_next_week", "expected_applicants_next_month", "expected_applicants_next_quarter", "previous_week_total",
         "previous_month_total", "previous_quarter_total", "total_historical_applicants", "highest_forecasted_count",
         "highest_growth_percentage", "courses_modeled"]


@register("dashboard", "WITH fs AS (" + ORACLE["forecast_summary"] + "), cs AS (" + ORACLE["course_forecasts"] + "), ch AS (" + ORACLE["forecast_charts"]
          + "), fi AS (" + ORACLE["forecast_insights"] + ")\n" + " UNION ALL ".join(
              f"SELECT 'summary' AS part, {i} AS ord, '{k}' AS label, CAST({k} AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM fs" for i, k in enumerate(_KPIS, 1)) + """
UNION ALL SELECT 'courses', NULL, course, forecasted_applicant_count, trend FROM cs
UNION ALL SELECT 'charts', ord, chart || ': ' || label, value, NULL FROM ch
UNION ALL SELECT 'insights', ord, NULL, NULL, text FROM fi""")
def q_dashboard(spark, sf):
    """Summary, courses, charts and insights from one daily table, one set of parameters and one pass over the learners."""
    d, wk, wt, prm, fc = inputs(spark, sf)
    cf = checkpoint(FC.course_forecasts(d, wk, fc))
    kpi = RP.forecast_summary(d, wk, wt, fc, prm).select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(k).alias("label"), F.col(k).cast("double").alias("value")) for i, k in enumerate(_KPIS, 1)])).alias("k"))
    none = F.lit(None).cast("string")
    out = kpi.select(F.lit("summary").alias("part"), "k.ord", "k.label", "k.value", none.alias("text"))
    out = out.unionByName(cf.select(F.lit("courses").alias("part"), F.lit(None).cast("int").alias("ord"), F.col("course").alias("label"),
                                    F.col("forecasted_applicant_count").alias("value"), F.col("trend").alias("text")))
    out = out.unionByName(charts(spark, sf, d, wt, fc, cf).select(
        F.lit("charts").alias("part"), "ord", F.concat("chart", F.lit(": "), "label").alias("label"), "value", none.alias("text")))
    return out.unionByName(RP.forecast_insights(d, cf).select(
        F.lit("insights").alias("part"), "ord", none.alias("label"), F.lit(None).cast("double").alias("value"), "text"))
