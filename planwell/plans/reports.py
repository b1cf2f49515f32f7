"""Composite forecast reports (R2-R4, R6, R10, R11) over the per-key tables.

Single-value KPIs are scalar subqueries over one-row aggregates, so no
report needs a cross join; every join is on the series key between tables
of at most one row per key (or per key and step).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planwell import config as C
from planwell.functions import scalars as S
from planwell.operators import arima, series as SR, stats as ST
from planwell.plans import forecasting as FC

SUMMARY_POINTS = [("Next Week", 1), ("Next Month (~4 weeks)", 4), ("Next Quarter (~13 weeks)", 13)]


def total_horizons(fc: DataFrame) -> DataFrame:
    """M3 total over keys: one row with next_week / next_month / next_quarter (1 dp)."""
    c = FC.cents()
    return fc.agg(*[F.round(F.sum(F.when(F.col("step") <= s, c)) / F.lit(100.0), 1).alias(n)
                    for n, s in (("next_week", 1), ("next_month", 4), ("next_quarter", 13))])


def _top(cf: DataFrame):
    return cf.orderBy(F.desc("forecasted_applicant_count"), F.asc("course")).limit(1)


def _fastest(cf: DataFrame):
    # Argmax of growth; the first in the ranked list on ties
    return cf.orderBy(F.desc("growth_percentage"), F.desc("forecasted_applicant_count"),
                      F.asc("course")).limit(1)


def _lowest(cf: DataFrame):
    # K5: last item of the ranked list
    return cf.orderBy(F.asc("forecasted_applicant_count"), F.desc("course")).limit(1)


def forecast_summary(daily: DataFrame, weekly: DataFrame, wtotal: DataFrame, fc: DataFrame,
                     params: DataFrame) -> DataFrame:
    """R2: one row of KPIs (organisation-wide)."""
    cf = FC.course_forecasts(daily, weekly, fc, "next_month")
    # one struct-valued scalar subquery per source table: each runs once
    prev = SR.tail_stats(wtotal, [], "week").select(F.struct(
        F.round("last_value", 1).alias("w"), F.round("tail4_sum", 1).alias("m"),
        F.round("tail13_sum", 1).alias("q"))).scalar()
    top = _top(cf).select(F.struct("course", "forecast_next_month")).scalar()
    fast = _fastest(cf).select(F.struct("course", "growth_percentage")).scalar()
    mp = SR.most_popular(daily)
    return total_horizons(fc).select(
        F.col("next_week").alias("expected_applicants_next_week"),
        F.col("next_month").alias("expected_applicants_next_month"),
        F.col("next_quarter").alias("expected_applicants_next_quarter"),
        prev["w"].alias("previous_week_total"),
        prev["m"].alias("previous_month_total"),
        prev["q"].alias("previous_quarter_total"),
        daily.select(F.sum("cnt")).scalar().cast("long").alias("total_historical_applicants"),
        top["course"].alias("highest_forecasted_course"),
        top["forecast_next_month"].alias("highest_forecasted_count"),
        fast["course"].alias("highest_growth_course"),
        fast["growth_percentage"].alias("highest_growth_percentage"),
        mp.select("series_key").scalar().alias("most_popular_course"),
        params.select(F.count(F.lit(1))).scalar().alias("courses_modeled"))


def forecast_insights(daily: DataFrame, cf: DataFrame) -> DataFrame:
    """The organisation-wide planning sentences as (ord, text) rows."""
    top, fast, low = _top(cf), _fastest(cf), _lowest(cf)
    n = cf.select(F.count(F.lit(1))).scalar()
    s1 = top.select(F.lit(1).alias("ord"), F.format_string(
        C.INSIGHT_HIGHEST, F.col("course"), S.fmt_int("forecasted_applicant_count")).alias("text"))
    s2 = fast.select(F.lit(2).alias("ord"), F.format_string(C.INSIGHT_FASTEST, F.col("course"), F.col("growth_percentage")).alias("text"))
    s3 = low.where(n > 1).select(F.lit(3).alias("ord"), F.format_string(
        C.INSIGHT_LOWEST, F.col("course"), S.fmt_int("forecasted_applicant_count")).alias("text"))
    s4 = SR.most_popular(daily).select(F.lit(4).alias("ord"), F.format_string(C.INSIGHT_POPULAR, F.col("series_key")).alias("text"))
    return s1.unionByName(s2).unionByName(s3).unionByName(s4)


def _chart(df: DataFrame, chart: str, ord_col, label, value, pct=None) -> DataFrame:
    return df.select(F.lit(chart).alias("chart"), ord_col.cast("int").alias("ord"),
                     label.cast("string").alias("label"), value.cast("double").alias("value"),
                     (pct if pct is not None else F.lit(None)).cast("double").alias("percentage"))


def forecast_charts(daily: DataFrame, wtotal: DataFrame, fc: DataFrame, cf: DataFrame,
                    distributions: DataFrame, ages: DataFrame) -> DataFrame:
    """Every chart series as one long table (chart, ord, label, value, percentage)."""
    mtotal = SR.monthly_total(daily)
    months = SR.tail(mtotal, [], C.CHART_MONTHS, "month")
    trend = _chart(months, "applicant_trend_over_time", F.col("t"), S.month_label("month"), F.round("y", 1))
    weeks = SR.tail(wtotal, [], C.CHART_WEEKS, "week")
    wtrend = _chart(weeks, "weekly_applicant_trend", F.col("t"), F.date_format("week", "yyyy-MM-dd"),
                    F.round("y", 1))
    last_month = mtotal.select(F.max("month")).scalar()
    b = F.floor((F.col("step") - 1) / F.lit(C.WEEKS_PER_BUCKET)).cast("int") + 1
    buckets = (fc.where(F.col("step") <= C.CHART_BUCKETS * C.WEEKS_PER_BUCKET)
               .groupBy(b.alias("bucket")).agg(F.sum(FC.cents()).alias("c")))
    curve = _chart(buckets, "forecast_curve", F.col("bucket"),
                   S.month_label(F.add_months(last_month, F.col("bucket"))),
                   F.round(F.col("c") / F.lit(100.0), 1))
    top = cf.orderBy(F.desc("forecasted_applicant_count"), F.asc("course")).limit(C.TOP_COURSES_CHART)
    w = Window.orderBy(F.desc("forecasted_applicant_count"), F.asc("course"))
    top = _chart(top.withColumn("_r", F.row_number().over(w)), "top_courses", F.col("_r"),
                 F.col("course"), F.col("forecasted_applicant_count"))
    hz = total_horizons(fc)
    pts = None
    for i, (label, steps) in enumerate(SUMMARY_POINTS, start=1):
        col = {1: "next_week", 4: "next_month", 13: "next_quarter"}[steps]
        one = _chart(hz, "summary_points", F.lit(i), F.lit(label), F.col(col))
        pts = one if pts is None else pts.unionByName(one)
    dist = distributions.select(F.concat(F.col("dimension"), F.lit("_distribution")).alias("chart"),
                                F.col("rank").cast("int").alias("ord"), F.col("label").cast("string").alias("label"),
                                F.col("count").cast("double").alias("value"),
                                F.col("percentage").cast("double").alias("percentage"))
    age = _chart(ages, "age_distribution", F.col("ord"), F.col("label"), F.col("count"), F.col("percentage"))
    return (trend.unionByName(wtrend).unionByName(curve).unionByName(top).unionByName(pts)
            .unionByName(dist).unionByName(age))


def course_detail(weekly: DataFrame, daily: DataFrame, fc: DataFrame) -> DataFrame:
    """R6 for every key: current count, horizons, next-week trend, 3 month-equivalent buckets
    dated after the key's last month."""
    sums = FC.horizon_sums(fc)
    tails = SR.tail_stats(weekly, ["series_key"], "week")
    last_month = SR.monthly_series(daily).groupBy("series_key").agg(F.max("month").alias("last_month"))
    bk = FC.forecast_buckets(fc).groupBy("series_key").pivot("bucket", [1, 2, 3]).agg(F.first("applicants"))
    _, trend = S.growth_and_trend(F.col("recent_avg"), F.col("sum1"))
    j = sums.join(tails, "series_key").join(last_month, "series_key", "left").join(bk, "series_key", "left")
    return j.select(
        F.col("series_key").alias("course"),
        S.round_int("last_value").alias("current_applicant_count"),
        F.round("sum1", 1).alias("forecast_next_week"), F.round("sum4", 1).alias("forecast_next_month"),
        F.round("sum13", 1).alias("forecast_next_quarter"), trend.alias("trend"),
        F.col("1").alias("month_1"), F.col("2").alias("month_2"), F.col("3").alias("month_3"),
        S.month_label(F.add_months("last_month", 1)).alias("month_1_label"),
        S.month_label(F.add_months("last_month", 2)).alias("month_2_label"),
        S.month_label(F.add_months("last_month", 3)).alias("month_3_label"))


def step_predictions(fc: DataFrame, round_steps: bool = True) -> DataFrame:
    """Weekly predictions of R10: cross-key step sums rounded to 1 dp (organisation-wide,
    B17), or the unrounded values when one key is selected; ``units`` are exact integers."""
    if round_steps:
        return FC.total_forecast_by_step(fc).select(
            "step", F.col("y_total").alias("p"), F.round(F.col("y_total") * 10).cast("long").alias("units"),
            F.lit(10.0).alias("scale"))
    return fc.groupBy("step").agg(F.sum(FC.cents()).alias("units")).select(
        "step", (F.col("units") / F.lit(100.0)).alias("p"), "units", F.lit(100.0).alias("scale"))


def volume_forecast_buckets(fc: DataFrame, monthly_history: DataFrame, round_steps: bool = True) -> DataFrame:
    """R10 month-equivalent buckets for every period: 4-week sums dated after the last history month."""
    st = step_predictions(fc, round_steps)
    periods = F.create_map(*[x for k, v in C.PREDICT_PERIODS.items() for x in (F.lit(k), F.lit(v))])
    last_month = monthly_history.select(F.max("month")).scalar()
    per = st.select("*", F.explode(periods).alias("forecast_period", "steps"))
    n_b = F.greatest(F.lit(1), F.floor(F.col("steps") / F.lit(C.WEEKS_PER_BUCKET)))
    b = F.floor((F.col("step") - 1) / F.lit(C.WEEKS_PER_BUCKET)).cast("int") + 1
    per = per.where((F.col("step") <= F.col("steps")) & (b <= n_b))
    out = per.groupBy("forecast_period", b.alias("bucket")).agg(
        (F.sum("units") / F.first("scale")).alias("v"))
    return out.select("forecast_period", "bucket",
                      S.month_label(F.add_months(last_month, F.col("bucket"))).alias("period"),
                      F.round("v", 1).alias("applicants"))


def volume_forecast(wtotal: DataFrame, fc: DataFrame, confidence: DataFrame, round_steps: bool = True) -> DataFrame:
    """R10 for every planning period at once, one row per period.

    Organisation-wide, weekly predictions are the cross-key step sums rounded
    to 1 dp (B17); for one key they are that key's values.  Totals add exact
    integer units, so they do not depend on row order.
    """
    step_tot = step_predictions(fc, round_steps)
    periods = F.create_map(*[x for k, v in C.PREDICT_PERIODS.items() for x in (F.lit(k), F.lit(v))])
    labels = F.create_map(*[x for k, v in C.PREDICT_LABELS.items() for x in (F.lit(k), F.lit(v))])
    per = step_tot.select("*", F.explode(periods).alias("forecast_period", "steps")).where(
        F.col("step") <= F.col("steps"))
    agg = per.groupBy("forecast_period", "steps").agg(
        (F.sum("units") / F.first("scale")).alias("total"),
        F.min_by("step", F.struct(-F.col("p"), F.col("step"))).alias("peak_week"),
        F.max("p").alias("peak_value"))
    # previous period: the same number of weeks from the history tail (all of it if shorter)
    pos = SR.with_position_from_end(wtotal, [], "week")
    tails = pos.agg(*[F.round(F.sum(F.when(F.col("rpos") <= n, F.col("y"))), 1).alias(f"t{n}")
                      for n in sorted(set(C.PREDICT_PERIODS.values()))])
    prev_expr = None
    for n in sorted(set(C.PREDICT_PERIODS.values())):
        val = tails.select(f"t{n}").scalar()
        prev_expr = (F.when(F.col("steps") == n, val) if prev_expr is None
                     else prev_expr.when(F.col("steps") == n, val))
    j = agg.withColumn("previous_period_total", prev_expr)
    growth = S.growth_pct(F.round("total", 1), F.col("previous_period_total"))
    conf = confidence.select("confidence_level").scalar()
    return j.select(
        "forecast_period", labels[F.col("forecast_period")].alias("planning_period_label"),
        F.col("steps").cast("int").alias("steps"),
        F.round("total", 1).alias("total_predicted_applicants"),
        F.coalesce("previous_period_total", F.lit(0.0)).alias("previous_period_total"),
        growth.alias("growth_percentage"), S.growth_direction(growth).alias("growth_direction"),
        conf.alias("confidence_level"),
        F.when(F.col("steps") > 1, F.col("peak_week")).cast("int").alias("peak_week"),
        F.when(F.col("steps") > 1, F.col("peak_value")).alias("peak_value"),
        F.greatest(F.lit(1), F.floor(F.col("steps") / F.lit(C.WEEKS_PER_BUCKET))).cast("int").alias("n_buckets"))


def volume_insights(report: DataFrame, subject: str = "The organisation") -> DataFrame:
    """The planning sentences on total, direction and peak week, as (forecast_period, ord, text) rows."""
    change = F.abs("growth_percentage").cast("string")
    texts = F.array(
        F.format_string(C.INSIGHT_TOTAL, F.lit(subject), S.fmt_int("total_predicted_applicants"),
                        F.lower("planning_period_label")),
        F.when(F.col("growth_direction") == "growth", F.format_string(C.INSIGHT_INCREASE, change))
        .when(F.col("growth_direction") == "decline", F.format_string(C.INSIGHT_DECREASE, change))
        .otherwise(F.lit(C.INSIGHT_STABLE)),
        F.when(F.col("peak_week").isNotNull(), F.format_string(C.INSIGHT_PEAK, F.col("peak_week").cast("string"),
                                                               S.fmt_int("peak_value"))))
    rows = report.select("forecast_period", F.posexplode(texts).alias("pos", "text"))
    return rows.where(F.col("text").isNotNull()).select("forecast_period", (F.col("pos") + 1).alias("ord"), "text")


def evaluation(weekly: DataFrame, wtotal: DataFrame) -> DataFrame:
    """M7: the overall backtest (the total series fitted on its own) and that of every key; keys that
    cannot be evaluated are listed as skipped with the reason."""
    ranges = SR.chrono_split(wtotal, [], "week").select(F.struct("training_period", "testing_period")).scalar()
    overall = ST.forecast_metrics(arima.walk_forward(wtotal, [], "week"), [])
    overall = overall.select(
        F.lit("overall").alias("scope"), F.lit(None).cast("string").alias("series_key"),
        "mape", "mae", "rmse", F.col("test_periods").cast("long").alias("test_periods"),
        F.col("mape_periods").cast("long").alias("mape_periods"),
        S.mape_class(F.col("mape")).alias("assessment"), F.lit("evaluated").alias("status"),
        F.lit(None).cast("string").alias("reason"),
        ranges["training_period"].alias("training_period"), ranges["testing_period"].alias("testing_period"))
    per_key = ST.forecast_metrics(arima.walk_forward(weekly, ["series_key"], "week"), ["series_key"])
    split = SR.chrono_split(weekly, ["series_key"], "week").select(
        "series_key", "split", "training_period", "testing_period")
    # a single period cannot be split at all: that is a short history too
    short = F.coalesce(F.col("split"), F.lit(0)) < C.MIN_TRAINING_PERIODS
    none = F.col("test_periods").isNull()
    per_key = split.join(per_key, "series_key", "left").select(
        F.lit("series").alias("scope"), "series_key", "mape", "mae", "rmse",
        F.coalesce("test_periods", F.lit(0)).cast("long").alias("test_periods"),
        F.coalesce("mape_periods", F.lit(0)).cast("long").alias("mape_periods"),
        F.when(none, F.lit(None).cast("string")).otherwise(S.mape_class(F.col("mape"))).alias("assessment"),
        F.when(short | none, F.lit("skipped")).otherwise(F.lit("evaluated")).alias("status"),
        F.when(short, F.format_string(f"Insufficient training history (%d < {C.MIN_TRAINING_PERIODS} weeks).",
                                      F.coalesce(F.col("split"), F.lit(0))))
        .when(none, F.lit("No successful walk-forward forecasts were produced.")).alias("reason"),
        "training_period", "testing_period")
    # MAPE ascending, nulls last
    return overall.unionByName(per_key).orderBy(F.col("scope"), F.col("mape").asc_nulls_last())


def home_dashboard(ctx, fc: DataFrame) -> DataFrame:
    """Best site, top-5, count of sites >= 80 %, next-month total, for the most popular course."""
    course = ctx.learners.groupBy("course").count().orderBy(F.desc("count"), F.asc("course")).limit(1)
    # only this course is scored
    ranked = ctx.ranking(ST.representative_profile(ctx.learners).join(course.select("course"), "course"))
    nm = fc.agg(F.round(F.sum(F.when(F.col("step") <= C.STEPS_NEXT_MONTH, FC.cents())) / F.lit(100.0), 1)).scalar()
    agg = ranked.groupBy("course").agg(
        F.min_by("site", "rank").alias("best_site"),
        F.max("completion_probability").alias("completion_probability"),
        F.count_if(F.col("completion_probability") >= C.HIGH_PROBABILITY_THRESHOLD).alias("n_high"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "site", F.col("completion_probability").alias("p"))))).alias("top5"))
    return agg.select(
        "course", "best_site", "completion_probability", nm.alias("forecast_next_month"),
        F.transform("top5", lambda x: x["site"]).alias("top_sites"),
        F.transform("top5", lambda x: x["p"]).alias("top_probabilities"),
        F.format_string(C.HOME_BEST, F.col("best_site"), F.col("completion_probability").cast("string")).alias("insight_1"),
        F.format_string(C.HOME_EXPECTED, nm.cast("string")).alias("insight_2"),
        F.format_string(C.HOME_ABOVE, F.col("n_high").cast("string")).alias("insight_3"),
        F.format_string(C.HOME_PRIORITY, F.array_join(F.slice(F.transform("top5", lambda x: x["site"]), 1, 3), ", ")).alias("insight_4"),
        F.lit("Online").alias("ai_status"))
