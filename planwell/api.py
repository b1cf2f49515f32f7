"""User-facing functions: one per service endpoint, each returning DataFrames.

The optional ``course`` of an endpoint is a filter on a result computed for
every key (the per-key work is shared, the filter is pushed as far down as
Catalyst allows).  Validation errors are raised on the driver after a
bounded check (``limit(1)``), never by collecting data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwell import config as C
from planwell.functions import scalars as S
from planwell.operators import arima, ingest as IG, series as SR, stats as ST
from planwell.operators.snapshots import SnapshotTable
from planwell.plans import forecasting as FC
from planwell.plans import ingest_flow as FLOW
from planwell.plans import reports as RP
from planwell.plans import training as TR
from planwell.sources import tables as T
from planwell.session import checkpoint


class UnknownMemberError(ValueError):
    """a key, site or category that is not in the data."""


class UnknownPeriodError(ValueError):
    """an unsupported planning period."""


def validate_member(df: DataFrame, column: str, value: str, what: str = "course", shown_members: int = 200) -> str:
    """raise naming the accepted values (the first ``shown_members``, and how many more) when ``value`` is absent (bounded driver work)."""
    if df.where(F.col(column) == F.lit(value)).limit(1).count() == 0:
        known = df.select(column).distinct()
        shown, n = [r[0] for r in known.orderBy(column).limit(shown_members).collect()], known.count()
        more = f" and {n - len(shown)} more" if n > len(shown) else ""
        raise UnknownMemberError(f"Unknown {what} '{value}'. Available: {', '.join(map(str, shown))}{more}")
    return value


def validate_period(period: str, allowed) -> int:
    """F6."""
    if period not in allowed:
        raise UnknownPeriodError(f"Unsupported period '{period}'. Use: {', '.join(allowed)}")
    return allowed[period]


@dataclass
class Volume:
    """The daily volume table and the cutoff that bounds training.

    ``params_root`` names the saved parameters (T8): where it is given, only series that changed since they were
    saved are fitted, and every report reads the saved ones.
    """
    daily: DataFrame
    cutoff: str = C.DEFAULT_CUTOFF
    params_root: str | None = None

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str, cutoff: str = C.DEFAULT_CUTOFF, params_root: str | None = None) -> "Volume":
        return cls(T.volume(spark, sf_dir), cutoff, params_root)

    def materialised(self) -> "Volume":
        """The same over a written daily table, so that many reports cost one pass over the raw rows."""
        return Volume(checkpoint(self.daily), self.cutoff, self.params_root)

    def weekly(self) -> DataFrame:
        return SR.weekly_series(self.daily, self.cutoff)

    def weekly_total(self) -> DataFrame:
        return SR.weekly_total(self.daily, self.cutoff)

    def params(self) -> DataFrame:
        if self.params_root is None:
            return FC.params(self.weekly())
        TR.refit(checkpoint(self.weekly()), TR.WEEKLY_KEYS, self.params_root, "week")
        return TR.load(self.daily.sparkSession, self.params_root)

    def forecast(self, params: DataFrame | None = None) -> DataFrame:
        return FC.weekly_forecast(params if params is not None else self.params())


# ---------------------------------------------------------------------------
# T8 persistence (S10 / S11 / S15) and retraining
# ---------------------------------------------------------------------------

def save_params(params: DataFrame, root: str, trained_at: str | None = None) -> str:
    """Write the parameter table as a new version (pointer switched after success)."""
    stamp = F.lit(trained_at).cast("timestamp") if trained_at else F.current_timestamp()
    return IG.write_version(params.withColumn("trained_at", stamp), root)


def load_params(spark: SparkSession, root: str) -> DataFrame | None:
    """The current parameter table, or None (then the caller refits)."""
    return TR.load(spark, root)


def retrain(vol: Volume, root: str, force: bool = False) -> DataFrame:
    """Refit the series that changed since the saved version and publish the next T8 version; a one-row summary."""
    done = TR.refit(vol.weekly(), TR.WEEKLY_KEYS, root, "week", force=force)
    spark = vol.daily.sparkSession
    return load_params(spark, root).agg(
        F.lit(done["models_trained"]).cast("long").alias("models_trained"), F.lit(done["models_kept"]).cast("long").alias("models_kept"),
        F.min("data_start").alias("data_start"), F.max("data_end").alias("data_end"), F.lit(done["path"]).alias("version_path"))


# ---------------------------------------------------------------------------
# endpoint equivalents
# ---------------------------------------------------------------------------

def courses(vol: Volume, period: str = "next_month", course: str | None = None,
            params: DataFrame | None = None) -> DataFrame:
    """GET /forecast/courses."""
    validate_period(period, C.FORECAST_PERIODS)
    if course:
        validate_member(vol.daily, "series_key", course)
    out = FC.course_forecasts(vol.daily, vol.weekly(), vol.forecast(params), period)
    return out.where(F.col("course") == course) if course else out


def summary(vol: Volume, course: str | None = None, params: DataFrame | None = None) -> DataFrame:
    """GET /forecast/summary (R2); with a course the horizons and history are that course's,
    while ``total_historical_applicants`` stays organisation-wide (as in the service)."""
    prm = checkpoint(params if params is not None else vol.params())
    fc, weekly = vol.forecast(prm), vol.weekly()
    if not course:
        return RP.forecast_summary(vol.daily, weekly, vol.weekly_total(), fc, prm)
    validate_member(vol.daily, "series_key", course)
    one = lambda df: df.where(F.col("series_key") == course)
    w1 = one(weekly).select("week", "t", "y")
    out = RP.forecast_summary(vol.daily.where(F.col("series_key") == course), one(weekly), w1, one(fc), one(prm))
    return out.withColumn("total_historical_applicants",
                          vol.daily.select(F.sum("cnt")).scalar().cast("long"))


def insights(vol: Volume, period: str = "next_month", course: str | None = None, params: DataFrame | None = None) -> DataFrame:
    """GET /forecast/insights (R3); without any forecast one sentence says so."""
    cf = courses(vol, period, course, params)
    if cf.isEmpty():
        return vol.daily.sparkSession.createDataFrame([(1, C.INSIGHT_NONE)], "ord int, text string")
    if not course:
        return RP.forecast_insights(vol.daily, cf)
    s1 = cf.select(F.lit(1).alias("ord"), F.format_string(
        C.INSIGHT_ONE_COURSE, F.lit(course), S.fmt_int("forecasted_applicant_count")).alias("text"))
    s2 = SR.most_popular(vol.daily).select(F.lit(2).alias("ord"), F.format_string(C.INSIGHT_POPULAR, F.col("series_key")).alias("text"))
    return s1.unionByName(s2)


def charts(vol: Volume, learners: DataFrame, course: str | None = None, params: DataFrame | None = None) -> DataFrame:
    """GET /forecast/charts (R4); a course narrows the history and forecast series."""
    fc, daily = vol.forecast(params), vol.daily
    if course:
        validate_member(vol.daily, "series_key", course)
        fc, daily = fc.where(F.col("series_key") == course), daily.where(F.col("series_key") == course)
    sub = Volume(daily, vol.cutoff)
    cf = FC.course_forecasts(daily, sub.weekly(), fc)
    from pyspark.sql import Window
    demo = ST.distribution(learners, ["employment", "education", "sex", "classification", "site"], {"site": 10})
    course_dist = ST.weighted_distribution(vol.daily).select(
        F.lit("course").alias("dimension"), "label", "count", "percentage",
        F.row_number().over(Window.orderBy(F.desc("count"), F.asc("label"))).alias("rank"))
    return RP.forecast_charts(daily, sub.weekly_total(), fc, cf, demo.unionByName(course_dist),
                              ST.age_distribution(learners))


def dashboard(vol: Volume, learners: DataFrame, period: str = "next_month",
              course: str | None = None) -> dict[str, DataFrame]:
    """GET /forecast/dashboard (R5): the four named parts, from one pass over the raw rows and one set of parameters."""
    vol = vol.materialised()
    params = checkpoint(vol.params())
    return {"summary": summary(vol, course, params), "courses": courses(vol, period, course, params),
            "charts": charts(vol, learners, course, params), "insights": insights(vol, period, course, params)}


def home_dashboard(spark: SparkSession, vol: Volume, learners: DataFrame, source: str) -> DataFrame:
    """GET /dashboard (R14): the recommendation for the most popular course and next month's volume."""
    from planwell.operators import ml as ML
    return RP.home_dashboard(ML.ModelContext(spark, learners, source), vol.forecast())


def course_detail(vol: Volume, course: str, params: DataFrame | None = None) -> DataFrame:
    """GET /forecast/course/{name}."""
    validate_member(vol.daily, "series_key", course)
    out = RP.course_detail(vol.weekly(), vol.daily, vol.forecast(params))
    return out.where(F.col("course") == course)


def site_profile(learners: DataFrame, site: str, registrations: DataFrame | None = None) -> dict[str, DataFrame]:
    """GET /forecast/profile/{barangay} (R7 / R9); a site without learner records is described by its ``registrations``."""
    one = learners.where(F.col("site") == site)
    events = None if registrations is None else registrations.where(F.col("site") == site)
    known = learners.select("site") if events is None else learners.select("site").unionByName(events.select("site"))
    validate_member(known, "site", site, "barangay")
    rows = one if events is None else ST.by_presence(one, events, "site")
    dims = ["sex", "education", "employment", "classification", "course", "career", "skill"]
    return {"profile": ST.site_profile(one, events),
            "distributions": ST.distribution(rows, dims, {"course": 8, "career": 8, "skill": 8}),
            "age_distribution": ST.age_distribution(one)}


def evaluation(vol: Volume) -> DataFrame:
    """GET /forecast/evaluation (M7): overall and per key, with skip reasons and period ranges."""
    sub = Volume(checkpoint(vol.daily), vol.cutoff)
    return RP.evaluation(sub.weekly(), sub.weekly_total())


def ingest(spark: SparkSession, batch: DataFrame, root: str, sync_type: str = "incremental",
           manual_retrain: bool = False, params_root: str | None = None, cutoff: str = C.DEFAULT_CUTOFF,
           today: str | None = None, known_keys: DataFrame | None = None, max_count: int | None = None,
           max_records: int | None = None) -> DataFrame:
    """POST /forecast/ingest-data (G2): validate, publish a snapshot, count new days, decide, retrain.

    ``batch`` holds records (idx, date, course, applicant_count).  Any error
    rejects the whole batch (the error rows are returned instead).  New days
    are counted after the stored data's last date (B9 fixed).  ``known_keys`` (series_key) names the
    keys that a batch may hold, by default those of the stored table; a first batch must be given them.
    ``max_count`` and ``max_records`` are off unless set.
    """
    result = FLOW.ingest_batch(SnapshotTable(spark, root), batch, sync_type, manual_retrain, today, known_keys, max_count, max_records)
    if not result.accepted:
        if result.too_many:
            raise ValueError(f"{result.received} records in a batch; at most {max_records}")
        return result.errors
    if params_root and result.should_retrain:
        retrain(Volume(SnapshotTable(spark, root).read().select("date", "series_key", "cnt"), cutoff), params_root)
    return result.metrics(spark)


def applicant_volume(vol: Volume, period: str = "next_month", course: str | None = None,
                     params: DataFrame | None = None) -> dict[str, DataFrame]:
    """POST /predict/applicant-volume (R10): summary row and month-equivalent buckets.

    Confidence always comes from the organisation-wide backtest, as in the service.
    """
    validate_period(period, C.PREDICT_PERIODS)
    fc, hist, monthly = vol.forecast(params), vol.weekly_total(), SR.monthly_total(vol.daily)
    if course:
        validate_member(vol.daily, "series_key", course)
        fc = fc.where(F.col("series_key") == course)
        hist = vol.weekly().where(F.col("series_key") == course).select("week", "t", "y")
        monthly = SR.monthly_series(vol.daily.where(F.col("series_key") == course)).select("month", "t", "y")
    wt = vol.weekly_total()
    om = ST.forecast_metrics(arima.walk_forward(wt, [], "week"), [])
    mean = wt.select(F.avg("y")).scalar()
    conf = om.select(S.confidence_by_error(F.col("mae"), mean).alias("confidence_level"))
    pick = F.col("forecast_period") == period
    report = RP.volume_forecast(hist, fc, conf, round_steps=course is None).where(pick)
    return {"summary": report,
            "insights": RP.volume_insights(report, f"course '{course}'" if course else "The organisation"),
            "buckets": RP.volume_forecast_buckets(fc, monthly, round_steps=course is None).where(pick),
            "history": SR.tail(monthly, [], C.CHART_MONTHS, "month").select(
                S.month_label("month").alias("period"), F.round("y", 1).alias("applicants"))}


def completion(spark: SparkSession, learners: DataFrame, course: str, source: str) -> dict[str, DataFrame]:
    """POST /predict/completion (R12 + R13) for one course.

    ``learners`` is the learner table, ``source`` names it for the saved
    model (trained once, then loaded).  Returns the representative profile,
    the workforce summary and distributions, the ranked sites with
    participation and evidence (left joins with defaults), and the top-1
    explanation with its historical blocks.
    """
    from planwell.operators import ml as ML
    validate_member(learners, "course", course)
    ctx = ML.ModelContext(spark, learners, source)
    base, model = ctx.learners, ctx.model
    one = base.where(F.col("course") == course)
    profile = ST.representative_profile(one)
    ranked = ctx.ranking(profile)
    ev = ST.site_evidence(one)
    recs = ranked.join(ev, ["course", "site"], "left").select(
        "rank", "site", "completion_probability", "confidence_level",
        F.coalesce("historical_applicant_count", F.lit(0)).alias("historical_applicants"),
        F.coalesce("historical_participation_percentage", F.lit(0.0)).alias("historical_participation_percentage"),
        F.coalesce("data_reliability", F.lit(C.RELIABILITY_LIMITED)).alias("data_reliability"),
        "historical_completion_percentage", "historical_dropout_percentage")
    top = ranked.where(F.col("rank") == 1).join(ST.completion_rates(one), ["course", "site"], "left")
    return {"profile": profile, "workforce": ST.workforce_summary(one),
            "workforce_distributions": ST.workforce_profile(one),
            "recommendations": recs.orderBy("rank"), "explanation": top}


MODEL_ARTIFACTS = ("metrics", "importance", "metadata")


def save_model_artifacts(spark: SparkSession, learners: DataFrame, source: str, root: str) -> dict[str, str]:
    """Validation metrics, feature importance and metadata beside the model, as versioned tables."""
    from planwell.operators import ml as ML
    ctx = ML.ModelContext(spark, learners, source)
    tables = {"metrics": ctx.metrics(), "importance": ctx.importance(), "metadata": ctx.metadata()}
    return {name: IG.write_version(df, f"{root.rstrip('/')}/{name}") for name, df in tables.items()}


def load_model_artifacts(spark: SparkSession, root: str) -> dict[str, DataFrame | None]:
    """The saved artifacts; a missing one reads as None (as a missing file does in the service)."""
    return {name: IG.read_current(spark, f"{root.rstrip('/')}/{name}") for name in MODEL_ARTIFACTS}


def top_features(artifacts: dict[str, DataFrame | None], limit: int = 5) -> DataFrame | None:
    """K3: display names of the ``limit`` most important features (None without saved importances)."""
    imp = artifacts.get("importance")
    return None if imp is None else imp.where(F.col("rank") <= limit).select("rank", "display_name")
