"""Endpoint-equivalent functions: filters, validation errors, T8 round trip, ingest flow."""

import tempfile

import pytest
from pyspark.sql import functions as F

from planwell import api
from planwell.operators import ingest as IG
from planwell.operators.snapshots import SnapshotTable
from planwell.plans import catalog_ingest as CI
from planwell.sources import tables as T

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def vol(spark):
    return api.Volume.from_tables(spark, SF_SMALL)


def test_course_filter_and_validation(spark, vol):
    key = vol.daily.select("series_key").orderBy("series_key").first()[0]
    rows = api.courses(vol, "next_week", key).collect()
    assert len(rows) == 1 and rows[0].course == key and rows[0].period == "next_week"
    with pytest.raises(api.UnknownMemberError):
        api.courses(vol, "next_month", "No Such Brand")
    with pytest.raises(api.UnknownPeriodError):
        api.courses(vol, "next_decade")


def test_course_summary_keeps_org_total(spark, vol):
    key = vol.daily.select("series_key").orderBy("series_key").first()[0]
    s = api.summary(vol, key).first()
    assert s.total_historical_applicants == vol.daily.agg(F.sum("cnt")).first()[0]
    assert s.highest_forecasted_course == key and s.courses_modeled == 1


def test_params_round_trip_reproduces_forecast(spark, vol):
    root = tempfile.mkdtemp(prefix="planwell-t8-")
    assert api.load_params(spark, root) is None
    api.retrain(vol, root).first()
    loaded = api.load_params(spark, root).drop("trained_at")
    a = vol.forecast(loaded).select("series_key", "step", "y_hat")
    b = vol.forecast().select("series_key", "step", "y_hat")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_ingest_flow(spark):
    root = tempfile.mkdtemp(prefix="planwell-ingest-")
    first = IG.records_from_daily(T.ingest_batch(spark, SF_SMALL).where(F.col("date") < "2024-01-20"))
    keys = first.select(F.col("course").alias("series_key"))
    with pytest.raises(ValueError, match="known_keys"):
        api.ingest(spark, first, root, "full")
    m1 = api.ingest(spark, first, root, "full", known_keys=keys).first()
    assert m1.retraining_triggered and m1.new_days == 999
    second = IG.records_from_daily(CI.incoming_daily(spark, SF_SMALL))
    m2 = api.ingest(spark, second, root, "incremental", manual_retrain=False).first()
    table = SnapshotTable(spark, root).read()
    assert m2.total_records == table.count()
    assert m2.new_days == table.where(F.col("date") >= "2024-01-20").select("date").distinct().count()
    bad = spark.createDataFrame([(0, "2024-13-01", "view", 1)], "idx long, date string, course string,"
                                                                 " applicant_count long")
    errs = api.ingest(spark, bad, root)
    assert [r.rule for r in errs.collect()] == ["date"]


def test_optional_table_missing_path_is_empty(spark):
    from planwell.sources.tables import VOLUME_SCHEMA, optional_table
    df = optional_table(spark, "/nonexistent/path/x.parquet", VOLUME_SCHEMA)
    assert df.count() == 0 and df.columns == ["date", "series_key", "cnt"]
    assert optional_table(spark, None, VOLUME_SCHEMA).count() == 0


def test_dashboard_profile_evaluation_detail(spark, vol):
    lr = T.learners(spark, SF_SMALL)
    parts = api.dashboard(vol, lr, "next_quarter")
    assert set(parts) == {"summary", "courses", "charts", "insights"}
    assert parts["summary"].count() == 1 and parts["insights"].count() == 4
    site = lr.select("site").orderBy("site").first()[0]
    prof = api.site_profile(lr, site)
    assert prof["profile"].first().total_applicants == lr.where(F.col("site") == site).count()
    with pytest.raises(api.UnknownMemberError):
        api.site_profile(lr, "Atlantis")
    ev = api.evaluation(vol)
    assert ev.where(F.col("series_key").isNull()).count() == 1
    key = vol.daily.select("series_key").orderBy("series_key").first()[0]
    assert api.course_detail(vol, key).count() == 1


def test_evaluation_lists_short_series_as_skipped(spark):
    days = [(f"2001-{1 + w // 4:02d}-{1 + 7 * (w % 4):02d}", "LONG", 5 + w % 3) for w in range(40)]
    rows = [*days, *[(d, "SHORT", 1) for d, _, _ in days[:5]], (days[0][0], "ONE", 1)]
    daily = spark.createDataFrame(rows, "date string, series_key string, cnt long").withColumn("date", F.to_date("date"))
    got = {r.series_key: r for r in api.evaluation(api.Volume(daily, "2001-12-31")).collect()}
    assert got[None].scope == "overall" and got["LONG"].status == "evaluated" and got["LONG"].mape is not None
    for key in ("SHORT", "ONE"):
        assert got[key].status == "skipped" and got[key].assessment is None
        assert got[key].reason.startswith("Insufficient training history")


def test_applicant_volume_per_course_uses_unrounded_steps(spark, vol):
    key = vol.daily.select("series_key").orderBy("series_key").first()[0]
    out = api.applicant_volume(vol, "next_month", key)
    row = out["summary"].first()
    preds = [r.y_hat for r in vol.forecast().where((F.col("series_key") == key) & (F.col("step") <= 4)).collect()]
    assert row.total_predicted_applicants == round(sum(preds), 1)
    assert out["buckets"].count() == 1 and out["history"].count() <= 18
    assert out["insights"].where("ord = 1").first().text.startswith(f"course '{key}' is projected")
    with pytest.raises(api.UnknownPeriodError):
        api.applicant_volume(vol, "next_week")


def test_completion_for_one_course(spark):
    lr = T.learners(spark, SF_SMALL)
    course = lr.select("course").orderBy("course").first()[0]
    out = api.completion(spark, lr, course, f"api-test:{SF_SMALL}")
    n_sites = lr.select("site").distinct().count()
    recs = out["recommendations"].collect()
    assert len(recs) == n_sites and [r["rank"] for r in recs] == list(range(1, n_sites + 1))
    assert all(0.0 <= r.completion_probability <= 100.0 for r in recs)
    assert out["explanation"].count() == 1 and out["profile"].first().course == course
    with pytest.raises(api.UnknownMemberError):
        api.completion(spark, lr, "Brand#999", "x")


def test_model_artifacts_round_trip(spark):
    root = tempfile.mkdtemp(prefix="planwell-artifacts-")
    assert api.load_model_artifacts(spark, root) == {"metrics": None, "importance": None, "metadata": None}
    lr = T.learners(spark, SF_SMALL)
    api.save_model_artifacts(spark, lr, f"artifact-test:{SF_SMALL}", root)
    art = api.load_model_artifacts(spark, root)
    assert art["metadata"].first().n_records == lr.count()
    assert art["importance"].count() == 9
    names = {r.metric for r in art["metrics"].collect()}
    assert {"accuracy", "roc_auc", "macro_f1", "precision"} <= names
    assert api.top_features(art).count() == 5


def test_reports_read_saved_parameters(spark, vol, monkeypatch):
    from planwell.plans import training as TR
    saved = api.Volume.from_tables(spark, SF_SMALL, params_root=tempfile.mkdtemp(prefix="planwell-t8-")).materialised()
    saved.params()
    monkeypatch.setattr(TR.arima, "fit_params", lambda *_: pytest.fail("fitted again"))
    key = saved.daily.select("series_key").orderBy("series_key").first()[0]
    lr = T.learners(spark, SF_SMALL)
    parts = api.dashboard(saved, lr, "next_month", key)
    assert parts["courses"].first().course == key and parts["insights"].count() == 2
    assert parts["charts"].where("chart = 'top_courses'").count() == 1
    assert api.course_detail(saved, key).count() == 1
    assert api.applicant_volume(saved)["summary"].count() == 1


def test_insights_without_any_forecast(spark):
    daily = spark.createDataFrame([], "date date, series_key string, cnt long")
    assert [r.text for r in api.insights(api.Volume(daily)).collect()] == ["No forecasting data is available yet."]


def test_home_dashboard_and_one_answer(spark, vol):
    from planwell.operators import ml as ML
    from planwell.plans import catalog_ml as CM
    lr = T.learners(spark, SF_SMALL)
    row = api.home_dashboard(spark, vol, lr, f"api-test:{SF_SMALL}").first()
    assert row.insight_1.startswith(row.best_site) and len(row.top_sites) == 5
    answers = CM.completion_answer(ML.ModelContext(spark, lr, f"api-test:{SF_SMALL}")).collect()
    assert len(answers) == lr.select("course").distinct().count()
    for a in answers:
        assert [s["rank"] for s in a.recommended_sites] == list(range(1, len(a.recommended_sites) + 1))
        why = a.explainable_ai
        assert why["recommended_site"] == a.recommended_sites[0]["site"]
        assert why["evaluation"]["sites_evaluated"] == len(a.recommended_sites)
        checks = why["ai_decision_summary"]["model_validation"]
        (tn, fp), (fn, tp) = checks["confusion_matrix"]
        assert checks["accuracy"] == pytest.approx((tn + tp) / (tn + fp + fn + tp), abs=1e-4)
        assert checks["recall"] == pytest.approx(tp / (fn + tp), abs=1e-4) and checks["precision"] == pytest.approx(tp / (fp + tp), abs=1e-4)
