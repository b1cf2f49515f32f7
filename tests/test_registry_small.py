"""Registered queries on the smallest fixture against the DuckDB oracle, and streaming = batch."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from planwell.sources.tables import TABLES

from conftest import SF_SMALL

FAST = ["daily_volume", "weekly_series", "monthly_total", "totals_rollup", "chrono_split", "arima_params",
        "arima_forecast", "course_forecasts", "walk_forward_total", "distribution", "age_distribution",
        "representative_profile", "site_evidence", "roc_auc", "classification_report", "upsert_volume",
        "holdout_backtest", "stratified_split", "stream_daily_counts", "ingest_validation", "retrain_criteria",
        "org_profile", "unknown_categories", "site_profile", "volume_insights", "upsert_versions", "saved_forecast",
        "saved_forecast_two_key", "retrain_incremental", "stratified_split_rows", "gini", "dashboard", "volume_monthly_charts",
        "volume_monthly_insights", "ingest_payload", "ingest_flow", "stream_event_time"]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)[:10]
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF_SMALL)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(oracle_sql()[name])
    want = canon([d[0] for d in res.description], res.fetchall())
    assert got == want


def test_rules_and_labels_are_not_vacuous(spark):
    row = queries()["ingest_validation"](spark, SF_SMALL).first()
    assert all(row[c] > 0 for c in row.__fields__ if c.startswith("n_")) and not row.accepted and row.records_valid > 0
    # sites without demographic records are described by their registrations, which have no sexes
    sites = queries()["site_profile"](spark, SF_SMALL).where("average_age is not null").selectExpr("sum(male_count) m", "sum(female_count) f", "sum(total_applicants) n").first()
    assert sites.m > 0 and sites.f > 0 and sites.m + sites.f == sites.n


def test_every_query_has_a_callable_and_sql_keys_are_known():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) >= 60


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0 and "forecasted_applicant_count" in df.columns


def test_results_do_not_depend_on_session_time_zone(spark, con):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        for name in ["daily_volume", "weekly_series_partial_week", "upsert_volume"]:
            df = queries()[name](spark, SF_SMALL)
            got = canon(df.columns, [tuple(r) for r in df.collect()])
            res = con.execute(oracle_sql()[name])
            assert got == canon([d[0] for d in res.description], res.fetchall()), name
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_site_age_distribution_counts_every_record(spark):
    rows = queries()["site_age_distribution"](spark, SF_SMALL).collect()
    n = duckdb.sql(f"SELECT count(*), count(DISTINCT c_nationkey) FROM '{SF_SMALL}/lineitem.parquet' "
                   f"JOIN '{SF_SMALL}/part.parquet' ON l_partkey = p_partkey JOIN '{SF_SMALL}/orders.parquet' ON l_orderkey = o_orderkey "
                   f"JOIN '{SF_SMALL}/customer.parquet' ON o_custkey = c_custkey").fetchall()[0]
    assert (sum(r["count"] for r in rows), len({r["site"] for r in rows})) == n
