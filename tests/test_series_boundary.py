"""Data-boundary behaviour of the regular series (cutoff, partial weeks, gaps, monthly totals)."""

import datetime as dt

from planwell.operators import series as SR

SCHEMA = "date date, series_key string, cnt long"


def days(start, end):
    d = start
    while d <= end:
        yield d
        d += dt.timedelta(days=1)


def test_cutoff_keeps_partial_last_week(spark):
    rows = [(d, "C", 5) for d in days(dt.date(2025, 12, 1), dt.date(2026, 1, 10))]
    w = SR.weekly_series(spark.createDataFrame(rows, SCHEMA), "2025-12-31").orderBy("week").collect()
    assert w[-1].week == dt.date(2026, 1, 4)
    assert w[-1].y == 15.0           # only Dec 29-31
    assert w[0].week == dt.date(2025, 12, 7)


def test_monthly_total_uses_all_dates(spark):
    rows = [(dt.date(y, m, d), k, 3) for (y, m) in ((2025, 12), (2026, 1)) for d in range(1, 6) for k in "AB"]
    m = SR.monthly_total(spark.createDataFrame(rows, SCHEMA)).orderBy("month").collect()
    assert [(r.month, r.y) for r in m] == [(dt.date(2025, 12, 1), 30.0), (dt.date(2026, 1, 1), 30.0)]


def test_gaps_become_zero(spark):
    rows = [(dt.date(2025, 12, 31), "C", 100), (dt.date(2026, 8, 10), "C", 50)]
    m = SR.monthly_series(spark.createDataFrame(rows, SCHEMA)).orderBy("month").collect()
    assert len(m) == 9 and sum(1 for r in m if r.y == 0.0) == 7


def test_gap_and_cutoff_has_no_later_week(spark):
    rows = [(d, "C", 5) for d in days(dt.date(2025, 12, 1), dt.date(2025, 12, 31))]
    rows += [(d, "C", 5) for d in days(dt.date(2026, 8, 10), dt.date(2026, 8, 19))]
    w = SR.weekly_series(spark.createDataFrame(rows, SCHEMA), "2025-12-31").collect()
    assert max(r.week for r in w) < dt.date(2026, 2, 1)


def test_data_range_and_new_days(spark):
    rows = [(d, "C", 1) for d in days(dt.date(2025, 12, 20), dt.date(2026, 1, 5))]
    df = spark.createDataFrame(rows, SCHEMA)
    r = SR.data_range(df, "2025-12-31").first()
    assert (r.start_date, r.end_date) == ("2025-12-20", "2025-12-31")
    assert SR.new_data_count(df, "2025-12-31").first().new_days == 5
    empty = SR.data_range(df, "2020-01-01").first()
    assert (empty.start_date, empty.end_date) == ("", "")
