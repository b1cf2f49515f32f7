"""Differential test: Spark resampling equals a pandas resample on random sparse series."""

import datetime as dt

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from planwell.operators import series as SR

rows_strategy = st.lists(
    st.tuples(st.integers(0, 400), st.sampled_from(["A", "B", "C"]), st.integers(0, 9)),
    min_size=1, max_size=60)


def pandas_weekly(rows, cutoff):
    df = pd.DataFrame(rows, columns=["date", "series_key", "cnt"])
    df = df[df.date <= cutoff]
    out = {}
    for key, g in df.groupby("series_key"):
        s = g.groupby(pd.to_datetime(g.date))["cnt"].sum().astype(float).sort_index()
        w = s.resample("W-SUN").sum()
        out.update({(key, d.date()): v for d, v in w.items()})
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows_strategy)
def test_weekly_matches_pandas(spark, raw):
    base = dt.date(2024, 1, 1)
    rows = [(base + dt.timedelta(days=d), k, c) for d, k, c in raw]
    cutoff = base + dt.timedelta(days=300)
    df = spark.createDataFrame(rows, "date date, series_key string, cnt long")
    got = {(r.series_key, r.week): r.y for r in SR.weekly_series(df, cutoff.isoformat()).collect()}
    assert got == pandas_weekly(rows, cutoff)
    # positions are consecutive from 0 within each key
    for key in {k for k, _ in got}:
        ts = sorted(r.t for r in SR.weekly_series(df, cutoff.isoformat()).where(f"series_key = '{key}'").collect())
        assert ts == list(range(len(ts)))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows_strategy)
def test_monthly_null_fill_matches_pandas_asfreq(spark, raw):
    base = dt.date(2023, 1, 1)
    rows = [(dt.date(base.year + (m // 12), m % 12 + 1, 1), k, c) for m, k, c in ((d % 40, k, c) for d, k, c in raw)]
    df = spark.createDataFrame(rows, "date date, series_key string, cnt long")
    got = {(r.series_key, r.month): r.y for r in SR.resample(df, "month", ["series_key"], fill=None).collect()}
    pdf = pd.DataFrame(rows, columns=["date", "series_key", "cnt"])
    want = {}
    for key, g in pdf.groupby("series_key"):
        s = g.groupby(pd.to_datetime(g.date))["cnt"].sum().astype(float).sort_index().asfreq("MS")
        want.update({(key, d.date()): (None if pd.isna(v) else v) for d, v in s.items()})
    assert got == want


label_rows = st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d", None]), st.sampled_from(["x", "y", None])),
                      min_size=1, max_size=50)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(label_rows)
def test_distribution_matches_value_counts(spark, rows):
    from planwell.operators import stats as ST
    df = spark.createDataFrame(rows, "p string, q string")
    got = {(r.dimension, r.label): (r["count"], r.percentage) for r in ST.distribution(df, ["p", "q"]).collect()}
    pdf = pd.DataFrame(rows, columns=["p", "q"])
    want = {}
    for col in ("p", "q"):
        for label, n in pdf[col].value_counts().items():   # nulls dropped, denominator = all rows
            want[(col, label)] = (int(n), round(n / len(pdf) * 100, 1))
    assert got.keys() == want.keys()
    for k, (n, pct) in want.items():
        assert got[k][0] == n and abs(got[k][1] - pct) <= 0.1 + 1e-9   # half-up vs half-even ties
