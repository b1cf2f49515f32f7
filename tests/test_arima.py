"""ARIMA(1,1,1) CSS core: grid fit vs brute force, prefix trick vs refits, closed-form forecast."""

import itertools

import numpy as np
import pandas as pd

from planwell.operators import arima


def css(y, phi, theta):
    e_prev, d_prev, sse = 0.0, 0.0, 0.0
    for t in range(1, len(y)):
        d = y[t] - y[t - 1]
        e = d - phi * d_prev - theta * e_prev
        sse += e * e
        e_prev, d_prev = e, d
    return sse, d_prev, e_prev


def best_of(y, points):
    best = None
    for phi, theta in points:
        if phi == -theta and not (phi == 0 and theta == 0):
            continue
        sse, d, e = css(y, phi, theta)
        key = (sse, abs(phi), abs(theta), phi, theta)
        if best is None or key < best[0]:
            best = (key, phi, theta, d, e)
    return best


def brute_fit(y, den=20, fine=10):
    """Independent loop implementation of the grid search and of the finer one around its best point."""
    vals = [i / den for i in range(-(den - 1), den)]
    _, phi, theta, _, _ = best_of(y, itertools.product(vals, vals))
    near = [[i / (den * fine) for i in range(round(v * den) * fine - fine, round(v * den) * fine + fine + 1) if abs(i) < den * fine]
            for v in (phi, theta)]
    return best_of(y, itertools.product(*near))


def test_grid_fit_matches_brute_force():
    rng = np.random.default_rng(7)
    y = np.cumsum(rng.normal(size=40)) + 50
    fit = arima.fit_series(y)
    (sse, *_), phi, theta, d_last, e_last = brute_fit(list(y))
    assert (fit["phi"], fit["theta"]) == (phi, theta)
    assert abs(fit["sse"] - sse) < 1e-9
    assert abs(fit["last_e"] - e_last) < 1e-9 and fit["last_d"] == d_last


def test_prefix_trick_equals_refitting_every_prefix(spark):
    rng = np.random.default_rng(3)
    y = np.round(np.abs(np.cumsum(rng.normal(size=30))) * 10)
    weeks = pd.date_range("2020-01-05", periods=len(y), freq="W-SUN").date
    pdf = pd.DataFrame({"series_key": "k", "week": weeks, "t": np.arange(len(y), dtype=np.int32), "y": y})
    wf = arima.walk_forward(spark.createDataFrame(pdf), ["series_key"], "week", min_training=12).toPandas()
    split = int(np.floor(len(y) * 0.8))
    assert list(wf["t"]) == list(range(split, len(y)))
    for _, row in wf.iterrows():
        fit = arima.fit_series(y[: row.t])
        expect = max(0.0, arima.forecast_values(fit, 1)[0])
        assert abs(row.predicted - expect) < 1e-9
        assert row.actual == y[row.t]


def test_the_finer_search_never_loses_to_the_grid():
    rng = np.random.default_rng(11)
    phi, theta = arima.grid()
    better = 0
    for n in (3, 4, 12, 60):
        for _ in range(5):
            y = np.cumsum(rng.normal(size=n)) * 10
            _, b, s, _ = arima.css_scan(y, phi, theta, start_k=n - 2)
            fit = arima.fit_series(y)
            assert fit["sse"] <= s[0] and abs(fit["phi"]) < 1 and abs(fit["theta"]) < 1
            assert abs(fit["phi"] - phi[b[0]]) <= 0.05 + 1e-12 and abs(fit["theta"] - theta[b[0]]) <= 0.05 + 1e-12
            better += fit["sse"] < s[0]
    assert better >= 10


def test_closed_form_equals_step_recursion():
    fit = {"phi": 0.45, "theta": -0.3, "last_y": 120.0, "last_d": 4.0, "last_e": -1.5}
    closed = arima.forecast_values(fit, 52)
    d, e, y, out = fit["last_d"], fit["last_e"], fit["last_y"], []
    for h in range(52):
        dn = fit["phi"] * d + (fit["theta"] * e if h == 0 else 0.0)
        y, d, e = y + dn, dn, 0.0
        out.append(y)
    assert np.max(np.abs(closed - np.array(out))) < 1e-9


def test_constant_and_short_series():
    fit = arima.fit_series(np.full(20, 7.0))
    assert (fit["phi"], fit["theta"]) == (0.0, 0.0)
    assert np.allclose(arima.forecast_values(fit, 5), 7.0)
    assert arima.fit_series(np.array([1.0, 2.0])) is None


def test_gap_restarts_lags():
    y = np.array([5.0, 6.0, np.nan, 8.0, 9.0, 7.0, 8.0])
    fit = arima.fit_series(y)
    assert fit is not None and fit["last_y"] == 8.0
