"""ARIMA(1,1,1) for many series at once (M1, M2, M6, M8, M9).

Model, without constant, on the first difference d_t = y_t - y_{t-1}:

    e_t = d_t - phi * d_{t-1} - theta * e_{t-1},   d_0 = e_0 = 0

(conditional sum of squares).  The fit minimises sum e_t^2 over a grid
phi, theta in {i / GRID_DENOMINATOR : |i| < GRID_DENOMINATOR}, which keeps
the model stationary and invertible, and then over the best point's
neighbourhood, one grid step to each side in steps GRID_REFINE times finer.  On the line theta = -phi the model is
white noise whatever the value, so that line is cut to (0, 0).  Ties are
broken by (sse, |phi|, |theta|, phi, theta) in both searches.  A missing difference (a gap
in a null-filled series) contributes no residual and restarts the lags.

Forecast from the end of a series of length n:

    dhat_1 = phi * d_n + theta * e_n
    yhat_{n+h} = y_n + dhat_1 * (1 - phi^h) / (1 - phi)

For fixed (phi, theta) the recursion is causal, so the running SSE after
k differences is the SSE of the prefix of k + 1 points.  One scan of a
series therefore gives the fitted parameters of *every* prefix, which is
what the walk-forward backtest needs: all refits for the price of one fit.

Spark runs one call per series key through ``applyInPandas``; each group
is one regular series (at most a few hundred periods after aggregation),
however many raw rows the key had.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwell import config as C

MIN_POINTS = 3


def grid(denominator: int = C.GRID_DENOMINATOR) -> tuple[np.ndarray, np.ndarray]:
    """Grid points (phi, theta) in tie-break order; theta = -phi cut to (0, 0)."""
    vals = np.arange(-(denominator - 1), denominator, dtype=np.float64) / float(denominator)
    phi = np.repeat(vals, len(vals))
    theta = np.tile(vals, len(vals))
    keep = (phi != -theta) | ((phi == 0.0) & (theta == 0.0))
    phi, theta = phi[keep], theta[keep]
    order = np.lexsort((theta, phi, np.abs(theta), np.abs(phi)))
    return phi[order], theta[order]


def css_scan(y: np.ndarray, phi: np.ndarray, theta: np.ndarray, start_k: int = 0):
    """One causal pass over the differences for every grid point at once.

    Memory is O(grid): only the running residuals and SSEs are kept, and for
    every difference index k >= ``start_k`` the best grid point of the prefix
    ending there is recorded (the grid is in tie-break order, so ``argmin``
    returning the first minimum applies the tie rule).

    Returns ``dlag`` (differences, 0 where a point is missing) and, per
    recorded k, the best index, its SSE and its residual.
    """
    d = y[1:] - y[:-1]
    m, g = len(d), len(phi)
    e = np.zeros(g)
    s = np.zeros(g)
    d_prev = 0.0
    n_rec = max(0, m - start_k)
    best = np.empty(n_rec, dtype=np.int64)
    best_s = np.empty(n_rec)
    best_e = np.empty(n_rec)
    for k in range(m):
        dk = d[k]
        if np.isnan(dk):
            e = np.zeros(g)
            d_prev = 0.0
        else:
            e = dk - phi * d_prev - theta * e
            s = s + e * e
            d_prev = dk
        if k >= start_k:
            b = int(np.argmin(s))
            best[k - start_k], best_s[k - start_k], best_e[k - start_k] = b, s[b], e[b]
    dlag = np.where(np.isnan(d), 0.0, d)
    return dlag, best, best_s, best_e


def neighbourhood(phi: float, theta: float, denominator: int = C.GRID_DENOMINATOR,
                  refine: int = C.GRID_REFINE) -> tuple[np.ndarray, np.ndarray]:
    """Finer points around a grid point, itself included, in tie-break order."""
    fine = denominator * refine
    around = np.arange(-refine, refine + 1)
    i = (round(phi * denominator) * refine + around).repeat(len(around))
    j = np.tile(round(theta * denominator) * refine + around, len(around))
    keep = (np.abs(i) < fine) & (np.abs(j) < fine) & ((i != -j) | ((i == 0) & (j == 0)))
    p, q = i[keep] / float(fine), j[keep] / float(fine)
    order = np.lexsort((q, p, np.abs(q), np.abs(p)))
    return p[order], q[order]


def refine_scan(y: np.ndarray, phi: np.ndarray, theta: np.ndarray, start_k: int, denominator: int = C.GRID_DENOMINATOR):
    """The second search, for every prefix at once: ``phi``, ``theta`` are the best grid points of the prefixes
    that end at differences ``start_k``, ``start_k`` + 1, ...

    Prefixes with one best grid point share its neighbourhood, and all neighbourhoods go through one causal pass.
    Returns phi, theta, the SSE and the last residual of each prefix.
    """
    cells = sorted(set(zip(phi.tolist(), theta.tolist())))
    number = {c: i for i, c in enumerate(cells)}
    points = [neighbourhood(p, q, denominator) for p, q in cells]
    starts = np.cumsum([0, *[len(p) for p, _ in points]])
    all_phi, all_theta = (np.concatenate([x[i] for x in points]) for i in (0, 1))
    d = y[1:] - y[:-1]
    e, s, d_prev, out = np.zeros(len(all_phi)), np.zeros(len(all_phi)), 0.0, []
    for k in range(start_k + len(phi)):
        if np.isnan(d[k]):
            e, d_prev = np.zeros(len(all_phi)), 0.0
        else:
            e = d[k] - all_phi * d_prev - all_theta * e
            s = s + e * e
            d_prev = d[k]
        if k >= start_k:
            c = number[phi[k - start_k], theta[k - start_k]]
            b = int(starts[c] + np.argmin(s[starts[c]:starts[c + 1]]))
            out.append((all_phi[b], all_theta[b], s[b], e[b]))
    return tuple(np.array(x) for x in zip(*out)) if out else (np.empty(0),) * 4


def fit_series(y: np.ndarray, denominator: int = C.GRID_DENOMINATOR) -> dict | None:
    """Fit one series; ``None`` when it has fewer than three points."""
    y = np.asarray(y, dtype=np.float64)
    if len(y) < MIN_POINTS:
        return None
    phi, theta = grid(denominator)
    dlag, best, _, _ = css_scan(y, phi, theta, start_k=len(y) - 2)
    p, q, sse, e = refine_scan(y, phi[best], theta[best], len(y) - 2, denominator)
    observed = y[~np.isnan(y)]
    return {
        "phi": float(p[0]), "theta": float(q[0]), "sse": float(sse[0]),
        "last_y": float(observed[-1]) if len(observed) else 0.0,
        "last_d": float(dlag[-1]), "last_e": float(e[0]),
    }


def forecast_values(fit: dict, steps: int) -> np.ndarray:
    """Closed-form h-step forecasts (unclipped, unrounded)."""
    phi, theta = fit["phi"], fit["theta"]
    dhat = phi * fit["last_d"] + theta * fit["last_e"]
    h = np.arange(1, steps + 1, dtype=np.float64)
    return fit["last_y"] + dhat * ((1.0 - np.power(phi, h)) / (1.0 - phi))


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

def _key_ddl(keys: list[str]) -> str:
    return "".join(f"{k} string, " for k in keys)


def fit_params(series: DataFrame, keys: list[str], period: str = "week",
               denominator: int = C.GRID_DENOMINATOR) -> DataFrame:
    """M1 / M9: one parameter row per series (the T8 table).

    ``series`` holds keys, ``period``, ``t`` (0-based) and ``y`` (may be null
    for gap-preserving series).  Output: keys, phi, theta, sse, n_obs,
    last_y, last_d, last_e, data_start, data_end.
    """
    schema = (_key_ddl(keys) + "phi double, theta double, sse double, n_obs int, "
              "last_y double, last_d double, last_e double, data_start date, data_end date")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        res = fit_series(pdf["y"].to_numpy(dtype=np.float64, na_value=np.nan), denominator)
        if res is None:
            return pd.DataFrame(columns=[c.split(" ")[0] for c in schema.split(", ")])
        row = {k: pdf[k].iloc[0] for k in keys}
        row.update(res)
        row.update(n_obs=len(pdf), data_start=pdf[period].iloc[0], data_end=pdf[period].iloc[-1])
        return pd.DataFrame([row])

    cols = keys + [period, "t", "y"]
    grouped = series.select(*cols).groupBy(*keys) if keys else series.select(*cols).groupBy()
    return grouped.applyInPandas(fit, schema=schema)


def forecast(params: DataFrame, keys: list[str], steps: int = C.STEPS_PRECOMPUTE,
             period_step: str = "week", clip: bool = True, digits: int | None = 2) -> DataFrame:
    """M2: h = 1..steps forecasts from the parameter table, in pure SQL.

    ``period_step`` 'week' dates the step as data_end + 7h; 'month' as
    add_months(data_end, h).  The weekly service clips at 0 and rounds to 2 dp.
    """
    h = F.col("step")
    phi = F.col("phi")
    dhat = phi * F.col("last_d") + F.col("theta") * F.col("last_e")
    raw = F.col("last_y") + dhat * ((F.lit(1.0) - F.pow(phi, h.cast("double"))) / (F.lit(1.0) - phi))
    value = F.round(raw, digits) if digits is not None else raw
    if clip:
        value = F.greatest(F.lit(0.0), value)
    if period_step == "week":
        when = F.date_add(F.col("data_end"), h * 7)
    else:
        when = F.add_months(F.col("data_end"), h)
    return (params.select(*keys, "phi", "theta", "last_y", "last_d", "last_e", "data_end",
                          F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
            .select(*keys, "step", when.alias("period"), value.alias("y_hat")))


def walk_forward(series: DataFrame, keys: list[str], period: str = "week",
                 train_ratio: float = C.DEFAULT_TRAIN_RATIO,
                 min_training: int = C.MIN_TRAINING_PERIODS,
                 denominator: int = C.GRID_DENOMINATOR) -> DataFrame:
    """M6: expanding-window one-step backtest of every series in one pass.

    For t in [split, n) the model is fitted on points [0, t) and predicts
    point t, clipped at 0.  split = max(1, min(floor(n * ratio), n - 1));
    a series with split < ``min_training`` yields no rows.  Output: keys,
    t, period, actual, predicted (unrounded), phi, theta.
    """
    schema = (_key_ddl(keys) + f"t int, {period} date, actual double, predicted double, "
              "phi double, theta double")
    phi_g, theta_g = grid(denominator)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y = pdf["y"].to_numpy(dtype=np.float64, na_value=np.nan)
        n = len(y)
        names = [c.split(" ")[0] for c in schema.split(", ")]
        if n < 2:
            return pd.DataFrame(columns=names)
        split = max(1, min(int(np.floor(n * train_ratio)), n - 1))
        if split < min_training or split < MIN_POINTS:
            return pd.DataFrame(columns=names)
        ts = np.arange(split, n)
        k = ts - 2                       # last difference inside prefix [0, t)
        dlag, b, _, _ = css_scan(y[: n - 1], phi_g, theta_g, start_k=split - 2)
        ph, th, _, e_best = refine_scan(y[: n - 1], phi_g[b], theta_g[b], split - 2, denominator)
        # last observed value of each prefix
        last_obs = pd.Series(y).ffill().to_numpy()
        pred = last_obs[ts - 1] + (ph * dlag[k] + th * e_best)
        out = pd.DataFrame({"t": ts.astype(np.int32), period: pdf[period].to_numpy()[ts],
                            "actual": y[ts], "predicted": np.maximum(0.0, pred),
                            "phi": ph, "theta": th})
        for key in keys:
            out.insert(0, key, pdf[key].iloc[0])
        return out[names]

    cols = keys + [period, "t", "y"]
    grouped = series.select(*cols).groupBy(*keys) if keys else series.select(*cols).groupBy()
    return grouped.applyInPandas(run, schema=schema)


def holdout(series: DataFrame, keys: list[str], period: str = "month",
            holdout_n: int = C.HOLDOUT_MONTHS, min_extra: int = C.HOLDOUT_MIN_EXTRA,
            denominator: int = C.GRID_DENOMINATOR) -> DataFrame:
    """M8: fit on all but the last ``holdout_n`` points, forecast them (multi-step).

    Series with n <= holdout_n + min_extra yield no rows.  Output: keys, h,
    period, actual (null in a gap), predicted (unclipped).
    """
    schema = _key_ddl(keys) + f"h int, {period} date, actual double, predicted double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y = pdf["y"].to_numpy(dtype=np.float64, na_value=np.nan)
        names = [c.split(" ")[0] for c in schema.split(", ")]
        n = len(y)
        if n <= holdout_n + min_extra:
            return pd.DataFrame(columns=names)
        fit = fit_series(y[: n - holdout_n], denominator)
        preds = forecast_values(fit, holdout_n)
        out = pd.DataFrame({"h": np.arange(1, holdout_n + 1, dtype=np.int32),
                            period: pdf[period].to_numpy()[n - holdout_n:],
                            "actual": y[n - holdout_n:], "predicted": preds})
        for key in keys:
            out.insert(0, key, pdf[key].iloc[0])
        return out[names]

    cols = keys + [period, "t", "y"]
    grouped = series.select(*cols).groupBy(*keys) if keys else series.select(*cols).groupBy()
    return grouped.applyInPandas(run, schema=schema)


def comparable_forecast(sum_col: Column, steps: int) -> Column:
    """M4: forecast in weekly units (sum of the first ``steps`` divided by ``steps``)."""
    return sum_col / F.lit(float(steps))
