"""Saved model parameters and incremental refits (T8; M11, S10, S11, S15).

The saved table holds, a row per series, the fitted parameters and a digest of the observations they were
fitted on.  A refit compares digests and fits only the series whose digest changed; the other
rows are carried on as they are.  The digest is a sum and an exclusive or over hashes of the observations, so it is
an ordinary partial aggregate, whatever the size or order of the data.  Reports read the saved table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwell import config as C
from planwell.operators import arima, ingest as IG
from planwell.plans import forecasting as FC
from planwell.session import checkpoint, discard, ensure_checkpoint_dir

WEEKLY_KEYS, TWO_KEYS = ["series_key"], ["site", "series_key"]
FITTED = ["phi", "theta", "sse", "n_obs", "last_y", "last_d", "last_e", "data_start", "data_end"]


def digests(series: DataFrame, keys: list[str], period: str, denominator: int = C.GRID_DENOMINATOR) -> DataFrame:
    """(keys, digest): what the fit of each series depends on, its observations and the estimator's setting."""
    one = F.xxhash64(F.col(period), F.col("t"), F.col("y"))
    low = F.sum(one.bitwiseAND(F.lit((1 << 31) - 1)))  # with the exclusive or, a repeated row does not cancel out
    text = F.concat_ws(":", F.lit(f"css/{denominator}x{C.GRID_REFINE}"), F.count(F.lit(1)), F.bit_xor(one), low)
    return series.groupBy(*keys).agg(text.alias("digest"))


def load(spark: SparkSession, root: str) -> DataFrame | None:
    """The saved parameters of all series that could be fitted; None if nothing is saved."""
    saved = IG.read_current(spark, root)
    return None if saved is None else saved.where(F.col("phi").isNotNull())


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    cond = None
    for k in keys:
        one = a[k].eqNullSafe(b[k])
        cond = one if cond is None else cond & one
    return cond


def refit(series: DataFrame, keys: list[str], root: str, period: str, trained_at: str | None = None,
          force: bool = False) -> dict:
    """Fit the series that are new or changed since the saved version, and publish the next version.

    ``series`` is regular: keys, ``period``, t, y.  Series that are gone leave the table; with ``force`` every
    series counts as changed.  Nothing is written if nothing changed.  Returns models_trained, models_kept and the path.
    """
    spark = series.sparkSession
    now = checkpoint(digests(series, keys, period))
    saved = None if force else IG.read_current(spark, root)
    if saved is not None and not set(keys + FITTED + ["digest", "trained_at", "fit_number"]) <= set(saved.columns):
        saved = None  # saved by something else: fit all
    number = 0
    if saved is None:
        changed, kept = now, None
    else:
        match = _same(now, saved, keys) & (now["digest"] == saved["digest"])
        changed = checkpoint(now.join(saved, match, "left_anti"))
        kept = saved.join(now, _same(saved, now, keys) & (saved["digest"] == now["digest"]), "left_semi")
        n_saved = saved.agg(F.count(F.lit(1)), F.max("fit_number")).first()
        n_kept = kept.count()
        if changed.isEmpty() and n_kept == n_saved[0]:
            discard(now, changed)
            return {"models_trained": 0, "models_kept": n_kept, "path": IG.current_path(spark, root)}
        number = (n_saved[1] or 0) + 1 if n_saved[0] else 0
    names = [F.col(k).alias(f"_{k}") for k in keys]
    todo = changed.select(*names, "digest")
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = one if on is None else on & one
    # only the changed series come to the grouped map
    fitted = arima.fit_params(series.join(todo, on, "left_semi"), keys, period)
    stamp = F.lit(trained_at).cast("timestamp") if trained_at else F.current_timestamp()
    fresh = todo.join(fitted, on, "left").select(*[F.col(f"_{k}").alias(k) for k in keys], *FITTED, "digest",
                                                 stamp.alias("trained_at"), F.lit(number).cast("long").alias("fit_number"))
    fresh = checkpoint(fresh)
    table = fresh if kept is None else fresh.unionByName(kept.select(*fresh.columns))
    path = IG.write_version(table, root)
    done = {"models_trained": fresh.count(), "models_kept": 0 if kept is None else kept.count(), "path": path}
    discard(now, fresh, *([] if saved is None else [changed]))
    return done


def saved_params(series: DataFrame, keys: list[str], period: str, name: str) -> DataFrame:
    """The parameters of ``series`` from the shared folder's table ``name``, refitted where a digest differs."""
    root = params_root(series.sparkSession, name)
    refit(series, keys, root, period)
    return load(series.sparkSession, root).select(*keys, *FITTED)


def params_root(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/params/{hashlib.sha256(name.encode()).hexdigest()[:24]}"


def weekly_forecast(weekly: DataFrame, name: str) -> DataFrame:
    """M2 from saved parameters."""
    return FC.weekly_forecast(saved_params(weekly, WEEKLY_KEYS, "week", name))
