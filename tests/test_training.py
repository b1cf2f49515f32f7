"""Incremental refits equal a fresh fit, and only changed series are fitted."""

import pytest
from pyspark.sql import functions as F

from planwell.operators import arima, ingest as IG
from planwell.plans.catalog import QUERIES, weekly
from planwell.plans import catalog_backtest as CB  # noqa: E402 - registered by catalog
from planwell.plans import training as TR

from conftest import SF_SMALL


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def fresh(series, keys, period):
    return arima.fit_params(series, keys, period).select(*keys, *TR.FITTED)


@pytest.mark.parametrize("keys", [TR.WEEKLY_KEYS, TR.TWO_KEYS])
def test_only_changed_series_are_refitted(spark, tmp_path, monkeypatch, keys):
    root, period = str(tmp_path / "t8"), "week" if len(keys) == 1 else "month"
    series = weekly(spark, SF_SMALL) if len(keys) == 1 else CB.two_key_series(spark, SF_SMALL)
    series = TR.checkpoint(series.select(*keys, period, "t", "y"))
    first = TR.refit(series, keys, root, period)
    n = series.select(*keys).distinct().count()
    assert (first["models_trained"], first["models_kept"]) == (n, 0)
    assert same(TR.load(spark, root).select(*keys, *TR.FITTED), fresh(series, keys, period))

    seen = []
    real = arima.fit_params
    monkeypatch.setattr(TR.arima, "fit_params", lambda s, k, p: (seen.append(s.select(*k).distinct().count()), real(s, k, p))[1])
    assert TR.refit(series, keys, root, period)["models_trained"] == 0 and seen == []  # nothing is fitted or written
    one = series.select(*keys).distinct().orderBy(*keys).first()
    hit = F.lit(True)
    for k in keys:
        hit = hit & (F.col(k) == one[k])
    moved = TR.checkpoint(series.withColumn("y", F.when(hit & (F.col("t") == 3), F.coalesce("y", F.lit(0.0)) + 5).otherwise(F.col("y"))))
    second = TR.refit(moved, keys, root, period)
    assert (second["models_trained"], second["models_kept"]) == (1, n - 1) and seen == [1]
    got = TR.load(spark, root)
    assert same(got.select(*keys, *TR.FITTED), fresh(moved, keys, period))
    assert got.where("fit_number = 1").count() == 1
    gone = moved.where(~hit)
    assert TR.refit(gone, keys, root, period) == {"models_trained": 0, "models_kept": n - 1, "path": IG.current_path(spark, root)}
    assert TR.load(spark, root).where(hit).count() == 0
    assert TR.refit(gone, keys, root, period, force=True)["models_trained"] == n - 1


def test_short_series_are_not_fitted_again(spark, tmp_path):
    root = str(tmp_path / "t8")
    series = spark.sql("select 'A' series_key, date'2025-01-05' week, 0 t, 1.0D y union all "
                       "select 'B', date'2025-01-05' + cast(id * 7 as int), cast(id as int), cast(id % 3 as double) from range(20)")
    assert TR.refit(series, ["series_key"], root, "week")["models_trained"] == 2
    assert [r.series_key for r in TR.load(spark, root).collect()] == ["B"]
    assert TR.refit(series, ["series_key"], root, "week")["models_trained"] == 0


def test_digest_sees_any_change_but_not_the_order(spark):
    rows = [("A", 0, 1.0), ("A", 1, 2.0), ("A", 2, None), ("A", 3, 2.0)]

    def digest(r):
        df = spark.createDataFrame(r, "series_key string, t int, y double").withColumn("week", F.date_add(F.lit("2025-01-05").cast("date"), F.col("t") * 7))
        return TR.digests(df, ["series_key"], "week").first().digest

    base = digest(rows)
    assert digest(rows[::-1]) == base
    assert len({base, digest(rows[:3]), digest([*rows[:2], ("A", 2, 0.0), rows[3]]), digest([*rows, rows[0], rows[0]])}) == 4


def test_saved_forecast_uses_the_saved_table(spark, monkeypatch):
    want = QUERIES["saved_forecast"](spark, SF_SMALL).collect()
    monkeypatch.setattr(TR.arima, "fit_params", lambda *_: pytest.fail("fitted again"))
    assert sorted(QUERIES["saved_forecast"](spark, SF_SMALL).collect()) == sorted(want)
