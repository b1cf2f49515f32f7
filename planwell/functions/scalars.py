"""Scalar expressions (labels, percentages, rounding) as JVM-side Columns.

Every function here returns a ``Column`` so it stays inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planwell import config as C


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def week_end(date_col) -> Column:
    """Sunday that ends the week of ``date_col`` (a Sunday maps to itself)."""
    return F.next_day(F.date_sub(_c(date_col), 1), C.WEEK_END_DAY)


def month_start(date_col) -> Column:
    return F.trunc(_c(date_col), "MM")


def clip0(x) -> Column:
    """Clip at zero."""
    return F.greatest(F.lit(0.0), _c(x))


def pct(part, whole, digits: int = 1, empty=0.0) -> Column:
    """``round(part / whole * 100, digits)``; ``empty`` when whole is 0.

    Division comes first, as in the service: at exact halves the binary
    quotient decides the rounding (82 / 160 * 100 rounds to 51.2).
    """
    whole = _c(whole)
    value = F.round(_c(part) / whole * F.lit(100.0), digits)
    return F.when(whole > 0, value).otherwise(F.lit(empty).cast("double"))


def growth_pct(new, base) -> Column:
    """C4: growth percent, 0.0 when the base is 0."""
    base = _c(base)
    return F.when(base == 0, F.lit(0.0)).otherwise(
        F.round((_c(new) - base) / base * F.lit(100.0), 1))


def growth_direction(growth) -> Column:
    """Growth / decline / stable at +-1 percent (exclusive)."""
    g = _c(growth)
    band = C.GROWTH_DIRECTION_BAND_PERCENT
    return (F.when(g > band, F.lit("growth"))
            .when(g < -band, F.lit("decline"))
            .otherwise(F.lit("stable")))


def trend_label(growth) -> Column:
    """Trend label at +-5 percent (exclusive)."""
    g = _c(growth)
    band = C.TREND_STABLE_THRESHOLD_PERCENT
    return (F.when(g > band, F.lit("Increasing"))
            .when(g < -band, F.lit("Decreasing"))
            .otherwise(F.lit("Stable")))


def growth_and_trend(baseline, comparable):
    """(growth, trend) of a weekly-unit forecast against a weekly baseline.

    A baseline <= 0 gives growth 0.0 and Increasing if the forecast is
    positive, else Stable.
    """
    b, f = _c(baseline), _c(comparable)
    growth = F.when(b <= 0, F.lit(0.0)).otherwise(F.round((f - b) / b * F.lit(100.0), 1))
    trend = F.when(b <= 0, F.when(f > 0, F.lit("Increasing")).otherwise(F.lit("Stable"))) \
        .otherwise(trend_label(growth))
    return growth, trend


def mape_class(mape) -> Column:
    """MAPE assessment, left-closed at 5 / 10 / 20; null is Needs Improvement."""
    m = _c(mape)
    return (F.when(m.isNull(), F.lit("Needs Improvement"))
            .when(m < C.MAPE_EXCELLENT_MAX, F.lit("Excellent"))
            .when(m < C.MAPE_GOOD_MAX, F.lit("Good"))
            .when(m < C.MAPE_ACCEPTABLE_MAX, F.lit("Acceptable"))
            .otherwise(F.lit("Needs Improvement")))


def confidence_by_error(mae, mean_volume) -> Column:
    """High / Medium / Low from MAE over mean volume.

    A missing MAE counts as 0.0 and a zero mean as 1.0.
    """
    mean = _c(mean_volume)
    ratio = F.coalesce(_c(mae), F.lit(0.0)) / F.when(mean == 0, F.lit(1.0)).otherwise(mean)
    return (F.when(ratio < C.CONFIDENCE_HIGH_RATIO, F.lit("High"))
            .when(ratio < C.CONFIDENCE_MEDIUM_RATIO, F.lit("Medium"))
            .otherwise(F.lit("Low")))


def confidence_by_error_legacy(mae, mean_volume) -> Column:
    """C8 (legacy form): Medium when MAE is missing or the mean is not positive."""
    m, mean = _c(mae), _c(mean_volume)
    ratio = m / mean
    return (F.when(m.isNull() | mean.isNull() | (mean <= 0), F.lit("Medium"))
            .when(ratio < C.CONFIDENCE_HIGH_RATIO, F.lit("High"))
            .when(ratio < C.CONFIDENCE_MEDIUM_RATIO, F.lit("Medium"))
            .otherwise(F.lit("Low")))


def confidence_by_probability(p) -> Column:
    """Confidence label of a completion probability in percent."""
    p = _c(p)
    expr = None
    for threshold, label in C.CONFIDENCE_THRESHOLDS:
        expr = (F.when(p >= threshold, F.lit(label)) if expr is None
                else expr.when(p >= threshold, F.lit(label)))
    return expr.otherwise(F.lit("Low Confidence"))


def reliability(n) -> Column:
    """Data reliability of an applicant count."""
    return F.when(_c(n) < C.MIN_HISTORICAL_APPLICANTS_FOR_RELIABILITY,
                  F.lit(C.RELIABILITY_LIMITED)).otherwise(F.lit(C.RELIABILITY_RELIABLE))


def month_label(d) -> Column:
    """C11: 'Jan 2001'."""
    return F.date_format(_c(d), "MMM yyyy")


def fmt_int(x) -> Column:
    """C14: ``{:,.0f}``: grouped, no decimals, ties to even (as Python formats)."""
    return F.format_number(_c(x), 0)


def fmt_signed1(x) -> Column:
    """C14: ``{:+.1f}``."""
    x = _c(x)
    return F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit("")), F.format_string("%.1f", x))


def unknown_if_null(x) -> Column:
    """A null category becomes 'Unknown'."""
    return F.coalesce(_c(x).cast("string"), F.lit("Unknown"))


def round_int(x) -> Column:
    """C17: float to int by rounding."""
    return F.round(_c(x)).cast("int")
