"""Descriptive statistics and evaluation metrics.

Design rules used throughout:

* many distributions come out of ONE scan: the dimensions are unpivoted to
  (dimension, label) rows and counted with a partial + final aggregate, so a
  hot label is combined map-side before the shuffle;
* denominators are scalar subqueries (``DataFrame.scalar()``), not joins;
* windows only run over aggregated rows (labels of one dimension, sites of
  one course), never over raw records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwell import config as C
from planwell.functions import scalars as S
from planwell.operators import ordered as OD
from planwell.session import checkpoint


def _count_all(df: DataFrame) -> Column:
    """Row count of ``df`` as a scalar subquery."""
    return df.select(F.count(F.lit(1))).scalar()


def unpivot(df: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    """Wide to long: (ids..., dimension, label) with every label cast to string."""
    ids = list(ids or [])
    pairs = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("label"))
             for c in columns]
    return df.select(*ids, F.explode(F.array(*pairs)).alias("_p")).select(
        *ids, "_p.dimension", "_p.label")


ROWS_MARKER = "__rows__"


def distribution(df: DataFrame, columns: list[str], limits: dict[str, int] | None = None,
                 by: list[str] | None = None) -> DataFrame:
    """Count and percentage of every label of every column, optional top-n per column.

    Percentages are of all rows (of the group ``by`` when given); rows whose
    label is null are not counted but stay in the denominator.  Order and
    top-n use (count desc, label asc).

    One pass over ``df``: every row also emits a row-marker item, so the
    denominator comes out of the same aggregate instead of a second scan: as a scalar, or with ``by`` by
    a window over the aggregated rows of each group.  Without ``by`` ranks come from one order per dimension.
    """
    by = list(by or [])
    limits = limits or {}
    long = unpivot(df.withColumn(ROWS_MARKER, F.lit("")), [*columns, ROWS_MARKER], by) \
        .where(F.col("label").isNotNull())
    counts = long.groupBy(*by, "dimension", "label").agg(F.count(F.lit(1)).alias("count"))
    if by:
        total = F.max(F.when(F.col("dimension") == ROWS_MARKER, F.col("count"))).over(Window.partitionBy(*by))
    else:
        counts = checkpoint(counts)  # the labels of all dimensions, counted
        total = counts.where(F.col("dimension") == ROWS_MARKER).select("count").scalar()
    counts = counts.withColumn("_total", total).where(F.col("dimension") != ROWS_MARKER)
    w = Window.partitionBy(*by, "dimension").orderBy(F.desc("count"), F.asc("label"))
    out = counts.select(*by, "dimension", "label", F.col("count").cast("long").alias("count"),
                        F.round(F.col("count") / F.col("_total") * F.lit(100.0), 1).alias("percentage"),
                        F.row_number().over(w).alias("rank"))
    if limits:
        cap = F.lit(None).cast("int")
        for dim, n in limits.items():
            cap = F.when(F.col("dimension") == dim, F.lit(n)).otherwise(cap)
        out = out.where(cap.isNull() | (F.col("rank") <= cap))
    return out


def weighted_distribution(daily: DataFrame, key: str = "series_key", weight: str = "cnt",
                          limit: int | None = None) -> DataFrame:
    """Sum of ``weight`` per key, percent of the grand total; all keys, or the top ``limit``."""
    sums = daily.groupBy(key).agg(F.sum(weight).alias("count"))
    grand = daily.select(F.sum(weight)).scalar()
    pct = F.when(grand > 0, F.round(F.col("count") / grand * F.lit(100.0), 1)).otherwise(F.lit(0.0))
    out = sums.select(F.col(key).alias("label"), F.col("count").cast("long").alias("count"), pct.alias("percentage"))
    return out if limit is None else out.orderBy(F.desc("count"), F.asc("label")).limit(limit)


def age_bins(age: Column) -> list[tuple[str, Column]]:
    """Right-closed bins; the first bin includes its lower edge (age 0)."""
    edges, labels = C.AGE_BIN_EDGES, C.AGE_LABELS
    out = []
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = (age >= lo) & (age <= hi) if i == 0 else (age > lo) & (age <= hi)
        out.append((label, cond))
    return out


def age_distribution(df: DataFrame, by: list[str] | None = None, age: str = "age") -> DataFrame:
    """Every age bin (empty bins as 0) with percentage of all rows.

    One conditional-count aggregate, then ``stack`` to one row per bin; the
    bin list is the fixed label list, so no dimension table is joined.
    """
    by = list(by or [])
    bins = age_bins(F.col(age))
    g = df.groupBy(*by) if by else df.groupBy()
    wide = g.agg(F.count(F.lit(1)).alias("_total"),
                 *[F.count_if(cond).alias(f"_b{i}") for i, (_, cond) in enumerate(bins)])
    stack = "stack({n}, {items}) as (ord, label, count)".format(
        n=len(bins), items=", ".join(f"{i + 1}, '{lab}', _b{i}" for i, (lab, _) in enumerate(bins)))
    long = wide.select(*by, "_total", F.expr(stack))
    return long.select(*by, F.col("ord").cast("int").alias("ord"), "label",
                       F.col("count").cast("long").alias("count"),
                       S.pct(F.col("count"), F.col("_total"), 1, 0.0).alias("percentage"))


def distributions_and_ages(df: DataFrame, columns: list[str], limits: dict[str, int] | None = None,
                           age: str = "age") -> tuple[DataFrame, DataFrame]:
    """A11 and A13 together over one pass of ``df``: the age bin is one more label that is counted.

    Same rows as ``distribution`` and ``age_distribution``; only the counted labels are written in between.
    """
    bin_label = F.lit(None).cast("string")
    for label, cond in reversed(age_bins(F.col(age))):
        bin_label = F.when(cond, F.lit(label)).otherwise(bin_label)
    rows = df.select(*columns, bin_label.alias("_age_bin"), F.lit("").alias(ROWS_MARKER))
    counts = checkpoint(OD.label_counts(rows, [], [*columns, "_age_bin", ROWS_MARKER]))
    total = counts.where(F.col("dimension") == ROWS_MARKER).select("n").scalar()
    w = Window.partitionBy("dimension").orderBy(F.desc("n"), F.asc("label"))
    dist = counts.where(F.col("dimension").isin(columns)).select(
        "dimension", "label", F.col("n").cast("long").alias("count"), F.round(F.col("n") / total * F.lit(100.0), 1).alias("percentage"),
        F.row_number().over(w).alias("rank"))
    for dim, n in (limits or {}).items():
        dist = dist.where((F.col("dimension") != dim) | (F.col("rank") <= n))
    bins = df.sparkSession.createDataFrame([(i + 1, label) for i, label in enumerate(C.AGE_LABELS)], "ord int, label string")
    seen = counts.where(F.col("dimension") == "_age_bin").select(F.col("label").alias("_label"), "n")
    ages = bins.join(seen, F.col("label") == F.col("_label"), "left").select(
        "ord", "label", F.coalesce("n", F.lit(0)).cast("long").alias("count"),
        S.pct(F.coalesce("n", F.lit(0)), F.coalesce(total, F.lit(0)), 1, 0.0).alias("percentage"))
    return dist, ages


def representative_profile(learners: DataFrame, key: str = "course") -> DataFrame:
    """Per key, the mode of each profile column and the median age (truncated).

    One pass counts the labels of all columns and the ages; modes and medians come from the counts.
    """
    counts = checkpoint(OD.label_counts(learners, [key], [*C.PROFILE_MODE_COLUMNS, "age"]))
    ages = counts.where(F.col("dimension") == "age").select(key, F.col("label").cast("double").alias("value"), "n")
    median = OD.medians(ages, [key]).select(F.col(key).alias("_key"), F.col("median").cast("int").alias("age"))
    # a key with nothing but nulls has no counts: it comes from the keys themselves
    keys = learners.select(key).distinct()
    modes = OD.modes(counts, [key], C.PROFILE_MODE_COLUMNS).withColumnRenamed(key, "_mode_key")
    out = keys.join(modes, F.col(key).eqNullSafe(F.col("_mode_key")), "left").join(median, F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.select(key, "age", *C.PROFILE_MODE_COLUMNS)


def modes_of(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per group (or over all rows) the most frequent value of each column, the smallest on ties."""
    return OD.modes(OD.label_counts(df, keys, columns), keys, columns)


def by_presence(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Rows of ``primary``, and for the keys that it has no row of those of ``secondary``.

    Columns that only one of them has are null in the other's rows.  The keys present are counted out first, so the
    anti join meets a table of keys and not of rows.
    """
    present = primary.where(F.col(key).isNotNull()).select(F.col(key).alias("_present")).distinct()
    rest = secondary.join(present, F.col(key) == F.col("_present"), "left_anti")
    return primary.unionByName(rest, allowMissingColumns=True)


def site_profile(demographics: DataFrame, registrations: DataFrame | None = None) -> DataFrame:
    """R7 for every site: counts, sexes, mean age and most applied course from the site's demographic records, or
    from its ``registrations`` (site, course) where it has none; the number of registrations in any case.

    Without ``registrations`` the demographic records count as such.
    """
    events = demographics if registrations is None else registrations
    rows = demographics if registrations is None else by_presence(demographics, registrations, "site")
    facts = rows.where(F.col("site").isNotNull()).groupBy("site").agg(
        F.count(F.lit(1)).cast("long").alias("total_applicants"),
        F.count_if(F.col("sex") == C.MALE_LABEL).cast("long").alias("male_count"),
        F.count_if(F.col("sex") == C.FEMALE_LABEL).cast("long").alias("female_count"),
        F.round(F.avg("age"), 1).alias("average_age"))
    event_counts = events.groupBy(F.col("site").alias("_site")).agg(F.count(F.lit(1)).cast("long").alias("_events"))
    most = modes_of(rows, ["site"], ["course"]).select(F.col("site").alias("_mode_site"), F.col("course").alias("most_applied_course"))
    out = facts.join(event_counts, F.col("site") == F.col("_site"), "left").join(most, F.col("site") == F.col("_mode_site"), "left")
    return out.select("site", "total_applicants", F.coalesce("_events", F.lit(0)).cast("long").alias("registration_event_count"),
                      "male_count", "female_count", "average_age", "most_applied_course")


def outcome_summary(learners: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of records and graduates per group."""
    return learners.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("applicants"),
        F.count_if(F.col("outcome") == C.GRADUATE_LABEL).alias("graduates"))


def workforce_summary(learners: DataFrame) -> DataFrame:
    """A19 (totals): applicants, graduates and completion rate per course."""
    s = outcome_summary(learners, ["course"])
    return s.select("course", F.col("applicants").cast("long").alias("total_historical_applicants"),
                    F.col("graduates").cast("long").alias("historical_graduates"),
                    S.pct("graduates", "applicants").alias("historical_completion_rate"))


WORKFORCE_DIMS = {"skill": 5, "education": 5, "employment": None, "career": 5, "classification": None}


def workforce_profile(learners: DataFrame) -> DataFrame:
    """A19 (distributions): five distributions per course, top 5 where the service caps them."""
    limits = {d: n for d, n in WORKFORCE_DIMS.items() if n}
    return distribution(learners, list(WORKFORCE_DIMS), limits, by=["course"])


def site_evidence(learners: DataFrame) -> DataFrame:
    """Per (course, site) participation, completion, dropout, reliability.

    The course total is a window sum over the (course, site) aggregate:
    one row per site of the course, never raw rows.
    """
    s = outcome_summary(learners, ["course", "site"])
    total = F.sum("applicants").over(Window.partitionBy("course"))
    s = s.withColumn("_course_total", total)
    dropouts = F.col("applicants") - F.col("graduates")
    return s.select(
        "course", "site",
        F.col("applicants").cast("long").alias("historical_applicant_count"),
        F.col("graduates").cast("long").alias("graduates"),
        dropouts.cast("long").alias("dropouts"),
        S.pct("applicants", "_course_total").alias("historical_participation_percentage"),
        S.pct("graduates", "applicants").alias("historical_completion_percentage"),
        S.pct(dropouts, F.col("applicants")).alias("historical_dropout_percentage"),
        S.reliability("applicants").alias("data_reliability"),
        F.lit(C.SUPPORTING_EVIDENCE_LABEL).alias("label"))


def completion_rates(learners: DataFrame) -> DataFrame:
    """Completion / dropout / success blocks with their sentences, per (course, site)."""
    ev = site_evidence(learners)
    n, g, d = (F.col("historical_applicant_count"), F.col("graduates"), F.col("dropouts"))
    return ev.select(
        "course", "site",
        F.col("historical_completion_percentage").alias("completion_rate"),
        F.col("historical_dropout_percentage").alias("dropout_rate"),
        g.alias("graduates"), d.alias("dropouts"), n.alias("total_applicants"),
        F.format_string("(%d graduates out of %d %s applicants in %s)", g, n, F.col("course"),
                        F.col("site")).alias("completion_detail"),
        F.format_string("(%d dropouts out of %d %s applicants in %s)", d, n, F.col("course"),
                        F.col("site")).alias("dropout_detail"),
        F.format_string("%d of %d %s applicants successfully completed training in %s.", g, n,
                        F.col("course"), F.col("site")).alias("success_detail"))


def forecast_metrics(pairs: DataFrame, keys: list[str], actual: str = "actual",
                     predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE, MAPE (over actual > 0, null if none), rounded to 2 dp."""
    e = F.col(actual) - F.col(predicted)
    g = pairs.groupBy(*keys) if keys else pairs.groupBy()
    return g.agg(
        F.round(F.avg(F.abs(e)), 2).alias("mae"),
        F.round(F.sqrt(F.avg(e * e)), 2).alias("rmse"),
        F.round(F.avg(F.when(F.col(actual) > 0, F.abs(e / F.col(actual)))) * F.lit(100.0), 2).alias("mape"),
        F.count(F.lit(1)).alias("test_periods"),
        F.count_if(F.col(actual) > 0).alias("mape_periods"))


def class_balance(learners: DataFrame, label: str = "outcome", site: str = "site") -> DataFrame:
    """Class counts and shares, records per site (min / max / mean), balanced flag."""
    total = _count_all(learners)
    classes = learners.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    per_site = learners.groupBy(site).agg(F.count(F.lit(1)).alias("n"))
    site_stats = per_site.agg(F.min("n").alias("mn"), F.max("n").alias("mx"), F.avg("n").alias("avg"),
                              F.count(F.lit(1)).alias("n_sites"))
    mn = site_stats.select("mn").scalar()
    mx = site_stats.select("mx").scalar()
    return classes.select(
        F.col(label).alias("label"), F.col("count").cast("long").alias("count"),
        F.round(F.col("count") / total * F.lit(100.0), 1).alias("percentage"),
        mn.cast("long").alias("site_min_records"), mx.cast("long").alias("site_max_records"),
        F.round(site_stats.select("avg").scalar(), 2).alias("site_mean_records"),
        (mn == mx).alias("is_balanced"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "pred", weight: str | None = None) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted averages,
    and the confusion matrix, as (section, class, metric, value) rows; ``weight`` names a count a row.

    One aggregate builds the confusion counts; everything else is arithmetic on
    that (classes x classes) table.
    """
    # the (classes x classes) confusion table is the only pass over the predictions;
    # it is materialised once and every figure below is read from it
    conf = checkpoint(pred.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted"))
                      .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n")))
    per_class_actual = conf.groupBy(F.col("actual").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))).alias("tp"))
    per_class_pred = conf.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("predicted_n"))
    cls = per_class_actual.join(per_class_pred, "cls", "full_outer").select(
        "cls", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("predicted_n", F.lit(0)).alias("predicted_n"))
    prec = F.when(F.col("predicted_n") > 0, F.col("tp") / F.col("predicted_n")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(F.col("p") + F.col("r") > 0, F.lit(2.0) * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))) \
        .otherwise(F.lit(0.0))
    per = cls.select("cls", "support", prec.alias("p"), rec.alias("r")).withColumn("f", f1)
    rows = per.select(F.lit("class").alias("section"), F.col("cls").cast("string").alias("class"),
                      F.explode(F.create_map(
                          F.lit("precision"), F.round("p", 4), F.lit("recall"), F.round("r", 4),
                          F.lit("f1_score"), F.round("f", 4),
                          F.lit("support"), F.col("support").cast("double"))).alias("metric", "value"))
    total = conf.select(F.sum("n")).scalar()
    correct = conf.where(F.col("actual") == F.col("predicted")).select(F.sum("n")).scalar()
    avgs = per.agg(
        F.round(F.avg("p"), 4).alias("macro_precision"), F.round(F.avg("r"), 4).alias("macro_recall"),
        F.round(F.avg("f"), 4).alias("macro_f1"),
        F.round(F.sum(F.col("p") * F.col("support")) / F.sum("support"), 4).alias("weighted_precision"),
        F.round(F.sum(F.col("r") * F.col("support")) / F.sum("support"), 4).alias("weighted_recall"),
        F.round(F.sum(F.col("f") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"))
    summary = avgs.select(F.lit("summary").alias("section"), F.lit(None).cast("string").alias("class"),
                          F.explode(F.create_map(
                              F.lit("accuracy"), F.round(F.coalesce(correct, F.lit(0)) / total, 4),
                              F.lit("macro_precision"), F.col("macro_precision"),
                              F.lit("macro_recall"), F.col("macro_recall"),
                              F.lit("macro_f1"), F.col("macro_f1"),
                              F.lit("weighted_precision"), F.col("weighted_precision"),
                              F.lit("weighted_recall"), F.col("weighted_recall"),
                              F.lit("weighted_f1"), F.col("weighted_f1"))).alias("metric", "value"))
    matrix = conf.select(F.lit("confusion").alias("section"), F.col("actual").cast("string").alias("class"),
                         F.concat(F.lit("predicted_"), F.col("predicted").cast("string")).alias("metric"),
                         F.col("n").cast("double").alias("value"))
    return rows.unionByName(summary).unionByName(matrix)


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score", weight: str | None = None) -> DataFrame:
    """Exact ROC-AUC with tie-averaged ranks, null when one class is absent.

    AUC = sum over positives of (#negatives scored below + 0.5 * #negatives tied) / (n_pos * n_neg).  Scores are
    counted by distinct value and the negatives below come from running sums over range partitions, whose
    bounds are sampled from the scores themselves: clustered scores spread like any others.
    """
    one = F.col(weight) if weight else F.lit(1)
    d = pred.groupBy(F.col(score).alias("s")).agg(
        F.coalesce(F.sum(F.when(F.col(label) == 1, one)), F.lit(0)).cast("long").alias("npos"),
        F.coalesce(F.sum(F.when(F.col(label) != 1, one)), F.lit(0)).cast("long").alias("nneg"))
    d = OD.running_sums(d, ["s"], ["nneg"])
    agg = d.agg(F.sum(F.col("npos") * (F.col("nneg_before") + F.lit(0.5) * F.col("nneg"))).alias("num"),
                F.sum("npos").alias("np"), F.sum("nneg").alias("nn"))
    auc = F.when((F.col("np") > 0) & (F.col("nn") > 0),
                 F.round(F.col("num") / (F.col("np") * F.col("nn")), 4))
    return agg.select(auc.alias("roc_auc"), F.col("np").cast("long").alias("n_pos"),
                      F.col("nn").cast("long").alias("n_neg"))


def gini(counts: DataFrame, count: str = "count") -> DataFrame:
    """Gini coefficient of counts: 2 sum(i c_(i)) / (n sum c) - (n + 1) / n.

    Items of equal count are one row with their number m: behind k smaller items their ranks add up to
    m k + m (m + 1) / 2, and k comes from running sums over range partitions.
    """
    m = F.col("m").cast("double")
    same = counts.groupBy(F.col(count).cast("double").alias("c")).agg(F.count(F.lit(1)).alias("m"))
    ranked = OD.running_sums(same, ["c"], ["m"])
    agg = ranked.agg(F.sum((m * F.col("m_before") + m * (m + 1) / 2) * F.col("c")).alias("ic"), F.sum(m * F.col("c")).alias("sc"),
                     F.sum("m").alias("n"))
    return agg.select(F.round(F.lit(2.0) * F.col("ic") / (F.col("n") * F.col("sc"))
                              - (F.col("n") + F.lit(1.0)) / F.col("n"), 4).alias("gini"),
                      F.coalesce("n", F.lit(0)).cast("long").alias("n_items"))


def diversity(winners: DataFrame, key: str, winner: str, n_sites: Column) -> DataFrame:
    """Winners per site, distinct winners, their share and a verdict."""
    per = winners.groupBy(winner).agg(F.count(F.lit(1)).alias("wins"))
    n_keys = winners.select(F.countDistinct(key)).scalar()
    unique = per.select(F.count(F.lit(1))).scalar()
    verdict = (F.when(unique >= n_keys * F.lit(C.DIVERSITY_HIGH_SHARE), F.lit("HIGH DIVERSITY"))
               .when(unique >= n_keys * F.lit(C.DIVERSITY_MODERATE_SHARE), F.lit("MODERATE DIVERSITY"))
               .otherwise(F.lit("LIMITED DIVERSITY")))
    return per.select(F.col(winner).alias("site"), F.col("wins").cast("long").alias("wins"),
                      F.round(F.col("wins") / n_keys * F.lit(100.0), 1).alias("share_percentage"),
                      unique.cast("long").alias("unique_winners"),
                      F.round(unique / n_sites * F.lit(100.0), 1).alias("unique_share_percentage"),
                      verdict.alias("verdict"))


def dq_report(daily: DataFrame, max_count: int = C.MAX_PLAUSIBLE_DAILY_COUNT) -> DataFrame:
    """One aggregate pass -> (check, expected, actual, ok) rows.

    Checks: row count equals days x keys (full coverage), required columns,
    minimum >= 0, maximum <= ``max_count``, no nulls, no duplicate (date, key),
    every key covers every day.
    """
    per_key = daily.groupBy("series_key").agg(F.countDistinct("date").alias("days"))
    base = daily.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("date").alias("n_days"),
        F.countDistinct("series_key").alias("n_keys"),
        F.min("cnt").alias("mn"), F.max("cnt").alias("mx"),
        F.count_if(F.col("date").isNull() | F.col("series_key").isNull() | F.col("cnt").isNull()).alias("nulls"),
        (F.count(F.lit(1)) - F.countDistinct("date", "series_key")).alias("dups"),
        F.min("date").alias("d0"), F.max("date").alias("d1"))
    span = F.datediff("d1", "d0") + 1
    min_cov = per_key.select(F.min("days")).scalar()
    checks = [
        ("row_count", (span * F.col("n_keys")).cast("string"), F.col("rows").cast("string"),
         F.col("rows") == span * F.col("n_keys")),
        ("columns", F.lit("cnt,date,series_key"),
         F.lit(",".join(sorted(daily.columns))), F.lit(sorted(daily.columns) == ["cnt", "date", "series_key"])),
        ("min_count", F.lit(">= 0"), F.col("mn").cast("string"), F.col("mn") >= 0),
        ("max_count", F.lit(f"<= {max_count}"), F.col("mx").cast("string"), F.col("mx") <= max_count),
        ("nulls", F.lit("0"), F.col("nulls").cast("string"), F.col("nulls") == 0),
        ("duplicate_keys", F.lit("0"), F.col("dups").cast("string"), F.col("dups") == 0),
        ("coverage_per_key", span.cast("string"), min_cov.cast("string"), min_cov == span),
    ]
    arr = F.array(*[F.struct(F.lit(n).alias("check"), e.alias("expected"), a.alias("actual"),
                             ok.alias("ok")) for n, e, a, ok in checks])
    out = base.select(F.explode(arr).alias("c")).select("c.*")
    return out
