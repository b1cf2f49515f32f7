"""Registered descriptive-statistics queries (A11-A31, R7, R8) and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from planwell import config as C
from planwell.operators import stats as ST
from planwell.plans import oracle as O
from planwell.plans.catalog import daily, register
from planwell.sources import tables as T

LEARN = O.VIEWS["learners"]
PRED = O.VIEWS["predictions"]
VOL = O.VIEWS["volume"]

ORG_DIMS = ["employment", "education", "sex", "classification", "site"]
ALL_DIMS = ["site", "course", "sex", "education", "employment", "skill", "career", "classification"]


def dist_sql(source: str, dims: list[str], limits: dict[str, int] | None = None,
             by: list[str] | None = None) -> str:
    """SQL body (after WITH ...) of a distribution like ``stats.distribution``."""
    by = by or []
    limits = limits or {}
    bk = "".join(f"{b}, " for b in by)
    long = " UNION ALL ".join(
        f"SELECT {bk}'{d}' AS dimension, CAST({d} AS VARCHAR) AS label FROM {source}" for d in dims)
    part = ", ".join([*by, "dimension"])
    if by:
        total = f"(SELECT count(*) FROM {source} s2 WHERE " + " AND ".join(
            f"s2.{b} = r.{b}" for b in by) + ")"
    else:
        total = f"(SELECT count(*) FROM {source})"
    cond = " AND ".join(f"NOT (dimension = '{d}' AND rank > {n})" for d, n in limits.items()) or "TRUE"
    return f""", d_long AS ({long}),
d_counts AS (SELECT {bk}dimension, label, count(*) AS c FROM d_long WHERE label IS NOT NULL GROUP BY ALL),
d_ranked AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY c DESC, label) AS rank FROM d_counts)
SELECT {''.join(f'r.{b}, ' for b in by)}dimension, label, CAST(c AS BIGINT) AS count,
  round(c / {total} * 100.0, 1) AS percentage, CAST(rank AS INTEGER) AS rank
FROM d_ranked r WHERE {cond}"""


def age_sql(source: str, by: list[str] | None = None) -> str:
    by = by or []
    bk = "".join(f"{b}, " for b in by)
    edges, labels = C.AGE_BIN_EDGES, C.AGE_LABELS
    conds = []
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        c = f"age >= {lo} AND age <= {hi}" if i == 0 else f"age > {lo} AND age <= {hi}"
        conds.append((i + 1, lab, c))
    bins = " UNION ALL ".join(f"SELECT {o} AS ord, '{lab}' AS label" for o, lab, _ in conds)
    case = "CASE " + " ".join(f"WHEN {c} THEN {o}" for o, _, c in conds) + " END"
    grp = f"GROUP BY {', '.join(by)}" if by else ""
    keys = f"(SELECT DISTINCT {', '.join(by)} FROM {source})" if by else "(SELECT 1 AS one)"
    join_k = " AND ".join(f"c.{b} = k.{b}" for b in by) or "TRUE"
    join_t = " AND ".join(f"t.{b} = k.{b}" for b in by) or "TRUE"
    return f""", a_bins AS ({bins}),
a_cnt AS (SELECT {bk}{case} AS ord, count(*) AS c FROM {source} GROUP BY ALL),
a_tot AS (SELECT {bk}count(*) AS n FROM {source} {grp})
SELECT {''.join(f'k.{b}, ' for b in by)}CAST(b.ord AS INTEGER) AS ord, b.label, CAST(coalesce(c.c, 0) AS BIGINT) AS count,
  CASE WHEN t.n > 0 THEN round(coalesce(c.c, 0) / t.n * 100.0, 1) ELSE 0.0 END AS percentage
FROM {keys} k CROSS JOIN a_bins b
LEFT JOIN a_cnt c ON c.ord = b.ord AND {join_k}
JOIN a_tot t ON {join_t}"""


def learners(spark, sf):
    return T.learners(spark, sf)


@register("distribution", "WITH " + LEARN + dist_sql("learners", ALL_DIMS))
def q_distribution(spark, sf):
    return ST.distribution(learners(spark, sf), ALL_DIMS)


@register("weighted_distribution", "WITH " + VOL + """
SELECT series_key AS label, CAST(SUM(cnt) AS BIGINT) AS count,
  round(SUM(cnt) / (SELECT SUM(cnt) FROM volume) * 100.0, 1) AS percentage
FROM volume GROUP BY series_key""")
def q_weighted_distribution(spark, sf):
    return ST.weighted_distribution(daily(spark, sf))


@register("age_distribution", "WITH " + LEARN + age_sql("learners"))
def q_age_distribution(spark, sf):
    return ST.age_distribution(learners(spark, sf))


MODE_SQL = " ".join(
    f"""JOIN (SELECT course, {c} FROM (SELECT course, {c}, row_number() OVER (PARTITION BY course
 ORDER BY count(*) DESC, {c}) AS rn FROM learners WHERE {c} IS NOT NULL GROUP BY course, {c}) WHERE rn = 1) m_{c}
 ON m_{c}.course = base.course""" for c in C.PROFILE_MODE_COLUMNS)


@register("representative_profile", "WITH " + LEARN + f"""
SELECT base.course, CAST(trunc(base.q) AS INTEGER) AS age,
  {', '.join(f'm_{c}.{c}' for c in C.PROFILE_MODE_COLUMNS)}
FROM (SELECT course, quantile_cont(age, 0.5) AS q FROM learners GROUP BY course) base {MODE_SQL}""")
def q_representative_profile(spark, sf):
    return ST.representative_profile(learners(spark, sf))


@register("workforce_summary", "WITH " + LEARN + """
SELECT course, CAST(count(*) AS BIGINT) AS total_historical_applicants,
  CAST(count(*) FILTER (WHERE outcome = 'Graduate') AS BIGINT) AS historical_graduates,
  round(count(*) FILTER (WHERE outcome = 'Graduate') / count(*) * 100.0, 1) AS historical_completion_rate
FROM learners GROUP BY course""")
def q_workforce_summary(spark, sf):
    return ST.workforce_summary(learners(spark, sf))


@register("workforce_profile", "WITH " + LEARN + dist_sql(
    "learners", list(ST.WORKFORCE_DIMS), {d: n for d, n in ST.WORKFORCE_DIMS.items() if n}, by=["course"]))
def q_workforce_profile(spark, sf):
    return ST.workforce_profile(learners(spark, sf))


SITE_EVIDENCE_SQL = """site_ev AS (
SELECT course, site, CAST(n AS BIGINT) AS historical_applicant_count, CAST(g AS BIGINT) AS graduates,
  CAST(n - g AS BIGINT) AS dropouts,
  round(n / sum(n) OVER (PARTITION BY course) * 100.0, 1) AS historical_participation_percentage,
  round(g / n * 100.0, 1) AS historical_completion_percentage,
  round((n - g) / n * 100.0, 1) AS historical_dropout_percentage,
  CASE WHEN n < 20 THEN 'Limited historical data' ELSE 'Reliable' END AS data_reliability,
  'Historical Supporting Evidence' AS label
FROM (SELECT course, site, count(*) AS n, count(*) FILTER (WHERE outcome = 'Graduate') AS g
      FROM learners GROUP BY course, site))"""


@register("site_evidence", "WITH " + LEARN + ", " + SITE_EVIDENCE_SQL + " SELECT * FROM site_ev")
def q_site_evidence(spark, sf):
    return ST.site_evidence(learners(spark, sf))


@register("completion_rates", "WITH " + LEARN + ", " + SITE_EVIDENCE_SQL + """
SELECT course, site, historical_completion_percentage AS completion_rate,
  historical_dropout_percentage AS dropout_rate, graduates, dropouts,
  historical_applicant_count AS total_applicants,
  '(' || graduates || ' graduates out of ' || historical_applicant_count || ' ' || course || ' applicants in ' || site || ')' AS completion_detail,
  '(' || dropouts || ' dropouts out of ' || historical_applicant_count || ' ' || course || ' applicants in ' || site || ')' AS dropout_detail,
  graduates || ' of ' || historical_applicant_count || ' ' || course || ' applicants successfully completed training in ' || site || '.' AS success_detail
FROM site_ev""")
def q_completion_rates(spark, sf):
    return ST.completion_rates(learners(spark, sf))


@register("class_balance", "WITH " + LEARN + """, ps AS (SELECT site, count(*) AS n FROM learners GROUP BY site)
SELECT outcome AS label, CAST(count(*) AS BIGINT) AS count,
  round(count(*) / (SELECT count(*) FROM learners) * 100.0, 1) AS percentage,
  CAST((SELECT min(n) FROM ps) AS BIGINT) AS site_min_records,
  CAST((SELECT max(n) FROM ps) AS BIGINT) AS site_max_records,
  round((SELECT avg(n) FROM ps), 2) AS site_mean_records,
  (SELECT min(n) = max(n) FROM ps) AS is_balanced
FROM learners GROUP BY outcome""")
def q_class_balance(spark, sf):
    return ST.class_balance(learners(spark, sf))


@register("classification_report", "WITH " + PRED + """,
conf AS (SELECT label AS actual, pred AS predicted, count(*) AS n FROM predictions GROUP BY ALL),
cls AS (SELECT coalesce(a.cls, p.cls) AS cls, coalesce(a.support, 0) AS support, coalesce(a.tp, 0) AS tp,
               coalesce(p.pn, 0) AS pn
        FROM (SELECT actual AS cls, sum(n) AS support, sum(n) FILTER (WHERE actual = predicted) AS tp FROM conf GROUP BY 1) a
        FULL OUTER JOIN (SELECT predicted AS cls, sum(n) AS pn FROM conf GROUP BY 1) p ON a.cls = p.cls),
per AS (SELECT cls, support, CASE WHEN pn > 0 THEN tp / pn ELSE 0.0 END AS p,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM cls),
perf AS (SELECT *, CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END AS f FROM per)
SELECT 'class' AS section, CAST(cls AS VARCHAR) AS class, 'precision' AS metric, round(p, 4) AS value FROM perf
UNION ALL SELECT 'class', CAST(cls AS VARCHAR), 'recall', round(r, 4) FROM perf
UNION ALL SELECT 'class', CAST(cls AS VARCHAR), 'f1_score', round(f, 4) FROM perf
UNION ALL SELECT 'class', CAST(cls AS VARCHAR), 'support', CAST(support AS DOUBLE) FROM perf
UNION ALL SELECT 'summary', NULL, 'accuracy', round(coalesce((SELECT sum(n) FROM conf WHERE actual = predicted), 0) / (SELECT count(*) FROM predictions), 4)
UNION ALL SELECT 'summary', NULL, 'macro_precision', round(avg(p), 4) FROM perf
UNION ALL SELECT 'summary', NULL, 'macro_recall', round(avg(r), 4) FROM perf
UNION ALL SELECT 'summary', NULL, 'macro_f1', round(avg(f), 4) FROM perf
UNION ALL SELECT 'summary', NULL, 'weighted_precision', round(sum(p * support) / sum(support), 4) FROM perf
UNION ALL SELECT 'summary', NULL, 'weighted_recall', round(sum(r * support) / sum(support), 4) FROM perf
UNION ALL SELECT 'summary', NULL, 'weighted_f1', round(sum(f * support) / sum(support), 4) FROM perf
UNION ALL SELECT 'confusion', CAST(actual AS VARCHAR), 'predicted_' || CAST(predicted AS VARCHAR), CAST(n AS DOUBLE) FROM conf""")
def q_classification_report(spark, sf):
    return ST.classification_report(T.predictions(spark, sf))


@register("roc_auc", "WITH " + PRED + """,
d AS (SELECT score AS s, count(*) FILTER (WHERE label = 1) AS npos, count(*) FILTER (WHERE label <> 1) AS nneg
      FROM predictions GROUP BY score),
c AS (SELECT *, coalesce(sum(nneg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d)
SELECT CASE WHEN sum(npos) > 0 AND sum(nneg) > 0 THEN round(sum(npos * (below + 0.5 * nneg)) / (sum(npos) * sum(nneg)), 4) END AS roc_auc,
  CAST(sum(npos) AS BIGINT) AS n_pos, CAST(sum(nneg) AS BIGINT) AS n_neg FROM c""")
def q_roc_auc(spark, sf):
    return ST.roc_auc(T.predictions(spark, sf))


HIST_WINNERS_SQL = SITE_EVIDENCE_SQL + """, winners AS (
  SELECT course, site FROM (SELECT course, site, row_number() OVER (PARTITION BY course
    ORDER BY historical_completion_percentage DESC, site) AS rn FROM site_ev) WHERE rn = 1)"""


def historical_winners(spark, sf):
    """Top site per course by historical completion (ties: site name)."""
    from pyspark.sql import Window
    ev = ST.site_evidence(learners(spark, sf))
    w = Window.partitionBy("course").orderBy(F.desc("historical_completion_percentage"), F.asc("site"))
    return ev.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("course", "site")


@register("gini", "WITH " + LEARN + ", " + HIST_WINNERS_SQL + """,
cnt AS (SELECT site, CAST(count(*) AS DOUBLE) AS c FROM winners GROUP BY site),
rk AS (SELECT c, row_number() OVER (ORDER BY c) AS i FROM cnt)
SELECT round(2.0 * sum(i * c) / (count(*) * sum(c)) - (count(*) + 1.0) / count(*), 4) AS gini,
  CAST(count(*) AS BIGINT) AS n_items FROM rk""")
def q_gini(spark, sf):
    w = historical_winners(spark, sf)
    return ST.gini(w.groupBy("site").agg(F.count(F.lit(1)).alias("count")))


@register("diversity", "WITH " + LEARN + ", " + HIST_WINNERS_SQL + """,
per AS (SELECT site, count(*) AS wins FROM winners GROUP BY site),
k AS (SELECT count(DISTINCT course) AS nk, (SELECT count(DISTINCT site) FROM learners) AS ns,
             (SELECT count(*) FROM per) AS u FROM winners)
SELECT site, CAST(wins AS BIGINT) AS wins, round(wins / nk * 100.0, 1) AS share_percentage,
  CAST(u AS BIGINT) AS unique_winners, round(u / ns * 100.0, 1) AS unique_share_percentage,
  CASE WHEN u >= nk * 0.5 THEN 'HIGH DIVERSITY' WHEN u >= nk * 0.3 THEN 'MODERATE DIVERSITY'
       ELSE 'LIMITED DIVERSITY' END AS verdict
FROM per CROSS JOIN k""")
def q_diversity(spark, sf):
    lr = learners(spark, sf)
    n_sites = lr.select(F.countDistinct("site")).scalar()
    return ST.diversity(historical_winners(spark, sf), "course", "site", n_sites)


@register("dq_report", "WITH " + VOL + """,
b AS (SELECT count(*) AS rows, count(DISTINCT date) AS n_days, count(DISTINCT series_key) AS n_keys,
        min(cnt) AS mn, max(cnt) AS mx,
        count(*) FILTER (WHERE date IS NULL OR series_key IS NULL OR cnt IS NULL) AS nulls,
        count(*) - count(DISTINCT (date, series_key)) AS dups,
        date_diff('day', min(date), max(date)) + 1 AS span FROM volume),
cov AS (SELECT min(days) AS mc FROM (SELECT series_key, count(DISTINCT date) AS days FROM volume GROUP BY 1))
SELECT 'row_count' AS "check", CAST(span * n_keys AS VARCHAR) AS expected, CAST(rows AS VARCHAR) AS actual, rows = span * n_keys AS ok FROM b
UNION ALL SELECT 'columns', 'cnt,date,series_key', 'cnt,date,series_key', TRUE
UNION ALL SELECT 'min_count', '>= 0', CAST(mn AS VARCHAR), mn >= 0 FROM b
UNION ALL SELECT 'max_count', '<= 1000', CAST(mx AS VARCHAR), mx <= 1000 FROM b
UNION ALL SELECT 'nulls', '0', CAST(nulls AS VARCHAR), nulls = 0 FROM b
UNION ALL SELECT 'duplicate_keys', '0', CAST(dups AS VARCHAR), dups = 0 FROM b
UNION ALL SELECT 'coverage_per_key', CAST(span AS VARCHAR), CAST(mc AS VARCHAR), mc = span FROM b, cov""")
def q_dq_report(spark, sf):
    return ST.dq_report(daily(spark, sf))


SITE_DIM_LIMITS = {"course": 8, "career": 8, "skill": 8}
SITE_DIMS = ["sex", "education", "employment", "classification", "course", "career", "skill"]


# Every fifth nation has registrations (orders) but no demographic records.
SITE_SQL = LEARN + """,
regs AS (SELECT n_name AS site, o_orderpriority AS course FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey),
demo AS (SELECT * FROM learners WHERE site NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 5 = 0)),
recs AS (SELECT site, course, age, sex, education, employment, skill, career, classification FROM demo
  UNION ALL SELECT site, course, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM regs WHERE site NOT IN (SELECT site FROM demo))"""


@register("site_profile", "WITH " + SITE_SQL + """
SELECT l.site, CAST(count(*) AS BIGINT) AS total_applicants,
  CAST((SELECT count(*) FROM regs r WHERE r.site = l.site) AS BIGINT) AS registration_event_count,
  CAST(count(*) FILTER (WHERE sex = 'Male') AS BIGINT) AS male_count,
  CAST(count(*) FILTER (WHERE sex = 'Female') AS BIGINT) AS female_count,
  round(avg(age), 1) AS average_age, m.course AS most_applied_course
FROM recs l JOIN (SELECT site, course FROM (SELECT site, course, row_number() OVER (PARTITION BY site
  ORDER BY count(*) DESC, course) AS rn FROM recs GROUP BY site, course) WHERE rn = 1) m ON l.site = m.site
GROUP BY l.site, m.course""")
def q_site_profile(spark, sf):
    """The profile of every site, from registrations where a site has no demographic records."""
    return ST.site_profile(T.demographics(spark, sf), T.registrations(spark, sf))


@register("site_distributions", "WITH " + SITE_SQL + dist_sql("recs", SITE_DIMS, SITE_DIM_LIMITS, by=["site"]))
def q_site_distributions(spark, sf):
    rows = ST.by_presence(T.demographics(spark, sf), T.registrations(spark, sf), "site")
    return ST.distribution(rows, SITE_DIMS, SITE_DIM_LIMITS, by=["site"])


@register("site_age_distribution", "WITH " + LEARN + age_sql("learners", ["site"]))
def q_site_age_distribution(spark, sf):
    """A13 per site, over the records of all sites."""
    return ST.age_distribution(learners(spark, sf), by=["site"])


@register("org_distributions", "WITH " + LEARN + ", " + VOL + dist_sql("learners", ORG_DIMS, {"site": 10})
          .replace("FROM d_ranked r WHERE", "FROM d_ranked r WHERE dimension <> 'course' AND") + """
UNION ALL
SELECT 'course' AS dimension, series_key AS label, CAST(SUM(cnt) AS BIGINT) AS count,
  round(SUM(cnt) / (SELECT SUM(cnt) FROM volume) * 100.0, 1) AS percentage,
  CAST(row_number() OVER (ORDER BY SUM(cnt) DESC, series_key) AS INTEGER) AS rank
FROM volume GROUP BY series_key""")
def q_org_distributions(spark, sf):
    """Organisation distributions (demographics from learners, course from volume)."""
    from pyspark.sql import Window
    demo = ST.distribution(learners(spark, sf), ORG_DIMS, {"site": 10})
    course = ST.weighted_distribution(daily(spark, sf)).select(
        F.lit("course").alias("dimension"), "label", "count", "percentage",
        F.row_number().over(Window.orderBy(F.desc("count"), F.asc("label"))).alias("rank"))
    return demo.unionByName(course)


@register("org_profile", "WITH " + LEARN + ", " + VOL + """
SELECT CAST((SELECT sum(cnt) FROM volume) AS BIGINT) AS total_applicants,
  (SELECT series_key FROM volume GROUP BY 1 ORDER BY sum(cnt) DESC, series_key LIMIT 1) AS most_popular_course,
  (SELECT employment FROM learners WHERE employment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, employment LIMIT 1) AS most_common_employment_status,
  (SELECT education FROM learners WHERE education IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, education LIMIT 1) AS most_common_educational_attainment""")
def q_org_profile(spark, sf):
    """The organisation's key facts beside its distributions."""
    from planwell.operators import series as SR
    volume = daily(spark, sf)
    return ST.modes_of(learners(spark, sf), [], ["employment", "education"]).select(
        volume.select(F.sum("cnt")).scalar().cast("long").alias("total_applicants"),
        SR.most_popular(volume).select("series_key").scalar().alias("most_popular_course"),
        F.col("employment").alias("most_common_employment_status"),
        F.col("education").alias("most_common_educational_attainment"))


@register("unknown_categories", "WITH " + LEARN + """
SELECT coalesce(nullif(employment, 'A'), 'Unknown') AS employment, CAST(count(*) AS BIGINT) AS n FROM learners GROUP BY 1""")
def q_unknown_categories(spark, sf):
    """Records whose category is null count as 'Unknown' (one employment status is made null here)."""
    from planwell.operators import ml as ML
    missing = learners(spark, sf).withColumn("employment", F.nullif("employment", F.lit("A")))
    return ML.clean_features(missing).groupBy("employment").agg(F.count(F.lit(1)).alias("n"))


@register("site_participation", "WITH " + LEARN + ", " + SITE_EVIDENCE_SQL + """
SELECT course, site, historical_applicant_count AS historical_applicants,
  historical_participation_percentage, data_reliability FROM site_ev""")
def q_site_participation(spark, sf):
    """The participation view of the per-site evidence."""
    return ST.site_evidence(learners(spark, sf)).select(
        "course", "site", F.col("historical_applicant_count").alias("historical_applicants"),
        "historical_participation_percentage", "data_reliability")


@register("available_sites", "WITH " + LEARN + " SELECT DISTINCT site FROM learners")
def q_available_sites(spark, sf):
    """A8 for sites: distinct sorted site labels of the learner table."""
    from planwell.operators import series as SR
    return SR.available_keys(learners(spark, sf), "site")
