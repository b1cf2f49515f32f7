"""Registered completion-model queries (L1-L10, A28/A29 on the model's winners, R12-R14).

The forest is not reproducible in SQL, so the queries that read its output
are rows-only checks; the split sizes and class weights have SQL oracles,
and so do the metric operators on the fixed prediction table (catalog_stats).
"""

from __future__ import annotations


from pyspark.sql import functions as F

from planwell import config as C
from planwell.operators import ml as ML, stats as ST
from planwell.plans import reports as RP
from planwell.plans import training as TR
from planwell.plans.catalog import CUT, register, weekly
from planwell.plans.catalog_stats import LEARN
from planwell.session import checkpoint
from planwell.sources import tables as T


@register("stratified_split", "WITH " + LEARN + f"""
SELECT outcome AS label, CAST(count(*) AS BIGINT) AS n,
  CAST(ceil(count(*) * {C.TEST_FRACTION}) AS BIGINT) AS n_test,
  CAST(count(*) - ceil(count(*) * {C.TEST_FRACTION}) AS BIGINT) AS n_train
FROM learners GROUP BY outcome""")
def q_stratified_split(spark, sf):
    """L3: exact per-class test / train sizes of the stratified split."""
    s = ML.stratified_split(ML.clean_features(T.learners(spark, sf)))
    return s.groupBy(F.col("outcome").alias("label")).agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.count_if(F.col("is_test")).cast("long").alias("n_test"),
        F.count_if(~F.col("is_test")).cast("long").alias("n_train"))


@register("stratified_split_rows", "WITH " + LEARN + f""",
r AS (SELECT record_id, outcome, row_number() OVER (PARTITION BY outcome ORDER BY md5(CAST(record_id AS VARCHAR)), record_id) AS rn,
  count(*) OVER (PARTITION BY outcome) AS n FROM learners)
SELECT record_id, outcome, rn <= ceil(n * {C.TEST_FRACTION}) AS is_test FROM r""")
def q_stratified_split_rows(spark, sf):
    """L3: which rows are in the test part."""
    return ML.stratified_split(T.learners(spark, sf).select("record_id", "outcome")).select("record_id", "outcome", "is_test")


@register("class_weights", "WITH " + LEARN + """
SELECT outcome, CAST(count(*) AS BIGINT) AS n_class,
  (SELECT count(*) FROM learners) / ((SELECT count(DISTINCT outcome) FROM learners) * count(*)) AS weight
FROM learners GROUP BY outcome""")
def q_class_weights(spark, sf):
    """Balanced class weights n / (k * n_c)."""
    return ML.class_weights(T.learners(spark, sf))


def Context(spark, sf) -> ML.ModelContext:  # noqa: N802 - reads like the class it builds
    """The model context of the learner view derived from the tables in ``sf``."""
    return ML.ModelContext(spark, T.learners(spark, sf), f"learners:{sf}",
                           lambda n: [T.learners(spark, sf, (i, n)) for i in range(n)])


@register("site_ranking")
def q_site_ranking(spark, sf):
    return Context(spark, sf).ranking()


@register("recommend_all")
def q_recommend_all(spark, sf):
    """The top site of every course."""
    return Context(spark, sf).winners()


@register("feature_importance")
def q_feature_importance(spark, sf):
    """Features ranked by forest importance."""
    return Context(spark, sf).importance()


@register("model_metrics")
def q_model_metrics(spark, sf):
    """Classification report and ROC-AUC of the held-out part (A26 + A27)."""
    return Context(spark, sf).metrics()


@register("model_metadata", "WITH " + LEARN + f""", c AS (SELECT count(*) AS n FROM learners GROUP BY outcome)
SELECT CAST(count(*) AS BIGINT) AS n_records,
  CAST(count(*) - (SELECT sum(ceil(n * {C.TEST_FRACTION})) FROM c) AS BIGINT) AS n_train,
  CAST((SELECT sum(ceil(n * {C.TEST_FRACTION})) FROM c) AS BIGINT) AS n_test,
  CAST(count(DISTINCT site) AS BIGINT) AS n_sites, CAST(count(DISTINCT course) AS BIGINT) AS n_courses,
  CAST(count(*) FILTER (WHERE outcome = 'Graduate') AS BIGINT) AS n_graduate,
  CAST(count(*) FILTER (WHERE outcome = 'Dropout') AS BIGINT) AS n_dropout,
  CAST({len(C.FEATURE_COLUMNS)} AS INTEGER) AS n_features, CAST({C.FOREST_TREES} AS INTEGER) AS num_trees,
  CAST({C.FOREST_MAX_DEPTH} AS INTEGER) AS max_depth, CAST({C.FOREST_MIN_LEAF} AS INTEGER) AS min_instances_per_node,
  CAST({C.FOREST_SEED} AS INTEGER) AS seed FROM learners""")
def q_model_metadata(spark, sf):
    """One metadata row beside the model."""
    return Context(spark, sf).metadata()


@register("recommend_gini")
def q_recommend_gini(spark, sf):
    """A28 on the model's top sites."""
    return ST.gini(Context(spark, sf).winners().groupBy("site").agg(F.count(F.lit(1)).alias("count")))


@register("recommend_diversity")
def q_recommend_diversity(spark, sf):
    """A29 on the model's top sites."""
    ctx = Context(spark, sf)
    n_sites = ctx.learners.select(F.countDistinct("site")).scalar()
    return ST.diversity(ctx.winners(), "course", "site", n_sites)


@register("recommendation_answer")
def q_recommendation_answer(spark, sf):
    """Ranked sites of every course with participation and evidence (J2 / J3 left joins)."""
    ctx = Context(spark, sf)
    return _answer_rows(ctx, ctx.learners)


def _answer_rows(ctx, learners, profile=None):
    ranked = ctx.ranking(profile)
    ev = ST.site_evidence(learners)
    evidence = F.struct(
        "label", "historical_participation_percentage", "historical_completion_percentage",
        "historical_dropout_percentage", "historical_applicant_count", "data_reliability")
    ev = ev.select("course", "site", "historical_applicant_count", "historical_participation_percentage",
                   "data_reliability", evidence.alias("supporting_evidence"))
    j = ranked.join(ev, ["course", "site"], "left")
    return j.select(
        "course", "rank", "site", "completion_probability", "confidence_level",
        F.coalesce("historical_applicant_count", F.lit(0)).alias("historical_applicants"),
        F.coalesce("historical_participation_percentage", F.lit(0.0)).alias("historical_participation_percentage"),
        F.coalesce("data_reliability", F.lit(C.RELIABILITY_LIMITED)).alias("data_reliability"),
        "supporting_evidence")


def explained(ctx: ML.ModelContext):
    """R13 for every course: its top site with historical blocks, the evaluation block and the decision summary."""
    ranked = ctx.ranking()
    n_sites = ranked.groupBy(F.col("course").alias("_course")).agg(F.count(F.lit(1)).alias("sites_evaluated"))
    top = ranked.where(F.col("rank") == 1).drop("rank").join(n_sites, F.col("course") == F.col("_course"))
    rates = ST.completion_rates(ctx.learners)
    feats = [d for _, d, _ in sorted(ML.feature_importance(ctx.model), key=lambda r: (-r[2], r[0]))][:5]
    factors = F.array(*[F.lit(f) for f in feats])
    report = checkpoint(ctx.metrics())

    def value(section, metric, cls=None):
        return report.where((F.col("section") == section) & (F.col("metric") == metric) & F.col("class").eqNullSafe(cls)).select("value").scalar()

    # the class 1 is that of the graduates; the matrix is read actual by predicted
    validation = F.struct(
        value("summary", "accuracy").alias("accuracy"), value("class", "precision", "1").alias("precision"),
        value("class", "recall", "1").alias("recall"), value("class", "f1_score", "1").alias("f1_score"),
        value("summary", "roc_auc").alias("roc_auc"),
        F.array(*[F.array(*[F.coalesce(value("confusion", f"predicted_{p}", a), F.lit(0.0)).cast("long") for p in "01"]) for a in "01"]).alias("confusion_matrix"),
        F.array(F.lit(C.DROPOUT_LABEL), F.lit(C.GRADUATE_LABEL)).alias("class_labels"))
    j = top.join(rates, ["course", "site"], "left")
    score = F.col("completion_probability").cast("string")
    defense = F.format_string(C.DEFENSE_SUMMARY, F.col("course"), F.col("sites_evaluated"), F.col("site"), score)
    return j.select(
        "course", F.col("site").alias("recommended_site"), "completion_probability", "confidence_level",
        "completion_rate", "dropout_rate", "completion_detail", "dropout_detail", "success_detail",
        value("summary", "accuracy").alias("model_accuracy"), factors.alias("top_features"),
        F.concat(F.col("site"), F.lit(" is recommended for "), F.col("course"), F.lit(" with a predicted completion probability of "),
                 score, F.lit("%.")).alias("decision_summary"),
        F.struct(F.lit(C.EVALUATION_TITLE).alias("title"), F.col("site"), F.col("course"), F.col("sites_evaluated"),
                 F.col("completion_probability").alias("recommendation_score"), F.col("confidence_level"),
                 factors.alias("recommendation_factors"), defense.alias("defense_summary")).alias("evaluation"),
        F.struct(F.lit(C.MODEL_USED).alias("model_used"), ctx.learners.select(F.count(F.lit(1))).scalar().alias("training_records"),
                 ctx.learners.select(F.countDistinct("site")).scalar().alias("sites"), F.col("course").alias("course_selected"),
                 F.col("site").alias("top_site"), F.col("completion_probability").alias("prediction_confidence"),
                 F.col("confidence_level"), validation.alias("model_validation")).alias("ai_decision_summary"),
        F.format_string(C.EVALUATION_MESSAGE, F.col("sites_evaluated")).alias("evaluation_message"))


@register("explanation")
def q_explanation(spark, sf):
    """The explanation of every course's recommendation."""
    return explained(Context(spark, sf))


@register("completion_answer")
def q_completion_answer(spark, sf):
    """R12 + R13 as one answer a course: profile, workforce, ranked sites with evidence, explanation."""
    return completion_answer(Context(spark, sf))


def completion_answer(ctx: ML.ModelContext, learners=None):
    """One row a course; ``learners`` narrows the courses.  The lists hold labels and sites of one course, not records."""
    rows = ctx.learners if learners is None else learners
    profile = checkpoint(ST.representative_profile(rows))
    sites = checkpoint(_answer_rows(ctx, rows, profile))
    dist = ST.workforce_profile(rows)
    ranked = sites.groupBy("course").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "site", "completion_probability", "confidence_level", "historical_applicants",
        "historical_participation_percentage", "data_reliability", "supporting_evidence"))).alias("recommended_sites"))
    labels = dist.groupBy("course").agg(F.array_sort(F.collect_list(F.struct("dimension", "rank", "label", "count", "percentage"))).alias("distributions"))
    own = F.struct(*[c for c in profile.columns if c != "course"]).alias("applicant_profile")
    total = ST.workforce_summary(rows)
    work = F.struct("total_historical_applicants", "historical_graduates", "historical_completion_rate", "distributions")
    why = explained(ctx).withColumnRenamed("course", "_c")
    why = why.select("_c", F.struct(*[c for c in why.columns if c != "_c"]).alias("explainable_ai"))
    return (profile.select("course", own).join(total.join(labels, "course"), "course").join(ranked, "course")
            .join(why, F.col("course") == F.col("_c"), "left")
            .select("course", "applicant_profile", work.alias("course_workforce_profile"), "recommended_sites", "explainable_ai"))


@register("home_dashboard")
def q_home_dashboard(spark, sf):
    """Best site, top-5, count of sites >= 80 %, next-month total, for the most popular course."""
    return RP.home_dashboard(Context(spark, sf), TR.weekly_forecast(checkpoint(weekly(spark, sf)), f"weekly:{sf}:{CUT}"))
