"""Constants that change results.

FIXED VALUES: these must equal the values of the service this library
re-implements, because they decide labels, horizons and thresholds.
They are listed plainly, in natural order, in one place.
"""

from __future__ import annotations

# --- fixed values: weekly series and ARIMA --------------------------------
WEEK_END_DAY = "SU"                 # weeks end on, and are labelled by, Sunday
ARIMA_ORDER = (1, 1, 1)
STEPS_NEXT_WEEK = 1
STEPS_NEXT_MONTH = 4
STEPS_NEXT_QUARTER = 13
STEPS_NEXT_6_MONTHS = 26
STEPS_NEXT_12_MONTHS = 52
STEPS_PRECOMPUTE = 52
RECENT_PERIODS_FOR_TREND = 4
TREND_STABLE_THRESHOLD_PERCENT = 5.0
GROWTH_DIRECTION_BAND_PERCENT = 1.0
FORECAST_PERIODS = {"next_week": 1, "next_month": 4, "next_quarter": 13}
PREDICT_PERIODS = {"next_month": 4, "next_quarter": 13, "next_6_months": 26, "next_12_months": 52}
PREDICT_LABELS = {
    "next_month": "Next Month (~4 weeks)",
    "next_quarter": "Next Quarter (~13 weeks)",
    "next_6_months": "Next 6 Months (~26 weeks)",
    "next_12_months": "Next 12 Months (~52 weeks)",
}
LEGACY_PERIODS = {"next_month": 1, "next_quarter": 3, "next_6_months": 6, "next_12_months": 12}
WEEKS_PER_BUCKET = 4
CHART_BUCKETS = 3
CHART_MONTHS = 18
CHART_WEEKS = 26
TOP_COURSES_CHART = 10

# --- fixed values: backtest -------------------------------------------------
DEFAULT_TRAIN_RATIO = 0.8
MIN_TRAINING_PERIODS = 12
MAPE_EXCELLENT_MAX = 5.0
MAPE_GOOD_MAX = 10.0
MAPE_ACCEPTABLE_MAX = 20.0
CONFIDENCE_HIGH_RATIO = 0.08
CONFIDENCE_MEDIUM_RATIO = 0.15
HOLDOUT_MONTHS = 6
HOLDOUT_MIN_EXTRA = 3                # a series needs more than 6 + 3 points

# --- fixed values: sentences of the planning insights -----------------------
INSIGHT_TOTAL = "%s is projected to receive %s applicants during the %s planning window."
INSIGHT_INCREASE = "Applicant volume is expected to increase by %s%% compared with the equivalent previous period."
INSIGHT_DECREASE = "Applicant volume is expected to decrease by %s%% compared with the equivalent previous period."
INSIGHT_STABLE = "Applicant volume is expected to remain stable compared with the equivalent previous period."
INSIGHT_PEAK = "Peak weekly demand is projected in week %s with approximately %s applicants."

# --- fixed values: labels and sentences of the monthly answer -----------------
LEGACY_LABELS = {
    "next_month": "Next Month",
    "next_quarter": "Next Quarter (3 Months)",
    "next_6_months": "Next 6 Months",
    "next_12_months": "Next 12 Months",
}
LEGACY_INCREASE = "Applicant volume is expected to increase by %s%% compared with the previous period of the same length."
LEGACY_DECREASE = "Applicant volume is expected to decrease by %s%% compared with the previous period of the same length."
LEGACY_STABLE = "Applicant volume is expected to remain stable compared with the previous period of the same length."
LEGACY_PEAK = "Peak demand is projected in month %s with approximately %s applicants."
LEGACY_USE = "Use this forecast to plan instructor allocation, training schedules, and barangay coordination across all programs."

# --- fixed values: sentences of the recommendation ---------------------------
EVALUATION_TITLE = "How the AI Calculates the Recommendation"
MODEL_USED = "Random Forest Classifier"
DEFENSE_SUMMARY = (
    "The representative applicant profile for %s was evaluated across all %d barangays. The Random Forest predicted the "
    "probability of successful completion for each barangay. %s obtained the highest predicted completion probability of "
    "%s%% and is recommended as the priority deployment area. Historical statistics are supporting evidence only and are not "
    "used to calculate the AI Recommendation Score.")
EVALUATION_MESSAGE = "%d barangays were evaluated by the Random Forest model and ranked by predicted completion probability."
HOME_BEST = "%s has the highest predicted completion probability (%s%%)."
HOME_EXPECTED = "Expected applicants next month: %s."
HOME_ABOVE = "%s barangays have predicted completion probabilities above 80%%."
HOME_PRIORITY = "Recommended priority areas: %s."

# --- fixed values: sentences of the course insights ---------------------------
INSIGHT_HIGHEST = "%s has the highest projected applicant volume (%s) for the selected period."
INSIGHT_FASTEST = "%s is the fastest growing course (%+.1f%% versus recent weekly average)."
INSIGHT_LOWEST = "%s has the lowest projected applicant volume (%s)."
INSIGHT_POPULAR = "The most popular course historically is %s."
INSIGHT_NONE = "No forecasting data is available yet."
INSIGHT_ONE_COURSE = "Course '%s' is projected to receive %s applicants for the selected period."

# --- fixed values: ingestion and retraining --------------------------------
RETRAIN_MIN_NEW_DAYS = 30
FULL_SYNC_NEW_DAYS = 999
RETRAIN_MAX_DAYS_SINCE_TRAINING = 7
RETRAIN_DRIFT_PERCENT = 20.0
MAX_PLAUSIBLE_DAILY_COUNT = 1000
MAX_RECORDS_PER_BATCH = 10000

# --- fixed values: descriptive statistics and recommendation ---------------
AGE_BIN_EDGES = [0, 17, 24, 34, 44, 54, 200]
AGE_LABELS = ["Under 18", "18-24", "25-34", "35-44", "45-54", "55+"]
MIN_HISTORICAL_APPLICANTS_FOR_RELIABILITY = 20
RELIABILITY_LIMITED = "Limited historical data"
RELIABILITY_RELIABLE = "Reliable"
SUPPORTING_EVIDENCE_LABEL = "Historical Supporting Evidence"
MALE_LABEL = "Male"
FEMALE_LABEL = "Female"
GRADUATE_LABEL = "Graduate"
DROPOUT_LABEL = "Dropout"
CONFIDENCE_THRESHOLDS = [
    (90.0, "Very High Confidence"),
    (80.0, "High Confidence"),
    (70.0, "Moderate Confidence"),
    (0.0, "Low Confidence"),
]
HIGH_PROBABILITY_THRESHOLD = 80.0
DIVERSITY_HIGH_SHARE = 0.5
DIVERSITY_MODERATE_SHARE = 0.3

# Random forest (numTrees, maxDepth, minInstancesPerNode, subset, seed)
FOREST_TREES = 100
FOREST_MAX_DEPTH = 10
FOREST_MIN_LEAF = 2
FOREST_FEATURE_SUBSET = "sqrt"
FOREST_SEED = 42
TEST_FRACTION = 0.2
# The forest is grown in parts: as many trees at once as have this many bag counts (rows x trees),
# and this many trees at once where even those have more.
FOREST_BAG_COUNTS = 100_000_000
FOREST_PART_TREES = 10

# The learner table is joined in pieces, one after the other: one for this many bytes of input files, at most so many.
LEARNER_PIECE_BYTES = 64 << 20
LEARNER_PIECES = 8

FEATURE_COLUMNS = [
    "site",
    "course",
    "age",
    "sex",
    "education",
    "employment",
    "skill",
    "career",
    "classification",
]
CATEGORICAL_COLUMNS = [c for c in FEATURE_COLUMNS if c != "age"]
PROFILE_MODE_COLUMNS = ["sex", "education", "employment", "skill", "career", "classification"]
FEATURE_DISPLAY_NAMES = {
    "site": "Barangay",
    "course": "Course Applied",
    "age": "Age",
    "sex": "Sex",
    "education": "Educational Attainment",
    "employment": "Employment Status",
    "skill": "Current Skill",
    "career": "Desired Career",
    "classification": "Learner Classification",
}

# --- parameters of the test-data mapping (not reference values) ------------
# The driver tables end in 2001, so the cutoff that plays the role of the
# service's historical cutoff is a parameter; 2000-12-31 is a Sunday.
DEFAULT_CUTOFF = "2000-12-31"
# Grid resolution of the conditional-sum-of-squares fit: phi, theta in
# {i / GRID_DENOMINATOR : |i| < GRID_DENOMINATOR}; 20 means a 0.05 step.
GRID_DENOMINATOR = 20
# The best grid point's neighbourhood is searched again in steps this many times finer.
GRID_REFINE = 10
# Size in bytes above which the site side of the scoring product is not broadcast.
BROADCAST_SITE_BYTES = 16 << 20
