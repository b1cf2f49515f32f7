"""Completion model: encoding, split, weights, random forest, scoring and ranking.

``pyspark.ml`` does the learning; everything around it is DataFrame work:

* L3 exact stratified split without a global sort: per class the test part is
  the first ceil(0.2 n) rows in the order of (md5 of the id, id).  Rows are counted
  by hash prefix, only the boundary's bucket is refined until it is small, and
  membership is then a comparison with the boundary row;
* L6 / L10 score the representative profile of every course against every
  site in one ``transform``; the site side is broadcast only after its
  row count has been checked.
"""

from __future__ import annotations

import hashlib
import math
import os
from decimal import Decimal
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwell import config as C
from planwell.functions import scalars as S
from planwell.operators import forest as FO
from planwell.operators.ingest import read_current, write_version
from planwell.session import checkpoint, collect_garbage, discard, ensure_checkpoint_dir, path_exists, shuffles_removed

LABEL = "outcome"
IDX = [f"{c}_idx" for c in C.CATEGORICAL_COLUMNS]


def clean_features(df: DataFrame) -> DataFrame:
    """Null categories become 'Unknown'."""
    return df.select(*[c for c in df.columns if c not in C.CATEGORICAL_COLUMNS],
                     *[S.unknown_if_null(c).alias(c) for c in C.CATEGORICAL_COLUMNS])


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weights w_c = n / (k * n_c) (one row per class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    every = Window.partitionBy()  # one row per class
    return counts.select(label, F.col("n_class").cast("long").alias("n_class"),
                         (F.sum("n_class").over(every) / (F.count(F.lit(1)).over(every) * F.col("n_class"))).alias("weight"))


def with_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    # the classes of a classifier are few: their weights come as one map, so the rows are not shuffled by class
    weights = class_weights(df, label).agg(F.map_from_entries(F.collect_list(F.struct(label, "weight")))).scalar()
    return df.withColumn("weight", F.element_at(weights, F.col(label)))


#: hexadecimal digits by which buckets are refined, and rows of a boundary bucket that are few enough to be ordered
SPLIT_DIGITS, SPLIT_FEW = 4, 10_000


def split_bounds(df: DataFrame, id_col: str, label: str, test_fraction: float) -> dict:
    """Per class the last (hash, id) of its test part, the ceil(test_fraction * n)-th row in the order of the hash, and
    how many of the rows with this id are in the test part, and how many there are.

    Rows are counted by the first digits of their hash; in each class only the bucket with the boundary is counted
    again by more digits, until it holds few rows, of which the one at the boundary is looked up.
    """
    h = F.md5(F.col(id_col).cast("string").cast("binary"))
    rows = df.select(F.col(label).alias("c"), F.col(id_col).alias("id"), h.alias("h"))
    # class -> (rows wanted, rows before the bucket, the bucket's prefix); None: the class as a whole
    state: dict = {}
    digits, open_ = SPLIT_DIGITS, None
    while True:
        part = rows if open_ is None else rows.where(_any([F.col("c").eqNullSafe(c) & F.col("h").startswith(state[c][2]) for c in open_]))
        cells = part.groupBy("c", F.substring("h", 1, digits).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        cells = checkpoint(cells)
        if open_ is None:
            for r in cells.groupBy("c").agg(F.sum("n").alias("n")).collect():  # a row a class
                state[r["c"]] = (_ceil(test_fraction, r["n"]), 0, "", r["n"])
            open_ = [c for c, s in state.items() if s[0] > 0]
        w = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        placed = cells.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))  # at most 16^SPLIT_DIGITS cells a class
        hit = _any([F.col("c").eqNullSafe(c) & (F.col("before") < state[c][0] - state[c][1])
                    & (F.col("before") + F.col("n") >= state[c][0] - state[c][1]) for c in open_])
        for r in (placed.where(hit).collect() if open_ else []):
            want, before, _, _ = state[r["c"]]
            state[r["c"]] = (want, before + r["before"], r["p"], r["n"])
        discard(cells)
        open_ = [c for c in open_ if state[c][3] > SPLIT_FEW and digits < 32]
        if not open_:
            break
        digits += SPLIT_DIGITS
    bounds = {}
    if not any(want for want, *_ in state.values()):
        return bounds
    # the rows of the last buckets are looked up once, not for each question
    near = checkpoint(rows.where(_any([F.col("c").eqNullSafe(c) & F.col("h").startswith(s[2]) for c, s in state.items() if s[0]])))
    for c, (want, before, _, _) in state.items():
        if want:
            few = near.where(F.col("c").eqNullSafe(c))
            last = few.orderBy("h", "id").offset(want - before - 1).limit(1).collect()[0]
            same = (F.col("h") == last["h"]) & (F.col("id") == F.lit(last["id"]))
            less = (F.col("h") < last["h"]) | ((F.col("h") == last["h"]) & (F.col("id") < F.lit(last["id"])))
            n_less, n_same = few.agg(F.count_if(less), F.count_if(same)).first()
            bounds[c] = (last["h"], last["id"], want - before - n_less, n_same)
    discard(near)
    return bounds


def _any(conditions: list):
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _ceil(fraction: float, n: int) -> int:
    return math.ceil(Decimal(str(fraction)) * n)


def stratified_split(df: DataFrame, id_col: str = "record_id", label: str = LABEL,
                     test_fraction: float = C.TEST_FRACTION, bounds: dict | None = None) -> DataFrame:
    """L3: add ``is_test``: per class exactly ceil(test_fraction * n_c) rows, the first in the order of (md5 of the
    id's text, id).  ``df`` is read for the bounds first; the flag is then a comparison a row, without a join or a
    window.  Only where an id repeats just at the boundary are the rows of this id put in an order, by their content.
    ``bounds`` are those of the same rows, if they are known."""
    # one comparison of pairs, so that a row's hash is computed once; a missing id lies after all others
    h = F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit("~"))
    if bounds is None:
        bounds = split_bounds(df, id_col, label, test_fraction)
    kind = df.schema[id_col].dataType
    inside = _any([F.col(label).eqNullSafe(c) & (F.struct(h.alias("h"), F.col(id_col).alias("id")) <= F.struct(F.lit(last).alias("h"), F.lit(i).cast(kind).alias("id")))
                   for c, (last, i, _, _) in bounds.items()])
    out = df.withColumn("is_test", F.coalesce(inside, F.lit(False)))
    for c, (_, i, taken, there) in bounds.items():
        if taken < there:
            tie = F.coalesce(F.col(label).eqNullSafe(c) & (F.col(id_col) == F.lit(i)), F.lit(False))
            w = Window.partitionBy(label).orderBy(F.xxhash64(*df.columns))
            tied = out.where(tie).withColumn("is_test", F.row_number().over(w) <= taken)
            out = out.where(~tie).unionByName(tied)
    return out


def _memory_mb(text: str) -> int:
    units = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}
    text = text.strip().lower().rstrip("b")
    # a bare number means MiB, as in Spark's memory settings
    return int(float(text[:-1]) * units[text[-1]]) if text[-1] in units else int(float(text))


def forest_memory_mb(spark: SparkSession) -> int:
    """Histogram budget of the forest, sized to the memory of one executor (the driver in
    local mode): an eighth of it, between 256 MB (Spark's default) and 1 GB."""
    sc = spark.sparkContext
    key = "spark.driver.memory" if sc.master.startswith("local") else "spark.executor.memory"
    return max(256, min(1024, _memory_mb(sc.getConf().get(key, "1g")) // 8))


def indexers() -> StringIndexer:
    """L1: alphabetical string indexers (nominal) of all categories; an unknown category is an error (L2)."""
    return StringIndexer(inputCols=C.CATEGORICAL_COLUMNS, outputCols=IDX, stringOrderType="alphabetAsc", handleInvalid="error")


def part_trees(rows: int) -> int:
    """Trees that are grown together: the largest divisor of the forest's trees with at most ``FOREST_BAG_COUNTS`` bag counts
    (rows x trees) or, for many rows, at most ``FOREST_PART_TREES`` trees."""
    most = max(C.FOREST_PART_TREES, C.FOREST_BAG_COUNTS // max(1, rows))
    return next(k for k in range(min(C.FOREST_TREES, most), 0, -1) if C.FOREST_TREES % k == 0)


#: seeds of two parts lie so far apart because Spark adds the number of a partition to a seed
SEED_STEP = 1_000_003


def forests(max_bins: int = 32, memory_mb: int = 256, part: int = C.FOREST_PART_TREES) -> list[RandomForestClassifier]:
    """L4: the weighted random forest in parts of ``part`` trees, each part with a seed and output columns of its own.

    Trees are grown independently of each other on bags of all rows, so the parts together are the forest.  Spark keeps
    the bag counts of every row for all trees that it grows at once; parts bound them to ``part`` counts a row.
    """
    return [RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight",
        rawPredictionCol=f"raw_{i}", probabilityCol=f"probability_{i}", predictionCol=f"prediction_{i}",
        numTrees=part, maxDepth=C.FOREST_MAX_DEPTH, minInstancesPerNode=C.FOREST_MIN_LEAF,
        featureSubsetStrategy=C.FOREST_FEATURE_SUBSET, seed=C.FOREST_SEED + i * SEED_STEP, maxBins=max_bins,
        # an execution-only knob (the trees do not change): a larger histogram budget groups more nodes per pass over
        # the data.  Cached node ids would be kept a number a row and tree, in several versions and checkpoints.
        maxMemoryInMB=memory_mb) for i in range(C.FOREST_TREES // part)]


def forest_parts(model: PipelineModel) -> list:
    """The fitted parts of the forest: the stages after the indexers and the assembler."""
    return model.stages[3:]


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``probability`` (an array, one value a class: the mean over all trees) and ``prediction`` (its class)."""
    parts = forest_parts(model)
    total, classes = sum(f.getNumTrees for f in parts), range(parts[0].numClasses)
    each = [(vector_to_array(f.getProbabilityCol()), f.getNumTrees / total) for f in parts]
    mean = F.array(*[sum((p[k] * share for p, share in each[1:]), each[0][0][k] * each[0][1]) for k in classes])
    out = model.transform(rows).withColumn("probability", mean)
    best = F.array_position("probability", F.array_max("probability")) - 1
    made = [c for f in parts for c in (f.getRawPredictionCol(), f.getProbabilityCol(), f.getPredictionCol())]
    return out.withColumn("prediction", best.cast("double")).drop(*made)


def model_dir(spark: SparkSession, source: str) -> str:
    """Model path in the shared checkpoint folder, one per training source and set of training choices."""
    choices = (C.FOREST_TREES, C.FOREST_MAX_DEPTH, C.FOREST_MIN_LEAF, C.FOREST_FEATURE_SUBSET, C.FOREST_SEED,
               C.FOREST_PART_TREES, C.FOREST_BAG_COUNTS, C.CATEGORICAL_COLUMNS, C.FEATURE_COLUMNS, C.TEST_FRACTION)
    tag = hashlib.sha1(f"{source}|{choices!r}".encode()).hexdigest()[:16]
    return os.path.join(ensure_checkpoint_dir(spark), "models", f"completion_{tag}")


def train_or_load(spark: SparkSession, learners: DataFrame, source: str) -> PipelineModel:
    """Load the saved pipeline for ``source`` or train it on the train split and save it.

    The split reads ``learners`` for its bounds (id and class only), the indexers read the training part, and then its
    rows are written as numbers, ordered by content inside each partition, because like rows take less space beside each other.
    ``forest.fit`` grows all trees of two classes together, a level in a pass; for other classes Spark's own forest is fitted
    part after part, and shuffles of its passes are deleted after each part.
    """
    path = model_dir(spark, source)
    if path_exists(spark, f"{path}/metadata"):
        return PipelineModel.load(path)
    rows = clean_features(learners)
    bounds = split_bounds(rows, "record_id", LABEL, C.TEST_FRACTION)
    split = stratified_split(rows, bounds=bounds)
    train = split.where(~F.col("is_test"))
    # features and label are indexed in one pass, and are two stages of the model: rows that are scored have no label
    both = indexers().setInputCols([*C.CATEGORICAL_COLUMNS, LABEL]).setOutputCols([*IDX, "label"]).fit(train)
    *categories, classes = [list(labels) for labels in both.labelsArray]
    prepare = [StringIndexerModel.from_arrays_of_labels(categories, C.CATEGORICAL_COLUMNS, IDX, handleInvalid="error"),
               StringIndexerModel.from_labels(classes, LABEL, "label", handleInvalid="error")]
    numbers = both.transform(train).select(*IDX, "age", "label")
    # a small table may come as few partitions; spreading it over the cluster's slots keeps every core busy
    n = spark.sparkContext.defaultParallelism
    if learners.rdd.getNumPartitions() < n:
        numbers = numbers.repartition(n)
    sizes = [len(labels) for labels in categories]
    cells = [c for _, c in sorted(zip(sizes, IDX))]
    with shuffles_removed(spark):
        numbers = checkpoint(numbers.sortWithinPartitions("label", *cells, "age"))
    try:
        assembler = VectorAssembler(inputCols=[*IDX, "age"], outputCol="features", handleInvalid="error")
        parts = forests(max(32, *sizes), forest_memory_mb(spark), part_trees(numbers.count()))
        grown = FO.fit(spark, numbers, IDX, sizes, "age", "label", parts)
        if grown is None:
            rows = assembler.transform(with_weights(numbers, "label")).select("features", "label", "weight")
            grown = []
            for f in parts:
                collect_garbage(spark)
                grown.append(f.fit(rows))
    finally:
        discard(numbers)
        collect_garbage(spark)
    model = PipelineModel([*prepare, assembler, *grown])
    model.write().overwrite().save(path)
    model.planwell_bounds = bounds
    return model


def fingerprint(df: DataFrame) -> str:
    """Order-independent digest of a table (row count, XOR and modular sum of row hashes).

    Part of the saved model's key, so a changed learner table never loads a
    stale model; one aggregate pass, combined map-side.
    """
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"),
                 F.sum(F.pmod(h, F.lit(2147483647))).alias("s")).first()
    return f"{row.n}-{row.x}-{row.s}"


def input_files(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of the files that ``df`` reads."""
    spark = df.sparkSession
    seen = []
    for f in sorted(df.inputFiles()):
        target = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target)
        seen.append((f, status.getLen(), status.getModificationTime()))
    return seen


def input_stamp(df: DataFrame) -> str | None:
    """A digest of the files that ``df`` reads (path, length, time of change); None if it reads none.

    It changes whenever a file does, and costs a look at the files' names instead of a pass over their rows.
    """
    seen = input_files(df)
    if not seen:
        return None
    return hashlib.sha256(repr(seen).encode()).hexdigest()[:24]


def piece_count(df: DataFrame) -> int:
    """Pieces in which a view of many input bytes is written, so that only one piece's shuffles are on disk at a time."""
    size = sum(length for _, length, _ in input_files(df))
    return max(1, min(C.LEARNER_PIECES, math.ceil(size / C.LEARNER_PIECE_BYTES)))


def stored_learners(spark: SparkSession, learners: DataFrame, source: str, pieces=None) -> tuple[DataFrame, str]:
    """(rows, stamp): the learner view as a stored table, written once for each state of the files behind it.

    Every query of the model reads this table; a view without files is copied and stamped by its rows.  ``pieces`` (n ->
    the view as n tables) lets the view be written piece after piece.
    """
    rows = clean_features(learners)
    stamp = input_stamp(rows)
    if stamp is None:
        rows = checkpoint(rows)
        return rows, fingerprint(rows)
    root = f"{ensure_checkpoint_dir(spark)}/learners/{hashlib.sha256(f'{source}|{stamp}|{rows.columns}'.encode()).hexdigest()[:24]}"
    stored = read_current(spark, root, rows.schema)
    if stored is None:
        n = piece_count(rows) if pieces else 1
        with shuffles_removed(spark):
            write_version([clean_features(p) for p in pieces(n)] if n > 1 else rows, root)
        stored = read_current(spark, root, rows.schema)
    return stored, stamp


def graduate_index(model: PipelineModel) -> int:
    return list(model.stages[1].labels).index(C.GRADUATE_LABEL)


def candidates(profiles: DataFrame, sites: DataFrame, limit: int = C.BROADCAST_SITE_BYTES) -> DataFrame:
    """Every course profile x every site.

    The output is the ranking itself (courses x sites).  The site side is
    broadcast only when its checked size in bytes is under ``limit``; above it
    Spark plans an ordinary shuffled product.
    """
    sizes = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in sites.columns]
    size = sites.agg(F.sum(sum(sizes[1:], sizes[0]))).first()[0] or 0
    side = F.broadcast(sites) if size <= limit else sites
    return profiles.crossJoin(side)


def score(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """P(Graduate) x 100, 1 dp, and its confidence label, for every (course, site) pair."""
    gi = graduate_index(model)
    scored = predicted(model, pairs)
    p = F.round(F.col("probability")[gi] * F.lit(100.0), 1)
    return scored.select("course", "site", p.alias("completion_probability")).withColumn(
        "confidence_level", S.confidence_by_probability("completion_probability"))


def rank_sites(scored: DataFrame) -> DataFrame:
    """Rank sites per course by probability (ties: site name)."""
    w = Window.partitionBy("course").orderBy(F.desc("completion_probability"), F.asc("site"))
    return scored.withColumn("rank", F.row_number().over(w))


def feature_importance(model: PipelineModel) -> list[tuple[str, str, float]]:
    """(feature, display name, importance) in model order (a 9-value vector)."""
    imp = sum(f.featureImportances.toArray() * f.getNumTrees for f in forest_parts(model))
    imp = imp / (imp.sum() or 1.0)
    names = [*C.CATEGORICAL_COLUMNS, "age"]
    return [(n, C.FEATURE_DISPLAY_NAMES[n], round(float(v), 6)) for n, v in zip(names, imp)]


class ModelContext:
    """One model build: the stored learner table, the exact split, the (loaded or trained) model.

    ``source`` names the learner table; the model is saved under that name and the state of its input in
    the shared checkpoint folder and loaded on later builds.  ``pieces`` as in ``stored_learners``.
    """

    def __init__(self, spark: SparkSession, learners: DataFrame, source: str, pieces=None):
        self.spark = spark
        self.learners, stamp = stored_learners(spark, learners, source, pieces)
        self.name = f"{source}|{stamp}"
        self.model = train_or_load(spark, self.learners, self.name)

    @cached_property
    def split(self) -> DataFrame:
        """The learners with ``is_test``; only the queries that look at the held-out part ask for it."""
        return stratified_split(self.learners, bounds=getattr(self.model, "planwell_bounds", None))

    def ranking(self, profiles: DataFrame | None = None) -> DataFrame:
        """L6 + W7: representative profile of every course (or the given ones) x every site, ranked."""
        from planwell.operators import stats as ST
        profiles = profiles if profiles is not None else ST.representative_profile(self.learners)
        sites = self.learners.select("site").distinct()
        return rank_sites(score(self.model, candidates(profiles, sites)))

    def winners(self) -> DataFrame:
        return self.ranking().where(F.col("rank") == 1).drop("rank")

    def test_counts(self) -> DataFrame:
        """Held-out rows counted by (label, pred, score): label 1 = Graduate, score = P(Graduate).

        The forest gives rows of equal features equal scores, and counting is an ordinary partial aggregate, so
        what is written is no row a record."""
        gi = graduate_index(self.model)
        features, classes, *_ = self.model.stages
        held = classes.transform(features.transform(self.split.where(F.col("is_test"))))
        parts = forest_parts(self.model)
        trees = FO.saved_trees(self.spark, model_dir(self.spark, self.name), [f.uid for f in parts])
        sizes = [len(labels) for labels in features.labelsArray]
        out = FO.scored(held, [*IDX, "age"], "label", FO.scorer(trees, [*sizes, 1], {len(sizes)}), gi)
        return checkpoint(out.groupBy(
            (F.col("label") == gi).cast("int").alias("label"), (F.col("prediction") == gi).cast("int").alias("pred"),
            "score").agg(F.count(F.lit(1)).alias("n")))

    def metrics(self) -> DataFrame:
        """Classification report and ROC-AUC of the held-out rows."""
        from planwell.operators import stats as ST
        tp = self.test_counts()
        auc = ST.roc_auc(tp, weight="n").select(F.lit("summary").alias("section"), F.lit(None).cast("string").alias("class"),
                                                F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))
        return ST.classification_report(tp, weight="n").unionByName(auc)

    def importance(self) -> DataFrame:
        """Features ranked by importance."""
        df = self.spark.createDataFrame(feature_importance(self.model),
                                        "feature string, display_name string, importance double")
        return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), F.asc("feature"))))

    def metadata(self) -> DataFrame:
        """One metadata row; the forest's values are those of the model itself."""
        parts = forest_parts(self.model)
        forest = parts[0]
        return self.split.agg(
            F.count(F.lit(1)).alias("n_records"),
            F.count_if(~F.col("is_test")).alias("n_train"),
            F.count_if(F.col("is_test")).alias("n_test"),
            F.countDistinct("site").alias("n_sites"),
            F.countDistinct("course").alias("n_courses"),
            F.count_if(F.col("outcome") == C.GRADUATE_LABEL).alias("n_graduate"),
            F.count_if(F.col("outcome") == C.DROPOUT_LABEL).alias("n_dropout"),
            F.lit(len(C.FEATURE_COLUMNS)).alias("n_features"),
            F.lit(sum(f.getNumTrees for f in parts)).alias("num_trees"), F.lit(forest.getMaxDepth()).alias("max_depth"),
            F.lit(forest.getMinInstancesPerNode()).alias("min_instances_per_node"), F.lit(forest.getSeed()).alias("seed"))
