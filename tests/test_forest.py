"""The forest from counts: its trees are those of Spark, whatever the blocks, tasks and groups of trees."""

import uuid

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from planwell.operators import forest as FO, ml as ML


@pytest.fixture(scope="module")
def numbers(spark):
    """Category numbers with gaps and ties, an age, and a label that depends on them: 2,000 rows of class 0 and 4,000 of class 1,
    whose weights 1.5 and 0.75 are exact in sums of any order."""
    rng = np.random.default_rng(5)
    n = 12_000
    a, b, c, age = rng.integers(0, 7, n), rng.integers(0, 40, n), rng.integers(0, 2, n), rng.integers(18, 70, n)
    y = rng.random(n) < 0.4 + 0.3 * (a % 3 == 1) + 0.2 * ((b * 7) % 5 > 2) * (age > 40) - 0.2 * c * (a == 4)
    keep = np.concatenate([np.flatnonzero(~y)[:2000], np.flatnonzero(y)[:4000]])
    a, b, c, age, y = (x[keep] for x in (a, b, c, age, y))
    rows = [("a%02d" % i, "b%02d" % j, "c%d" % k, int(g), "y%d" % z) for i, j, k, g, z in zip(a, b, c, age, y)]
    df = spark.createDataFrame(rows, "a string, b string, c string, age int, y string")
    model = StringIndexer(inputCols=["a", "b", "c", "y"], outputCols=["ai", "bi", "ci", "label"], stringOrderType="alphabetAsc").fit(df)
    return ML.checkpoint(model.transform(df).select("ai", "bi", "ci", "age", "label"))


def estimator(**params):
    return RandomForestClassifier(**{"featuresCol": "features", "labelCol": "label", "weightCol": "weight", "maxBins": 64, "maxDepth": 8,
                                     "minInstancesPerNode": 2, "numTrees": 3, "seed": 42, "featureSubsetStrategy": "sqrt", **params})


def by_counts(spark, numbers, *estimators):
    return FO.fit(spark, numbers, ["ai", "bi", "ci"], [7, 40, 2], "age", "label", list(estimators))


def assembled(numbers):
    return VectorAssembler(inputCols=["ai", "bi", "ci", "age"], outputCol="features").transform(ML.with_weights(numbers, "label"))


def test_a_tree_of_all_rows_and_features_is_the_one_of_spark(spark, numbers):
    whole = estimator(numTrees=1, bootstrap=False, featureSubsetStrategy="all")
    [got] = by_counts(spark, numbers, whole)
    rows = assembled(numbers)
    want = whole.fit(rows)
    assert got.trees[0].numNodes > 100 and got.trees[0].depth == 8
    assert got.toDebugString.split("\n")[1:] == want.toDebugString.split("\n")[1:]
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray())
    both = [m.transform(rows).select("features", "probability", "prediction").collect() for m in (got, want)]
    assert all(g.prediction == w.prediction and g.probability.toArray() == pytest.approx(w.probability.toArray()) for g, w in zip(*both))


def test_bags_are_poisson_and_the_forest_is_as_good_as_the_one_of_spark(spark, numbers):
    counts = np.bincount(FO.POISSON, minlength=9) / 65536
    assert counts == pytest.approx([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(9)], abs=2e-5)
    forest = estimator(numTrees=40)
    [got] = by_counts(spark, numbers, forest)
    rows = assembled(numbers)
    want = forest.fit(rows)
    sizes = [list(r) for r in zip(*[[t.numNodes for t in m.trees] for m in (got, want)])]
    assert len({tuple(s) for s in sizes}) > 1 and np.mean([s[0] for s in sizes]) == pytest.approx(np.mean([s[1] for s in sizes]), rel=0.1)
    roots = [t._call_java("rootNode").impurityStats().count() for t in got.trees]
    assert np.mean(roots) == pytest.approx(6000, rel=0.02) and len(set(roots)) > 30
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=0.05)
    p = [np.array([r[0][1] for r in m.transform(rows).select("probability").collect()]) for m in (got, want)]
    assert np.corrcoef(*p)[0, 1] > 0.97 and p[0].mean() == pytest.approx(p[1].mean(), abs=0.01)


def test_groups_of_trees_and_lookup_tables_do_not_change_the_trees(spark, numbers, monkeypatch):
    two = [estimator(seed=7), estimator(seed=8)]
    want = [m.toDebugString for m in by_counts(spark, numbers, *two)]
    monkeypatch.setattr(FO, "CELLS", 300)
    monkeypatch.setattr(FO, "TABLE", 50)
    monkeypatch.setattr(FO, "WORD_LEVELS", 2)
    assert [m.toDebugString for m in by_counts(spark, numbers, *two)] == want and want[0] != want[1]


def test_a_tree_of_many_blocks_is_that_of_one(spark, numbers, monkeypatch):
    whole = estimator(numTrees=1, bootstrap=False, featureSubsetStrategy="all")
    [want] = by_counts(spark, numbers, whole)
    monkeypatch.setattr(FO, "BLOCK", 500)
    [got] = by_counts(spark, numbers.repartition(5), whole)
    assert got.toDebugString.split("\n")[1:] == want.toDebugString.split("\n")[1:]


def test_thresholds_lie_between_values_or_share_the_weight():
    assert FO.thresholds([(3.0, 1.0), (1.0, 5.0), (2.0, 1.0)], 2) == [1.5, 2.5]
    assert FO.thresholds([(float(i), 1.0) for i in range(100)], 4) == [19.5, 39.5, 59.5, 79.5]
    assert FO.thresholds([(1.0, 2.0)], 3) == []


def test_other_classes_are_left_to_spark_and_a_null_is_an_error(spark, numbers):
    three = numbers.withColumn("label", F.when(F.col("age") > 60, 2.0).otherwise(F.col("label")))
    assert by_counts(spark, three, estimator()) is None
    assert by_counts(spark, numbers.where("label = 0"), estimator()) is None
    with pytest.raises(Exception, match="null"):
        by_counts(spark, numbers.withColumn("age", F.when(F.col("age") > 30, F.col("age"))), estimator())
    rows = [(i, "s%d" % (i % 3), "c%d" % (i % 5), 20 + i % 7, *["u%d" % (i % 2)] * 6, ["Graduate", "Dropout", "Active"][i % 3]) for i in range(300)]
    schema = "record_id long, site string, course string, age int, sex string, education string, employment string, skill string, career string, classification string, outcome string"
    model = ML.train_or_load(spark, spark.createDataFrame(rows, schema), f"three classes {uuid.uuid4()}")
    assert ML.forest_parts(model)[0].numClasses == 3


def test_the_learners_forest_is_not_fitted_part_by_part(spark, monkeypatch):
    monkeypatch.setattr(ML.C, "FOREST_TREES", 4)
    monkeypatch.setattr(ML.C, "FOREST_PART_TREES", 2)
    monkeypatch.setattr(ML.C, "FOREST_BAG_COUNTS", 1)
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda *_: pytest.fail("a pass over the rows for each part"))
    from planwell.sources import tables as T
    model = ML.train_or_load(spark, T.learners(spark, "/root/testdata/sf0.001"), f"not part by part {uuid.uuid4()}")
    assert [f.getNumTrees for f in ML.forest_parts(model)] == [2, 2]


def test_scores_of_held_out_rows_are_those_of_the_model_in_one_pass(spark, monkeypatch):
    from planwell.sources import tables as T
    monkeypatch.setattr(ML.C, "FOREST_TREES", 6)
    monkeypatch.setattr(ML.C, "FOREST_PART_TREES", 2)
    monkeypatch.setattr(ML.C, "FOREST_BAG_COUNTS", 1)
    ctx = ML.ModelContext(spark, T.learners(spark, "/root/testdata/sf0.001"), f"scores in one pass {uuid.uuid4()}")
    held = ML.predicted(ctx.model, ctx.split.where("is_test")).collect()
    monkeypatch.setattr(ML, "predicted", lambda *_: pytest.fail("scored by each part of the forest"))
    monkeypatch.setattr(ML, "split_bounds", lambda *_: pytest.fail("the split's bounds are known"))
    gi = ML.graduate_index(ctx.model)
    want = sorted((int(r.label == gi), int(r.prediction == gi), r.probability[gi]) for r in held)
    got = sorted((r.label, r.pred, r.score) for r in ctx.test_counts().collect() for _ in range(r.n))
    assert len(got) == len(want) > 1000 and [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])
