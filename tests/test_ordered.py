"""Modes, medians, AUC, Gini and split membership from counts, against brute force, with hot and clustered values."""

import collections
import hashlib
import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from planwell import config as C
from planwell.operators import ml as ML, ordered as OD, stats as ST

LEARN = "course string, age int, " + ", ".join(f"{c} string" for c in C.PROFILE_MODE_COLUMNS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def learners(spark):
    r = random.Random(4)
    rows = []
    for i in range(900):
        course = "hot" if i % 3 else r.choice(["a", "b", "c"])
        rows.append((course, r.choice([None, *range(20, 30)]), *[r.choice(["x", "y", "z", None]) for _ in C.PROFILE_MODE_COLUMNS]))
    rows += [("nulls", None, *[None] * 6), ("one", 33, *["q"] * 6), ("two", 20, *["b"] * 6), ("two", 23, *["a"] * 6)]
    return rows, spark.createDataFrame(rows, LEARN).repartition(6)


def test_profile_by_brute_force_and_without_per_key_maps(spark):
    rows, df = learners(spark)
    want = {}
    for course, group in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        group = list(group)
        ages = [g[1] for g in group if g[1] is not None]
        modes = []
        for j in range(2, 8):
            n = collections.Counter(g[j] for g in group if g[j] is not None)
            modes.append(min(n, key=lambda v: (-n[v], v)) if n else None)
        want[course] = (int(statistics.median(ages)) if ages else None, *modes)
    out = ST.representative_profile(df)
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == want
    text = plan(out).lower()
    assert " mode(" not in text and "partial_mode" not in text and "median" not in text.replace("median#", "") and "percentile" not in text


def test_medians_of_skewed_keys(spark):
    r = random.Random(1)
    values = {k: [round(r.gauss(0, 1), 1) for _ in range(n)] for k, n in ((None, 5), ("a", 2000), ("b", 1), ("c", 2))}
    counts = [(k, v, n) for k, vs in values.items() for v, n in collections.Counter(vs).items()] + [("b", None, 9), ("d", None, 1)]
    got = OD.medians(spark.createDataFrame(counts, "k string, value double, n long"), ["k"]).collect()
    assert {r["k"]: r["median"] for r in got} == pytest.approx({k: statistics.median(v) for k, v in values.items()})


def test_running_sums(spark):
    rows = [(k, v, (k * 7 + v) % 5) for k in range(6) for v in range(40)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, v int, n long").repartition(5)
    out = OD.running_sums(df, ["k", "v"], ["n"])
    before, want = 0, {}
    for k, v, n in sorted(rows):
        want[k, v] = before
        before += n
    assert {(r["k"], r["v"]): r["n_before"] for r in out.collect()} == want
    assert OD.running_sums(df.limit(0), ["k"], ["n"]).collect() == []


def test_auc_of_scores_that_cluster(spark):
    r = random.Random(9)
    data = [(r.randint(0, 1), 0.5 + r.randint(0, 400) / 400_000) for _ in range(1500)] + [(0, 0.0), (1, 1.0), (1, None)]
    scored = [(y, s) for y, s in data if s is not None]
    below = sum((a > b) + 0.5 * (a == b) for y, a in scored if y for z, b in scored if not z)
    n = [sum(y == k for y, _ in scored) for k in (0, 1)]
    df = spark.createDataFrame(scored, "label int, score double")
    assert ST.roc_auc(df).first().roc_auc == round(below / (n[0] * n[1]), 4)
    weighted = df.groupBy("label", "score").agg(F.count(F.lit(1)).alias("n"))
    assert ST.roc_auc(weighted, weight="n").first() == ST.roc_auc(df).first()
    assert ST.roc_auc(df.limit(0)).first().roc_auc is None


def test_gini_by_brute_force(spark):
    r = random.Random(3)
    counts = [r.choice([1, 1, 1, 2, 5, 90]) for _ in range(400)]
    n, total = len(counts), sum(counts)
    want = 2 * sum(i * c for i, c in enumerate(sorted(counts), 1)) / (n * total) - (n + 1) / n
    df = spark.createDataFrame([(c,) for c in counts], "count long")
    assert tuple(ST.gini(df).first()) == (round(want, 4), n)


def test_report_from_counts_equals_report_from_rows(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(r.randint(0, 1), r.randint(0, 1)) for _ in range(200)], "label int, pred int")
    counted = df.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))
    key = lambda x: [str(v) for v in x]
    assert sorted(ST.classification_report(counted, weight="n").collect(), key=key) == sorted(ST.classification_report(df).collect(), key=key)


def split_by_hand(rows, fraction=C.TEST_FRACTION):
    test = set()
    for label in {r[1] for r in rows}:
        group = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, c in rows if c == label)
        test |= {i for _, i in group[:math.ceil(round(fraction * len(group), 9))]}
    return test


@pytest.mark.parametrize("few", [10_000, 3, 1])
def test_split_membership_by_hand_at_any_refinement(spark, monkeypatch, few):
    monkeypatch.setattr(ML, "SPLIT_FEW", few)
    monkeypatch.setattr(ML, "SPLIT_DIGITS", 1)
    rows = [(i, "Graduate" if i % 3 else "Dropout") for i in range(1, 700)] + [(5000, "single"), (5001, None), (5002, None)]
    df = spark.createDataFrame(rows, "record_id long, outcome string")
    out = ML.stratified_split(df)
    assert {r.record_id for r in out.where("is_test").collect()} == split_by_hand(rows)
    assert out.count() == len(rows)
    assert "Window" not in plan(out) and "Join" not in plan(out)


def test_split_where_an_id_repeats_at_the_boundary(spark):
    for repeated in range(10):
        rows = [(i, "a") for i in range(10)] + [(repeated, "a")] * 5
        out = ML.stratified_split(spark.createDataFrame(rows, "record_id long, outcome string"))
        assert out.where("is_test").count() == 3 and out.count() == 15


def test_split_of_no_rows(spark):
    assert ML.stratified_split(spark.createDataFrame([], "record_id long, outcome string")).collect() == []


def test_site_profile_uses_registrations_where_a_site_has_no_records(spark):
    demo = spark.createDataFrame([("s1", "a", 20, "Male"), ("s1", "b", 30, "Female"), ("s1", "b", None, None)], "site string, course string, age int, sex string")
    regs = spark.createDataFrame([("s1", "z"), ("s2", "y"), ("s2", "x"), ("s2", "y"), (None, "x")], "site string, course string")
    got = {r.site: tuple(r)[1:] for r in ST.site_profile(demo, regs).collect()}
    assert got == {"s1": (3, 1, 1, 1, 25.0, "b"), "s2": (3, 3, 0, 0, None, "y")}
    assert {r.site: r.registration_event_count for r in ST.site_profile(demo).collect()} == {"s1": 3}
    assert ST.by_presence(demo.limit(0), regs, "site").count() == regs.count()


def test_an_unknown_category_is_an_error(spark):
    rows = [(i, "s%d" % (i % 3), "c", 20 + i % 5, *["u"] * 6, "Graduate" if i % 2 else "Dropout") for i in range(40)]
    schema = "record_id long, site string, course string, age int, sex string, education string, employment string, skill string, career string, classification string, outcome string"
    df = spark.createDataFrame(rows, schema)
    indexed = ML.indexers().fit(df)
    assert indexed.transform(df).count() == 40
    with pytest.raises(Exception, match="[Uu]nseen label"):
        indexed.transform(df.withColumn("site", F.lit("elsewhere"))).select("site_idx").collect()


def test_learners_are_stored_once_for_each_state_of_their_files(spark, tmp_path, monkeypatch):
    schema = "record_id long, site string, course string, age int, sex string, education string, employment string, skill string, career string, classification string, outcome string"
    rows = [(i, "s", "c", 20, *["u"] * 6, "Graduate") for i in range(5)]
    path = str(tmp_path / "l")
    spark.createDataFrame(rows, schema).write.parquet(path)
    first, stamp = ML.stored_learners(spark, spark.read.parquet(path), f"t:{path}")
    monkeypatch.setattr(ML, "write_version", lambda *_: pytest.fail("written again"))
    again, same = ML.stored_learners(spark, spark.read.parquet(path), f"t:{path}")
    assert same == stamp and again.inputFiles() == first.inputFiles() and first.count() == 5
    monkeypatch.undo()
    spark.createDataFrame(rows[:1], schema).write.mode("append").parquet(path)
    more, other = ML.stored_learners(spark, spark.read.parquet(path), f"t:{path}")
    assert other != stamp and more.count() == 6


def test_the_forest_is_grown_in_parts_that_bound_what_is_kept_of_a_row(spark, monkeypatch):
    monkeypatch.setattr(ML.C, "FOREST_TREES", 6)
    monkeypatch.setattr(ML.C, "FOREST_PART_TREES", 2)
    monkeypatch.setattr(ML.C, "FOREST_BAG_COUNTS", 300)
    assert [ML.part_trees(n) for n in (0, 50, 99, 100, 10**9)] == [6, 6, 3, 3, 2]
    grown = ML.forests(part=2)
    assert not any(f.getCacheNodeIds() for f in grown) and len({f.getSeed() for f in grown}) == len(grown) == 3
    rows = [(i, "s%d" % (i % 3), "c%d" % (i % 5), 20 + i % 7, *["u%d" % (i % 2)] * 6, "Graduate" if i % 3 else "Dropout") for i in range(400)]
    schema = "record_id long, site string, course string, age int, sex string, education string, employment string, skill string, career string, classification string, outcome string"
    ctx = ML.ModelContext(spark, spark.createDataFrame(rows, schema), "parts")
    parts = ML.forest_parts(ctx.model)
    assert [f.getNumTrees for f in parts] == [2, 2, 2] and parts[0].trees[0].toDebugString != parts[1].trees[0].toDebugString
    raw = ctx.model.transform(ctx.learners).orderBy("record_id").collect()
    for one, r in zip(ML.predicted(ctx.model, ctx.learners).orderBy("record_id").collect(), raw, strict=True):
        mean = [sum(r[f"probability_{i}"][k] for i in range(3)) / 3 for k in (0, 1)]
        assert one.probability == pytest.approx(mean) and one.prediction == float(mean[1] > mean[0])
    assert ctx.winners().count() == 5
    row = ctx.metadata().first()
    assert (row.num_trees, row.seed, row.n_train) == (6, ML.C.FOREST_SEED, 319)
    assert sum(r.importance for r in ctx.importance().collect()) == pytest.approx(1, abs=1e-4)


def test_the_learner_view_is_written_in_pieces_whose_shuffles_are_deleted(spark, monkeypatch):
    from planwell.plans import catalog_ml as CM
    from planwell.session import CLEANUP_CONF
    from planwell.sources import tables as T
    sf = "/root/testdata/sf0.001"
    whole = T.learners(spark, sf)
    pieces = [T.learners(spark, sf, (i, 3)) for i in range(3)]
    assert all(p.count() for p in pieces)
    assert (ML.piece_count(whole), ML.piece_count(spark.createDataFrame([(1,)], "x int"))) == (1, 1)
    monkeypatch.setattr(ML.C, "LEARNER_PIECE_BYTES", 1000)
    assert ML.piece_count(whole) == ML.C.LEARNER_PIECES
    monkeypatch.setattr(ML.C, "LEARNER_PIECES", 3)
    written = []
    keep = ML.write_version

    def write(tables, root):
        assert spark.conf.get(CLEANUP_CONF) == "true"
        written.append(len(tables))
        return keep(tables, root)

    monkeypatch.setattr(ML, "write_version", write)
    monkeypatch.setattr(ML, "train_or_load", lambda *_: None)
    monkeypatch.setattr(ML, "model_dir", lambda *_: pytest.fail("not asked for"))
    monkeypatch.setattr(ML, "ensure_checkpoint_dir", lambda s, root=ML.ensure_checkpoint_dir(spark): f"{root}/pieces")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = CM.Context(spark, sf).learners
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written == [3] and spark.conf.get(CLEANUP_CONF) == "false"
    rows = ML.clean_features(whole)
    assert stored.count() == rows.count() and stored.exceptAll(rows).isEmpty()


def test_rows_of_the_forest_lie_in_order_of_content(spark, monkeypatch):
    seen = []
    keep = ML.checkpoint

    def look(df, *a):
        if "label" in df.columns:
            seen.append([[tuple(r) for r in p] for p in df.rdd.glom().collect()])
        return keep(df, *a)

    monkeypatch.setattr(ML, "checkpoint", look)
    monkeypatch.setattr(ML.C, "FOREST_TREES", 2)
    rows = [(i, "s%d" % (i % 3), "c%d" % (i * 7 % 5), 20 + i * 5 % 7, *["u%d" % (i % 2)] * 6, "Graduate" if i % 3 else "Dropout") for i in range(400)]
    schema = "record_id long, site string, course string, age int, sex string, education string, employment string, skill string, career string, classification string, outcome string"
    model = ML.train_or_load(spark, spark.createDataFrame(rows, schema), "ordered rows")
    assert sum(f.getNumTrees for f in ML.forest_parts(model)) == 2
    label = len(ML.IDX) + 1
    [parts] = seen
    assert sum(map(len, parts)) == 319
    assert all([r[label] for r in p] == sorted(r[label] for r in p) for p in parts) and any(len({r[label] for r in p}) == 2 for p in parts)
