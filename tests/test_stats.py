"""Distributions, modes, bins, AUC, Gini and the exact stratified split on small frames."""

import itertools
import random

from pyspark.sql import functions as F

from planwell.operators import ml as ML, stats as ST


def test_distribution_keeps_nulls_in_denominator(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    rows = {r.label: (r["count"], r.percentage) for r in ST.distribution(df, ["x"]).collect()}
    assert rows == {"a": (2, 50.0), "b": (1, 25.0)}


def test_top_n_and_tie_order(spark):
    df = spark.createDataFrame([(v,) for v in "ccbbaad"], "x string")
    rows = ST.distribution(df, ["x"], {"x": 2}).orderBy("rank").collect()
    assert [r.label for r in rows] == ["a", "b"]


def test_age_bins_include_zero_and_empty_bins(spark):
    df = spark.createDataFrame([(0,), (17,), (18,), (54,), (55,), (201,), (None,)], "age int")
    rows = ST.age_distribution(df).orderBy("ord").collect()
    assert [(r.label, r["count"]) for r in rows] == [
        ("Under 18", 2), ("18-24", 1), ("25-34", 0), ("35-44", 0), ("45-54", 1), ("55+", 1)]
    assert rows[0].percentage == round(2 / 7 * 100, 1)


def test_profile_mode_smallest_on_ties_and_truncated_median(spark):
    rows = [("c", a, s, "e", "m", "k", "r", "l") for a, s in ((20, "F"), (21, "M"), (30, "M"), (31, "F"))]
    df = spark.createDataFrame(rows, "course string, age int, sex string, education string, employment string,"
                                     " skill string, career string, classification string")
    r = ST.representative_profile(df).first()
    assert r.sex == "F" and r.age == 25


def test_auc_matches_pairwise_count(spark):
    rnd = random.Random(5)
    data = [(rnd.randint(0, 1), float(rnd.randint(0, 20)) / 10) for _ in range(300)]
    pos = [s for l, s in data if l == 1]
    neg = [s for l, s in data if l == 0]
    num = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    df = spark.createDataFrame(data, "label int, score double")
    got = ST.roc_auc(df).first().roc_auc
    assert got == round(num / (len(pos) * len(neg)), 4)
    one = spark.createDataFrame([(1, 0.3), (1, 0.4)], "label int, score double")
    assert ST.roc_auc(one).first().roc_auc is None


def test_gini(spark):
    counts = spark.createDataFrame([(1,), (1,), (2,), (4,)], "count long")
    # sorted 1,1,2,4: 2*(1+2+6+16)/(4*8) - 5/4
    assert ST.gini(counts).first().gini == round(2 * 25 / 32 - 5 / 4, 4)


def test_stratified_split_is_exact_and_stable(spark):
    rows = [(i, "Graduate" if i % 3 else "Dropout") for i in range(1, 2001)]
    df = spark.createDataFrame(rows, "record_id long, outcome string")
    s = ML.stratified_split(df)
    got = {r.outcome: (r.n, r.t) for r in s.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert got == {"Graduate": (1334, 267), "Dropout": (666, 134)}
    again = ML.stratified_split(df.repartition(7)).where("is_test").select("record_id")
    assert again.exceptAll(s.where("is_test").select("record_id")).count() == 0


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "outcome string")
    w = {r.outcome: r.weight for r in ML.class_weights(df).collect()}
    assert w == {"a": 4 / 6, "b": 2.0}


def test_fingerprint_is_order_independent_and_sensitive(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, v string")
    b = spark.createDataFrame([(3, "z"), (1, "x"), (2, "y")], "k long, v string").repartition(3)
    c = spark.createDataFrame([(1, "x"), (2, "y"), (3, "w")], "k long, v string")
    assert ML.fingerprint(a) == ML.fingerprint(b) != ML.fingerprint(c)
