import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alleleflow.functions.ordered import exact_median, hash_rank, prefix_sums, site_rank
from alleleflow.operators import metrics as mt
from alleleflow.operators import protocol as pr


def frame(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")


def brute_auc(y, p):
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    return np.mean([[(a > b) + .5 * (a == b) for b in neg] for a in pos])


def test_auc_with_ties_and_hot_score(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    p = np.where(rng.random(400) < .4, .5, np.round(rng.random(400), 2))
    df = frame(spark, y, p)
    want = brute_auc(y, p)
    assert mt.roc_auc(df).collect()[0][0] == pytest.approx(want)
    # results do not depend on where the buckets are cut
    for splits in ([], [0.5], [0.1, 0.2, 0.5, 0.9]):
        assert mt.roc_auc(df, splits=splits).collect()[0][0] == pytest.approx(want)
    assert mt.roc_auc(frame(spark, [1, 1], [.1, .2])).collect()[0][0] is None


def test_auc_agrees_with_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    e = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0)
    df = frame(spark, y, p)
    assert mt.roc_auc(df).collect()[0][0] == pytest.approx(e.evaluate(df))


def test_calibration_edges(spark):
    df = frame(spark, [0, 0, 1, 1], [0, .1, .95, 1.0])
    bins = {r["bin"]: r["n"] for r in mt.calibration_bins(df).collect()}
    assert bins == {0: 1, 1: 1, 9: 2}
    assert mt.calibration_error(df).collect()[0][0] == pytest.approx((.1 + 2 * .025) / 4)
    assert mt.brier_score(df).collect()[0][0] == pytest.approx((.01 + .0025) / 4)


def test_calibration_edges_are_those_of_even_steps(spark):
    p = [i / 10 for i in range(11)] + [np.nextafter(i * 0.1, d) for i in range(1, 10) for d in (0, 1)]
    edges = np.linspace(0, 1, 11)
    want = [min(int((edges <= x).sum()) - 1, 9) for x in p]
    got = mt.calibration_bins(frame(spark, [0] * len(p), p)).collect()
    assert {r["bin"]: r["n"] for r in got} == {b: want.count(b) for b in set(want)} and want[3] == 2


def test_poisson_weights_are_not_cut(spark):
    from alleleflow.functions.exprs import poisson_one
    step = 2.0 ** -32
    got = [r[0] for r in spark.createDataFrame([(0.0,), (0.5,), (1 - 1000 * step,), (1 - step,)], "u double").select(poisson_one(F.col("u"))).collect()]
    mass = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(20)])
    assert got == [int((u > mass).sum()) for u in (0.0, 0.5, 1 - 1000 * step, 1 - step)] and got[-1] > 9


def test_prefix_sums_per_key(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 300), rng.integers(0, 40, 300))]
    df = spark.createDataFrame(rows, "k int, v double")
    got = prefix_sums(df, "v", {"n": F.count(F.lit(1))}, ["k"], n_splits=8).collect()
    assert len(got) == len(set(rows))
    for r in got:
        same = [v for k, v in rows if k == r["k"]]
        assert r["n"] == same.count(r["v"]) and r["n_total"] == len(same)
        assert r["n_below"] == sum(v < r["v"] for v in same)
    med = {r["k"]: r["median"] for r in exact_median(df, "v", ["k"]).collect()}
    for k in range(3):
        assert med[k] == np.median([v for q, v in rows if q == k])


def test_ranks(spark):
    df = spark.createDataFrame([(f"c{i % 2}", (i * 37) % 101) for i in range(101)],
                               "chrom string, pos long")
    for r in site_rank(df, bin_size=9).collect():
        assert r["rank"] == sum(c == r["chrom"] and p <= r["pos"]
                                for c, p in [(f"c{i % 2}", (i * 37) % 101) for i in range(101)])
    h = df.withColumn("h", F.md5(F.concat("chrom", F.col("pos").cast("string"))))
    ordered = [r["h"] for r in hash_rank(h, "h").orderBy("rank").collect()]
    assert ordered == sorted(ordered)
    assert [r["h"] for r in hash_rank(h, "h", limit=10).orderBy("rank").collect()] == ordered[:10]


def test_spearman_and_relative_error(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, 150).astype(float), rng.integers(0, 9, 150).astype(float)
    y = y + x

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    assert mt.spearman(df, "x", "y").collect()[0]["spearman"] == pytest.approx(
        np.corrcoef(ranks(x), ranks(y))[0, 1])
    logs = df.selectExpr("'a' AS band", "-x / 3 AS t", "-y / 6 AS p")
    t, p = 10 ** (-x / 3), 10 ** (-y / 6)
    r = mt.relative_error(logs, "p", "t").collect()[0]
    assert r["mean_relative_error"] == pytest.approx(np.mean(abs(p - t) / t))
    assert r["median_relative_error"] == pytest.approx(np.median(abs(p - t) / t))
    pct = mt.relative_error(logs, "p", "t", floor=1e-8).collect()[0]
    assert pct["mean_relative_error"] == pytest.approx(100 * np.mean(abs(p - t) / t))


def test_confusion_and_f1(spark):
    rows = [("A", "A", 4), ("A", "B", 1), ("B", "A", 2), ("B", "B", 3), ("C", "A", 5)]
    cm = spark.createDataFrame(rows, "truth string, predicted string, n long")
    pairs = {(r["first"], r["second"]): r["n"] for r in mt.pair_confusion(cm).collect()}
    assert pairs == {("A", "B"): 3, ("A", "C"): 5}
    assert mt.macro_f1(cm, "ABC").collect()[0][0] == pytest.approx((8 / 16 + 6 / 9 + 0) / 3)


def test_selective_accuracy_improves(spark):
    rows = [("all", "A", "A" if i >= 5 else "B", i / 20) for i in range(20)]
    df = spark.createDataFrame(rows, "band string, direction string, call string, confidence double")
    got = {r["dropped"]: (r["accuracy"], r["n_kept"]) for r in mt.selective_accuracy(df).collect()}
    assert got == {0.0: (0.75, 20), 0.25: (1.0, 15), 0.5: (1.0, 10)}


def test_bootstrap_covers_the_mean(spark):
    df = spark.createDataFrame([("all", i, int(i % 4 != 0)) for i in range(200)],
                               "band string, replicate int, hit int")
    r = mt.bootstrap_interval(df).collect()[0]
    assert r["low"] < .75 < r["high"] and r["high"] - r["low"] < .2
    assert r["mean"] == pytest.approx(.75, abs=.02)


def test_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(g, r) for g in range(23) for r in range(3)],
                               "replicate int, g int")
    folds = pr.group_folds(df, k=5, seeds=(0, 1)).collect()
    for s in (0, 1):
        sizes = np.bincount([r["fold"] for r in folds if r["seed"] == s])
        assert len(sizes) == 5 and sizes.max() - sizes.min() <= 1 and sizes.sum() == 23
    w = pr.with_folds(df, k=5, seeds=(0, 1))
    assert w.count() == 69
    assert w.groupBy("replicate").agg(F.count_distinct("fold_0").alias("n")).where("n > 1").count() == 0


def test_bands_calls_and_gate(spark):
    rows = [(5e-7, "A"), (2.5e-4, "B"), (1e-3, "C"), (0.0, "D"), (1e-5, "A")]
    df = spark.createDataFrame(rows, "magnitude double, direction string")
    n = {r["band"]: r["count"] for r in pr.rate_bands(df).groupBy("band").count().collect()}
    assert n == {"5.0e-07": 1, "2.5e-04": 1, "appreciable": 2, "overall": 5}
    assert sorted(map(tuple, pr.gate_rows(df).select("direction", "y").collect())) == [
        ("B", 1), ("C", 1), ("D", 0)]
    assert pr.gate_rows(df, "all").count() == 5
    p = spark.createDataFrame([(.4, .4, .2, .9), (.1, .2, .7, .2)],
                              "p_A double, p_B double, p_C double, gate double")
    assert [r["call"] for r in pr.gated_call(p, ["p_A", "p_B", "p_C"]).collect()] == ["A", None]


def test_leakage_formula(spark):
    df = spark.createDataFrame([(r, g) for r in range(60) for g in range(6)],
                               "replicate int, g int")
    r = pr.leakage_audit(df).collect()[0]
    assert r["expected"] == pytest.approx(1 - .8 ** 6 - .2 ** 6)
    assert abs(r["shared"] - r["expected"]) < .2 and r["n_groups"] == 60


def test_feature_shift_and_histogram(spark):
    t = spark.createDataFrame([(float(i), 2.0 * i, 1.0) for i in range(10)],
                              "a double, b double, c double")
    r = t.selectExpr("a + 5 AS a", "b", "c")
    sd = np.std(np.arange(10))
    z = mt.feature_shift(r, t, ["a", "b", "c"]).collect()[0]
    assert z["median_shift"] == pytest.approx(np.median([5 / sd, 0])) and z["n_features"] == 2
    h = {x["bin"]: x["n"] for x in mt.histogram(t, "a", 3).collect()}
    assert h == {0: 3, 1: 3, 2: 4}
    assert math.isclose(sum(h.values()), 10)
