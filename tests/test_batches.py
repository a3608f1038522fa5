"""Stored states: batches pooled equal all rows at once."""

import numpy as np
import pytest

from alleleflow.functions.session import shared_path
from alleleflow.operators import metrics as mt
from alleleflow.operators import rarefaction as rf
from alleleflow.plans import batches as bt


def test_moments_pool(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i % 2, *map(int, rng.integers(2, 9, 6))) for i in range(60)], "k int, c1_1 int, c1_2 int, c1_3 int, c2_1 int, c2_2 int, c2_3 int")
    path = shared_path(spark, "test")
    first, second = df.where("c1_1 > 5"), df.where("c1_1 <= 5")
    bt.add_batch(bt.moment_state(first, keys=["k"]), path, "a")
    before = bt.pooled_matrix(spark, path, ["k"]).count()
    bt.add_batch(bt.moment_state(second, keys=["k"]), path, "b")

    def rows(x):
        return {(r["k"], r["g"]): [v for v in r] for r in x.collect()}
    got, want = rows(bt.pooled_matrix(spark, path, ["k"])), rows(rf.feature_matrix(df, keys=["k"]))
    assert set(got) == set(want) and before > 0
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    one = rows(bt.pooled_matrix(spark, path, ["k"], ["a"]))
    assert all(one[k] == pytest.approx(v, abs=1e-9) for k, v in rows(rf.feature_matrix(first, keys=["k"])).items())
    with pytest.raises(Exception, match="(?i)exist"):
        bt.add_batch(bt.moment_state(second, keys=["k"]), path, "b")


def test_scores_pool(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < p).astype(int)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))] + [(400, 1, None), (401, None, 0.5)], "i int, y int, p double")
    path = shared_path(spark, "test")
    for k in range(3):
        bt.add_batch(bt.score_state(df.where(f"i % 3 = {k}")), path, str(k))
    got = bt.score_metrics(bt.pooled(spark, path, ["p"])).first()
    known = df.na.drop()
    assert got["n"] == 400
    assert got["auc"] == pytest.approx(mt.roc_auc(known).first()["auc"])
    assert got["ece"] == pytest.approx(mt.calibration_error(known).first()["ece"])
    assert got["brier"] == pytest.approx(mt.brier_score(known).first()["brier"])
