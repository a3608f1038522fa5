import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from alleleflow.operators import heads as hd
from alleleflow.operators import kernel as kn
from alleleflow.operators import protocol as pr
from alleleflow.plans import analyses as an
from alleleflow.plans.contract import CLASSES, FEATURES, STATISTICS


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    n = 240
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) + np.eye(3, 4)[y] * 1.5
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    df = spark.createDataFrame([(i // 3, "ABC"[b], *map(float, a)) for i, (a, b) in
                                enumerate(zip(x, y))],
                               "replicate int, y string, x0 double, x1 double, x2 double, x3 double")
    return pr.with_folds(df, "replicate", 4, (0, 1)).repartition(3).persist()


X = ["x0", "x1", "x2", "x3"]


def objective_gradient(x, onehot, coef, intercept, mean, sd, c=1.0):
    z = (x - mean) / sd
    w = coef * sd
    b = intercept + coef @ mean
    s = z @ w.T + b
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return (p - onehot).T @ z + w / c, (p - onehot).sum(0)


def test_logistic_reaches_the_optimum(rows, data):
    x, y = data
    h = hd.fit_logistic(rows, X, "y", CLASSES)
    gw, gb = objective_gradient(x, np.eye(3)[y], h.coef, h.intercept, x.mean(0), x.std(0))
    assert np.abs(gw).max() < 1e-4 and np.abs(gb).max() < 1e-4


def mllib(rows, y, x):
    """MLlib's coefficients for standardised features; its penalty is on the mean loss."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    mean, sd = x.mean(0), x.std(0)
    z = rows.select(y.cast("double").alias("_y"), *[((F.col(c) - float(m)) / float(d)).alias(c)
                                                    for c, m, d in zip(X, mean, sd)])
    model = LogisticRegression(
        featuresCol="_x", labelCol="_y", maxIter=400, tol=1e-8, regParam=1 / len(x),
        standardization=False).fit(VectorAssembler(inputCols=X, outputCol="_x").transform(z))
    w = model.coefficientMatrix.toArray() / sd
    return w, np.array(model.interceptVector.toArray()) - w @ mean


def test_newton_agrees_with_mllib(rows, data):
    x, _ = data
    a = hd.fit_logistic(rows, X, "y", CLASSES)
    w, _ = mllib(rows, F.coalesce(*[F.when(F.col("y") == c, F.lit(i)) for i, c in enumerate(CLASSES)]), x)
    assert np.abs(a.coef - w).max() < 1e-3 and a.meta["converged"]
    y = (F.col("y") == "A").cast("int")
    a = hd.fit_logistic(rows.withColumn("t", y), X, "t")
    w, b = mllib(rows, y, x)
    assert np.abs(a.coef - w).max() < 1e-3 and abs(a.intercept - b).max() < 1e-3


def test_newton_tells_when_it_ends_early(rows):
    assert not hd.fit_logistic(rows, X, "y", CLASSES, max_iter=1).meta["converged"]


def test_folds_fitted_together_equal_single_fits(rows):
    heads = hd.logistic_by_fold(rows, X, "y", CLASSES, (0, 1), 4)
    assert len(heads) == 8
    one = hd.fit_logistic(rows.where("fold_1 <> 2"), X, "y", CLASSES)
    assert np.abs(heads[(1, 2)].coef - one.coef).max() < 1e-5
    scored = hd.apply_by_fold(hd.explode_seeds(rows, (0, 1)), heads)
    assert scored.count() == 480
    single = {(r["replicate"], r["x0"]): r["p_B"] for r in
              heads[(1, 2)].apply(rows.where("fold_1 = 2")).collect()}
    for r in scored.where("seed = 1 AND fold = 2").collect():
        assert r["p_B"] == pytest.approx(single[(r["replicate"], r["x0"])])
        assert r["p_A"] + r["p_B"] + r["p_C"] == pytest.approx(1)


def test_moments(rows, data):
    x, y = data
    m = hd.collect_moments(hd.moment_sums(rows, X, ["y"]), ["y"], 5)
    z = np.column_stack([np.ones(len(x)), x])
    for i, c in enumerate("ABC"):
        assert m[(c,)] == pytest.approx(z[y == i].T @ z[y == i])
    held = hd.collect_moments(hd.moment_sums(rows, X, ["y"], (0, 1)), ["seed", "fold", "y"], 5)
    train = hd.leave_fold_out(held)[(1, 3)]
    direct = hd.collect_moments(hd.moment_sums(rows.where("fold_1 <> 3"), X, ["y"]), ["y"], 5)
    for c in "ABC":
        assert train[c] == pytest.approx(direct[(c,)])


def test_discriminant_closed_form(rows, data):
    x, y = data
    m = hd.collect_moments(hd.moment_sums(rows, X, ["y"]), ["y"], 5)
    h = hd.discriminant_from_moments({k[0]: v for k, v in m.items()}, X)
    mu = np.array([x[y == i].mean(0) for i in range(3)])
    prior = np.bincount(y) / len(y)
    s = sum((x[y == i] - mu[i]).T @ (x[y == i] - mu[i]) for i in range(3)) / (len(x) - 3)
    score = x @ np.linalg.solve(s, mu.T) - .5 * np.einsum(
        "ij,ij->i", mu @ np.linalg.inv(s), mu) + np.log(prior)
    p = np.exp(score)
    p /= p.sum(1, keepdims=True)
    got = {r["x0"]: r["p_C"] for r in h.apply(rows).collect()}
    assert [got[v] for v in x[:, 0]] == pytest.approx(p[:, 2].tolist())


def test_ridge_closed_form(rows, data):
    x, _ = data
    df = rows.withColumn("t", F.expr("x0 * 2 - x1 + 0.3 * x2 * x3"))
    t = x[:, 0] * 2 - x[:, 1] + .3 * x[:, 2] * x[:, 3]
    m = hd.collect_moments(hd.moment_sums(df.withColumn("o", F.lit(1)), [*X, "t"], ["o"]), ["o"], 6)
    h = hd.ridge_from_moments(m[(1,)], X)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(4), z.T @ ((t - t.mean()) / t.std()))
    want = z @ w * t.std() + t.mean()
    got = {r["x0"]: r["p_log_rate"] for r in h.apply(rows).collect()}
    assert [got[v] for v in x[:, 0]] == pytest.approx(want.tolist())


def test_pca_and_standardise(rows, data):
    x, _ = data
    z = (x - x.mean(0)) / x.std(0)
    _, s, _ = np.linalg.svd(z, full_matrices=False)
    p = np.array([[r["pc_1"], r["pc_2"]] for r in hd.pca_projection(rows, X).collect()])
    assert (p ** 2).sum(0) == pytest.approx(s[:2] ** 2)
    c = rows.withColumn("k", F.lit(3.0))
    r = hd.standardise(c, c.withColumn("k", F.lit(4.5)), [*X, "k"])
    assert r.agg(F.avg("x1")).collect()[0][0] == pytest.approx(0, abs=1e-12)
    assert r.select("k").first()[0] == pytest.approx(1.5)        # constant: scale 1


def test_separation_table(data, rows):
    m = hd.collect_moments(hd.moment_sums(rows, X, ["y"]), ["y"], 5)
    t = hd.separation_table({k[0]: v for k, v in m.items()}, "C")
    assert [(r["first"], r["second"]) for r in t] == [("A", "C"), ("B", "C"), ("A", "B")]
    assert all(0 < r["predicted_error"] < .5 for r in t)


def test_landmarks(spark, data):
    x, _ = data
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)],
                               "id int, v array<double>")
    marks = hd.landmark_rows(df, "v", "id", 8)
    s = hd.landmark_spread(marks)
    apart = ((marks[:, None] - marks[None]) ** 2).sum(-1)[np.triu_indices(8, 1)]
    assert s == pytest.approx(np.sqrt(apart.mean()))
    got = hd.landmark_similarity(df, "v", marks, s).orderBy("id").collect()
    d = np.sqrt(((x[:, None] - marks[None]) ** 2).sum(-1)) / s
    want = (1 + np.sqrt(5) * d + 5 / 3 * d ** 2) * np.exp(-np.sqrt(5) * d)
    assert np.array([r["similarity"] for r in got]) == pytest.approx(want)
    assert len(hd.landmark_rows(df, "v", "id", 100)) == min(100, len(x))


def test_correction_is_fitted_outside_the_fold(spark, data):
    """Another vector and truth in one fold leave that fold's landmarks, scale and fit alone."""
    x, _ = data
    rows = [(i, i // 2, list(map(float, v)), 0.1, float(v[0])) for i, v in enumerate(x)]
    kind = "id int, replicate int, v array<double>, p double, residual double"

    def run(rows):
        out = kn.residual_correction(spark.createDataFrame(rows, kind), "v", "id", ["p"],
                                     ["residual"], "replicate", n_landmarks=6, standardise=True)
        return {r["id"]: r["corrected_p"] for r in out.collect()}
    from alleleflow.operators.protocol import with_folds
    fold = {r["id"]: r["fold_137"] for r in with_folds(
        spark.createDataFrame(rows, kind), "replicate", 5, [137]).collect()}
    odd = max(i for i, f in fold.items() if f == 2)
    moved = [(i, r, [9 * c for c in v] if i == odd else v, p, 5e3 if i == odd else t)
             for i, r, v, p, t in rows]
    a, b = run(rows), run(moved)
    assert len(a) == len(rows)
    same = [i for i, f in fold.items() if f == 2 and i != odd]
    assert same and all(a[i] == pytest.approx(b[i], rel=1e-9, abs=1e-12) for i in same)
    assert any(abs(a[i] - b[i]) > 1e-6 for i, f in fold.items() if f != 2)


def test_saved_heads_apply_alike(spark, rows):
    h = hd.fit_logistic(rows, X, "y", CLASSES)
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "model")
    hd.save_heads(spark, {"direction": h}, path)
    again = hd.load_heads(spark, path)["direction"]
    a = h.apply(rows).orderBy("x0").first()["p_A"]
    assert again.apply(rows).orderBy("x0").first()["p_A"] == pytest.approx(a, abs=1e-15)


def test_curve_grid(spark):
    df = spark.createDataFrame([(r, g, float(r * g)) for r in range(3) for g in range(2, 12)],
                               "replicate int, g int, s double")
    assert hd.curve_depths(10) == sorted({int(round(v)) for v in np.geomspace(1, 9, 8)})
    c = hd.curve_features(df, ["s"], 8).where("replicate = 2").collect()[0]
    assert c["s_at3"] == 6 and c["s_at11"] == 22 and c["s_curve"] == pytest.approx(13)
    with pytest.raises(ValueError):
        hd.curve_features(df.where("NOT (replicate = 1 AND g = 5)"), ["s"])


# ------------------------------------------------------------------ analyses on separable data

@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(1)
    out = []
    for r in range(60):
        d = "ABCD"[r % 4]
        m = 0.0 if d == "D" else (2.5e-4 if r % 8 < 4 else 1e-3)
        base = rng.normal(size=27) * .3
        base["ABCD".index(d)] += 3
        for g in range(2, 7):
            out.append((r, d, m, g, *map(float, base + rng.normal(size=27) * .05)))
    cols = ", ".join(f"{c} double" for c in STATISTICS)
    return spark.createDataFrame(
        out, f"replicate int, direction string, magnitude double, g int, {cols}").persist()


@pytest.mark.parametrize("head", ["logistic", "discriminant"])
def test_direction_table(features, head):
    t = {r["band"]: r["accuracy"] for r in
         an.direction_table(features, head, (0,), 3).collect()}
    assert t["appreciable"] > 90 and t["overall"] == t["appreciable"] and "5.0e-07" not in t


def test_boosted_head(features):
    t = an.direction_table(features, "boosted", (0,), 3, rounds=10, depth=2, least=5).collect()
    assert {r["band"]: r["accuracy"] for r in t}["overall"] > 90


def test_gate_report(features):
    r = {x["metric"]: x["mean"] for x in an.gate_report(features, seeds=(0,), k=3).collect()}
    assert r["roc_auc_all"] > .95 and r["roc_auc_appreciable"] == r["roc_auc_all"]
    assert 0 <= r["ece"] < .3 and r["brier"] < .15


def test_ablation_heads_agree_on_full_columns(features):
    subsets = {"full": FEATURES, "g": ["g", "alpha_1_mean", "alpha_1_variance", "alpha_1_se"]}
    a = {r["subset"]: r["overall"] for r in
         an.subset_ablation(features, subsets, (0,), 3, "discriminant").collect()}
    b = {r["band"]: r["accuracy"] for r in
         an.direction_table(features, "discriminant", (0,), 3).collect()}
    assert a["full"] == pytest.approx(b["overall"])


def test_depth_requirement_equals_direct_fit(features):
    r = {x["g_max"]: x["appreciable_accuracy"] for x in
         an.depth_requirement(features, (3, 6), (0,), 3).collect()}
    direct = an.direction_table(features.where("g <= 3"), "discriminant", (0,), 3).collect()
    assert r[3] == pytest.approx({x["band"]: x["accuracy"] for x in direct}["appreciable"])
    assert set(r) == {3, 6}


def test_frozen_model_and_batches(features):
    b = an.heldout_batches(features.where("replicate < 32"), {
        "one": features.where("replicate BETWEEN 32 AND 47"),
        "two": features.where("replicate > 47")}, "band").collect()
    v = {(r["batch"], r["metric"]): r["value"] for r in b}
    assert v[("pooled", "accuracy_overall")] > .8
    assert {k[0] for k in v} == {"one", "two", "pooled"}


def test_archaic_counts_by_hand(spark):
    modern = spark.createDataFrame(
        [("1", p, "A", "C", info, s, a, b) for p, info in ((1, "AA=A"), (2, "AA=c|"), (3, "AA=G"),
                                                           (4, "AA=A"), (5, "AA=A"))
         for s, a, b in (("x", 0, 1), ("y", 1, 1), ("z", 0, None), ("w", 1, 1))],
        "chrom string, pos long, ref string, alt string, info string, sample string, a1 int, a2 int")
    samples = spark.createDataFrame([("x", 0, "P1"), ("w", 1, "P1"), ("y", 2, "P2"), ("z", 3, "P3")],
                                    "sample string, sample_idx int, pop string")
    schema = "chrom string, pos long, call_ref string, n1 string, n2 string"
    sets = {"a": spark.createDataFrame([("1", p, "T" if p == 4 else "A", "A", "C")
                                        for p in (1, 2, 3, 4, 5)], schema),
            "b": spark.createDataFrame([("1", p, "A", "C", "C") for p in (1, 2, 3, 4)], schema)}
    # 3: ancestral base fits neither allele; 4: other reference; 5: missing in one call set
    got = an.archaic_counts(modern, samples, sets, ["P1", "P2", "P3"], 1).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [1, 2] and got[1]["aa"] == "C"
    r = got[0]           # w is the second sample of P1 and left out
    assert [r[f"c1_{j}"] for j in (1, 2, 3, 4)] == [1, 0, 1, 1]
    assert [r[f"c2_{j}"] for j in (1, 2, 3, 4)] == [1, 2, 0, 3]


def test_injected_flow_is_reported_per_condition(spark, features):
    rng = np.random.default_rng(2)
    pops = [f"P{1 + s // 8}" for s in range(24)]
    g = spark.createDataFrame([(s, pops[s], loc, *map(int, rng.integers(0, 2, 2)))
                               for s in range(24) for loc in range(15)],
                              "sample int, pop string, locus int, a1 int, a2 int")
    samples = spark.createDataFrame(list(enumerate(pops)), "sample int, pop string")
    model = an.train_frozen(features, cap=100)
    r = an.injection_grid(g, samples, {"B": ("P2", "P3")}, model, (0.1, 0.5), 2, max_depth=5)
    got = {(x["inject"], x["fraction"]): x for x in r.collect()}
    assert set(got) == {("B", 0.1), ("B", 0.5), ("D", 0.0)}
    assert all(x["n"] == 2 and 0 <= x["mean_gate"] <= 1 for x in got.values())
    assert got[("D", 0.0)]["direction_accuracy"] is None
