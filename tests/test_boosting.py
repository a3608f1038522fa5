"""Boosting against a brute-force builder, by passes and in tasks alike; stored trees; array sums."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from alleleflow.functions.arrays import sum_arrays
from alleleflow.functions.session import checkpointed
from alleleflow.operators import boosting as bo
from alleleflow.operators import heads as hd
from alleleflow.operators import protocol as pr
from alleleflow.plans import analyses as an

X = ["x0", "x1", "x2"]
OPTIONS = {"rounds": 4, "depth": 3, "least": 5, "bins": 16, "step": 0.3}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    n = 300
    y = rng.integers(0, 3, n)
    x = np.round(rng.normal(size=(n, 3)) + np.eye(3)[y] * 1.2, 2)
    x[::17, 1] = np.nan
    x[:, 2] = np.round(x[:, 2])                     # many ties
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    df = spark.createDataFrame([(i // 3, "ABC"[b], *map(float, a)) for i, (a, b) in enumerate(zip(x, y))],
                               "replicate int, y string, x0 double, x1 double, x2 double")
    return pr.with_folds(df, "replicate", 3, (0, 1)).repartition(3).persist()


def brute_fit(x, y, edges, step, depth, least, rounds):
    """Trees grown from the rows themselves: every threshold of every node tried in turn."""
    b = bo._binned(x, edges)
    base = np.log(np.bincount(y, minlength=3) / len(y))
    scores, trees = np.tile(base, (len(y), 1)), []

    def grow(tree, node, at, g, h, level):
        best = (1e-9, None)
        if level < depth:
            for f in range(b.shape[1]):
                for cut in range(max(map(len, edges))):
                    left = at[b[at, f] <= cut]
                    right = at[b[at, f] > cut]
                    if min(len(left), len(right)) < least or min(h[left].sum(), h[right].sum()) <= 1e-3:
                        continue
                    gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[at].sum() ** 2 / h[at].sum()
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut, left, right))
        if best[1] is None:
            tree[node] = -step * g[at].sum() / h[at].sum()
            return
        f, cut, left, right = best[1]
        tree[node] = (f, edges[f][min(cut, len(edges[f]) - 1)])
        grow(tree, 2 * node + 1, left, g, h, level + 1)
        grow(tree, 2 * node + 2, right, g, h, level + 1)

    def value(tree, row):
        node = 0
        while isinstance(tree[node], tuple):
            f, edge = tree[node]
            node = 2 * node + (1 if row[f] <= edge else 2)
        return tree[node]

    for _ in range(rounds):
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = []
        for c in range(3):
            tree: dict = {}
            grow(tree, 0, np.arange(len(y)), p[:, c] - (y == c), p[:, c] * (1 - p[:, c]), 0)
            new.append(tree)
        trees.append(new)
        scores = scores + np.array([[value(t, r) for t in new] for r in x])
    return base, trees, value


@pytest.mark.parametrize("one_task", [0, 1000])
def test_equals_brute_force(rows, data, one_task):
    x, y = data
    head = bo.fit_boosted(rows, X, "y", ["A", "B", "C"], one_task=one_task, **OPTIONS)
    edges = bo.quantile_edges(rows, X, OPTIONS["bins"])
    base, trees, value = brute_fit(x, y, edges, OPTIONS["step"], OPTIONS["depth"], OPTIONS["least"], OPTIONS["rounds"])
    want = base + sum(np.array([[value(t, r) for t in new] for r in x]) for new in trees)
    want = np.exp(want) / np.exp(want).sum(1, keepdims=True)
    got = {(r["replicate"], r["x0"], r["x2"]): [r["p_A"], r["p_B"], r["p_C"]] for r in head.apply(rows).collect()}
    for i, r in enumerate(x):
        assert got[(i // 3, r[0], r[2])] == pytest.approx(want[i], abs=1e-9)


def test_passes_and_tasks_grow_the_same_trees(rows):
    folds = [("fold_0", 0), ("fold_0", 1), ("fold_1", 2)]
    a, _ = bo.boost(rows, X, "y", ["A", "B", "C"], folds, one_task=1000, **OPTIONS)
    b, _ = bo.boost(rows, X, "y", ["A", "B", "C"], folds, one_task=0, renew=3, **OPTIONS)
    for one, two in zip(a, b):
        assert [[t[0].tolist() for t in c] for c in one.trees] == [[t[0].tolist() for t in c] for c in two.trees]
        assert np.allclose([[t[2] for t in c] for c in one.trees], [[t[2] for t in c] for c in two.trees], atol=1e-9)


def test_folds_together_equal_single_fits(rows):
    preds = bo.boosted_out_of_fold(rows, X, "y", ["A", "B", "C"], (0, 1), 3, **OPTIONS).collect()
    assert len(preds) == 2 * rows.count()
    heads, _ = bo.boost(rows, X, "y", ["A", "B", "C"], [("fold_1", 2)], **OPTIONS)
    own = heads[0].apply(rows.where("fold_1 = 2")).select("replicate", "p_A").collect()
    got = sorted((r["replicate"], round(r["p_A"], 9)) for r in preds if r["seed"] == 1 and r["fold"] == 2)
    assert got == sorted((r["replicate"], round(r["p_A"], 9)) for r in own)


def test_saved_trees_apply_alike(spark, rows):
    head = bo.fit_boosted(rows, X, "y", ["A", "B", "C"], **OPTIONS)
    linear = hd.fit_logistic(rows.na.fill(0.0), X, "y", ["A", "B", "C"])
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "model")
    an.save_frozen(spark, {"direction": linear, "boosted": head}, path)
    again = an.load_frozen(spark, path, ["boosted"])
    assert set(again) == {"direction", "boosted"}

    def scores(h):
        return sorted(map(tuple, h.apply(rows).select("replicate", "x0", "p_A", "p_B", "p_C").collect()))
    assert scores(again["boosted"]) == scores(head)
    plan = again["boosted"].apply(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_a_single_class_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, None, "A")] * 40 + [(1.0, None, "B")] * 20, "x0 double, x1 double, y string")
    head = bo.fit_boosted(df, ["x0", "x1"], "y", ["A", "B"], rounds=2)
    assert head.apply(df).first()["p_A"] == pytest.approx(2 / 3, abs=1e-9)


def test_arrays_are_summed_in_levels(spark):
    df = spark.range(0, 500, 1, 40).selectExpr("id % 3 AS k", "array(double(id), 1D) AS v")
    got = {r["k"]: r["v"] for r in sum_arrays(df, ["k"], "v").collect()}
    assert got == {k: [float(sum(range(k, 500, 3))), float(len(range(k, 500, 3)))] for k in range(3)}


def test_matrices_are_not_taken_apart(rows):
    clean = checkpointed(rows.na.fill(0.0))
    plan = hd.moment_sums(clean, X, ["y"], (0, 1))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan
    # one row per fit and class reaches the driver
    assert hd.moment_sums(clean, X, ["y"], (0, 1)).count() == 2 * 3 * 3
    long = hd.moment_entries(hd.moment_sums(clean, X, ["y"]), ["y"], 4)
    direct = clean.groupBy("y").agg(F.sum(F.col("x0") * F.col("x2")).alias("v")).collect()
    got = {r["y"]: r["value"] for r in long.where("i = 1 AND j = 3").collect()}
    assert got == pytest.approx({r["y"]: r["v"] for r in direct})


def test_a_pass_is_one_job_and_many_histograms_are_added_on_the_way(spark, rows, monkeypatch):
    """A level of all trees costs one job; beyond `direct` bytes one array per tree reaches the driver."""
    calls, counted = [], bo._histograms

    def spy(blocks, fit, growing, wanted, level):
        group = f"level-{len(calls)}"
        spark.sparkContext.setJobGroup(group, group)
        one = counted(blocks, fit, growing, wanted, level)
        spark.sparkContext.setJobGroup("after", "after")
        two = counted(blocks, fit, growing, wanted, level, direct=0)
        assert one.keys() == two.keys() and all(np.allclose(one[t], two[t]) for t in one)
        calls.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        return one
    monkeypatch.setattr(bo, "_histograms", spy)
    bo.boost(rows, X, "y", ["A", "B", "C"], [("fold_0", 0), ("fold_1", 2)], one_task=0, **OPTIONS)
    assert len(calls) == OPTIONS["rounds"] * OPTIONS["depth"]
    assert max(calls) <= 2               # the pass; after every `renew` rounds also the checkpoint


def test_rows_of_equal_bins_are_fitted_as_one(spark, rows, data, monkeypatch):
    """Copies of rows in other folds count by number: the trees are those of all rows, held out or not."""
    def passes(*_):
        raise AssertionError("300 rows of different bins fit in a task")
    monkeypatch.setattr(bo, "_fits_by_passes", passes)
    plain = rows.select("replicate", "y", *X)
    copies = pr.with_folds(plain.crossJoin(spark.range(12)).selectExpr("int(replicate + 100 * id) AS replicate", "y", *X), "replicate", 3, (0, 1)).persist()
    options = OPTIONS | {"one_task": 300}
    head, out = bo.boost(copies, X, "y", ["A", "B", "C"], [("fold_1", 2)], keep=["replicate", *X], **options)
    t = copies.where("fold_1 != 2").toPandas()
    x, y = t[X].to_numpy(float), np.array(["ABC".index(v) for v in t.y])
    edges = bo.quantile_edges(copies, X, OPTIONS["bins"])
    base, trees, value = brute_fit(x, y, edges, OPTIONS["step"], OPTIONS["depth"], OPTIONS["least"], OPTIONS["rounds"])
    held = copies.where("fold_1 = 2")
    got = {(r["replicate"], r["x0"], r["x2"]): np.frombuffer(r["_scores"]) for r in out.collect()}
    assert out.count() == 3600 and held.count() > 0
    probabilities = {(r["replicate"], r["x0"], r["x2"]): r["p_A"] for r in head[0].apply(held).collect()}
    for r in held.collect():
        key = (r["replicate"], r["x0"], r["x2"])
        want = base + sum(np.array([value(tree, [r[c] if r[c] is not None else np.nan for c in X]) for tree in new]) for new in trees)
        assert got[key] == pytest.approx(want, abs=1e-9)
        assert probabilities[key] == pytest.approx(np.exp(want[0]) / np.exp(want).sum(), abs=1e-9)


@pytest.mark.parametrize("n", [40, 4000])
def test_histograms_of_few_and_of_many_rows(n):
    """Many rows are counted by cells of two features at once; the sums are those of each feature."""
    rng = np.random.default_rng(1)
    fit = bo._Fit(6, 3, 2, 2, 3)
    columns, scores = rng.integers(0, 6, (3, n)).astype(np.uint8), rng.normal(size=(2, 3, n))
    weights = rng.integers(0, 3, (2, 3, n)).astype(np.uint8)
    trees = bo.Trees.empty(6, 2)
    trees.feature[:, 0], trees.cut[:, 0] = [0, 1, 2, 0, 1, -1], 2
    wanted = np.full(trees.feature.shape, -1)
    wanted[:5, 1], wanted[0, 2] = 0, 1
    got = bo._count(fit, columns, scores, weights, trees, wanted, 1)
    assert sorted(got) == [0, 1, 2, 3, 4] and got[0].shape == (2, 3, 18)
    for t in got:
        i, c = divmod(t, 3)
        number = weights[i].sum(axis=0).astype(float)
        p = np.exp(scores[i, c]) / np.exp(scores[i]).sum(axis=0)
        left = columns[trees.feature[t, 0]] <= 2
        for slot, here in enumerate([left, ~left][:len(got[t])]):
            for f in range(3):
                for b in range(6):
                    at = here & (columns[f] == b)
                    want = [number[at].sum(), (number * p - weights[i, c])[at].sum(), (number * p * (1 - p))[at].sum()]
                    assert got[t][slot, :, 6 * f + b] == pytest.approx(want, abs=1e-9)


def test_blocks_are_as_many_as_cores_unless_too_large(spark, rows, monkeypatch):
    """Parts follow the cores; blocks over their bound are cut further, with the same sums."""
    parts, sums, counted = [], [], bo._histograms

    def spy(blocks, *now):
        parts.append(blocks.getNumPartitions())
        sums.append(counted(blocks, *now))
        return sums[-1]
    monkeypatch.setattr(bo, "_histograms", spy)
    folds, cores = [(f"fold_{s}", f) for s in (0, 1) for f in range(3)], spark.sparkContext.defaultParallelism
    for block, want in ((bo.BLOCK, 1), (4096, -(-300 * 183 // (cores * 4096)) * cores)):
        monkeypatch.setattr(bo, "BLOCK", block)
        bo.boost(rows, X, "y", ["A", "B", "C"], folds, one_task=0, **OPTIONS | {"rounds": 1, "depth": 1})
        assert parts[-1] == want
    one, two = sums
    assert one.keys() == two.keys() and all(np.allclose(one[t], two[t]) for t in one)


def test_each_fit_has_a_partition_of_its_own(spark):
    state = spark.range(0, 2000, 1, 4).selectExpr("binary(string(id)) AS _bins", "array_repeat(array(1L, 0L), 15) AS _w")
    got = bo._dealt(state, 15).groupBy("_fit", F.spark_partition_id().alias("part")).count().collect()
    assert len(got) == len({r["part"] for r in got}) == 15 and {r["count"] for r in got} == {2000}
