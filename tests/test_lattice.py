"""All subsets of many populations from shared prefix products."""

from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from alleleflow.operators import rarefaction as rf


def brute(cells, g):
    """{subset: richness} of one locus, each subset's product on its own."""
    n = cells.sum(0)
    q = np.array([[comb(int(t - c), g) / comb(int(t), g) for c, t in zip(row, n)] for row in cells])
    pops = cells.shape[1]
    return [sum(np.prod([1 - a[j] if m >> j & 1 else a[j] for j in range(pops)]) for a in q) for m in range(2 ** pops)]


def _counts(spark, loci):
    fields = ", ".join(f"c_{j}: int" for j in range(1, loci[0].shape[1] + 1))
    rows = [(k, [tuple(map(int, r)) for r in c]) for k, c in enumerate(loci)]
    return spark.createDataFrame(rows, f"locus int, cells array<struct<{fields.replace(': ', ':')}>>")


@pytest.mark.parametrize("pops", [1, 3, 12])
def test_every_subset_equals_its_own_product(spark, pops):
    rng = np.random.default_rng(pops)
    loci = [rng.integers(0, 4, (int(rng.integers(2, 5)), pops)) + np.eye(1, pops, dtype=int)[0] * 2 + 1 for _ in range(3)]
    df = _counts(spark, loci)
    for r in rf.subset_richness(df, 4).collect():
        assert r["_subsets"] == pytest.approx(brute(loci[r["locus"]], r["g"]), abs=1e-9)
    deepest = min(4, min(int(c.sum(0).min()) for c in loci))
    got = {(r["g"], r["subset"]): r for r in rf.subset_moments(df, 4).collect()}
    assert set(got) == {(g, m) for g in range(2, deepest + 1) for m in range(1, 2 ** pops)}
    for g in range(2, deepest + 1):
        x = np.array([brute(c, g) for c in loci])
        for m in (1, 2 ** pops - 1, 2 ** pops // 2):
            assert got[(g, m)]["mean"] == pytest.approx(x[:, m].mean(), abs=1e-9) and got[(g, m)]["n_loci"] == 3
            assert got[(g, m)]["variance"] == pytest.approx(x[:, m].var(ddof=1), abs=1e-9)


def test_agrees_with_the_named_combinations(spark):
    rng = np.random.default_rng(9)
    df = _counts(spark, [rng.integers(1, 6, (2, 4)) for _ in range(20)])
    names = rf.combination_names(4)
    named = {r["g"]: r for r in rf.finalise(rf.depth_sums(df.drop("locus"), 2, (), names), (), names).collect()}
    got = {r["subset"]: r["mean"] for r in rf.subset_moments(df, 2).collect()}
    for name, who in zip(names, [s for r in range(1, 5) for s in combinations(range(4), r)]):
        assert got[sum(1 << j for j in who)] == pytest.approx(named[2][f"{name}_mean"], abs=1e-9)


def test_columns_and_cells_agree(spark):
    df = spark.createDataFrame([(1, 5, 3, 4, 2, 6), (4, 4, 4, 1, 1, 1)], "c1_1 int, c1_2 int, c1_3 int, c2_1 int, c2_2 int, c2_3 int")
    cells = df.select(F.array(*[F.struct(*[F.col(f"c{i}_{j}").alias(f"c_{j}") for j in (1, 2, 3)]) for i in (1, 2)]).alias("cells"))
    a, b = (sorted(map(tuple, rf.subset_moments(x, 5).collect())) for x in (df, cells))
    assert a == b and a


def test_the_plan_grows_linearly(spark):
    def size(pops):
        df = _counts(spark, [np.ones((2, pops), int) * 3])
        return len(rf.subset_moments(df)._jdf.queryExecution().optimizedPlan().toString())
    assert size(12) < 2.2 * size(6)


def test_loci_are_spread_over_tasks_and_lattices_are_products_of_halves(spark):
    """Few bytes, much work: a table in one partition must not be one task's work."""
    rng = np.random.default_rng(3)
    loci = [rng.integers(0, 3, (int(rng.integers(1, 7)), 5)) + np.eye(1, 5, dtype=int)[0] + 1 for _ in range(40)]
    df = _counts(spark, loci).coalesce(1).cache()
    df.count()
    plan = rf.subset_moments(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(" + spark.conf.get("spark.sql.shuffle.partitions") in plan
    top = min(3, min(int(c.sum(0).min()) for c in loci))
    size = max(map(len, loci))
    sums = {g: (x, squares) for g, x, squares in rf._lattice_sums(np.array([np.pad(c, ((0, size - len(c)), (0, 0))) for c in loci]), top)}
    assert set(sums) == set(range(2, top + 1))
    for g, (x, squares) in sums.items():
        want = np.array([brute(c, g) for c in loci])
        assert x == pytest.approx(want.sum(0), abs=1e-9) and squares == pytest.approx((want ** 2).sum(0), abs=1e-9)
