"""Hand-computed and brute-force checks of counts and rarefaction statistics."""

import itertools
import math

import numpy as np
import pytest

from alleleflow.operators import counts as ct
from alleleflow.operators import rarefaction as rf
from alleleflow.plans import contract

NAMES = ct.count_columns(2, 3)


def table(spark, rows, keys=("locus",)):
    return spark.createDataFrame(rows, ", ".join([f"{k} int" for k in keys]
                                                 + [f"{c} int" for c in NAMES]))


def brute(counts, g):
    """Statistics of one locus by enumerating which alleles a subsample of g copies misses."""
    k, pops = len(counts), len(counts[0])
    q = [[0.0] * pops for _ in range(k)]
    for j in range(pops):
        copies = [i for i in range(k) for _ in range(counts[i][j])]
        draws = list(itertools.combinations(range(len(copies)), g))
        for i in range(k):
            q[i][j] = sum(all(copies[d] != i for d in draw) for draw in draws) / len(draws)
    out = {}
    for j in range(pops):
        out[f"alpha_{j + 1}"] = sum(1 - q[i][j] for i in range(k))
        out[f"pi_{j + 1}"] = sum((1 - q[i][j]) * math.prod(q[i][o] for o in range(pops) if o != j)
                                 for i in range(k))
    for a, b in ((0, 1), (0, 2), (1, 2)):
        c = 3 - a - b
        out[f"pihat_{a + 1}{b + 1}"] = sum((1 - q[i][a]) * (1 - q[i][b]) * q[i][c]
                                           for i in range(k))
    return out


ROWS = [(1, 2, 4, 3, 2, 0, 3), (2, 5, 1, 4, 1, 4, 0), (3, 0, 3, 2, 5, 3, 4), (4, 4, 4, 4, 0, 0, 0)]


def cells(row):
    return [list(row[1:4]), list(row[4:7])]


def test_single_locus_by_hand(spark):
    r = rf.per_locus(table(spark, [(1, 2, 2, 2, 2, 2, 2)]), 2).collect()[0]
    assert r["alpha_1"] == pytest.approx(5 / 3)


def test_statistics_match_enumeration(spark):
    got = {(r["locus"], r["g"]): r for r in rf.per_locus(table(spark, ROWS), 3).collect()}
    for row in ROWS:
        for g in (2, 3):
            for s, want in brute(cells(row), g).items():
                assert got[(row[0], g)][s] == pytest.approx(want, abs=1e-12)


def test_moments_match_numpy_and_collapse_agrees(spark):
    rows = ROWS + [(10 + i, *ROWS[i % 4][1:]) for i in range(7)]
    t = table(spark, rows)
    per = [brute(cells(r), 3) for r in rows]
    one = rf.feature_matrix(t.drop("locus"), 3).where("g = 3").collect()[0]
    two = rf.feature_matrix(t.drop("locus"), 3, collapse=False).where("g = 3").collect()[0]
    for s in contract.BLOCKS:
        x = np.array([p[s] for p in per])
        for r in (one, two):
            assert r[f"{s}_mean"] == pytest.approx(x.mean(), abs=1e-12)
            assert r[f"{s}_variance"] == pytest.approx(x.var(ddof=1), abs=1e-12)
            assert r[f"{s}_se"] == pytest.approx(x.std(ddof=1) / math.sqrt(len(x)), abs=1e-12)


def test_array_path_equals_column_path(spark):
    obs = [(r[0], f"P{j + 1}", i, cells(r)[i][j]) for r in ROWS for i in range(2) for j in range(3)]
    df = spark.createDataFrame(obs, "locus int, pop string, allele int, n int").where("n > 0")
    pops = ["P1", "P2", "P3"]
    a = rf.feature_matrix(ct.allele_table(df, pops), 3).orderBy("g").collect()
    b = rf.feature_matrix(ct.allele_cells(df, pops), 3).orderBy("g").collect()
    assert len(a) == len(b) == 2
    for x, y in zip(a, b):
        assert list(x) == pytest.approx(list(y), abs=1e-12)


def test_large_samples_use_the_series(spark):
    n, a, g = 5000, 1700, 40
    r = rf.per_locus(table(spark, [(1, a, a, a, n - a, n - a, n - a)]), g).where(f"g = {g}")
    q1 = math.comb(n - a, g) / math.comb(n, g)
    q2 = math.comb(a, g) / math.comb(n, g)
    assert r.collect()[0]["alpha_1"] == pytest.approx(2 - q1 - q2, rel=1e-9)
    assert rf.absence_table(table(spark, [(1, a, a, a, n - a, n - a, n - a)]), [g]).where(
        "allele = 1 AND pop_index = 1").collect()[0]["q"] == pytest.approx(q1, rel=1e-8)


def test_private_and_pair_alleles(spark):
    # allele 2 only in P1, then only in P2 and P3
    r = rf.per_locus(table(spark, [(1, 2, 4, 4, 2, 0, 0), (2, 4, 0, 0, 0, 4, 4)]), 2)
    one, two = (x for x in r.orderBy("locus").collect())
    p = 5 / 6
    assert one["pi_1"] == pytest.approx(p) and one["pi_2"] == one["pi_3"] == 0
    assert two["pihat_23"] == pytest.approx(1) and two["pihat_12"] == two["pihat_13"] == 0
    assert two["pi_1"] == pytest.approx(1) and two["pi_2"] == 0


def test_richness_grows_and_presence_patterns_add_up(spark):
    t = table(spark, ROWS)
    by_g = rf.per_locus(t, 3, first_depth=1).orderBy("locus", "g").collect()
    for a, b in zip(by_g, by_g[1:]):
        if a["locus"] == b["locus"]:
            assert b["alpha_1"] >= a["alpha_1"] - 1e-12
        if a["g"] == 1:
            assert a["alpha_1"] == pytest.approx(1)
    names = rf.combination_names(3)
    r = rf.per_locus(t, 3, names).where("g = 3").collect()
    for x in r:
        assert 0 <= sum(x[n] for n in names) <= 2 + 1e-12


def test_depths_stop_at_the_smallest_copy_number(spark):
    t = table(spark, ROWS)
    assert ct.max_depth(t).collect()[0][0] == 4
    assert [r["g"] for r in rf.depth_grid(t).orderBy("g").collect()] == [2, 3, 4]
    assert [r["g"] for r in rf.feature_matrix(t).orderBy("g").collect()] == [2, 3, 4]
    all_depths = rf.feature_matrix(t, per_depth_loci=True)
    assert all_depths.agg({"g": "max"}).collect()[0][0] > 4


def test_population_swap_permutes_columns(spark):
    obs = [(r[0], f"P{j + 1}", i, cells(r)[i][j]) for r in ROWS for i in range(2) for j in range(3)]
    df = spark.createDataFrame(obs, "locus int, pop string, allele int, n int")
    a = rf.feature_matrix(ct.allele_table(df, ["P1", "P2", "P3"]), 3).where("g = 2").collect()[0]
    b = rf.feature_matrix(ct.allele_table(df, ["P2", "P1", "P3"]), 3).where("g = 2").collect()[0]
    assert a["alpha_1_mean"] == pytest.approx(b["alpha_2_mean"])
    assert a["pihat_13_variance"] == pytest.approx(b["pihat_23_variance"])
    assert a["pihat_12_mean"] == pytest.approx(b["pihat_12_mean"])


def test_leave_one_out_equals_direct(spark):
    t = table(spark, [(i % 3, *ROWS[i % 4][1:]) for i in range(11)], ("chrom",))
    got = rf.leave_one_out(t, "chrom", 3).where("chrom = 1").orderBy("g").collect()
    want = rf.feature_matrix(t.where("chrom <> 1").drop("chrom"), 3).orderBy("g").collect()
    for x, y in zip(got, want):
        assert [x[c] for c in contract.FEATURES] == pytest.approx(list(y), abs=1e-10)
    assert rf.leave_one_out(t, "chrom", 3, min_loci=100).count() == 0


def test_contract_names_and_order(spark):
    f = rf.feature_matrix(table(spark, ROWS), 3)
    assert f.columns == contract.FEATURES and len(f.columns) == 28
    assert f.columns[19:22] == ["pihat_12_mean", "pihat_12_variance", "pihat_12_se"]
    assert f.columns[22] == "pihat_13_mean" and f.columns[25] == "pihat_23_mean"
    scrambled = f.select(*reversed(f.columns))
    assert contract.feature_subset(scrambled, contract.FEATURES).columns == contract.FEATURES
    assert len(contract.CHANNELS["asymmetric"]) == 19
    assert contract.MOMENT_SETS["var_only"][:2] == ["g", "alpha_1_variance"]


def test_population_validation():
    assert contract.validate_populations(["b", "a", "c"], ["a", "b", "c"]) == ["b", "a", "c"]
    with pytest.raises(ValueError):
        contract.validate_populations(["a", "b", "x"], ["a", "b", "c"])
    with pytest.raises(ValueError):
        contract.validate_populations(["a", "b", "c", "d"])


def test_no_size_changes_the_formula(spark):
    n, a, g = 120_000, 60_000, 3        # n * n does not fit into 32 bits
    r = rf.per_locus(table(spark, [(1, a, a, a, n - a, n - a, n - a)]), g).where(f"g = {g}")
    q = math.comb(n - a, g) / math.comb(n, g)
    assert r.collect()[0]["alpha_1"] == pytest.approx(2 - 2 * q, rel=1e-8)
    for n in (62, 63, 64, 65, 66):
        r = rf.per_locus(table(spark, [(1, 20, 20, 20, n - 20, n - 20, n - 20)]), 7).where("g = 7")
        q1, q2 = (math.comb(x, 7) / math.comb(n, 7) for x in (n - 20, 20))
        assert r.collect()[0]["alpha_1"] == pytest.approx(2 - q1 - q2, rel=1e-12)


def test_depths_are_bounded_by_the_shallowest_locus(spark):
    t = table(spark, [(1, 9, 9, 9, 20, 20, 20), (2, 1, 2, 1, 3, 2, 3)])
    sums = rf.depth_sums(t, shared_only=True)
    assert sorted(r["g"] for r in sums.collect()) == [0, 1, 2, 3, 4]
    a = rf.finalise(sums).orderBy("g").collect()
    b = rf.finalise(rf.depth_sums(t)).orderBy("g").collect()
    assert [list(x) for x in a] == [pytest.approx(list(y), nan_ok=True) for y in b]
    assert [r["g"] for r in a] == [2, 3, 4]
    keyed = rf.feature_matrix(t.withColumnRenamed("locus", "k"), keys=["k"])
    assert {r["k"]: r["count"] for r in keyed.groupBy("k").count().collect()} == {1: 28, 2: 3}


def test_no_table_is_carried_through_the_expansion(spark):
    stats = rf.per_locus(table(spark, [(1, 2, 2, 2, 2, 2, 2)]), 2)
    plan = stats._jdf.queryExecution().executedPlan()
    below = plan.toString().split("Generate explode")[1]
    assert "transform(" not in below and "concat(" not in below
