import math

import numpy as np
import pytest

from alleleflow.operators import classical as cl
from alleleflow.operators import counts as ct


def sites(spark, rows):
    return cl.abba_baba(spark.createDataFrame(
        [(c, int(p), *map(float, f)) for c, p, *f in rows],
        "chrom string, pos long, p1 double, p2 double, p3 double, p4 double"))


def random_rows(n=400, seed=3):
    rng = np.random.default_rng(seed)
    return [(f"c{i % 4}", i * 9000, *rng.random(3), rng.random() * 0.2) for i in range(n)]


def brute_weighted(rows, size=500_000):
    """Weighted delete-m jackknife, one block at a time."""
    blocks = {}
    for c, pos, p1, p2, p3, p4 in rows:
        a, b = (1 - p1) * p2 * p3 * (1 - p4), p1 * (1 - p2) * p3 * (1 - p4)
        x = blocks.setdefault((c, pos // size), [0.0, 0.0])
        x[0] += a - b
        x[1] += a + b
    v = np.array(list(blocks.values()))
    num, den = v.sum(0)
    theta = num / den
    left = (num - v[:, 0]) / (den - v[:, 1])
    h = den / v[:, 1]
    tj = len(v) * theta - ((1 - v[:, 1] / den) * left).sum()
    pseudo = h * theta - (h - 1) * left
    return theta, math.sqrt((((pseudo - tj) ** 2) / (h - 1)).mean())


def test_weighted_jackknife(spark):
    rows = random_rows()
    theta, se = brute_weighted(rows)
    r = cl.weighted_jackknife(cl.block_sums(sites(spark, rows))).collect()[0]
    assert r["d"] == pytest.approx(theta) and r["se"] == pytest.approx(se)
    assert r["z"] == pytest.approx(theta / se)


def test_unweighted_jackknife(spark):
    rows = random_rows()
    d = {}
    for c, _, p1, p2, p3, p4 in rows:
        a, b = (1 - p1) * p2 * p3 * (1 - p4), p1 * (1 - p2) * p3 * (1 - p4)
        x = d.setdefault(c, np.zeros(2))
        x += (a - b, a + b)
    tot = sum(d.values())
    left = np.array([(tot - x)[0] / (tot - x)[1] for x in d.values()])
    se = math.sqrt((len(d) - 1) / len(d) * ((left - left.mean()) ** 2).sum())
    r = cl.unweighted_jackknife(cl.block_sums(sites(spark, rows), None)).collect()[0]
    assert r["se"] == pytest.approx(se) and r["n_blocks"] == 4
    drop = cl.leave_one_block_out(cl.block_sums(sites(spark, rows), None)).collect()
    assert sorted(x["d"] for x in drop) == pytest.approx(sorted(left))
    assert cl.leave_one_block_out(cl.block_sums(sites(spark, rows), None),
                                  min_sites=301).count() == 0


def test_single_block_and_empty_denominator(spark):
    one = [("c", 1, .1, .4, .5, 0), ("c", 2, .3, .2, .6, 0)]
    r = cl.weighted_jackknife(cl.block_sums(sites(spark, one))).collect()[0]
    assert r["d"] is not None and r["se"] is None and r["z"] is None
    zero = [("c", 1, 0, 0, .5, 0), ("d", 2, 0, 0, .6, 0)]
    r = cl.patterson_d(sites(spark, zero)).collect()[0]
    assert r["d"] is None and r["n_abba"] == 0


def test_symmetries(spark):
    rows = random_rows(60)
    swapped = [(c, p, b, a, x, o) for c, p, a, b, x, o in rows]
    same = [(c, p, a, a, x, o) for c, p, a, b, x, o in rows]
    d = cl.patterson_d(sites(spark, rows)).collect()[0]["d"]
    assert cl.patterson_d(sites(spark, swapped)).collect()[0]["d"] == pytest.approx(-d)
    assert cl.patterson_d(sites(spark, same)).collect()[0]["d"] == pytest.approx(0)
    assert cl.f4_statistic(sites(spark, same)).collect()[0]["f4"] == pytest.approx(0)


def test_f_statistics_skip_nan(spark):
    rows = [("c", 1, .1, .4, .5, 0), ("c", 2, float("nan"), .2, .6, .1), ("c", 3, .9, .2, .3, .2)]
    f = sites(spark, rows)
    assert cl.f4_statistic(f).collect()[0][0] == pytest.approx(
        np.mean([(.1 - .4) * .5, (.9 - .2) * (.3 - .2)]))
    assert cl.f3_statistic(f).collect()[0][0] == pytest.approx(
        np.mean([(.5 - .1) * (.5 - .4), (.3 - .9) * (.3 - .2)]))


def test_trios_in_one_pass(spark):
    rows = random_rows(80)
    f = sites(spark, rows).drop("abba", "baba")
    got = {r["trio"]: r["d"] for r in cl.d_by_trio(
        f, {"a": ["p1", "p2", "p3", "p4"], "b": ["p2", "p1", "p3", "p4"]}).collect()}
    assert got["a"] == pytest.approx(-got["b"])
    rule = cl.d_decision(cl.d_by_trio(f, {"a": ["p1", "p2", "p3"]})).collect()[0]
    assert rule["call"] in ("D", "flow")


def test_polarisation(spark):
    f = spark.createDataFrame([(.2, .3, .4, .9), (.2, .3, .4, .5)],
                              "p1 double, p2 double, p3 double, p4 double")
    a, b = ct.polarise_outgroup(f).collect()
    assert list(a) == pytest.approx([.8, .7, .6, .1]) and list(b) == [.2, .3, .4, .5]
    c = spark.createDataFrame([("A", "C", "A", 1, 2, 3, 3, 2, 1), ("A", "C", "C", 1, 2, 3, 3, 2, 1),
                               ("A", "C", "G", 1, 2, 3, 3, 2, 1), ("A", "C", "A", 0, 2, 3, 0, 2, 1)],
                              "ref string, alt string, aa string, c1_1 int, c1_2 int, c1_3 int, "
                              "c2_1 int, c2_2 int, c2_3 int")
    r = ct.polarise_ancestral(c).collect()
    assert [x["p1"] for x in r] == [.75, .25]


def test_frequencies_need_two_alleles(spark):
    c = spark.createDataFrame([(1, 1, 2, 2, 1), (2, 0, 0, 3, 3), (3, 0, 2, 0, 1)],
                              "locus int, c1_1 int, c1_2 int, c2_1 int, c2_2 int")
    r = ct.site_frequencies(c).collect()
    assert [(x["locus"], x["p1"], x["p2"]) for x in r] == [(1, pytest.approx(2 / 3),
                                                             pytest.approx(1 / 3))]
    d = spark.createDataFrame([("a", 2.0), ("a", float("nan")), ("b", 0.0)],
                              "pop string, dosage double")
    assert {x["pop"]: x["freq"] for x in ct.allele_frequency(d, ["pop"]).collect()} == {
        "a": 1.0, "b": 0.0}
