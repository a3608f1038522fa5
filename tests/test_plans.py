"""Physical plans stay the intended ones, and hot keys do not change results."""

import os
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from alleleflow.functions.session import small_side
from alleleflow.operators import classical as cl
from alleleflow.operators import counts as ct
from alleleflow.operators import inject as inj
from alleleflow.operators import metrics as mt
from alleleflow.operators import protocol as pr
from alleleflow.operators import rarefaction as rf
from alleleflow.sources import text as tx

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan(df)))


@needs_tables
def test_flagship_reads_three_columns_and_stays_in_the_jvm(spark):
    df = entry.queries()["feature_matrix"](spark, SF)
    p = plan(df)
    assert "ReadSchema: struct<l_suppkey:bigint,l_returnflag:string,l_linestatus:string>" in p
    # by locus, by configuration (then spread evenly), by depth; the window is over one row per
    # depth
    assert shuffles(df) == 3 and p.count("Exchange RoundRobinPartitioning") == 1
    assert p.count("Exchange SinglePartition") == 1
    assert "Python" not in p and "Join" not in p


@needs_tables
def test_region_filters_reach_the_scan(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/v"
    v = entry.queries()["biallelic_filter"](spark, SF)
    tx.write_variants(v, path)
    p = plan(tx.scan_windows(spark.read.parquet(path).select("chrom", "pos"),
                             [("chr1", 5, 10_000), ("chr2", 7, 20_000)]))
    assert re.search(r"PartitionFilters: \[.*chrom.*chr1.*chr2", p)
    assert re.search(r"PushedFilters: \[[^\n]*pos", p)
    assert "ReadSchema: struct<pos:bigint>" in p


def test_counts_of_vcf_rows_need_no_shuffle(spark):
    names = ["a", "b"]
    lines = spark.createDataFrame([("1\t5\t.\tA\tC\t.\t.\t.\tGT\t0/1\t1/1",)], "value string")
    popmap = spark.createDataFrame([("a", "X"), ("b", "Y")], "sample string, pop string")
    c = tx.counts_from_vcf(tx.parse_vcf_lines(lines, 2), names, popmap, ["X", "Y"])
    rows = re.split(r"BroadcastExchange", plan(c))[0]
    assert "Exchange hashpartitioning" not in rows and "Generate" not in rows
    assert (c.collect()[0]["c1_1"], c.collect()[0]["c2_2"]) == (1, 2)


def test_trios_share_one_pass(spark):
    f = spark.createDataFrame([("c", 1, .1, .2, .3, .0)],
                              "chrom string, pos long, p1 double, p2 double, p3 double, p4 double")
    trios = {str(i): ["p1", "p2", "p3", "p4"] for i in range(6)}
    d = cl.d_by_trio(f, trios)
    assert "Join" not in plan(d) and plan(d).count("Scan") == 1


def test_broadcast_only_below_the_bound(spark):
    big = spark.range(1000).withColumn("x", F.col("id") * 2)
    assert "Broadcast" in plan(big.join(small_side(spark.range(50)), "id"))
    side = small_side(spark.range(50), max_rows=10)
    assert side._jdf.queryExecution().logical().toString().count("broadcast") == 0


def test_injection_does_not_shuffle_genotypes_by_sample(spark):
    g = spark.createDataFrame([(1, "P1", 1, 0, 1), (2, "P2", 1, 1, 1)],
                              "sample int, pop string, locus int, a1 int, a2 int")
    m = spark.createDataFrame([("x", 1, 2, "P1")],
                              "experiment string, sample int, donor int, pop string")
    p = plan(inj.inject_migrants(g, m.drop("experiment")))
    assert "SortMergeJoin" not in p and p.count("BroadcastHashJoin") == 2


# ------------------------------------------------------------------ a third of all rows in one key

def test_hot_locus(spark):
    rng = np.random.default_rng(0)
    rows = [(0 if i % 3 == 0 else int(rng.integers(1, 30)), f"P{1 + int(rng.integers(3))}",
             int(rng.integers(2))) for i in range(6000)]
    obs = spark.createDataFrame(rows, "locus int, pop string, allele int").repartition(7)
    c = ct.allele_table(obs, ["P1", "P2", "P3"])
    hot = c.where("locus = 0").collect()[0]
    assert sum(hot[x] for x in ct.count_columns(2, 3)) == 2000
    a = rf.feature_matrix(c, 12).orderBy("g").collect()
    b = rf.feature_matrix(c, 12, collapse=False).orderBy("g").collect()
    assert len(a) == len(b) == 11
    for x, y in zip(a, b):
        assert list(x) == pytest.approx(list(y), abs=1e-9)


def test_hot_replicate_and_score(spark):
    rng = np.random.default_rng(1)
    n = 3000
    rep = np.where(rng.random(n) < .35, 0, rng.integers(1, 50, n))
    p = np.where(rng.random(n) < .35, .25, rng.random(n))
    y = rng.integers(0, 2, n)
    df = spark.createDataFrame([(int(a), int(b), float(c), i) for i, (a, b, c) in
                                enumerate(zip(rep, y, p))],
                               "replicate int, y int, p double, g int").repartition(5)
    assert pr.with_folds(df, k=5, seeds=(0,)).count() == n
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).mean() + .5 * (pos[:, None] == neg).mean())
    assert mt.roc_auc(df).collect()[0][0] == pytest.approx(want)
    s = mt.spearman(df, "p", "g").collect()[0]
    assert s["n"] == n and abs(s["spearman"]) < .1
