import os
import tempfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from alleleflow.operators import counts as ct
from alleleflow.operators import inject as inj
from alleleflow.operators import quality as ql
from alleleflow.sources import text as tx

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3
1\t10\t.\tA\tC\t.\tPASS\tAC=1;AA=a|||\tGT\t0|1:9\t./1\t1/1
1\t20\t.\tA\tCT\t.\tPASS\tAA=.\tGT\t0/0\t0/1\t.
2\t5\t.\tG\tT\t.\tPASS\tAA=N\tGT\t0/0\t0/1:3:4\t./.
"""


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def write(text):
    path = os.path.join(folder(), "input.txt")
    with open(path, "w") as f:
        f.write(text)
    return path


@pytest.fixture(scope="module")
def popmap(spark):
    return spark.createDataFrame([("s1", "X"), ("s2", "X"), ("s3", "Y")], "sample string, pop string")


def test_read_vcf(spark, popmap):
    path = write(VCF)
    names = tx.vcf_samples(spark, path)
    assert names == ["s1", "s2", "s3"]
    v = tx.read_vcf(spark, path)
    g = tx.genotypes_from_vcf(v, names, popmap)
    got = {(r["chrom"], r["pos"], r["sample"]): (r["a1"], r["a2"]) for r in g.collect()}
    assert got[("1", 10, "s1")] == (0, 1) and got[("1", 10, "s2")] == (None, 1)
    assert got[("1", 20, "s3")] == (None, None) and len(got) == 9
    c = {r["pos"]: (r["c1_1"], r["c2_1"], r["c1_2"], r["c2_2"])
         for r in tx.counts_from_vcf(v, names, popmap, ["X", "Y"]).collect()}
    assert c[10] == (1, 2, 0, 2) and c[5] == (3, 1, 0, 0)
    assert ql.biallelic_snps(v).count() == 2
    assert [(r["pos"], r["aa"]) for r in ql.ancestral_allele(v).collect()] == [(10, "A")]


def test_short_vcf_row_raises(spark):
    path = write(VCF + "3\t1\t.\tA\tC\t.\tPASS\t.\tGT\t0/0\n")
    with pytest.raises(PySparkException):
        tx.read_vcf(spark, path).collect()


def test_vcf_round_trip(spark, popmap):
    v = tx.read_vcf(spark, write(VCF)).where("pos <> 20")
    g = tx.genotypes_from_vcf(v, ["s1", "s2", "s3"], popmap)
    out = os.path.join(folder(), "vcf")
    tx.write_vcf(g, ["s1", "s2", "s3"], out)
    again = tx.genotypes_from_vcf(tx.read_vcf(spark, out), tx.vcf_samples(spark, out), popmap)

    def key(df):
        return sorted(map(str, df.select("chrom", "pos", "ref", "alt", "sample", "a1", "a2")
                          .collect()))
    assert key(again) == key(g)
    pm = os.path.join(folder(), "pm")
    tx.write_popmap(popmap, pm)
    assert sorted(tx.read_popmap(spark, pm).collect()) == sorted(popmap.collect())
    js = os.path.join(folder(), "json")
    tx.write_records(popmap, js)
    assert spark.read.json(js).count() == 3


def test_variant_layout_prunes(spark):
    v = tx.read_vcf(spark, write(VCF))
    out = os.path.join(folder(), "variants")
    tx.write_variants(v, out)
    assert sorted(os.listdir(out))[-2:] == ["chrom=1", "chrom=2"]
    scan = tx.scan_region(spark.read.parquet(out), "1", 10, 15)
    assert scan.count() == 1
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan and "GreaterThanOrEqual(pos,10)" in plan
    w = tx.scan_windows(v, [("1", 20, 20), ("2", 1, 5)])
    assert {(r["pos"], r["window_id"]) for r in w.collect()} == {(20, 0), (5, 1)}


def test_geno_and_major_minor(spark):
    path = write("chrom\tpos\ta\tb\tc\n1\t5\tA/T\tT/T\tN\n1\t6\tA/C\tC/G\tA/A\n1\t7\tT/A\tA/T\tG\n"
                 "1\t8\tT/A\tA/T\tN/A\n1\t9\tC\tC/C\tN\n1\t10\tT/A\tA/T\tN/N\n")
    g = tx.read_geno(spark, path)
    r = {(x["pos"], x["sample"]): (x["b1"], x["b2"]) for x in g.collect()}
    assert r[(5, "a")] == ("A", "T") and r[(5, "c")] == (None, None)
    assert r[(9, "a")] == ("C", None) and r[(8, "c")] == (None, "A")
    mm = {x["pos"]: (x["ref"], x["alt"], x["n_ref"], x["n_alt"]) for x in
          ql.major_minor(g).collect()}
    # three bases at 6 and 7, one at 9; the tie at 10 goes to the base seen first
    assert mm == {5: ("T", "A", 3, 1), 8: ("A", "T", 3, 2), 10: ("T", "A", 2, 2)}
    coded = {(x["pos"], x["sample"]): (x["a1"], x["a2"])
             for x in ql.recode_to_sites(g, ql.major_minor(g)).collect()}
    assert coded[(5, "a")] == (1, 0) and coded[(5, "c")] == (None, None)


def test_popmap_reading(spark):
    path = write("sample pop super\ns1 X AFR\ns2\tY\n\nlonely\n")
    assert sorted(map(tuple, tx.read_popmap(spark, path).collect())) == [("s1", "X"), ("s2", "Y")]
    picked = tx.read_popmap(spark, path, {"P1": ["X"]})
    assert list(map(tuple, picked.collect())) == [("s1", "P1")]
    s = spark.createDataFrame([("Mmm_1",), ("Ms_2",), ("Mmd",), ("Zz_1",)], "sample string")
    p = tx.population_from_prefix(s, {"Mmm": "mus", "Ms": "spr", "Mmd": "dom"})
    assert sorted(map(tuple, p.collect())) == [("Mmm_1", "mus"), ("Ms_2", "spr")]


@pytest.mark.parametrize("n", [7, 10, 33, 100])
def test_even_thinning_is_linspace(spark, n):
    rows = [(f"c{i % 3}", int(p)) for i, p in enumerate(np.random.default_rng(1).permutation(100))]
    df = spark.createDataFrame(rows, "chrom string, pos long")
    ordered = sorted(rows)
    want = [ordered[i] for i in sorted(set(np.linspace(0, 99, n).astype(int)))]
    got = sorted(map(tuple, ql.thin_evenly(df, n, bin_size=7).collect()))
    assert got == want


def test_window_cap_and_sampling(spark):
    rows = [(w, p) for w in range(3) for p in range(50)]
    df = spark.createDataFrame(rows, "window_id int, pos long")
    got = sorted(map(tuple, ql.cap_per_window(df, 20, 45).collect()))
    assert got == [r for r in rows if r[1] < 20][:45]
    s = [ql.sample_fixed(df, 37, ["window_id", "pos"], seed) for seed in (1, 1, 2)]
    a, b, c = (sorted(map(tuple, x.collect())) for x in s)
    assert a == b != c and len(set(a)) == 37
    assert ql.sample_fixed(df, 500, ["window_id", "pos"]).count() == 150


def test_resolve_and_recode(spark):
    v = spark.createDataFrame([("1", 1, "A", "C,G", 0, 2), ("1", 2, "A", "C", 1, None),
                               ("1", 3, "AT", "C", 0, 1), ("1", 4, "A", "C,GT", 0, 2)],
                              "chrom string, pos long, ref string, alt string, a1 int, a2 int")
    r = ql.resolve_bases(v).collect()
    assert [(x["pos"], x["n1"], x["n2"]) for x in r] == [(1, "A", "G")]
    j = spark.createDataFrame([("A", "G", "A", "A", "G"), ("A", "C", "A", "A", "G"),
                               ("A", "G", "T", "A", "G")],
                              "ref string, alt string, call_ref string, n1 string, n2 string")
    assert [(x["a1"], x["a2"]) for x in ql.recode_against(j).collect()] == [(0, 1)]
    twice = spark.createDataFrame([("1", 1, 5, "a"), ("1", 1, 9, "b"), ("1", 2, 1, "c")],
                                  "chrom string, pos long, line int, x string")
    assert sorted(r["x"] for r in ql.last_call(twice, "line").collect()) == ["b", "c"]


def test_injection_by_difference_equals_replacement(spark):
    rng = np.random.default_rng(5)
    pops = {s: f"P{1 + s // 10}" for s in range(30)}
    rows = [(s, p, loc, *(None if rng.random() < .1 else int(x) for x in rng.integers(0, 2, 2)))
            for s, p in pops.items() for loc in range(12)]
    g = spark.createDataFrame(rows, "sample int, pop string, locus int, a1 int, a2 int")
    samples = spark.createDataFrame(list(pops.items()), "sample int, pop string")
    plan = [("x", "P3", "P2", 0.3, 4), ("y", "P2", "P3", 0.01, 4)]
    m = inj.pick_migrants(samples, plan)
    rows = m.collect()
    assert sum(r["experiment"] == "x" for r in rows) == 3
    assert sum(r["experiment"] == "y" for r in rows) == 1
    assert all(pops[r["donor"]] == {"x": "P3", "y": "P2"}[r["experiment"]] for r in rows)
    order = ["P1", "P2", "P3"]
    fast = inj.injected_counts(g, ct.allele_table(g, order), m, ["x", "y", "none"], order)
    for e in ("x", "y"):
        slow = ct.allele_table(inj.inject_migrants(g, m.where(f"experiment = '{e}'")), order)
        assert (sorted(map(tuple, fast.where(f"experiment = '{e}'").drop("experiment").collect()))
                == sorted(map(tuple, slow.collect())))
    assert (sorted(map(tuple, fast.where("experiment = 'none'").drop("experiment").collect()))
            == sorted(map(tuple, ct.allele_table(g, order).collect())))


def test_build_matrix_from_files(spark):
    from alleleflow.plans.analyses import build_matrix
    from alleleflow.plans.contract import FEATURES
    rng = np.random.default_rng(7)
    names = [f"s{i}" for i in range(12)]
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(names) + "\n"

    def line(pos, alleles):
        gts = ["%d/%d" % tuple(rng.integers(0, alleles, 2)) for _ in names]
        alt = ",".join("CGT"[:alleles - 1])
        return f"1\t{pos}\t.\tA\t{alt}\t.\tPASS\t.\tGT\t" + "\t".join(gts) + "\n"
    popmap = write("".join(f"{s}\tp{i % 3}\n" for i, s in enumerate(names)))
    two = write(head + "".join(line(i, 2) for i in range(20)))
    a = build_matrix(spark, two, popmap, ["p2", "p0", "p1"], 6).orderBy("g").collect()
    b = build_matrix(spark, two, popmap, ["p2", "p0", "p1"], 6, True).orderBy("g").collect()
    assert [r["g"] for r in a] == [2, 3, 4, 5, 6] and list(a[0].asDict()) == FEATURES
    for x, y in zip(a, b):
        assert list(x) == pytest.approx(list(y), abs=1e-12)
    many = write(head + "".join(line(i, 4) for i in range(20)))
    richer = build_matrix(spark, many, popmap, ["p2", "p0", "p1"]).orderBy("g").collect()
    assert richer[-1]["g"] == 8 and richer[-1]["alpha_1_mean"] > 2
    with pytest.raises(ValueError):
        build_matrix(spark, two, popmap, ["p2", "p0", "other"])


def test_recode_and_count_in_one_shuffle(spark):
    rng = np.random.default_rng(8)
    bases = np.array(["A", "C", "G", None], dtype=object)
    rows = [("1", pos, s, f"P{1 + s % 3}", *(bases[i] for i in rng.choice(4, 2, p=[.5, .3, .02, .18])))
            for pos in range(40) for s in range(9)]
    calls = spark.createDataFrame(rows, "chrom string, pos int, sample_idx int, pop string, "
                                        "b1 string, b2 string")
    pops = ["P1", "P2", "P3"]
    slow = ct.allele_table(ql.recode_to_sites(calls, ql.major_minor(calls)), pops,
                           locus=("chrom", "pos", "ref", "alt"))
    fast = ql.major_minor_counts(calls, pops)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))
    assert 0 < fast.count() < 40


def test_missing_rows_become_missing_cells(spark):
    g = spark.createDataFrame([("1", 1, "A", "C", "b", 0, 1), ("1", 1, "A", "C", "e", 1, None),
                               ("1", 2, "A", "C", "a", 1, 1), ("1", 2, "A", "C", "f", 0, 0)],
                              "chrom string, pos int, ref string, alt string, sample string, "
                              "a1 int, a2 int")
    lines = {r["pos"]: r["value"].split("\t")[9:]
             for r in tx.format_vcf(g, list("abcdef")).collect()}
    assert lines[1] == ["./.", "0/1", "./.", "./.", "1/.", "./."]
    assert lines[2] == ["1/1", "./.", "./.", "./.", "./.", "0/0"]


def test_geno_line_is_split_before_its_cells_become_rows(spark):
    lines = spark.createDataFrame([("c1\t5\tA/C\tN\tG",), ("chrom\tpos\tx\ty\tz",)], "value string")
    calls = tx.parse_geno_lines(lines, ["x", "y", "z"])
    above = calls._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[0]
    assert "split(" not in above
    assert sorted((r["sample"], r["b1"], r["b2"]) for r in calls.collect()) == [("x", "A", "C"), ("y", None, None), ("z", "G", None)]


def test_samples_without_a_row_stay_apart_from_missing_calls(spark):
    kinds = "chrom string, pos bigint, ref string, alt string, sample string, a1 int, a2 int"
    rows = [("1", 1, "A", "C", "a", 0, 1), ("1", 1, "A", "C", "b", None, None), ("1", 2, "A", "C", "c", 1, None)]
    popmap = spark.createDataFrame([(s, "X") for s in "abc"], "sample string, pop string")
    lines = tx.format_vcf(spark.createDataFrame(rows, kinds), list("abc"), absent=".").select("value")
    back = tx.genotypes_from_vcf(tx.parse_vcf_lines(lines, 3), list("abc"), popmap, absent=".")
    columns = ["chrom", "pos", "ref", "alt", "sample", "a1", "a2"]
    assert sorted(map(tuple, back.select(columns).collect()), key=str) == sorted(rows, key=str)


def partly_called(spark):
    """Migrants 10 and 11, donors 20 and 21: at locus 1 all have rows, at 2 the first migrant has none,
    at 3 the first donor has none."""
    calls = {1: (10, 11, 20, 21), 2: (11, 20, 21), 3: (10, 11, 21)}
    rows = [(s, f"P{s // 10}", s + 100, loc, *((0, 0) if s < 20 else (1, 1 if s == 20 else None))) for loc, held in calls.items() for s in (*held, 0)]
    g = spark.createDataFrame(rows, "sample int, pop string, sample_idx int, locus int, a1 int, a2 int")
    g = g.withColumn("pop", F.when(F.col("sample") == 0, "P3").otherwise(F.col("pop")))
    m = spark.createDataFrame([("x", 10, 20, "P1"), ("x", 11, 21, "P1")], "experiment string, sample int, donor int, pop string")
    return g, m


def test_migrants_keep_their_rows_and_no_others(spark):
    g, m = partly_called(spark)
    out = inj.inject_migrants(g, m.drop("experiment"))
    got = {(r["locus"], r["sample"]): (r["pop"], r["sample_idx"], r["a1"], r["a2"]) for r in out.where("sample in (10, 11)").collect()}
    assert got == {(1, 10): ("P1", 110, 1, 1), (1, 11): ("P1", 111, 1, None), (2, 11): ("P1", 111, 1, None),
                   (3, 10): ("P1", 110, None, None), (3, 11): ("P1", 111, 1, None)}
    assert out.count() == g.count() and out.columns == g.columns


def test_counts_take_donors_only_where_the_migrant_has_a_row(spark):
    g, m = partly_called(spark)
    got = {r["locus"]: (r["c1_1"], r["c2_1"]) for r in inj.injected_counts(g, ct.allele_table(g, ["P1", "P2"]), m, ["x"], ["P1", "P2"]).collect()}
    assert got == {1: (0, 3), 2: (0, 1), 3: (0, 1)}
