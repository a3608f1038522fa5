"""Cases that earlier went wrong."""

import pytest
from pyspark.sql import functions as F

from alleleflow.operators import metrics, quality
from alleleflow.operators import rarefaction as rf
from alleleflow.sources import text


def test_combinations_of_ten_populations():
    names = rf.combination_names(10)
    assert len(set(names)) == 2**10 - 1 and "private_10" in names and "private_1_10" in names
    absent = [f"q{j}" for j in range(1, 11)]
    assert rf._contribution("private_10", absent).count("1D") == 1
    assert "(1D - q10)" in rf._contribution("private_10", absent)
    assert rf._contribution("private_1_10", absent).count("1D") == 2
    assert rf._contribution("private_12", ["a", "b", "c"]) == "((1D - a) * (1D - b) * c)"


def test_thinning_to_one_site_and_ties(spark):
    rows = [("c1", 5, "A", x) for x in "TGC"] + [("c1", 9, "A", "T")]
    sites = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string")
    assert [r["alt"] for r in quality.thin_evenly(sites, 1).collect()] == ["C"]
    assert quality.thin_evenly(sites, 0).count() == 0
    capped = quality.cap_per_window(sites.withColumn("window_id", F.lit(1)), 2, 10)
    assert sorted(r["alt"] for r in capped.collect()) == ["C", "G"]


def test_histogram_of_one_value(spark):
    out = metrics.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 4).collect()
    assert [(r["bin"], r["n"]) for r in out] == [(0, 2)]


def test_files_with_other_samples_are_refused(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    (tmp_path / "a.vcf").write_text(head + "s1\ts2\n")
    assert text.vcf_samples(spark, str(tmp_path)) == ["s1", "s2"]
    (tmp_path / "b.vcf").write_text(head + "s2\ts1\n")
    with pytest.raises(ValueError, match="different samples"):
        text.vcf_samples(spark, str(tmp_path))


def test_allele_codes_beyond_999(spark):
    a, b = text.allele_codes(F.col("c"))
    rows = spark.createDataFrame([("1000/.",), ("0/1",)], "c string").select(a.alias("a"), b.alias("b")).collect()
    assert [tuple(r) for r in rows] == [(1000, None), (0, 1)]
