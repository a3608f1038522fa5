"""Labelled datasets: what is loaded, and what is refused with counts."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from alleleflow.plans.contract import FEATURES, STATISTICS
from alleleflow.sources import labelled as lb


@pytest.fixture(scope="module")
def good(spark):
    rows = [(r, "ABCD"[r % 4], 0.0 if r % 4 == 3 else 1e-3, g, *[0.5 * r + g] * len(STATISTICS)) for r in range(12) for g in range(2, 8)]
    cols = ", ".join(f"{c} double" for c in STATISTICS)
    return spark.createDataFrame(rows, f"replicate int, direction string, magnitude double, g int, {cols}").persist()


def test_round_trip(spark, good):
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "labelled")
    lb.write_labelled(good.withColumn("extra", F.lit(1)), path)
    got = lb.load_labelled(spark, path)
    assert got.columns == [*lb.LABELS, *FEATURES]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, good.select(*lb.LABELS, *FEATURES).collect()))


def at(column, value, where):
    return lambda df: df.withColumn(column, F.when(F.expr(where), F.lit(value)).otherwise(F.col(column)))


@pytest.mark.parametrize("check,count,change", [
    ("bad_direction", 6, at("direction", "E", "replicate = 1")),
    ("bad_direction", 6, at("direction", None, "replicate = 1")),
    ("bad_magnitude", 1, at("magnitude", float("nan"), "replicate = 1 AND g = 2")),
    ("bad_magnitude", 6, at("magnitude", -1.0, "replicate = 2")),
    ("control_with_flow", 6, at("magnitude", 1.0, "replicate = 3")),
    ("direction_without_flow", 6, at("magnitude", 0.0, "replicate = 4")),
    ("bad_depth", 1, at("g", 1, "replicate = 5 AND g = 2")),
    ("null_replicate", 6, at("replicate", None, "replicate = 0")),
    ("missing_feature", 1, at("pi_1_mean", None, "replicate = 6 AND g = 3")),
    ("missing_feature", 1, at("pi_1_mean", float("nan"), "replicate = 6 AND g = 3")),
    ("two_labels", 1, at("direction", "B", "replicate = 6 AND g = 3")),
    ("repeated_depth", 1, lambda df: df.unionByName(df.where("replicate = 7 AND g = 4"))),
    ("unequal_grid", 1, lambda df: df.where("NOT (replicate = 8 AND g = 4)")),
    ("unequal_grid", 2, lambda df: at("g", 9, "replicate IN (8, 9) AND g = 7")(df)),
])
def test_what_is_refused(good, check, count, change):
    bad = change(good)
    with pytest.raises(ValueError, match=rf"\b{check}: {count}\b"):
        lb.checked(bad)
    assert {r["check"]: r["failures"] for r in lb.check_report(bad).collect()}[check] == count


def test_allowed_failures_and_empty_tables(good):
    some = good.where("NOT (replicate = 8 AND g = 4)")
    assert lb.checked(some, allow=["unequal_grid"]).count() == good.count() - 1
    with pytest.raises(ValueError, match="no rows"):
        lb.checked(good.limit(0))
    assert all(r["failures"] == (72 if r["check"] == "n_rows" else 12 if r["check"] == "n_replicates" else 0) for r in lb.check_report(good).collect())
