"""Queries over every depth and every seed; their values are held against SQL in test_oracle."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["absence_probability", "allelic_richness", "private_richness", "pairwise_private_richness",
                                  "leave_one_block_out_features"])
def test_deeper_than_the_short_query(spark, name):
    short, whole = (entry.queries()[n](spark, SF).agg({"g": "max"}).first()[0] for n in (name, f"{name}_full"))
    assert whole > short


@pytest.mark.parametrize("name", ["majority_vote", "modal_class_by_block", "selective_accuracy", "bootstrap_interval"])
def test_every_seed(spark, name):
    assert {r[0] for r in entry.queries()[f"{name}_by_seed"](spark, SF).select("seed").distinct().collect()} == {0, 1, 2}
