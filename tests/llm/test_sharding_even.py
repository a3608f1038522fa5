"""Cuts under the smallest capacity spread what is left evenly."""

import numpy as np

from alleleflow.llm import sharding
from alleleflow.llm.shared import table


def test_even_cuts_are_feasible():
    rng = np.random.default_rng(4)
    for _ in range(300):
        sizes = rng.integers(1, 1000, rng.integers(1, 60)) ** rng.integers(1, 3)
        shards = int(rng.integers(1, 30))
        capacity = sharding.smallest_capacity(sizes, shards)
        cuts = [0, *sharding.even(np.cumsum(sizes), capacity, shards)]
        assert len(cuts) == shards + 1 and cuts[-1] == len(sizes) and sorted(cuts) == cuts
        assert max(sizes[a:b].sum() for a, b in zip(cuts, cuts[1:])) == capacity


def test_no_empty_shard_beside_a_large_text(spark):
    rows = [(k, f"text {k} " * 20) for k in range(400)]
    large = "x" * (sum(len(t) for _, t in rows) // 2)
    docs = table(spark.createDataFrame(rows + [(1000, large)], "doc_id long, text string"), "docs")
    sizes = {r["shard"]: r["sum(size)"] for r in sharding.assign(docs, 24).groupBy("shard").sum("size").collect()}
    assert set(sizes) == set(range(24)) and max(sizes.values()) == len(large) + 8
