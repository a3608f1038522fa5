"""Windows as a table: joined through bins, held against every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alleleflow.operators import intervals as iv
from alleleflow.sources import text as tx


def _tables(spark, n_sites, n_windows, seed, longest):
    rng = np.random.default_rng(seed)
    sites = [(f"c{rng.integers(3)}", int(p), i) for i, p in enumerate(rng.integers(0, 3_000_000, n_sites))]
    begs = rng.integers(-5, 3_000_000, n_windows)
    ends = begs + (longest ** rng.random(n_windows)).astype(int) - 1
    windows = [(i, f"c{rng.integers(3)}", int(b), int(e)) for i, (b, e) in enumerate(zip(begs, ends))]
    windows += [(10 ** 6, None, 0, 10), (10 ** 6 + 1, "c0", 9, 3), (10 ** 6 + 2, "c1", None, 4), (10 ** 6 + 3, "c1", -(10 ** 12), 10 ** 12)]
    return (sites, windows, spark.createDataFrame(sites, "chrom string, pos int, site int"),
            spark.createDataFrame(windows, "window_id int, chrom string, beg long, end long"))


@pytest.mark.parametrize("seed,longest", [(0, 50), (1, 40_000), (2, 2_500_000)])
def test_equals_every_pair(spark, seed, longest):
    sites, windows, s, w = _tables(spark, 400, 300, seed, longest)
    got = sorted((r["site"], r["window_id"]) for r in tx.scan_windows(s, w).collect())
    want = sorted((i, k) for c, p, i in sites for k, d, b, e in windows if c == d and b is not None and b <= p <= e)
    assert got == want and got


def test_edges_belong_to_a_window_and_bins_are_crossed(spark):
    edge = 1 << iv.FIRST_BITS
    s = spark.createDataFrame([("c", p) for p in (edge - 2, edge - 1, edge, edge + 1)], "chrom string, pos long")
    w = spark.createDataFrame([(1, "c", edge - 1, edge), (2, "c", edge, edge)], "window_id int, chrom string, beg long, end long")
    assert sorted(map(tuple, tx.scan_windows(s, w).select("pos", "window_id").collect())) == [(edge - 1, 1), (edge, 1), (edge, 2)]


def test_ten_thousand_windows_without_a_nested_loop(spark):
    _, _, s, w = _tables(spark, 2000, 10_000, 3, 100_000)
    plan = iv.join_windows(s, w.where("beg > -1000000"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and text.count("Join") >= 1
    assert iv.window_bins(w).groupBy("window_id").count().agg(F.max("count")).first()[0] <= 2
    # far fewer candidates than pairs
    assert plan.count() > 2000


def test_no_windows_and_clashing_columns(spark):
    _, _, s, w = _tables(spark, 10, 5, 4, 100)
    assert iv.join_windows(s, w.limit(0)).collect() == []
    with pytest.raises(ValueError):
        iv.join_windows(s.withColumn("window_id", F.lit(1)), w)


def test_windows_without_sites_stay(spark):
    _, windows, s, w = _tables(spark, 50, 40, 5, 100)
    out = iv.window_features(s, w, [F.count(F.lit(1)).alias("n")])
    assert out.count() == len(windows) and out.where("n IS NULL").count() > 0
