"""Stored site tables and the packed last call."""

import pytest
from pyspark.sql import functions as F

from alleleflow.operators import quality as ql
from alleleflow.sources import sitestore as ss


@pytest.fixture(scope="module")
def calls(spark):
    rows = [("c", p, "ACGT"[p % 4], ["C", "A,T", "G,GG", "."][p % 3], a, b, 10 * p + k)
            for p in range(60) for k, (a, b) in enumerate([(0, 1), (1, 1), (p % 3, None if p % 7 == 0 else p % 2)][:1 + p % 3])]
    rows += [("c", 100, "AC", "G", 0, 0, 1), ("c", 101, "a", "G", 0, 1, 1), ("c", 102, None, "G", 1, 1, 5)]
    return spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, a1 int, a2 int, line_no long")


def test_packed_last_call_equals_the_struct(calls):
    upper = calls.where("pos <> 101 AND pos <> 102")
    want = ql.resolve_bases(ql.last_call(upper, "line_no")).select("chrom", "pos", F.col("ref").alias("call_ref"), "n1", "n2")
    got = ql.last_bases(calls, "line_no")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_an_order_beyond_the_long_is_refused(calls):
    with pytest.raises(Exception, match="51 bits"):
        ql.last_bases(calls.withColumn("line_no", F.lit(1 << 51)), "line_no").collect()


def test_stored_tables_join_without_exchange(spark, calls):
    last = ql.last_bases(calls, "line_no")
    panel = calls.select("chrom", "pos").distinct().withColumn("id", F.col("pos") * 2)
    for name, df in (("t_panel", panel), ("t_x", last), ("t_y", last.where("pos % 2 = 0"))):
        ss.write_store(df, name, 4)
    try:
        out = ss.intersect_stores(spark, "t_panel", {"x": "t_x", "y": "t_y"})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortAggregate" not in plan and plan.count("SortMergeJoin") == 2
        got = sorted(map(tuple, out.select("pos", "id", "x_n1", "y_n2").collect()))
        sets = {"x": last, "y": last.where("pos % 2 = 0")}
        want = ql.intersect_positions(panel, sets).select("pos", "id", "x_n1", "y_n2").collect()
        assert got == sorted(map(tuple, want)) and got
    finally:
        for name in ("t_panel", "t_x", "t_y"):
            ss.drop_store(spark, name)
