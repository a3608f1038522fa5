"""Labelled feature tables: written with their checks' columns, loaded with the checks counted in
the same pass that uses the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from alleleflow.functions.exprs import add
from alleleflow.functions.session import checkpointed
from alleleflow.plans.contract import CLASSES, CONTROL, FEATURES

LABELS = ["replicate", "direction", "magnitude"]


def write_labelled(rows: DataFrame, path: str) -> None:
    """replicate, direction, magnitude and the 28 feature columns as Parquet."""
    rows.select(*LABELS, *FEATURES).write.parquet(path)


#: Row checks: name and condition that makes a row unfit (SQL).
ROW_CHECKS = {
    "null_replicate": "replicate IS NULL",
    "bad_direction": f"direction IS NULL OR direction NOT IN ({', '.join(repr(c) for c in (*CLASSES, CONTROL))})",
    "bad_magnitude": "magnitude IS NULL OR isnan(magnitude) OR magnitude < 0",
    "control_with_flow": f"direction = {CONTROL!r} AND magnitude > 0",
    "direction_without_flow": f"direction <> {CONTROL!r} AND magnitude = 0",
    "bad_depth": "g IS NULL OR g < 2 OR g <> floor(g)",
}


def row_checks(features=FEATURES) -> list:
    """Aggregates that count the rows failing each check, and missing feature values."""
    missing = add([F.expr(f"int(`{c}` IS NULL OR isnan(double(`{c}`)))") for c in features])
    return [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.expr(c)).alias(n) for n, c in ROW_CHECKS.items()],
            F.count_if(missing > 0).alias("missing_feature")]


def group_checks(rows: DataFrame) -> DataFrame:
    """One row: replicates with two labels, with a depth twice, and with other depths than most. A
    replicate's depths are compared by count, sum and sum of squares and by a hash of the depths,
    so that nothing is collected per replicate."""
    per = rows.groupBy("replicate").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("g").alias("d"), F.sum(F.xxhash64(F.col("g").cast("double")).cast("decimal(38,0)")).alias("grid"),
        F.min("direction").alias("d0"), F.max("direction").alias("d1"), F.min("magnitude").alias("m0"), F.max("magnitude").alias("m1"))
    grids = per.groupBy("d", F.when(F.col("n") == F.col("d"), F.col("grid")).alias("grid")).agg(
        F.count(F.lit(1)).alias("replicates"), F.count_if(F.expr("d0 <> d1 OR m0 <> m1")).alias("two_labels"),
        F.count_if(F.col("n") > F.col("d")).alias("repeated_depth"))
    return grids.agg(F.coalesce(F.sum("replicates"), F.lit(0)).alias("n_replicates"), F.coalesce(F.sum("two_labels"), F.lit(0)).alias("two_labels"),
                     F.coalesce(F.sum("repeated_depth"), F.lit(0)).alias("repeated_depth"),
                     F.coalesce(F.sum("replicates") - F.max("replicates"), F.lit(0)).alias("unequal_grid"))


def checked(rows: DataFrame, allow=()) -> DataFrame:
    """`rows` (labels and features) cut from their lineage and checked. Row checks are counted by an
    observation while the rows are written; checks per replicate follow from the written rows. Any
    failure whose name is not in `allow` raises a ValueError that gives all counts. An empty table
    raises too."""
    seen = Observation(f"labelled-{uuid.uuid4().hex}")
    kept = checkpointed(rows.select(*LABELS, *FEATURES).observe(seen, *row_checks()))
    counts = dict(seen.get) | group_checks(kept).first().asDict()
    bad = {n: c for n, c in counts.items() if n not in ("n_rows", "n_replicates") and c and n not in allow}
    if bad or not counts["n_rows"]:
        found = ", ".join(f"{n}: {c}" for n, c in sorted(bad.items())) or "no rows"
        raise ValueError(f"unfit labelled dataset ({found}; {counts['n_rows']} rows, {counts['n_replicates']} replicates)")
    return kept


def load_labelled(spark: SparkSession, path: str, allow=()) -> DataFrame:
    """A stored labelled dataset, checked: replicate, direction, magnitude and the 28 columns."""
    return checked(spark.read.parquet(path), allow)


def check_report(rows: DataFrame) -> DataFrame:
    """(check, failures) of every check, for tables that shall be looked at rather than refused."""
    first = rows.agg(*row_checks())
    one = first.crossJoin(F.broadcast(group_checks(rows)))          # two single rows
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("failures")) for c in one.columns])))
