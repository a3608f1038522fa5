"""Connected components of an edge table by union steps that run as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleleflow.llm.shared import table


def connected_components(edges: DataFrame, what: str = "components") -> DataFrame:
    """edges (a, b), any order, repeats allowed. Returns (node, component) for every node with an
    edge to another one; component is the smallest node that can be reached.

    Alternates two steps until nothing changes: every node links its larger neighbours to its
    smallest neighbour, then its smaller ones. Minima are combined before they are shuffled, each
    step writes its edges to the shared folder, and the driver sees two numbers per round."""
    edges = table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), what)
    before = None
    while True:
        # larger neighbours to the smallest neighbour (itself included)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = table(large, what)
        # smaller neighbours and itself to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = table(small, what)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
