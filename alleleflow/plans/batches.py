"""Results that grow by batches: mergeable states stored as tables, so that a new batch is added
without reading the old ones, and pooled results come from the states alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alleleflow.functions.exprs import ratio
from alleleflow.functions.ordered import prefix_sums
from alleleflow.operators import rarefaction as rf
from alleleflow.plans.contract import BLOCKS, FEATURES


def add_batch(state: DataFrame, path: str, batch: str) -> None:
    """Store a batch's state. A batch that is there already is refused, as it would count twice."""
    state.write.mode("error").parquet(f"{path}/batch={batch}")


def pooled(spark: SparkSession, path: str, keys, batches=None) -> DataFrame:
    """The states of all (or some) batches added up per `keys`."""
    keys = list(keys)
    states = spark.read.option("basePath", path).parquet(path)
    if batches is not None:
        states = states.where(F.col("batch").cast("string").isin([str(b) for b in batches]))
    sums = [c for c in states.columns if c not in (*keys, "batch")]
    return states.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


# ------------------------------------------------------------------ moments over loci

def moment_state(counts: DataFrame, max_depth: int | None = None, keys=()) -> DataFrame:
    """Power sums of the contract's statistics per (keys, g); loci of different batches must differ.
    Depth 0 carries the number of loci, so pooling keeps the depths that every locus of every batch
    reaches."""
    return rf.depth_sums(counts, max_depth, keys, BLOCKS)


def pooled_matrix(spark: SparkSession, path: str, keys=(), batches=None) -> DataFrame:
    """The feature matrix of all loci of the stored batches together."""
    keys = list(keys)
    return rf.finalise(pooled(spark, path, [*keys, "g"], batches), keys, BLOCKS).select(*keys, *FEATURES)


# ------------------------------------------------------------------ scores against outcomes

def score_state(scored: DataFrame, y: str = "y", p: str = "p", keys=()) -> DataFrame:
    """Outcomes per distinct score: what AUC, calibration and Brier score need. Rows without score
    or outcome are left out."""
    known = scored.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(*keys, F.col(p).alias("p")).agg(
        F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum(1 - F.col(y).cast("bigint")).alias("neg"))


def score_metrics(state: DataFrame, keys=(), bins: int = 10) -> DataFrame:
    """n, auc, ece and brier per keys from a score state."""
    keys = list(keys)
    s = prefix_sums(state, "p", {"pos": F.sum("pos"), "neg": F.sum("neg")}, keys)
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2))
    pairs = F.first("pos_total").cast("double") * F.first("neg_total")
    auc = s.groupBy(*keys).agg(ratio(wins, pairs).alias("auc"))
    step, n = 1.0 / bins, F.col("pos") + F.col("neg")
    near = F.floor(F.col("p") * bins)
    exact = near - (F.col("p") < near * step).cast("int") + (F.col("p") >= (near + 1) * step).cast("int")
    per_bin = state.groupBy(*keys, F.least(exact, F.lit(bins - 1)).alias("bin")).agg(
        F.sum(n).alias("n"), F.sum("pos").alias("pos"), F.sum(n * F.col("p")).alias("sp"),
        F.sum(F.col("pos") * (1 - F.col("p")) ** 2 + F.col("neg") * F.col("p") ** 2).alias("sq"))
    rest = per_bin.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.abs(F.col("pos") - F.col("sp"))) / F.sum("n")).alias("ece"),
                                      (F.sum("sq") / F.sum("n")).alias("brier"))
    return rest.join(auc, keys) if keys else rest.crossJoin(F.broadcast(auc))      # one row each
