"""Replicate-grouped evaluation: folds, replicate means, calls, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alleleflow.functions.exprs import argmax_label, hash_order
from alleleflow.functions.ordered import hash_rank
from alleleflow.plans.contract import APPRECIABLE, CLASSES, CONTROL, FIXED_RATES


def group_folds(df: DataFrame, group: str = "replicate", k: int = 5,
                seeds=(0,)) -> DataFrame:
    """(seed, group, fold): whole groups in shuffled, equally filled folds. The shuffle is the
    md5 order of 'seed:group', ranked in hash buckets, so it works for any number of groups."""
    seed = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    groups = df.select(group).distinct().select(seed, group)
    hashed = groups.withColumn("_h", hash_order(F.col("seed"), group))
    return (hash_rank(hashed, "_h", ["seed"])
            .select("seed", group, ((F.col("rank") - 1) % k).cast("int").alias("fold")))


def with_folds(df: DataFrame, group: str = "replicate", k: int = 5, seeds=(0,)) -> DataFrame:
    """Rows with one `fold_<seed>` column per seed, so that rows are not repeated per seed."""
    long = group_folds(df, group, k, seeds)
    wide = long.groupBy(group).agg(*[
        F.max(F.when(F.col("seed") == s, F.col("fold"))).alias(f"fold_{s}") for s in seeds])
    return df.join(wide, group)


def replicate_labels(rows: DataFrame, order: str, group: str = "replicate",
                     labels=("direction", "magnitude")) -> DataFrame:
    """Labels of each replicate's first row in `order`."""
    return rows.groupBy(group).agg(*[F.min_by(c, order).alias(c) for c in labels])


def replicate_probabilities(preds: DataFrame, cols, keys=("replicate",)) -> DataFrame:
    """Mean class probabilities per replicate; a replicate without rows is absent."""
    return preds.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def replicate_call(probs: DataFrame, cols, labels=CLASSES) -> DataFrame:
    return probs.withColumn("call", argmax_label(cols, labels))


def band_names(magnitude: str = "magnitude") -> Column:
    """Names of all (overlapping) rate bands a rate belongs to."""
    m = F.col(magnitude)
    named = [F.when(F.abs(m - r) <= r * 1e-3, F.lit(f"{r:.1e}")) for r in FIXED_RATES]
    named += [F.when(m >= APPRECIABLE, F.lit("appreciable")), F.lit("overall")]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def rate_bands(df: DataFrame, magnitude: str = "magnitude") -> DataFrame:
    """One row per band a row belongs to. Bands without rows do not appear."""
    return df.withColumn("band", F.explode(band_names(magnitude)))


def banded_accuracy(calls: DataFrame, truth: str = "direction", call: str = "call") -> DataFrame:
    """Per band: accuracy in percent over non-control replicates, averaged over seeds."""
    hit = (F.col(call) == F.col(truth)).cast("double")
    per_seed = (rate_bands(calls.where(F.col(truth) != CONTROL))
                .groupBy("band", "seed").agg(F.avg(hit).alias("_a"),
                                             F.count(F.lit(1)).alias("_n")))
    return per_seed.groupBy("band").agg((F.avg("_a") * 100).alias("accuracy"),
                                        F.max("_n").alias("n"))


def gate_rows(rows: DataFrame, which: str = "band") -> DataFrame:
    """Training rows of the detection gate with label `y`: only control or appreciable rows
    ('band') or every row ('all')."""
    flows = (F.col("direction") != CONTROL) & (F.col("magnitude") >= APPRECIABLE)
    out = rows.withColumn("y", flows.cast("int"))
    if which == "all":
        return out
    return out.where((F.col("direction") == CONTROL) | (F.col("magnitude") >= APPRECIABLE))


def gated_call(probs: DataFrame, cols, gate: str = "gate", threshold: float = 0.5,
               labels=CLASSES) -> DataFrame:
    """Detect, then orient: a direction only where the gate passes, otherwise NULL."""
    return probs.withColumn("call", F.when(F.col(gate) >= threshold, argmax_label(cols, labels)))


def depth_cap(rows: DataFrame, g_max: int) -> DataFrame:
    return rows.where(F.col("g") <= g_max)


def majority_vote(preds: DataFrame, labels=CLASSES, keys=("replicate",),
                  call: str = "call") -> DataFrame:
    """Most frequent call per key (first label wins ties), from one count per label."""
    n = [F.sum((F.col(call) == x).cast("int")).alias(f"n_{x}") for x in labels]
    out = preds.groupBy(*keys).agg(*n)
    return out.withColumn("vote", argmax_label([f"n_{x}" for x in labels], labels))


def leakage_audit(rows: DataFrame, test_share: float = 0.2, seed: int = 0,
                  group: str = "replicate", row_key=("replicate", "g")) -> DataFrame:
    """Share of groups with rows in both train and test under a row-level split, beside the
    expectation 1 - (1-p)^n - p^n averaged over groups."""
    from alleleflow.functions.exprs import hash_uniform
    test = (hash_uniform(seed, *row_key) < test_share).cast("int")
    per = (rows.withColumn("_t", test).groupBy(group)
           .agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"),
                F.count(F.lit(1)).alias("_n")))
    expected = (1 - F.pow(F.lit(1 - test_share), F.col("_n"))
                - F.pow(F.lit(test_share), F.col("_n")))
    return per.agg(F.avg((F.col("_lo") != F.col("_hi")).cast("double")).alias("shared"),
                   F.avg(expected).alias("expected"), F.count(F.lit(1)).alias("n_groups"))
