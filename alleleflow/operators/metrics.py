"""Evaluation metrics as aggregations. Order-based ones use `prefix_sums`, so neither a hot
score nor a long table of distinct scores ends up in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleleflow.functions.exprs import hash_order, poisson_one, ratio
from alleleflow.functions.ordered import exact_median, prefix_sums, value_splits
from alleleflow.operators.protocol import rate_bands


def roc_auc(df: DataFrame, y: str = "y", p: str = "p", keys=(),
            splits: list[float] | None = None) -> DataFrame:
    """Exact area under the ROC curve; a tie counts one half. NULL with a single class."""
    s = prefix_sums(df, p, {"pos": F.sum(F.col(y).cast("bigint")),
                            "neg": F.sum((1 - F.col(y)).cast("bigint"))}, keys, splits=splits)
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2))
    pairs = F.first("pos_total").cast("double") * F.first("neg_total")
    return s.groupBy(*keys).agg(ratio(wins, pairs).alias("auc"))


def calibration_bins(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10,
                     keys=()) -> DataFrame:
    """Size, mean outcome and mean score per equal-width bin; the last bin includes 1. Lower edges are
    k * (1 / bins) in double precision, so 0.3 lies below the fourth of ten bins."""
    step = 1.0 / bins
    near = F.floor(F.col(p) * bins)
    exact = near - (F.col(p) < near * step).cast("int") + (F.col(p) >= (near + 1) * step).cast("int")
    b = F.least(exact, F.lit(bins - 1)).cast("int")
    return (df.withColumn("bin", b).groupBy(*keys, "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("mean_y"),
                 F.avg(p).alias("mean_p")))


def calibration_error(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10,
                      keys=()) -> DataFrame:
    """Expected calibration error: |mean outcome - mean score| weighted by bin size."""
    gap = F.abs(F.col("mean_y") - F.col("mean_p")) * F.col("n")
    return (calibration_bins(df, y, p, bins, keys).groupBy(*keys)
            .agg((F.sum(gap) / F.sum("n")).alias("ece")))


def brier_score(df: DataFrame, y: str = "y", p: str = "p", keys=()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))


def confusion_matrix(df: DataFrame, truth: str = "direction", call: str = "call",
                     keys=()) -> DataFrame:
    return df.groupBy(*keys, F.col(truth).alias("truth"), F.col(call).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def pair_confusion(confusion: DataFrame, keys=()) -> DataFrame:
    """Errors between each unordered pair of classes, both ways added."""
    return (confusion.where(F.col("truth") != F.col("predicted"))
            .groupBy(*keys, F.least("truth", "predicted").alias("first"),
                     F.greatest("truth", "predicted").alias("second"))
            .agg(F.sum("n").alias("n")))


def macro_f1(confusion: DataFrame, labels, keys=()) -> DataFrame:
    """Mean over `labels` of F1 (0 for a class never seen and never predicted)."""
    per = []
    for x in labels:
        tp = F.sum(F.when((F.col("truth") == x) & (F.col("predicted") == x), F.col("n"))
                   .otherwise(0))
        t = F.sum(F.when(F.col("truth") == x, F.col("n")).otherwise(0))
        q = F.sum(F.when(F.col("predicted") == x, F.col("n")).otherwise(0))
        per.append(F.coalesce(ratio(2.0 * tp, (t + q).cast("double")), F.lit(0.0)))
    total = per[0]
    for x in per[1:]:
        total = total + x
    return confusion.groupBy(*keys).agg((total / len(labels)).alias("macro_f1"))


def relative_error(df: DataFrame, pred_log: str, true_log: str, keys=("band",),
                   floor: float | None = None) -> DataFrame:
    """Mean and exact median of |10^pred - 10^true| / 10^true per key. With `floor` the
    denominator is at least that and the mean is in percent."""
    truth = F.pow(F.lit(10.0), F.col(true_log))
    den = truth if floor is None else F.greatest(F.abs(truth), F.lit(floor))
    err = df.withColumn("_e", F.abs(F.pow(F.lit(10.0), F.col(pred_log)) - truth) / den)
    mean = err.groupBy(*keys).agg(
        (F.avg("_e") * (1 if floor is None else 100)).alias("mean_relative_error"),
        F.count(F.lit(1)).alias("n"))
    median = exact_median(err, "_e", keys, "median_relative_error")
    return mean.join(median, list(keys)) if keys else mean.crossJoin(median)   # one row each


def spearman(df: DataFrame, x: str, y: str, keys=()) -> DataFrame:
    """Spearman correlation with average ranks for ties. Pairs are first collapsed to distinct
    (x, y) with a weight; ranks come from distinct values and are joined back."""
    keys = list(keys)
    pairs = (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
             .groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
             .agg(F.count(F.lit(1)).alias("_w")))

    cuts = dict(zip(("_x", "_y"), value_splits(df.where(F.col(x).isNotNull()), [x, y])))

    def ranks(value):
        p = prefix_sums(pairs, value, {"n": F.sum("_w")}, keys, splits=cuts[value])
        centred = F.col("n_below") + (F.col("n") + 1) / 2 - (F.col("n_total") + 1) / 2
        return p.select(*keys, value, centred.alias(f"{value}_r"))

    j = (pairs.join(ranks("_x"), [*keys, "_x"]).join(ranks("_y"), [*keys, "_y"])
         if keys else pairs.join(ranks("_x"), "_x").join(ranks("_y"), "_y"))
    w, rx, ry = F.col("_w"), F.col("_x_r"), F.col("_y_r")
    cov, vx, vy = F.sum(w * rx * ry), F.sum(w * rx * rx), F.sum(w * ry * ry)
    return j.groupBy(*keys).agg(ratio(cov, F.sqrt(vx) * F.sqrt(vy)).alias("spearman"),
                                F.sum(w).alias("n"))


def selective_accuracy(calls: DataFrame, confidence: str = "confidence",
                       truth: str = "direction", call: str = "call",
                       drop=(0.0, 0.25, 0.5), keys=("band",)) -> DataFrame:
    """Accuracy after abstaining on the least confident share. A confidence value is dropped
    only if all its rows lie in that share, so ties stay together."""
    s = prefix_sums(calls, confidence, {
        "n": F.count(F.lit(1)),
        "hits": F.sum((F.col(call) == F.col(truth)).cast("bigint"))}, keys)
    s = s.withColumn("dropped", F.explode(F.array(*[F.lit(float(d)) for d in drop])))
    kept = s.where(F.col("n_below") + F.col("n") > F.col("dropped") * F.col("n_total"))
    return kept.groupBy(*keys, "dropped").agg(
        (F.sum("hits") / F.sum("n")).alias("accuracy"), F.sum("n").alias("n_kept"))


def bootstrap_interval(hits: DataFrame, hit: str = "hit", unit: str = "replicate",
                       rounds: int = 200, seed: int = 0, keys=("band",),
                       level: float = 0.95) -> DataFrame:
    """Percentile interval of an accuracy by Poisson bootstrap. Every unit draws its weights
    from a hash, so the draw does not depend on how rows are partitioned, and the rounds are
    combined map-side: only rounds x keys rows are shuffled."""
    u = F.conv(F.substring(hash_order(seed, unit, "_b"), 1, 8), 16, 10).cast("bigint") / F.lit(
        4294967296.0)
    rows = (hits.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
            .withColumn("_w", poisson_one(u)))
    per_round = rows.groupBy(*keys, "_b").agg(
        ratio(F.sum(F.col("_w") * F.col(hit)).cast("double"), F.sum("_w")).alias("_a"))
    tail = (1 - level) / 2
    # `rounds` values per key
    return per_round.groupBy(*keys).agg(
        F.percentile("_a", F.lit(tail)).alias("low"),
        F.percentile("_a", F.lit(1 - tail)).alias("high"), F.avg("_a").alias("mean"))


def feature_shift(real: DataFrame, train: DataFrame, features) -> DataFrame:
    """Median over features of |mean_real - mean_train| / sd_train."""
    t = train.agg(*[F.expr(f"avg({c}) AS m_{c}") for c in features],
                  *[F.expr(f"stddev_pop({c}) AS s_{c}") for c in features])
    r = real.agg(*[F.expr(f"avg({c}) AS r_{c}") for c in features])
    both = t.crossJoin(F.broadcast(r))                    # one row each
    shift = ", ".join(f"abs(r_{c} - m_{c}) / if(s_{c} <> 0, s_{c}, NULL)" for c in features)
    return both.selectExpr(f"explode(array({shift})) AS _z").agg(
        F.percentile("_z", F.lit(0.5)).alias("median_shift"), F.count("_z").alias("n_features"))


def seed_summary(values: DataFrame, value: str, keys=("metric",)) -> DataFrame:
    return values.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def banded_relative_error(df: DataFrame, pred_log: str, true_log: str,
                          magnitude: str = "magnitude") -> DataFrame:
    return relative_error(rate_bands(df, magnitude), pred_log, true_log, ("band",))


def histogram(df: DataFrame, value: str, bins: int, pad: float = 0.0) -> DataFrame:
    """Counts over `bins` equal bins between min - pad and max + pad."""
    edges = df.agg((F.min(value) - pad).alias("_lo"), (F.max(value) + pad).alias("_hi"))
    spread = F.col("_hi") - F.col("_lo")
    width = F.when(spread == 0, F.lit(1.0)).otherwise(spread) / bins      # one value: the first bin
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    return (df.crossJoin(F.broadcast(edges))              # one row
            .groupBy(b.alias("bin"), (F.col("_lo") + b * width).alias("left_edge"))
            .agg(F.count(F.lit(1)).alias("n")))
