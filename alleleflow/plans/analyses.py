"""Analyses composed from the operators. Model fitting collects coefficients only; every table
that grows with the data stays a DataFrame."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleleflow.functions.session import checkpointed, small_side
from alleleflow.operators import boosting as bo, classical, counts as ct, heads as hd, inject, kernel as kn
from alleleflow.operators import metrics as mt, protocol as pr, quality, rarefaction as rf
from alleleflow.plans.contract import (
    APPRECIABLE, CLASSES, CONTROL, FEATURES, MOMENT_SETS, STATISTICS, validate_populations)
from alleleflow.sources import text

P = [f"p_{c}" for c in CLASSES]


# ------------------------------------------------------------------ out-of-fold evaluation

def out_of_fold(rows: DataFrame, features, label: str, labels, head: str = "logistic",
                seeds=(0, 1, 2), k: int = 5, **options) -> DataFrame:
    """Scores of held-out rows. `rows` carries `fold_<seed>` columns. Heads of all seeds and folds
    are fitted together."""
    if head == "boosted":
        return bo.boosted_out_of_fold(rows, features, label, labels, seeds, k, **options)
    if head == "discriminant":
        fitted = hd.discriminant_by_fold(rows, features, label, seeds)
    elif head == "logistic":
        fitted = hd.logistic_by_fold(rows, features, label, labels, seeds, k, **options)
    else:
        raise ValueError(f"unknown head {head!r}")
    return hd.apply_by_fold(hd.explode_seeds(rows, seeds), fitted)


def folded(rows: DataFrame, seeds=(0, 1, 2), k: int = 5) -> DataFrame:
    """Rows with folds over all replicates, controls included, cut from their lineage."""
    return checkpointed(pr.with_folds(rows, "replicate", k, seeds))


def replicate_means(preds: DataFrame, cols) -> DataFrame:
    """Mean scores per seed and replicate with the labels of its first depth."""
    return preds.groupBy("seed", "replicate").agg(
        *[F.avg(c).alias(c) for c in cols],
        *[F.min_by(c, "g").alias(c) for c in ("direction", "magnitude")])


def direction_calls(folds: DataFrame, features=FEATURES, head: str = "logistic",
                    seeds=(0, 1, 2), k: int = 5, **options) -> DataFrame:
    rows = folds.where(F.col("direction") != CONTROL)
    preds = out_of_fold(rows, features, "direction", CLASSES, head, seeds, k, **options)
    return pr.replicate_call(replicate_means(preds, P), P)


def direction_table(rows: DataFrame, head: str = "logistic", seeds=(0, 1, 2), k: int = 5,
                    features=FEATURES, **options) -> DataFrame:
    """Direction accuracy per rate band, replicate-grouped and averaged over seeds."""
    return pr.banded_accuracy(direction_calls(folded(rows, seeds, k), features, head, seeds, k,
                                              **options))


def gate_scores(folds: DataFrame, features=FEATURES, head: str = "logistic", seeds=(0, 1, 2),
                k: int = 5, which: str = "band", **options) -> DataFrame:
    """Held-out gate score per seed and replicate with its label `y`."""
    rows = pr.gate_rows(folds, which)
    if head == "discriminant":
        preds = out_of_fold(rows, features, "y", [0, 1], head, seeds, k)
        score = "p_1"
    else:
        preds = out_of_fold(rows, features, "y", None, head, seeds, k, **options)
        score = "p_gate"
    reps = replicate_means(preds, [score]).withColumnRenamed(score, "p")
    flows = (F.col("direction") != CONTROL) & (F.col("magnitude") >= APPRECIABLE)
    return reps.withColumn("y", flows.cast("int"))


def gate_report(rows: DataFrame, head: str = "logistic", seeds=(0, 1, 2), k: int = 5,
                which: str = "band", **options) -> DataFrame:
    """Mean and spread over seeds of ROC-AUC (all scored and appreciable rates only),
    calibration error and Brier score of the gate."""
    s = checkpointed(gate_scores(folded(rows, seeds, k), FEATURES, head, seeds, k, which,
                                 **options))
    near = s.where((F.col("direction") == CONTROL) | (F.col("magnitude") >= APPRECIABLE))

    def tagged(df, name, value):
        return df.select("seed", F.lit(name).alias("metric"), F.col(value).alias("value"))
    per_seed = (tagged(mt.roc_auc(s, keys=["seed"]), "roc_auc_all", "auc")
                .unionByName(tagged(mt.roc_auc(near, keys=["seed"]), "roc_auc_appreciable", "auc"))
                .unionByName(tagged(mt.calibration_error(s, keys=["seed"]), "ece", "ece"))
                .unionByName(tagged(mt.brier_score(s, keys=["seed"]), "brier", "brier")))
    return mt.seed_summary(per_seed, "value")


def subset_ablation(rows: DataFrame, subsets=None, seeds=(0, 1, 2), k: int = 5,
                    head: str = "logistic") -> DataFrame:
    """Accuracy per column subset (moment or channel sets): overall, appreciable and the B-C
    confusion of the first seed. With the discriminant head all subsets are cut out of one set
    of moment matrices."""
    subsets = subsets or MOMENT_SETS
    folds = folded(rows, seeds, k)
    train = folds.where(F.col("direction") != CONTROL)
    moments = None
    if head == "discriminant":
        sums = hd.moment_sums(train, FEATURES, ["direction"], seeds)
        moments = hd.leave_fold_out(hd.collect_moments(
            sums, ["seed", "fold", "direction"], len(FEATURES) + 1))
    out = None
    for name, cols in subsets.items():
        if moments is None:
            calls = direction_calls(folds, cols, head, seeds, k)
        else:
            at = [0] + [1 + FEATURES.index(c) for c in cols]
            fitted = {sf: hd.discriminant_from_moments(
                {c: m[at][:, at] for c, m in by.items()}, cols) for sf, by in moments.items()}
            preds = hd.apply_by_fold(hd.explode_seeds(train, seeds), fitted)
            calls = pr.replicate_call(replicate_means(preds, P), P)
        calls = calls.withColumn("subset", F.lit(name))
        out = calls if out is None else out.unionByName(calls)
    hit = (F.col("call") == F.col("direction")).cast("int")
    near = F.col("magnitude") >= APPRECIABLE
    mixed = F.concat(F.least("call", "direction"), F.greatest("call", "direction")) == "BC"
    per_seed = out.groupBy("subset", "seed").agg(
        F.avg(hit).alias("o"), F.avg(F.when(near, hit)).alias("a"),
        F.sum(mixed.cast("int")).alias("bc"))
    first = F.col("seed") == min(seeds)
    return per_seed.groupBy("subset").agg(
        (F.avg("o") * 100).alias("overall"), (F.avg("a") * 100).alias("appreciable"),
        F.max(F.when(first, F.col("bc"))).alias("bc_confusion"))


def depth_requirement(rows: DataFrame, caps=(4, 6, 10, 199), seeds=(0, 1, 2),
                      k: int = 5) -> DataFrame:
    """Appreciable accuracy and gate AUC of the discriminant for each depth cap. Moments are
    taken once per depth interval and added up to every cap."""
    caps = sorted(caps)
    folds = folded(rows, seeds, k)
    interval = F.coalesce(*[F.when(F.col("g") <= c, F.lit(c)) for c in caps])
    folds = folds.withColumn("cap", interval).where(F.col("cap").isNotNull())

    def cumulative(df, label):
        sums = hd.moment_sums(df, FEATURES, [label, "cap"], seeds)
        held = hd.collect_moments(sums, ["seed", "fold", label, "cap"], len(FEATURES) + 1)
        out = {}
        for c in caps:
            part: dict = {}
            for (s, f, y, at), m in held.items():
                if at <= c:
                    part[(s, f, y)] = part.get((s, f, y), 0) + m
            out[c] = {sf: hd.discriminant_from_moments(by, FEATURES)
                      for sf, by in hd.leave_fold_out(part).items()}
        return out

    oriented = folds.where(F.col("direction") != CONTROL)
    gated = pr.gate_rows(folds)
    by_direction, by_gate = cumulative(oriented, "direction"), cumulative(gated, "y")
    calls = scores = None
    for c in caps:
        d = hd.apply_by_fold(hd.explode_seeds(pr.depth_cap(oriented, c), seeds), by_direction[c])
        d = pr.replicate_call(replicate_means(d, P), P).withColumn("g_max", F.lit(c))
        g = hd.apply_by_fold(hd.explode_seeds(pr.depth_cap(gated, c), seeds), by_gate[c])
        g = replicate_means(g, ["p_1"]).withColumn("g_max", F.lit(c))
        calls = d if calls is None else calls.unionByName(d)
        scores = g if scores is None else scores.unionByName(g)
    flows = (F.col("direction") != CONTROL) & (F.col("magnitude") >= APPRECIABLE)
    accuracy = (calls.where(F.col("magnitude") >= APPRECIABLE).groupBy("g_max", "seed")
                .agg(F.avg((F.col("call") == F.col("direction")).cast("int")).alias("a"))
                .groupBy("g_max").agg((F.avg("a") * 100).alias("appreciable_accuracy")))
    scores = checkpointed(scores.withColumn("y", flows.cast("int")))
    auc = (mt.roc_auc(scores, p="p_1", keys=["g_max", "seed"]).groupBy("g_max")
           .agg(F.avg("auc").alias("gate_auc")))
    return accuracy.join(auc, "g_max")


def two_stage(rows: DataFrame, seeds=(0,), k: int = 5) -> DataFrame:
    """Direction accuracy when an out-of-fold rate prediction is one more feature."""
    folds = folded(rows, seeds, k).where(F.col("direction") != CONTROL)
    folds = folds.withColumn("log_rate", F.log10("magnitude"))
    rate = hd.apply_by_fold(hd.explode_seeds(folds, seeds),
                            hd.ridge_by_fold(folds, FEATURES, "log_rate", seeds=seeds))
    wide = rate.groupBy("replicate", "g").agg(*[
        F.max(F.when(F.col("seed") == s, F.col("p_log_rate"))).alias(f"rate_{s}") for s in seeds])
    joined = checkpointed(folds.join(wide, ["replicate", "g"]))
    calls = None
    for s in seeds:
        one = direction_calls(joined.withColumnRenamed(f"rate_{s}", "rate"),
                              [*FEATURES, "rate"], "logistic", (s,), k)
        calls = one if calls is None else calls.unionByName(one)
    return pr.banded_accuracy(calls)


def curve_comparison(rows: DataFrame, seeds=(0,), k: int = 5, depths: int = 8,
                     n_landmarks: int = 1500) -> DataFrame:
    """Replicate curves: linear against landmark-corrected predictions, for direction (accuracy
    per band) and rate (relative error and rank correlation)."""
    labelled = ("direction", "magnitude")
    curves = hd.curve_features(rows, STATISTICS, depths, extra=labelled)
    cols = [c for c in curves.columns if c not in ("replicate", *labelled)]
    curves = folded(curves.where(F.col("direction") != CONTROL), seeds, k)
    curves = curves.withColumn("_curve", F.array(*cols)).withColumn(
        "log_rate", F.log10("magnitude"))

    linear = hd.apply_by_fold(hd.explode_seeds(curves, seeds), hd.logistic_by_fold(
        curves, cols, "direction", CLASSES, seeds, k, eps=1e-9))
    keep = ["seed", "replicate", *labelled, "log_rate", "_curve"]
    linear = checkpointed(linear.select(*keep, *P))
    rate = hd.apply_by_fold(hd.explode_seeds(curves, seeds), hd.ridge_by_fold(
        curves, cols, "log_rate", seeds=seeds, eps=1e-9))
    rate = checkpointed(rate.select(*keep, "p_log_rate"))

    direction = magnitude = None
    for s in seeds:
        one = linear.where(F.col("seed") == s)
        fixed = kn.residual_correction(
            hd.residual_targets(one, "direction", P, CLASSES), "_curve", "replicate", P,
            [f"residual_{c}" for c in CLASSES], "replicate", s, k, n_landmarks,
            standardise=True)
        both = (pr.replicate_call(one, P).select("seed", *labelled, "call")
                .withColumn("arm", F.lit("linear"))
                .unionByName(pr.replicate_call(fixed, [f"corrected_{c}" for c in P])
                             .select("seed", *labelled, "call")
                             .withColumn("arm", F.lit("corrected"))))
        direction = both if direction is None else direction.unionByName(both)
        one = rate.where(F.col("seed") == s)
        fixed = kn.residual_correction(
            hd.residual_targets(one, "log_rate", ["p_log_rate"]), "_curve", "replicate",
            ["p_log_rate"], ["residual"], "replicate", s, k, n_landmarks, standardise=True)
        both = (one.select("replicate", "magnitude", "log_rate", F.col("p_log_rate").alias("pred"))
                .withColumn("arm", F.lit("linear"))
                .unionByName(fixed.select("replicate", "magnitude", "log_rate",
                                          F.col("corrected_p_log_rate").alias("pred"))
                             .withColumn("arm", F.lit("corrected"))))
        magnitude = both if magnitude is None else magnitude.unionByName(both)

    accuracy = None
    for arm in ("linear", "corrected"):
        a = pr.banded_accuracy(direction.where(F.col("arm") == arm)).select(
            F.lit(arm).alias("arm"), "band", F.lit("accuracy").alias("metric"),
            F.col("accuracy").alias("value"))
        accuracy = a if accuracy is None else accuracy.unionByName(a)
    averaged = checkpointed(pr.rate_bands(
        magnitude.groupBy("arm", "replicate", "magnitude", "log_rate")
        .agg(F.avg("pred").alias("pred"))).where("band IN ('appreciable', 'overall')"))
    err = mt.relative_error(averaged, "pred", "log_rate", ("arm", "band"))
    rank = mt.spearman(averaged, "pred", "log_rate", ["arm", "band"])
    joined = err.join(rank.drop("n"), ["arm", "band"])
    long = joined.select("arm", "band", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in ("mean_relative_error", "median_relative_error", "spearman")])))
    return accuracy.unionByName(long)


# ------------------------------------------------------------------ frozen model

def train_frozen(rows: DataFrame, gate: str = "band", cap: int | None = None,
                 row_key=("replicate", "g"), boosted: dict | None = None) -> dict:
    """Gate and direction heads for use on other data. Both are scaled by all rows; direction
    is fitted on appreciable rows, at most `cap` of them (a seeded sample). With `boosted`, options
    of the boosting, a boosted direction head is fitted on the same rows and stands beside it."""
    rows = checkpointed(rows)
    flows = rows.where((F.col("direction") != CONTROL) & (F.col("magnitude") >= APPRECIABLE))
    if cap is not None:
        # every Newton pass reads the sample
        flows = checkpointed(quality.sample_fixed(flows, cap, list(row_key)))
    model = {
        "gate": hd.fit_logistic(pr.gate_rows(rows, gate), FEATURES, "y", scale_on=rows),
        "direction": hd.fit_logistic(flows, FEATURES, "direction", CLASSES, scale_on=rows)}
    if boosted is not None:
        model["boosted"] = bo.fit_boosted(flows, FEATURES, "direction", CLASSES, **boosted)
    return model


def save_frozen(spark, model: dict, path: str) -> None:
    """Linear heads as JSON, boosted ones as a Parquet table of trees, each in its own folder."""
    hd.save_heads(spark, {n: h for n, h in model.items() if isinstance(h, hd.LinearHead)}, f"{path}/linear")
    for name, head in model.items():
        if isinstance(head, bo.BoostedHead):
            bo.save_ensemble(spark, head, f"{path}/trees_{name}")


def load_frozen(spark, path: str, boosted=()) -> dict:
    """A saved model; `boosted` names the heads stored as trees."""
    return hd.load_heads(spark, f"{path}/linear") | {n: bo.load_ensemble(spark, f"{path}/trees_{n}") for n in boosted}


def score_frozen(features: DataFrame, model: dict) -> DataFrame:
    """`features` with gate_gate, p_<class> and, if the model has a boosted head, b_<class>."""
    scored = model["direction"].apply(model["gate"].apply(features, "gate"), "p")
    return model["boosted"].apply(scored, "b") if "boosted" in model else scored


def detect_then_orient(features: DataFrame, model: dict, keys=(), threshold: float = 0.5
                       ) -> DataFrame:
    """Mean gate score and class probabilities over depths per key; a call where the gate
    passes, and the call ignoring the gate."""
    scored = model["direction"].apply(model["gate"].apply(features, "gate"), "p")
    means = scored.groupBy(*keys).agg(F.avg("gate_gate").alias("gate"),
                                      *[F.avg(c).alias(c) for c in P],
                                      F.count(F.lit(1)).alias("n_depths"))
    ungated = pr.replicate_call(means, P).withColumnRenamed("call", "oriented")
    return pr.gated_call(ungated, P, threshold=threshold)


def heldout_batches(train: DataFrame, batches: dict, gate: str = "all") -> DataFrame:
    """Frozen heads on disjoint batches, one by one and pooled: direction accuracy per band,
    gate AUC and calibration error."""
    model = train_frozen(train, gate)
    rows = None
    for name, df in batches.items():
        df = df.withColumn("batch", F.lit(name))
        rows = df if rows is None else rows.unionByName(df)
    scored = model["direction"].apply(model["gate"].apply(rows, "gate"), "p")
    reps = scored.groupBy("batch", "replicate").agg(
        *[F.avg(c).alias(c) for c in (*P, "gate_gate")],
        *[F.min_by(c, "g").alias(c) for c in ("direction", "magnitude")])
    # replicates first, as ids can repeat in other batches
    reps = reps.withColumn("batch", F.explode(F.array(F.col("batch"), F.lit("pooled"))))
    flows = (F.col("direction") != CONTROL) & (F.col("magnitude") >= APPRECIABLE)
    reps = checkpointed(pr.replicate_call(reps, P).withColumn("y", flows.cast("int")))
    hit = (F.col("call") == F.col("direction")).cast("int")
    accuracy = pr.rate_bands(reps.where(F.col("direction") != CONTROL)).groupBy(
        "batch", F.concat(F.lit("accuracy_"), "band").alias("metric")).agg(
        F.avg(hit).alias("value"))
    auc = mt.roc_auc(reps, p="gate_gate", keys=["batch"]).select(
        "batch", F.lit("gate_auc").alias("metric"), F.col("auc").alias("value"))
    ece = mt.calibration_error(reps, p="gate_gate", keys=["batch"]).select(
        "batch", F.lit("gate_ece").alias("metric"), F.col("ece").alias("value"))
    return accuracy.unionByName(auc).unionByName(ece)


# ------------------------------------------------------------------ features from files

def build_matrix(spark, vcf: str, popmap: str, pop_order, max_depth: int | None = None,
                 biallelic: bool = False) -> DataFrame:
    """The 28-column matrix of a VCF and a sample map. Populations must be exactly the three of
    `pop_order`. Loci may have any number of alleles; `biallelic` takes the faster column path
    when no code above 1 occurs."""
    mapping = text.read_popmap(spark, popmap)
    present = [r["pop"] for r in mapping.select("pop").distinct()
               .limit(len(pop_order) + 1).collect()]        # one too many is enough to refuse
    order = validate_populations(pop_order, present)
    names = text.vcf_samples(spark, vcf)
    variants = text.read_vcf(spark, vcf, names)
    read = text.counts_from_vcf if biallelic else text.cells_from_vcf
    counts = read(variants, names, mapping, order)
    return rf.feature_matrix(counts.drop("chrom", "pos", "ref", "alt", "info"), max_depth)


# ------------------------------------------------------------------ real data

def trio_report(counts: DataFrame, model: dict, keys=(), max_depth: int | None = None,
                ancestral: bool = False, boosted=None) -> DataFrame:
    """D with its chromosome jackknife, gate and direction for a trio: populations 1-3 of a
    counts table, polarised by population 4 or, with `ancestral`, by the column `aa`. One
    counts table feeds both sides. A boosted head, given or in the model, adds its mean class
    probabilities b_<class>."""
    keys = list(keys)
    if ancestral:
        sites = classical.abba_baba(ct.polarise_ancestral(counts), outgroup=False)
    else:
        freqs = ct.polarise_outgroup(ct.site_frequencies(counts))
        sites = classical.abba_baba(freqs, outgroup=False)
    d = classical.unweighted_jackknife(classical.block_sums(sites, None, keys), keys)
    three = counts.select(*keys, *ct.count_columns(2, 3))
    features = rf.feature_matrix(three, max_depth, keys)
    call = detect_then_orient(features, model, keys)
    ratio = rf.pair_private_ratio(features, keys)
    report = _beside(_beside(d, call, keys), ratio, keys)
    boosted = boosted or model.get("boosted")
    if boosted is not None:
        b = boosted.apply(features, "b").groupBy(*keys).agg(
            *[F.avg(f"b_{c}").alias(f"b_{c}") for c in CLASSES])
        report = _beside(report, b, keys)
    return report


def _beside(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Join on keys; without keys both are single rows."""
    return a.join(b, list(keys)) if keys else a.crossJoin(F.broadcast(b))


def robustness_report(calls: DataFrame, popmap: DataFrame, trios: dict, model: dict,
                      target: int | None = None, min_copies: int = 16, seed: int = 100,
                      max_depth: int | None = None) -> DataFrame:
    """Several trios of labels from one base-call table. `trios` maps a tag to the labels that
    play P1, P2, P3 and the outgroup. Sites are recoded and filtered per trio; `target` draws so
    many of them."""
    out = None
    for i, (tag, labels) in enumerate(trios.items()):
        counts = trio_counts(calls, popmap, labels, min_copies)
        if target is not None:
            counts = quality.sample_fixed(counts, target, ["chrom", "pos"], seed + i)
        one = counts.withColumn("trio", F.lit(tag))
        out = one if out is None else out.unionByName(one)
    return classical.d_decision(trio_report(checkpointed(out), model, ["trio"], max_depth)
                                .drop("call")).withColumnRenamed("call", "d_call")


def trio_counts(calls: DataFrame, popmap: DataFrame, labels, min_copies: int = 16) -> DataFrame:
    """Counts of a four-population selection from base calls: majority recode over the selected
    samples, minimum copies (outgroup exempt) and ingroup polymorphism."""
    names = ["P1", "P2", "P3", "P4"]
    chosen = text.join_popmap(calls, text.select_populations(
        popmap, {n: [x] if isinstance(x, str) else list(x) for n, x in zip(names, labels)}))
    counts = quality.major_minor_counts(chosen, names).drop("ref", "alt")
    return ct.polymorphic(ct.min_copies(counts, min_copies, exempt=(4,)), (1, 2, 3))


def leave_one_chromosome_out(counts: DataFrame, model: dict, max_depth: int | None = None,
                             min_loci: int = 1000) -> DataFrame:
    """Direction call with each chromosome left out, by subtraction of power sums."""
    three = counts.select("chrom", *ct.count_columns(2, 3))
    f = rf.leave_one_out(three, "chrom", max_depth, min_loci=min_loci)
    return detect_then_orient(f, model, ["chrom", "n_loci"])


def locus_report(genotypes: DataFrame, windows, model: dict, pops, min_copies: int = 16,
                 per_window: int | None = None, target: int | None = None,
                 max_depth: int | None = None) -> DataFrame:
    """Direction and model-free ratio over genomic windows (genome-wide or a single locus), from
    all sites or from `per_window` of each window and `target` in all."""
    scanned = text.scan_windows(quality.biallelic_snps(genotypes), windows)
    counts = ct.allele_table(scanned, pops, locus=("window_id", "chrom", "pos"))
    counts = ct.min_copies(counts, min_copies)
    if per_window is not None:
        counts = quality.cap_per_window(counts, per_window, 1 << 60 if target is None else target)
    elif target is not None:
        raise ValueError("target needs per_window")
    counts = checkpointed(counts.withColumn("region", F.lit("all")))
    f = rf.feature_matrix(counts, max_depth, ["region"])
    call = detect_then_orient(f, model, ["region"])
    n = counts.groupBy("region").agg(F.count(F.lit(1)).alias("n_snp"))
    return (call.join(rf.pair_private_ratio(f, ["region"]), "region").join(n, "region")
            .drop("region"))


def depth_sweep_report(counts: DataFrame, model: dict, caps=(6, 8, 10, 12, 14, 16),
                       third_copies: int = 16, min_copies: int = 16) -> DataFrame:
    """Posterior of class C as depth grows, over the fixed loci where the third population is
    complete."""
    fixed = ct.full_coverage(ct.min_copies(counts, min_copies, exempt=(3,)), 3, third_copies)
    f = rf.feature_matrix(fixed, max(caps))
    return detect_then_orient(rf.depth_sweep(f, caps), model, ["cap"])


def diversity_report(genotypes: DataFrame, references, recipient: str, donor: str, model: dict,
                     min_copies: int = 16, het_copies: int = 12, max_depth: int | None = None
                     ) -> DataFrame:
    """The same recipient and donor against several references: call, ratio, and the
    heterozygosity of reference and recipient over all biallelic sites."""
    snps = quality.biallelic_snps(genotypes)
    out = None
    for ref in references:
        counts = ct.allele_table(snps, [ref, recipient, donor], locus=("chrom", "pos"))
        one = counts.withColumn("reference", F.lit(ref))
        out = one if out is None else out.unionByName(one)
    out = checkpointed(out)
    q = {j: F.col(f"c2_{j}") / ct.total_copies(2, j) for j in (1, 2)}
    het = out.groupBy("reference").agg(*[
        F.avg(F.when(ct.total_copies(2, j) >= het_copies, 2 * q[j] * (1 - q[j]))).alias(n)
        for j, n in ((1, "reference_heterozygosity"), (2, "recipient_heterozygosity"))])
    kept = ct.min_copies(out, min_copies)
    f = rf.feature_matrix(kept, max_depth, ["reference"])
    call = detect_then_orient(f, model, ["reference"])
    return (call.join(rf.pair_private_ratio(f, ["reference"]), "reference")
            .join(het, "reference"))


def archaic_counts(modern: DataFrame, samples: DataFrame, call_sets: dict, pops,
                   n_per_pop: int | None = None) -> DataFrame:
    """Counts of the populations `pops` and, last, of the archaic call sets together, at sites
    where all call sets have a call that fits the panel's alleles, with the ancestral base
    `aa`. `modern` has long calls with ref, alt, info and sample, `samples` (sample, sample_idx,
    pop); a call set has one row per position (n1, n2, call_ref)."""
    site, pops = ["chrom", "pos"], list(pops)
    chosen = samples.where(F.col("pop").isin(pops))
    if n_per_pop is not None:
        chosen = quality.first_n_per_population(chosen, n_per_pop)
    chosen = chosen.select("sample", "pop")
    panel = quality.biallelic_snps(modern).drop("pop").join(small_side(chosen), "sample")
    out = quality.ancestral_allele(ct.allele_table(
        panel, pops, locus=(*site, "ref", "alt", "info"))).drop("info")
    alternate = []
    for i, calls in enumerate(call_sets.values()):
        out = quality.recode_against(out.join(calls, site)).withColumn(
            f"_a{i}", F.col("a1") + F.col("a2")).drop("call_ref", "n1", "n2", "a1", "a2")
        alternate.append(f"_a{i}")
    last, copies = len(pops) + 1, 2 * len(alternate)
    total = " + ".join(alternate)
    return out.selectExpr(
        *site, "ref", "alt", "aa", *ct.count_columns(2, len(pops)),
        f"int({copies} - ({total})) AS c1_{last}", f"int({total}) AS c2_{last}")


def archaic_report(modern: DataFrame, samples: DataFrame, call_sets: dict, trios, model: dict,
                   n_per_pop: int | None = None, max_depth: int | None = None) -> DataFrame:
    """D, gate and direction for several (P1, P2, archaic) trios. Sites are intersected and
    counted once for all populations; each trio then picks its columns from the row."""
    pops = sorted({p for trio in trios for p in trio})
    counts = checkpointed(archaic_counts(modern, samples, call_sets, pops, n_per_pop))
    last = len(pops) + 1
    picks = []
    for p1, p2 in trios:
        j = [pops.index(p1) + 1, pops.index(p2) + 1, last]
        fields = ", ".join(f"c{i}_{x} AS c{i}_{y}" for i in (1, 2) for y, x in enumerate(j, 1))
        picks.append(f"struct('{p1}/{p2}' AS trio, {fields})")
    rows = counts.selectExpr("chrom", "pos", "ref", "alt", "aa",
                             f"inline(array({', '.join(picks)}))")
    called = rows.where("c1_1 + c2_1 > 0 AND c1_2 + c2_2 > 0")
    return trio_report(called, model, ["trio"], max_depth, ancestral=True)


def injection_grid(genotypes: DataFrame, samples: DataFrame, roles: dict, model: dict,
                   fractions=(0.05, 0.1, 0.2), repeats: int = 4, pop_order=("P1", "P2", "P3"),
                   max_depth: int | None = None) -> DataFrame:
    """Mean gate and direction accuracy per injected direction and fraction. `roles` maps a
    class to (donor, recipient); the control has no migrants."""
    experiments = [(f"{c}|{f}|{r}", d, q, f, draw) for draw, ((c, (d, q)), f, r) in enumerate(
        product(*[roles.items(), fractions, range(repeats)]))]
    names = [e[0] for e in experiments] + [f"{CONTROL}|0.0|{r}" for r in range(repeats)]
    base = ct.polymorphic(ct.allele_table(genotypes, pop_order))
    moved = inject.pick_migrants(samples, experiments)
    counts = inject.injected_counts(genotypes, base, moved, names, pop_order)
    f = rf.feature_matrix(counts, max_depth, ["experiment"])
    call = detect_then_orient(f, model, ["experiment"])
    part = F.split("experiment", r"\|")
    hit = F.when(part[0] != CONTROL, (F.col("oriented") == part[0]).cast("int"))
    return call.groupBy(part[0].alias("inject"), part[1].cast("double").alias("fraction")).agg(
        F.avg("gate").alias("mean_gate"), F.avg(hit).alias("direction_accuracy"),
        F.count(F.lit(1)).alias("n"))
