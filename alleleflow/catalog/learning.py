"""Registered queries: model heads, transforms and composed analyses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from alleleflow.catalog import views as v
from alleleflow.catalog.core import rounded_all
from alleleflow.catalog.evaluation import RATE_PREDS, rate_preds
from alleleflow.functions.exprs import rounded
from alleleflow.functions.session import checkpointed, shared_path
from alleleflow.operators import boosting as bo
from alleleflow.operators import counts as ct
from alleleflow.operators import heads as hd
from alleleflow.operators import kernel as kn
from alleleflow.operators import protocol as pr
from alleleflow.operators import quality as ql
from alleleflow.operators import rarefaction as rf
from alleleflow.plans import analyses as an
from alleleflow.plans import batches as bt
from alleleflow.plans.contract import CHANNELS, CLASSES, FEATURES, STATISTICS
from alleleflow.sources import labelled as lb

QUERIES: dict = {}
ORACLES: dict = {}
SEEDS = (0, 1, 2)
#: Landmarks of the similarity query, and the basis of the corrections.
N_LANDMARKS, BASIS = 64, 1500


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return register


def vectors(spark, sf):
    """Embeddings as 64 columns with a class and a replicate."""
    return v.table(spark, sf, "embeddings").selectExpr(
        "vec_id AS id", "vec_id div 5 AS replicate", "int(label % 3) AS class",
        *[f"double(embedding[{i}]) AS x{i}" for i in range(64)])


X = [f"x{i}" for i in range(64)]
VECTORS = """vectors AS (SELECT vec_id AS id, vec_id // 5 AS replicate,
  CAST(label % 3 AS INTEGER) AS class, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""


# ------------------------------------------------------------------ transforms with SQL

@query("standardise", "WITH " + v.features_sql() + """,
s AS (SELECT """ + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s_{c}"
    for c in FEATURES) + " FROM features WHERE direction <> 'D')\nSELECT replicate, "
    + ", ".join(f"round((f.{c} - m_{c}) / s_{c}, 5) + 0.0 AS {c}" for c in FEATURES)
    + " FROM features f, s")
def standardise(spark, sf):
    f = v.features(spark, sf).drop("magnitude")
    z = hd.standardise(f.where("direction <> 'D'"), f.drop("direction"), FEATURES)
    return z.select("replicate", *[rounded(c, 5).alias(c) for c in FEATURES])


@query("class_moments", "WITH " + VECTORS + """,
folds AS (SELECT seed, replicate, CAST((row_number() OVER (PARTITION BY seed
            ORDER BY md5(seed || ':' || replicate)) - 1) % 5 AS INTEGER) AS fold
          FROM (SELECT DISTINCT replicate FROM vectors), (SELECT unnest([0, 1, 2]) AS seed)),
y AS (SELECT seed, fold, class, [1.0::DOUBLE] || x AS x FROM vectors JOIN folds USING (replicate)),
ij AS (SELECT a.i AS i, b.i AS j FROM range(65) a(i), range(65) b(i) WHERE a.i <= b.i)
SELECT seed, fold, class, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
       round(sum(x[i + 1] * x[j + 1]), 6) + 0.0 AS value
FROM y, ij GROUP BY ALL""")
def class_moments(spark, sf):
    rows = pr.with_folds(vectors(spark, sf), "replicate", 5, SEEDS)
    keys = ["seed", "fold", "class"]
    return rounded_all(hd.moment_entries(hd.moment_sums(rows, X, ["class"], SEEDS), keys, len(X) + 1),
                       [*keys, "i", "j"])


HEAVY = ["g"] + [c for c in STATISTICS if c.startswith("pihat")]


@query("feature_weighting", "WITH " + v.features_sql() + " SELECT replicate, " + ", ".join(
    f"round(CAST({c} AS DOUBLE) * {5 if c in HEAVY else 1}, 6) + 0.0 AS {c}" for c in FEATURES)
    + " FROM features")
def feature_weighting(spark, sf):
    f = hd.weight_features(v.features(spark, sf), FEATURES, HEAVY)
    return rounded_all(f.select("replicate", *FEATURES), ["replicate"])


@query("residual_targets", "WITH " + v.REP_PROBS + """
SELECT seed, replicate, """ + ", ".join(
    f"round(CAST(direction = '{c}' AS INTEGER) - p_{c}, 6) + 0.0 AS residual_{c}"
    for c in CLASSES) + " FROM rep_probs WHERE direction <> 'D'")
def residual_targets(spark, sf):
    m = v.rep_probs(spark, sf).where("direction <> 'D'")
    r = hd.residual_targets(m, "direction", [f"p_{c}" for c in CLASSES], CLASSES)
    return rounded_all(r.select("seed", "replicate", *[f"residual_{c}" for c in CLASSES]),
                       ["seed", "replicate"])


@query("rate_residuals", RATE_PREDS + """
SELECT event_id, round(true_log - pred_log, 6) + 0.0 AS residual FROM rp""")
def rate_residuals(spark, sf):
    r = hd.residual_targets(rate_preds(spark, sf), "true_log", ["pred_log"])
    return rounded_all(r.select("event_id", "residual"), ["event_id"])


@query("landmark_similarity", "WITH " + VECTORS + f""",
l AS (SELECT id AS l, x AS z, row_number() OVER (ORDER BY md5('0:' || id)) - 1 AS k
      FROM vectors ORDER BY md5('0:' || id) LIMIT {N_LANDMARKS}),
d AS (SELECT a.k AS a, b.k AS b, list_sum(list_transform(range(1, 65),
        lambda i: pow(a.z[i] - b.z[i], 2))) AS d2 FROM l a, l b WHERE a.k < b.k),
s AS (SELECT sqrt(avg(d2)) AS s FROM d),
r AS (SELECT id, k, list_sum(list_transform(range(1, 65), lambda i: pow(x[i] - z[i], 2)))
        / (s * s) AS r2 FROM vectors, l, s)
SELECT id, CAST(k AS INTEGER) AS landmark, round((1 + sqrt(5 * r2) + 5.0::DOUBLE / 3 * r2)
       * exp(-sqrt(5 * r2)), 5) AS similarity FROM r""")
def landmark_similarity(spark, sf):
    rows = v.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    marks = hd.landmark_rows(rows, "x", "id", N_LANDMARKS)
    s = hd.landmark_similarity(rows, "x", marks, hd.landmark_spread(marks))
    return s.select("id", F.posexplode("similarity").alias("landmark", "s")).select(
        "id", "landmark", rounded("s", 5).alias("similarity"))


CURVE_POSITIONS = hd.curve_depths(v.FEATURE_DEPTH - 1)
CURVE_DEPTHS = [2 + i for i in CURVE_POSITIONS]


@query("curve_features", "WITH " + v.features_sql() + " SELECT replicate, " + ", ".join(
    f"round(max({s}) FILTER (g = {d}), 6) + 0.0 AS {s}_at{d}"
    for d in CURVE_DEPTHS for s in STATISTICS) + ", " + ", ".join(
    f"round(avg({s}), 6) + 0.0 AS {s}_curve" for s in STATISTICS)
    + " FROM features GROUP BY replicate")
def curve_features(spark, sf):
    f = checkpointed(v.features(spark, sf))
    return rounded_all(hd.curve_features(f, STATISTICS), ["replicate"])


# ------------------------------------------------------------------ labelled dataset

LABELLED_SQL = v.features_sql() + """,
-- every eleventh replicate loses a depth, every thirteenth has another label at one depth
f AS (SELECT * REPLACE (CASE WHEN replicate % 13 = 5 AND g = 4 THEN 'Q' ELSE direction END AS direction)
      FROM features WHERE NOT (replicate % 11 = 3 AND g = 6)),
r AS (SELECT count(*) AS n_rows, count(*) FILTER (replicate IS NULL) AS null_replicate,
  count(*) FILTER (direction NOT IN ('A', 'B', 'C', 'D')) AS bad_direction, count(*) FILTER (magnitude IS NULL OR magnitude < 0) AS bad_magnitude,
  count(*) FILTER (direction = 'D' AND magnitude > 0) AS control_with_flow, count(*) FILTER (direction <> 'D' AND magnitude = 0) AS direction_without_flow,
  count(*) FILTER (g < 2) AS bad_depth, count(*) FILTER (""" + " OR ".join(f"{c} IS NULL OR isnan({c})" for c in STATISTICS) + """) AS missing_feature FROM f),
p AS (SELECT replicate, list(DISTINCT g ORDER BY g) AS grid, count(*) AS n, count(DISTINCT g) AS d,
  count(DISTINCT direction) > 1 OR count(DISTINCT magnitude) > 1 AS two FROM f GROUP BY replicate),
q AS (SELECT sum(k) AS n_replicates, sum(t) AS two_labels, sum(m) AS repeated_depth, sum(k) - max(k) AS unequal_grid FROM (
  SELECT count(*) AS k, count(*) FILTER (two) AS t, count(*) FILTER (n > d) AS m FROM p GROUP BY grid))
SELECT "check", CAST(failures AS BIGINT) AS failures FROM (SELECT COLUMNS(*)::BIGINT FROM r, q) UNPIVOT (failures FOR "check" IN (COLUMNS(*)))"""


@query("labelled_checks", "WITH " + LABELLED_SQL)
def labelled_checks(spark, sf):
    """Failures of every check on a labelled table with some planted faults."""
    wrong = F.when(F.expr("replicate % 13 = 5 AND g = 4"), F.lit("Q")).otherwise(F.col("direction"))
    rows = v.features(spark, sf).where("NOT (replicate % 11 = 3 AND g = 6)").withColumn("direction", wrong)
    return lb.check_report(checkpointed(rows))


# ------------------------------------------------------------------ heads

@query("direction_logistic")
def direction_logistic(spark, sf):
    return an.direction_table(v.features(spark, sf), "logistic", SEEDS)


@query("direction_boosted")
def direction_boosted(spark, sf):
    return an.direction_table(v.features(spark, sf), "boosted", SEEDS, rounds=150)


@query("gate_logistic")
def gate_logistic(spark, sf):
    return an.gate_report(v.features(spark, sf), "logistic", SEEDS)


@query("fisher_discriminant")
def fisher_discriminant(spark, sf):
    return an.direction_table(v.features(spark, sf), "discriminant", (0, 1, 2))


def with_log_rate(spark, sf):
    f = an.folded(v.features(spark, sf), SEEDS)
    return f.where("direction <> 'D'").withColumn("log_rate", F.log10("magnitude"))


@query("rate_ridge")
def rate_ridge(spark, sf):
    rows = with_log_rate(spark, sf)
    heads = hd.ridge_by_fold(rows, FEATURES, "log_rate", seeds=SEEDS)
    preds = hd.apply_by_fold(hd.explode_seeds(rows, SEEDS), heads)
    return preds.groupBy("replicate").agg(F.avg("p_log_rate").alias("pred_log"),
                                          F.first("log_rate").alias("true_log"))


@query("oof_predictions")
def oof_predictions(spark, sf):
    rows = an.folded(v.features(spark, sf), SEEDS).where("direction <> 'D'")
    preds = an.out_of_fold(rows, FEATURES, "direction", CLASSES, "logistic", SEEDS)
    return preds.select("seed", "fold", "replicate", "g", *[f"p_{c}" for c in CLASSES])


@query("moment_ablation")
def moment_ablation(spark, sf):
    return an.subset_ablation(v.features(spark, sf), seeds=SEEDS, head="discriminant")


@query("channel_ablation")
def channel_ablation(spark, sf):
    return an.subset_ablation(v.features(spark, sf), CHANNELS, SEEDS, head="discriminant")


@query("depth_requirement")
def depth_requirement(spark, sf):
    return an.depth_requirement(v.features(spark, sf), (4, 6, 9), SEEDS)


@query("two_stage_direction")
def two_stage_direction(spark, sf):
    return an.two_stage(v.features(spark, sf), SEEDS)


@query("residual_correction")
def residual_correction(spark, sf):
    rows = pr.with_folds(vectors(spark, sf), "replicate", 5, SEEDS)
    fitted = hd.discriminant_by_fold(rows, X, "class", SEEDS)
    p = ["p_0", "p_1", "p_2"]
    preds = hd.apply_by_fold(hd.explode_seeds(rows, SEEDS), fitted)
    preds = checkpointed(preds.select("seed", "id", "replicate", "class", F.array(*X).alias("x"), *p))
    out = None
    for s in SEEDS:
        res = hd.residual_targets(preds.where(F.col("seed") == s), "class", p, [0, 1, 2])
        one = kn.residual_correction(res, "x", "id", p, [f"residual_{i}" for i in range(3)],
                                     "replicate", s, n_landmarks=BASIS).drop("x")
        out = one if out is None else out.unionByName(one)
    return out


@query("pca_projection")
def pca_projection(spark, sf):
    f = checkpointed(v.features(spark, sf))
    return hd.pca_projection(f, FEATURES).selectExpr(
        "replicate", "g", "direction", "log10(greatest(magnitude, 1e-12)) AS log_rate",
        "pc_1", "pc_2")


@query("separation_table")
def separation_table(spark, sf):
    f = v.features(spark, sf)
    m = hd.collect_moments(hd.moment_sums(f, STATISTICS, ["direction"]), ["direction"],
                           len(STATISTICS) + 1)
    rows = hd.separation_table({k[0]: x for k, x in m.items()}, "D")
    return spark.createDataFrame(rows)


@query("heldout_batches")
def heldout_batches(spark, sf):
    f = checkpointed(v.features(spark, sf))
    return an.heldout_batches(f.where("replicate div 4 % 3 = 0"), {
        "first": f.where("replicate div 4 % 3 = 1"), "second": f.where("replicate div 4 % 3 = 2")})


# ------------------------------------------------------------------ frozen model on other data

def frozen(spark, sf, **options):
    return an.train_frozen(v.features(spark, sf), **options)


@query("frozen_model_apply")
def frozen_model_apply(spark, sf):
    f = rf.feature_matrix(ct.allele_table(v.deep_obs(spark, sf), v.POPS), 100)
    return an.score_frozen(f, frozen(spark, sf, boosted={"rounds": 200})).select(
        "g", "gate_gate", *[f"{p}_{c}" for p in "pb" for c in CLASSES])


# A small fixed model, so that applying heads can be held against SQL.
FIXED_LINEAR = {"gate": ([[0.04, 0.9, -0.7]], [-0.3]),
                "direction": ([[0.02, 1.1, -0.4], [-0.03, 0.2, 0.8], [0.01, -1.3, 0.5]], [0.1, -0.2, 0.05])}
FIXED_COLUMNS = ["g", "alpha_1_mean", "pihat_12_mean"]
#: feature (-1: leaf), threshold and value of the heap's nodes; two trees per class.
FIXED_TREES = [
    ([0, 1, 2, -1, -1, -1, -1], [4.5, 1.6, 0.08, 0, 0, 0, 0], [0, 0, 0, 0.4, -0.2, 0.1, 0.3]),
    ([2, -1, 1, 0, 0, -1, -1], [0.02, 0, 1.9, 0, 0, 0, 0], [0, -0.3, 0, 0, 0, 0.2, 0.6]),
    ([1, 2, -1, -1, -1, 0, 0], [1.75, 0.05, 0, 0, 0, 0, 0], [0, 0, 0.5, -0.1, 0.25, 0, 0]),
    ([0, -1, -1, 0, 0, 0, 0], [6.5, 0, 0, 0, 0, 0, 0], [0, 0.15, -0.15, 0, 0, 0, 0]),
    ([2, 0, 0, -1, -1, -1, -1], [0.04, 3.5, 7.5, 0, 0, 0, 0], [0, 0, 0, 0.3, 0.05, -0.25, 0.45]),
    ([-1, 0, 0, 0, 0, 0, 0], [0] * 7, [0.07, 0, 0, 0, 0, 0, 0])]
FIXED_BASE = [-1.0, -1.2, -1.1]


def fixed_model() -> dict:
    heads = {n: hd.LinearHead(FIXED_COLUMNS, ["gate"] if n == "gate" else CLASSES, np.array(w), np.array(b),
                              "logistic" if n == "gate" else "softmax") for n, (w, b) in FIXED_LINEAR.items()}
    trees = [[tuple(map(np.array, t)) for t in FIXED_TREES[2 * k:2 * k + 2]] for k in range(3)]
    return heads | {"boosted": bo.BoostedHead(FIXED_COLUMNS, CLASSES, FIXED_BASE, trees)}


def linear_sql(weights, intercept) -> str:
    return "(" + " + ".join([f"{w}::DOUBLE * {c}" for w, c in zip(weights, FIXED_COLUMNS)] + [f"{intercept}::DOUBLE"]) + ")"


def tree_sql(tree) -> str:
    """Walk of one fixed tree in DuckDB, two steps from the root."""
    f, h, value = ("[" + ", ".join(map(str, a)) + "]" for a in tree)
    at = (f"list_reduce([0, 1, 2], lambda n, k: CASE WHEN ({f})[n + 1] < 0 THEN n WHEN x[({f})[n + 1] + 1] <= ({h})[n + 1]::DOUBLE "
          f"THEN 2 * n + 1 ELSE 2 * n + 2 END)")
    return f"({value})[{at} + 1]::DOUBLE"


def softmax_sql(scores: list[str], prefix: str) -> str:
    total = " + ".join(f"exp({s})" for s in scores)
    return ", ".join(f"round(exp({s}) / ({total}), 6) + 0.0 AS {prefix}_{c}" for s, c in zip(scores, CLASSES))


BOOSTED_SCORES = [f"({FIXED_BASE[k]}::DOUBLE + {tree_sql(FIXED_TREES[2 * k])} + {tree_sql(FIXED_TREES[2 * k + 1])})" for k in range(3)]


@query("fixed_model_apply", "WITH " + v.features_sql() + f""",
x AS (SELECT *, [{", ".join(f"CAST({c} AS DOUBLE)" for c in FIXED_COLUMNS)}] AS x FROM features)
SELECT replicate, g, round(1 / (1 + exp(-{linear_sql(FIXED_LINEAR["gate"][0][0], FIXED_LINEAR["gate"][1][0])})), 6) + 0.0 AS gate_gate,
  {softmax_sql([linear_sql(w, b) for w, b in zip(*FIXED_LINEAR["direction"])], "p")}, {softmax_sql(BOOSTED_SCORES, "b")} FROM x""")
def fixed_model_apply(spark, sf):
    scored = an.score_frozen(v.features(spark, sf), fixed_model())
    return rounded_all(scored.select("replicate", "g", "gate_gate", *[f"{p}_{c}" for p in "pb" for c in CLASSES]), ["replicate", "g"])


@query("detect_then_orient")
def detect_then_orient(spark, sf):
    obs = v.deep_obs(spark, sf)
    c = ct.allele_table(obs, v.POPS, keys=["chrom"])
    return an.detect_then_orient(rf.feature_matrix(c, 100, ["chrom"]),
                                 frozen(spark, sf, gate="all", cap=1000), ["chrom"])


@query("trio_report")
def trio_report(spark, sf):
    c = ct.allele_table(v.obs4(spark, sf), ["P1", "P2", "P3", "P4"],
                        locus=("chrom", "pos"))
    c = ct.polymorphic(ct.min_copies(c, 4, exempt=(4,)), (1, 2, 3))
    return an.trio_report(checkpointed(c), frozen(spark, sf, boosted={"rounds": 200}), max_depth=100)


@query("robustness_report")
def robustness_report(spark, sf):
    calls = v.base_calls(spark, sf).select("chrom", "pos", "sample", "sample_idx", "b1", "b2")
    trios = {"123": ["P1", "P2", "P3", "P4"], "213": ["P2", "P1", "P3", "P4"],
             "132": ["P1", "P3", "P2", "P4"]}
    return an.robustness_report(checkpointed(calls), v.samples(spark, sf).select("sample", "pop"),
                                trios, frozen(spark, sf), min_copies=10,
                                max_depth=100)


@query("leave_one_chromosome_out")
def leave_one_chromosome_out(spark, sf):
    c = ct.allele_table(v.deep_obs(spark, sf), v.POPS, locus=("locus", "chrom"))
    return an.leave_one_chromosome_out(c, frozen(spark, sf), 100, min_loci=50)


@query("locus_report")
def locus_report(spark, sf):
    w = [(f"chr{i}", 0, 60_000) for i in range(5)]
    return an.locus_report(v.genotypes(spark, sf), w, frozen(spark, sf), v.POPS, 10, max_depth=100)


@query("depth_sweep_report")
def depth_sweep_report(spark, sf):
    c = ct.allele_table(v.genotypes(spark, sf), v.POPS)
    n = v.samples(spark, sf).where("pop = 'P3'").count()
    return an.depth_sweep_report(c, frozen(spark, sf), third_copies=2 * n - 4)


@query("diversity_report")
def diversity_report(spark, sf):
    return an.diversity_report(v.genotypes(spark, sf), ["P1", "P4"], "P2", "P3",
                               frozen(spark, sf), 10, max_depth=100)


@query("archaic_report")
def archaic_report(spark, sf):
    """Panel calls: an order is a site, its line items are the calls of suppliers."""
    site = v.variants(spark, sf).drop("site_id").withColumnRenamed("pos", "p")
    k = F.col("l_orderkey")
    calls = v.table(spark, sf, "lineitem").select(
        (k * 1000).alias("pos"), F.col("l_suppkey").alias("sample"),
        (F.col("l_quantity") > 25).cast("int").alias("a1"),
        (F.col("l_linestatus") == "O").cast("int").alias("a2"))
    modern = calls.join(site, F.col("pos") == F.col("p")).drop("p")
    sets = {}
    for tag, o in (("x", 0), ("y", 1)):
        sets[tag] = ql.last_bases(v.archaic(spark, sf, o), "line_no")
    return an.archaic_report(modern, v.samples(spark, sf), sets, [("P1", "P2"), ("P1", "P3"), ("P2", "P3")],
                             frozen(spark, sf), max_depth=100)


@query("injection_grid")
def injection_grid(spark, sf):
    return an.injection_grid(v.genotypes(spark, sf), v.samples(spark, sf),
                             {"B": ("P2", "P3"), "C": ("P3", "P2")}, frozen(spark, sf),
                             repeats=4, max_depth=100)


@query("curve_comparison")
def curve_comparison(spark, sf):
    return an.curve_comparison(checkpointed(v.features(spark, sf)), SEEDS, n_landmarks=BASIS)


# ------------------------------------------------------------------ batches added one by one

@query("pooled_batches", "WITH " + v.features_sql() + """
SELECT replicate, """ + ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in FEATURES) + " FROM features")
def pooled_batches(spark, sf):
    """Feature matrices of every replicate from three batches of loci, stored as power sums one after
    the other and pooled."""
    path = shared_path(spark, "moments")
    obs = v.rep_obs(spark, sf)
    for k in range(3):
        counts = ct.min_copies(ct.allele_table(obs.where(F.col("locus") % 3 == k), v.POPS, keys=["replicate"]), v.FEATURE_DEPTH)
        bt.add_batch(bt.moment_state(counts.drop("locus"), v.FEATURE_DEPTH, ["replicate"]), path, str(k))
    return rounded_all(bt.pooled_matrix(spark, path, ["replicate"]), ["replicate"])


@query("pooled_scores", "WITH " + v.SCORES + """,
r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM scores),
b AS (SELECT least(floor(p * 10) - CAST(p < floor(p * 10) * 0.1::DOUBLE AS INTEGER)
    + CAST(p >= (floor(p * 10) + 1) * 0.1::DOUBLE AS INTEGER), 9) AS bin, count(*) AS n, avg(y) AS my, avg(p) AS mp FROM scores GROUP BY 1)
SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
    / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)), 6) AS auc,
  (SELECT round(sum(abs(my - mp) * n) / sum(n), 6) FROM b) AS ece, round(avg(pow(p - y, 2)), 6) AS brier FROM r""")
def pooled_scores(spark, sf):
    """AUC, calibration error and Brier score of three stored batches of scores together."""
    path = shared_path(spark, "scores")
    for k in range(3):
        bt.add_batch(bt.score_state(v.scores(spark, sf).where(F.col("id") % 3 == k)), path, str(k))
    return rounded_all(bt.score_metrics(bt.pooled(spark, path, ["p"])).drop("n"), [])
