"""Registered queries: folds, calls, bands and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from alleleflow.catalog import views as v
from alleleflow.catalog.core import rounded_all
from alleleflow.functions.exprs import rounded
from alleleflow.operators import metrics as mt
from alleleflow.operators import protocol as pr
from alleleflow.plans.contract import CHANNELS, CLASSES, FEATURES, feature_subset

QUERIES: dict = {}
ORACLES: dict = {}
P = ["p_A", "p_B", "p_C"]
SEEDS = (0, 1, 2)


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return register


# ------------------------------------------------------------------ protocol

FOLDS_SQL = """folds AS (
  SELECT seed, replicate, CAST((row_number() OVER (PARTITION BY seed
           ORDER BY md5(seed || ':' || replicate)) - 1) % 5 AS INTEGER) AS fold
  FROM (SELECT DISTINCT replicate FROM eval_rows), (SELECT unnest([0, 1, 2]) AS seed))"""


@query("group_folds", "WITH " + v.EVAL_ROWS + ",\n" + FOLDS_SQL + " SELECT * FROM folds")
def group_folds(spark, sf):
    return pr.group_folds(v.eval_rows(spark, sf), seeds=SEEDS)


@query("replicate_labels", "WITH " + v.EVAL_ROWS + """
SELECT replicate, min_by(direction, event_id) AS direction,
       min_by(magnitude, event_id) AS magnitude FROM eval_rows GROUP BY replicate""")
def replicate_labels(spark, sf):
    return pr.replicate_labels(v.eval_rows(spark, sf), "event_id")


@query("replicate_probabilities", "WITH " + v.EVAL_PREDS + """
SELECT seed, replicate, round(avg(p_A), 6) AS p_A, round(avg(p_B), 6) AS p_B,
       round(avg(p_C), 6) AS p_C FROM eval_preds GROUP BY seed, replicate""")
def replicate_probabilities(spark, sf):
    m = pr.replicate_probabilities(v.eval_preds(spark, sf), P, ("seed", "replicate"))
    return rounded_all(m, ["seed", "replicate"])


@query("replicate_call", "WITH " + v.REP_PROBS + " SELECT seed, replicate, call FROM rep_probs")
def replicate_call(spark, sf):
    return v.rep_probs(spark, sf).select("seed", "replicate", "call")


@query("rate_bands", "WITH " + v.EVAL_ROWS + ",\n" + v.BANDS_SQL + f"""
SELECT band, count(*) AS n, count(DISTINCT replicate) AS n_replicates
FROM eval_rows, bands b WHERE {v.IN_BAND} GROUP BY band""")
def rate_bands(spark, sf):
    return pr.rate_bands(v.eval_rows(spark, sf)).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("replicate").alias("n_replicates"))


BANDED = "WITH " + v.REP_PROBS + ",\n" + v.BANDS_SQL + f""",
banded AS (SELECT *, CAST(call = direction AS INTEGER) AS hit FROM rep_probs, bands b
           WHERE direction <> 'D' AND {v.IN_BAND})"""


@query("banded_accuracy", BANDED + """
SELECT band, round(avg(a) * 100, 6) AS accuracy, max(n) AS n
FROM (SELECT band, seed, avg(hit) AS a, count(*) AS n FROM banded GROUP BY ALL) GROUP BY band""")
def banded_accuracy(spark, sf):
    return rounded_all(pr.banded_accuracy(v.rep_probs(spark, sf)), ["band", "n"])


@query("gate_labels", "WITH " + v.EVAL_ROWS + """
SELECT event_id, direction, CAST(direction <> 'D' AND magnitude >= 2.5e-4 AS INTEGER) AS y
FROM eval_rows WHERE direction = 'D' OR magnitude >= 2.5e-4""")
def gate_labels(spark, sf):
    return pr.gate_rows(v.eval_rows(spark, sf)).select("event_id", "direction", "y")


@query("gated_call", "WITH " + v.REP_PROBS + """
SELECT seed, replicate, CASE WHEN 1 - p_A >= 0.5 THEN call END AS call FROM rep_probs""")
def gated_call(spark, sf):
    m = v.rep_probs(spark, sf).drop("call").withColumn("gate", 1 - F.col("p_A"))
    return pr.gated_call(m, P).select("seed", "replicate", "call")


@query("depth_cap", "WITH " + v.EVAL_ROWS + """
SELECT replicate, count(*) AS n FROM eval_rows WHERE g <= 60 GROUP BY replicate""")
def depth_cap(spark, sf):
    return pr.depth_cap(v.eval_rows(spark, sf), 60).groupBy("replicate").agg(
        F.count(F.lit(1)).alias("n"))


ROW_CALLS = "WITH " + v.EVAL_PREDS + """,
row_calls AS (SELECT *, CASE WHEN p_A >= p_B AND p_A >= p_C THEN 'A' WHEN p_B >= p_C THEN 'B'
  ELSE 'C' END AS call FROM eval_preds WHERE seed = 0)"""


def row_calls(spark, sf):
    return pr.replicate_call(v.eval_preds(spark, sf, (0,)), P)


def _vote_sql(key):
    return ROW_CALLS + f""",
n AS (SELECT {key}, count(*) FILTER (call = 'A') AS n_A, count(*) FILTER (call = 'B') AS n_B,
        count(*) FILTER (call = 'C') AS n_C FROM row_calls GROUP BY {key})
SELECT {key}, n_A, n_B, n_C, CASE WHEN n_A >= n_B AND n_A >= n_C THEN 'A'
  WHEN n_B >= n_C THEN 'B' ELSE 'C' END AS vote FROM n"""


@query("majority_vote", _vote_sql("replicate"))
def majority_vote(spark, sf):
    return pr.majority_vote(row_calls(spark, sf))


@query("modal_class_by_block", _vote_sql("block").replace(
    "FROM eval_preds WHERE", ", event_id // 500 AS block FROM eval_preds WHERE"))
def modal_class_by_block(spark, sf):
    blocks = row_calls(spark, sf).withColumn("block", F.expr("event_id div 500"))
    return pr.majority_vote(blocks, keys=("block",))


@query("leakage_audit", "WITH " + v.EVAL_ROWS + """,
t AS (SELECT replicate, CAST('0x' || substr(md5('0:' || event_id), 1, 8) AS BIGINT)
        / 4294967296.0::DOUBLE < 0.2 AS test FROM eval_rows),
p AS (SELECT replicate, bool_or(test) AND bool_or(NOT test) AS both_sides, count(*) AS n
      FROM t GROUP BY replicate)
SELECT round(avg(CAST(both_sides AS INTEGER)), 6) AS shared,
       round(avg(1 - pow(0.8, n) - pow(0.2, n)), 6) AS expected, count(*) AS n_groups FROM p""")
def leakage_audit(spark, sf):
    a = pr.leakage_audit(v.eval_rows(spark, sf), row_key=("event_id",))
    return rounded_all(a, ["n_groups"])


# ------------------------------------------------------------------ metrics

@query("roc_auc", "WITH " + v.SCORES + """,
r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r
      FROM scores)
SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
  / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)), 6) AS auc FROM r""")
def roc_auc(spark, sf):
    return rounded_all(mt.roc_auc(v.scores(spark, sf)), [])


@query("roc_auc_by_type", """
WITH s AS (SELECT event_type, user_id % 2 AS y, value / (value + 50) AS p FROM events),
r AS (SELECT event_type, y, rank() OVER (PARTITION BY event_type ORDER BY p)
        + (count(*) OVER (PARTITION BY event_type, p) - 1) / 2.0 AS r FROM s)
SELECT event_type, round((sum(r) FILTER (y = 1)
    - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
  / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)), 6) AS auc
FROM r GROUP BY event_type""")
def roc_auc_by_type(spark, sf):
    e = v.table(spark, sf, "events").selectExpr(
        "event_type", "user_id % 2 AS y", "value / (value + 50) AS p")
    return rounded_all(mt.roc_auc(e, keys=["event_type"]), ["event_type"])


BINS_SQL = "WITH " + v.SCORES + """,
bins AS (SELECT CAST(least(floor(p * 10) - CAST(p < floor(p * 10) * 0.1::DOUBLE AS INTEGER)
    + CAST(p >= (floor(p * 10) + 1) * 0.1::DOUBLE AS INTEGER), 9) AS INTEGER) AS bin, count(*) AS n, avg(y) AS mean_y,
    avg(p) AS mean_p FROM scores GROUP BY 1)"""


@query("calibration_bins", BINS_SQL + """
SELECT bin, n, round(mean_y, 6) AS mean_y, round(mean_p, 6) AS mean_p FROM bins""")
def calibration_bins(spark, sf):
    return rounded_all(mt.calibration_bins(v.scores(spark, sf)), ["bin", "n"])


@query("calibration_error", BINS_SQL + """
SELECT round(sum(abs(mean_y - mean_p) * n) / sum(n), 6) AS ece FROM bins""")
def calibration_error(spark, sf):
    return rounded_all(mt.calibration_error(v.scores(spark, sf)), [])


@query("brier_score", "WITH " + v.SCORES + " SELECT round(avg(pow(p - y, 2)), 6) AS brier FROM scores")
def brier_score(spark, sf):
    return rounded_all(mt.brier_score(v.scores(spark, sf)), [])


CONFUSION = "WITH " + v.REP_PROBS + """,
cm AS (SELECT direction AS truth, call AS predicted, count(*) AS n FROM rep_probs
       WHERE direction <> 'D' GROUP BY ALL)"""


def confusion(spark, sf):
    return mt.confusion_matrix(v.rep_probs(spark, sf).where("direction <> 'D'"))


@query("confusion_matrix", CONFUSION + " SELECT * FROM cm")
def confusion_matrix(spark, sf):
    return confusion(spark, sf)


@query("pair_confusion", CONFUSION + """
SELECT least(truth, predicted) AS first, greatest(truth, predicted) AS second,
       CAST(sum(n) AS BIGINT) AS n FROM cm WHERE truth <> predicted GROUP BY ALL""")
def pair_confusion(spark, sf):
    return mt.pair_confusion(confusion(spark, sf))


@query("macro_f1", CONFUSION + """,
l AS (SELECT unnest(['A', 'B', 'C']) AS x),
f AS (SELECT x, coalesce(2.0 * sum(n) FILTER (truth = x AND predicted = x) / nullif(
    coalesce(sum(n) FILTER (truth = x), 0) + coalesce(sum(n) FILTER (predicted = x), 0), 0), 0) AS f
  FROM l, cm GROUP BY x)
SELECT round(avg(f), 6) AS macro_f1 FROM f""")
def macro_f1(spark, sf):
    return rounded_all(mt.macro_f1(confusion(spark, sf), CLASSES), [])


RATE_PREDS = "WITH " + v.EVAL_ROWS + ",\n" + v.BANDS_SQL + f""",
rp AS (SELECT *, log10(magnitude) AS true_log, log10(magnitude) + p - 0.5 AS pred_log
       FROM eval_rows WHERE magnitude > 0),
rb AS (SELECT band, true_log, pred_log,
         abs(pow(10::DOUBLE, pred_log) - pow(10::DOUBLE, true_log)) / pow(10::DOUBLE, true_log) AS e
       FROM rp, bands b WHERE {v.IN_BAND})"""


def rate_preds(spark, sf):
    e = v.eval_rows(spark, sf).where("magnitude > 0")
    return e.selectExpr("*", "log10(magnitude) AS true_log",
                        "log10(magnitude) + p - 0.5 AS pred_log")


@query("relative_error", RATE_PREDS + """
SELECT band, round(avg(e), 6) AS mean_relative_error, count(*) AS n,
       round(median(e), 6) AS median_relative_error FROM rb GROUP BY band""")
def relative_error(spark, sf):
    r = mt.banded_relative_error(rate_preds(spark, sf), "pred_log", "true_log")
    return rounded_all(r, ["band", "n"])


@query("spearman", RATE_PREDS + """,
x AS (SELECT band, round(pred_log, 9) AS a, round(true_log, 9) AS b FROM rb),
r AS (SELECT band,
   rank() OVER (PARTITION BY band ORDER BY a) + (count(*) OVER (PARTITION BY band, a) - 1) / 2.0 AS ra,
   rank() OVER (PARTITION BY band ORDER BY b) + (count(*) OVER (PARTITION BY band, b) - 1) / 2.0 AS rb
  FROM x)
SELECT band, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM r
WHERE band IN ('appreciable', 'overall') GROUP BY band""")
def spearman(spark, sf):
    r = pr.rate_bands(rate_preds(spark, sf)).where("band IN ('appreciable', 'overall')")
    r = r.select("band", rounded("pred_log", 9).alias("a"), rounded("true_log", 9).alias("b"))
    return rounded_all(mt.spearman(r, "a", "b", ["band"]), ["band", "n"])


@query("selective_accuracy", BANDED + """,
c AS (SELECT band, hit, greatest(p_A, p_B, p_C) AS conf FROM banded WHERE seed = 0),
d AS (SELECT band, conf, count(*) AS n, sum(hit) AS hits FROM c GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY band ORDER BY conf) AS upto,
        sum(n) OVER (PARTITION BY band) AS total FROM d)
SELECT band, dropped, round(sum(hits)::DOUBLE / sum(n), 6) AS accuracy,
       CAST(sum(n) AS BIGINT) AS n_kept
FROM q, (SELECT unnest([0.0::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE]) AS dropped)
WHERE upto > dropped * total GROUP BY band, dropped""")
def selective_accuracy(spark, sf):
    m = v.rep_probs(spark, sf).where("seed = 0 AND direction <> 'D'")
    m = pr.rate_bands(m.withColumn("confidence", F.greatest(*P)))
    return rounded_all(mt.selective_accuracy(m), ["band", "dropped", "n_kept"])


@query("bootstrap_interval", BANDED + """,
cum AS (SELECT sum(exp(-1) / gamma(k + 1)) OVER (ORDER BY k) AS c FROM range(13) t(k)),
b AS (SELECT unnest(range(1, 101)) AS b),
draws AS (SELECT band, hit, b, CAST('0x' || substr(md5('0:' || replicate || ':' || b), 1, 8) AS BIGINT)
    / 4294967296.0::DOUBLE AS u FROM banded, b WHERE seed = 0),
w AS (SELECT band, hit, b, (SELECT count(*) FROM cum WHERE u > c) AS w FROM draws),
a AS (SELECT band, b, sum(w * hit)::DOUBLE / nullif(sum(w), 0) AS a FROM w GROUP BY band, b)
SELECT band, round(quantile_cont(a, 0.025), 6) AS low, round(quantile_cont(a, 0.975), 6) AS high,
       round(avg(a), 6) AS mean FROM a GROUP BY band""")
def bootstrap_interval(spark, sf):
    m = v.rep_probs(spark, sf).where("seed = 0 AND direction <> 'D'")
    m = pr.rate_bands(m.withColumn("hit", (F.col("call") == F.col("direction")).cast("int")))
    return rounded_all(mt.bootstrap_interval(m, rounds=100), ["band"])


@query("seed_summary", BANDED + """
SELECT band AS metric, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) + 0.0 AS sd
FROM (SELECT band, seed, avg(hit) AS a FROM banded GROUP BY ALL) GROUP BY band""")
def seed_summary(spark, sf):
    m = pr.rate_bands(v.rep_probs(spark, sf).where("direction <> 'D'"))
    per = m.groupBy(F.col("band").alias("metric"), "seed").agg(
        F.avg((F.col("call") == F.col("direction")).cast("int")).alias("a"))
    return rounded_all(mt.seed_summary(per, "a"), ["metric"])


@query("rate_histogram", "WITH " + v.EVAL_ROWS + """,
r AS (SELECT log10(m) AS x FROM (SELECT replicate, min_by(magnitude, event_id) AS m
        FROM eval_rows GROUP BY replicate) WHERE m > 0),
e AS (SELECT min(x) - 0.15::DOUBLE AS lo, max(x) + 0.15::DOUBLE AS hi FROM r)
SELECT CAST(least(floor((x - lo) / ((hi - lo) / 45)), 44) AS INTEGER) AS bin,
       round(lo + CAST(least(floor((x - lo) / ((hi - lo) / 45)), 44) AS INTEGER) * ((hi - lo) / 45), 6)
         + 0.0 AS left_edge, count(*) AS n FROM r, e GROUP BY 1, 2""")
def rate_histogram(spark, sf):
    r = pr.replicate_labels(v.eval_rows(spark, sf), "event_id").where("magnitude > 0")
    h = mt.histogram(r.selectExpr("log10(magnitude) AS x"), "x", 45, 0.15)
    return rounded_all(h, ["bin", "n"])


# ------------------------------------------------------------------ feature-table operators

@query("feature_subset", "WITH " + v.features_sql(True) + " SELECT replicate, "
       + ", ".join(CHANNELS["asymmetric"]) + " FROM features")
def subset(spark, sf):
    f = feature_subset(v.features(spark, sf), "asymmetric", ["replicate"])
    return rounded_all(f, ["replicate", "g"])


SHIFT = [c for c in FEATURES if c != "g"]


@query("feature_shift", "WITH " + v.features_sql() + """,
t AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SHIFT)
       + " FROM features WHERE direction <> 'D'),\nr AS (SELECT "
       + ", ".join(f"avg({c}) AS r_{c}" for c in SHIFT) + " FROM features WHERE direction = 'D'),\n"
       + "z AS (" + " UNION ALL ".join(
           f"SELECT abs(r_{c} - m_{c}) / nullif(s_{c}, 0) AS z FROM t, r" for c in SHIFT)
       + ") SELECT round(median(z), 6) AS median_shift, count(z) AS n_features FROM z")
def feature_shift(spark, sf):
    f = v.features(spark, sf)
    z = mt.feature_shift(f.where("direction = 'D'"), f.where("direction <> 'D'"), SHIFT)
    return rounded_all(z, ["n_features"])


# ------------------------------------------------------------------ every seed
# The queries above are held to seed 0; here the seed is a key.

def _every_vote_sql(name, key):
    return (ORACLES[name].replace(" WHERE seed = 0", "").replace(f"GROUP BY {key})", f"GROUP BY seed, {key})")
            .replace(f"SELECT {key}, ", f"SELECT seed, {key}, "))


def every_row_call(spark, sf):
    return pr.replicate_call(v.eval_preds(spark, sf), P)


@query("majority_vote_by_seed", _every_vote_sql("majority_vote", "replicate"))
def majority_vote_by_seed(spark, sf):
    return pr.majority_vote(every_row_call(spark, sf), keys=("seed", "replicate"))


@query("modal_class_by_block_by_seed", _every_vote_sql("modal_class_by_block", "block"))
def modal_class_by_block_by_seed(spark, sf):
    blocks = every_row_call(spark, sf).withColumn("block", F.expr("event_id div 500"))
    return pr.majority_vote(blocks, keys=("seed", "block"))


def every_band(spark, sf):
    return pr.rate_bands(v.rep_probs(spark, sf).where("direction <> 'D'"))


@query("selective_accuracy_by_seed", ORACLES["selective_accuracy"].replace(" WHERE seed = 0", "")
       .replace("SELECT band", "SELECT seed, band").replace("PARTITION BY band", "PARTITION BY seed, band")
       .replace("GROUP BY band", "GROUP BY seed, band"))
def selective_accuracy_by_seed(spark, sf):
    m = every_band(spark, sf).withColumn("confidence", F.greatest(*P))
    return rounded_all(mt.selective_accuracy(m, keys=("seed", "band")), ["seed", "band", "dropped", "n_kept"])


ROUNDS = 200            # default of the operator


@query("bootstrap_interval_by_seed", ORACLES["bootstrap_interval"].replace(" WHERE seed = 0", "")
       .replace("range(1, 101)", f"range(1, {ROUNDS + 1})").replace("md5('0:' ||", "md5(seed || ':' ||")
       .replace("SELECT band", "SELECT seed, band").replace("GROUP BY band", "GROUP BY seed, band"))
def bootstrap_interval_by_seed(spark, sf):
    m = every_band(spark, sf).withColumn("hit", (F.col("call") == F.col("direction")).cast("int"))
    return rounded_all(mt.bootstrap_interval(m, rounds=ROUNDS, seed=F.col("seed"), keys=("seed", "band")), ["seed", "band"])
