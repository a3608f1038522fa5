"""Genetic stand-in views over the given tables, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alleleflow.operators.counts import allele_table, min_copies
from alleleflow.operators.rarefaction import feature_matrix

POPS = ["P1", "P2", "P3"]
REGION_POPS = {"AFRICA": "P1", "AMERICA": "P2", "ASIA": "P3", "EUROPE": "P4"}
FEATURE_DEPTH = 9


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def flag_pop():
    f = F.col("l_returnflag")
    return F.when(f == "A", "P1").when(f == "N", "P2").otherwise("P3")


def status_allele():
    return (F.col("l_linestatus") == "O").cast("int")


def region_pop():
    return F.coalesce(*[F.when(F.col("r_name") == k, v) for k, v in REGION_POPS.items()])


def allele_obs(spark, sf):
    return (table(spark, sf, "lineitem")
            .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_partkey").alias("locus"), F.col("p_brand").alias("chrom"),
                    (F.col("l_partkey") * 1000).alias("pos"), flag_pop().alias("pop"),
                    status_allele().alias("allele")))


ALLELE_OBS = """allele_obs AS (
  SELECT l_partkey AS locus, p_brand AS chrom, l_partkey * 1000 AS pos,
         CASE l_returnflag WHEN 'A' THEN 'P1' WHEN 'N' THEN 'P2' ELSE 'P3' END AS pop,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS allele
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def deep_obs(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("locus"),
        F.concat(F.lit("chr"), F.col("l_suppkey") % 5).alias("chrom"),
        (F.col("l_suppkey") * 1000).alias("pos"), flag_pop().alias("pop"),
        status_allele().alias("allele"))


DEEP_OBS = """deep_obs AS (
  SELECT l_suppkey AS locus, 'chr' || (l_suppkey % 5) AS chrom, l_suppkey * 1000 AS pos,
         CASE l_returnflag WHEN 'A' THEN 'P1' WHEN 'N' THEN 'P2' ELSE 'P3' END AS pop,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS allele
  FROM lineitem)"""


def multi_obs(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("locus"), flag_pop().alias("pop"),
        F.ceil(F.col("l_quantity") / 10).cast("int").alias("allele"))


MULTI_OBS = """multi_obs AS (
  SELECT l_partkey AS locus,
         CASE l_returnflag WHEN 'A' THEN 'P1' WHEN 'N' THEN 'P2' ELSE 'P3' END AS pop,
         CAST(ceil(l_quantity / 10) AS INTEGER) AS allele
  FROM lineitem)"""


def order_nations(spark, sf):
    """(o_orderkey, c_nationkey): orders meet their customers first, so that line items, the largest
    table, are joined and shuffled once."""
    return (table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select("o_orderkey", "c_nationkey"))


def obs4(spark, sf):
    return (table(spark, sf, "lineitem")
            .join(order_nations(spark, sf), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("l_partkey").alias("locus"),
                    F.concat(F.lit("chr"), F.col("l_partkey") % 20).alias("chrom"),
                    (F.col("l_partkey") * 1000).alias("pos"), region_pop().alias("pop"),
                    (F.col("l_quantity") <= 5 + F.col("l_partkey") % 41).cast("int")
                    .alias("allele"))
            .where(F.col("pop").isNotNull()))


OBS4 = """obs4 AS (
  SELECT * FROM (
    SELECT l_partkey AS locus, 'chr' || (l_partkey % 20) AS chrom, l_partkey * 1000 AS pos,
           CASE r_name WHEN 'AFRICA' THEN 'P1' WHEN 'AMERICA' THEN 'P2' WHEN 'ASIA' THEN 'P3'
                       WHEN 'EUROPE' THEN 'P4' END AS pop,
           CASE WHEN l_quantity <= 5 + l_partkey % 41 THEN 1 ELSE 0 END AS allele
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey) WHERE pop IS NOT NULL)"""


def obs5(spark, sf):
    """Multi-allelic observations of all five regions as populations R0 ... R4."""
    return (table(spark, sf, "lineitem")
            .join(order_nations(spark, sf), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .selectExpr("l_suppkey AS locus", "concat('R', n_regionkey) AS pop",
                        "int(ceil(l_quantity / 10)) AS allele"))


OBS5 = """obs5 AS (
  SELECT l_suppkey AS locus, 'R' || n_regionkey AS pop,
         CAST(ceil(l_quantity / 10) AS INTEGER) AS allele
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def samples(spark, sf):
    """(sample, pop, sample_idx): suppliers as samples, their region as population."""
    return (table(spark, sf, "supplier")
            .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("sample"), region_pop().alias("pop"),
                    F.col("s_suppkey").alias("sample_idx"))
            .where(F.col("pop").isNotNull()))


SAMPLES = """samples AS (
  SELECT * FROM (
    SELECT s_suppkey AS sample, s_suppkey AS sample_idx,
           CASE r_name WHEN 'AFRICA' THEN 'P1' WHEN 'AMERICA' THEN 'P2' WHEN 'ASIA' THEN 'P3'
                       WHEN 'EUROPE' THEN 'P4' END AS pop
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey) WHERE pop IS NOT NULL)"""


def calls(spark, sf):
    """Diploid calls without population: one row per (site, sample)."""
    locus = F.col("l_partkey") % 50
    g = (table(spark, sf, "lineitem")
         .groupBy(F.col("l_suppkey").alias("sample"), locus.alias("locus"))
         .agg((F.sum("l_linenumber") % 2).alias("x1"),
              (F.sum((F.col("l_linestatus") == "O").cast("int")) % 2).alias("x2"),
              F.count(F.lit(1)).alias("n")))
    missing = F.col("n") % 10 == 0
    bases = F.split(F.lit("A,C,G,T"), ",")
    return g.select(
        F.concat(F.lit("chr"), F.col("locus") % 5).alias("chrom"),
        (F.col("locus") * 1000).alias("pos"), "locus",
        F.get(bases, (F.col("locus") % 4).cast("int")).alias("ref"),
        F.get(bases, ((F.col("locus") + 1 + F.col("locus") % 3) % 4).cast("int")).alias("alt"),
        "sample", F.col("sample").cast("int").alias("sample_idx"),
        F.when(~missing, F.col("x1")).cast("int").alias("a1"),
        F.when(~missing, F.col("x2")).cast("int").alias("a2"))


CALLS = """calls AS (
  SELECT 'chr' || (locus % 5) AS chrom, locus * 1000 AS pos, locus,
         substr('ACGT', CAST(locus % 4 + 1 AS INTEGER), 1) AS ref,
         substr('ACGT', CAST((locus + 1 + locus % 3) % 4 + 1 AS INTEGER), 1) AS alt,
         sample, CAST(sample AS INTEGER) AS sample_idx,
         CASE WHEN n % 10 <> 0 THEN CAST(x1 AS INTEGER) END AS a1,
         CASE WHEN n % 10 <> 0 THEN CAST(x2 AS INTEGER) END AS a2
  FROM (SELECT l_suppkey AS sample, l_partkey % 50 AS locus, sum(l_linenumber) % 2 AS x1,
               count(*) FILTER (l_linestatus = 'O') % 2 AS x2, count(*) AS n
        FROM lineitem GROUP BY ALL))"""


def genotypes(spark, sf):
    return calls(spark, sf).join(samples(spark, sf).select("sample", "pop"), "sample")


GENOTYPES = CALLS + ",\n" + SAMPLES + """,
genotypes AS (SELECT c.*, s.pop FROM calls c JOIN samples s ON c.sample = s.sample)"""


def base_calls(spark, sf):
    """Calls as bases b1, b2; some sites get a third base so that they are dropped."""
    g = genotypes(spark, sf)
    third = (F.col("locus") % 7 == 3) & (F.col("sample") % 11 == 5)
    bases = F.split(F.lit("A,C,G,T"), ",")

    def base(a):
        b = F.when(F.col(a) == 0, F.col("ref")).when(F.col(a) == 1, F.col("alt"))
        return F.when(third & b.isNotNull(),
                      F.get(bases, ((F.col("locus") + 3) % 4).cast("int"))).otherwise(b)
    return g.withColumn("b1", base("a1")).withColumn("b2", base("a2"))


BASE_CALLS = GENOTYPES + """,
base_calls AS (
  SELECT *, CASE WHEN a1 IS NULL THEN NULL WHEN third THEN b3
                 WHEN a1 = 0 THEN ref ELSE alt END AS b1,
            CASE WHEN a2 IS NULL THEN NULL WHEN third THEN b3
                 WHEN a2 = 0 THEN ref ELSE alt END AS b2
  FROM (SELECT *, locus % 7 = 3 AND sample % 11 = 5 AS third,
               substr('ACGT', CAST((locus + 3) % 4 + 1 AS INTEGER), 1) AS b3 FROM genotypes))"""


def variants(spark, sf):
    """Site table from orders: unique (chrom, pos), some long or odd alleles, AA= entries."""
    bases = F.split(F.lit("A,C,G,T"), ",")
    c = F.col("o_custkey")
    ref = F.get(bases, (c % 4).cast("int"))
    alt = F.get(bases, ((c + 1 + c % 3) % 4).cast("int"))
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("chr"), k % 22).alias("chrom"), (k * 1000).alias("pos"),
        F.when(k % 13 == 0, F.concat(ref, F.lit("A"))).otherwise(ref).alias("ref"),
        F.when(k % 11 == 0, F.lit(".")).when(k % 17 == 0, F.lit("*"))
        .when(k % 7 == 0, F.concat(alt, F.lit(","), ref)).otherwise(alt).alias("alt"),
        F.concat(F.lit("AC=1;AA="),
                 F.when(k % 5 == 0, F.lit(".")).when(k % 5 == 1, F.lower(ref))
                 .when(k % 5 == 2, F.concat(F.lit(" "), alt)).when(k % 5 == 3, F.lit("N"))
                 .otherwise(ref), F.lit("|||;DP=7")).alias("info"),
        k.alias("site_id"))


VARIANTS = """variants AS (
  SELECT 'chr' || (k % 22) AS chrom, k * 1000 AS pos,
         CASE WHEN k % 13 = 0 THEN r || 'A' ELSE r END AS ref,
         CASE WHEN k % 11 = 0 THEN '.' WHEN k % 17 = 0 THEN '*'
              WHEN k % 7 = 0 THEN a || ',' || r ELSE a END AS alt,
         'AC=1;AA=' || CASE k % 5 WHEN 0 THEN '.' WHEN 1 THEN lower(r) WHEN 2 THEN ' ' || a
                                  WHEN 3 THEN 'N' ELSE r END || '|||;DP=7' AS info,
         k AS site_id
  FROM (SELECT o_orderkey AS k, substr('ACGT', CAST(o_custkey % 4 + 1 AS INTEGER), 1) AS r,
               substr('ACGT', CAST((o_custkey + 1 + o_custkey % 3) % 4 + 1 AS INTEGER), 1) AS a
        FROM orders))"""


def archaic(spark, sf, offset: int):
    """A single-sample call set over part of the sites, with several rows per position."""
    bases = F.split(F.lit("A,C,G,T"), ",")
    k, q = F.col("l_orderkey"), F.col("l_linenumber")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = F.col("o_custkey")
    ref = F.get(bases, (c % 4).cast("int"))
    alt = F.get(bases, ((c + 1 + c % 3) % 4).cast("int"))
    return (table(spark, sf, "lineitem").join(o, k == F.col("o_orderkey"))
            .where((k + offset) % 3 != 0)
            .select(F.concat(F.lit("chr"), k % 22).alias("chrom"), (k * 1000).alias("pos"),
                    F.when((k + offset) % 19 == 0, alt).otherwise(ref).alias("ref"),
                    F.when(k % 23 == 0, F.lit("A,C,G,T")).otherwise(alt).alias("alt"),
                    (F.col("l_suppkey") % 2).cast("int").alias("a1"),
                    ((F.col("l_partkey") + offset) % 2 + (k % 23 == 0).cast("int"))
                    .cast("int").alias("a2"),
                    # one ordering number per distinct content, so 'last' is well defined
                    (q * 100000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey"))
                    .alias("line_no")))


def archaic_sql(name: str, offset: int) -> str:
    return f"""{name} AS (
  SELECT 'chr' || (k % 22) AS chrom, k * 1000 AS pos,
         CASE WHEN (k + {offset}) % 19 = 0 THEN a ELSE r END AS ref,
         CASE WHEN k % 23 = 0 THEN 'A,C,G,T' ELSE a END AS alt,
         CAST(l_suppkey % 2 AS INTEGER) AS a1,
         CAST((l_partkey + {offset}) % 2 + CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END AS INTEGER)
           AS a2,
         CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey * 10000 + l_suppkey AS line_no
  FROM (SELECT l_orderkey AS k, l_suppkey, l_partkey, l_linenumber,
               substr('ACGT', CAST(o_custkey % 4 + 1 AS INTEGER), 1) AS r,
               substr('ACGT', CAST((o_custkey + 1 + o_custkey % 3) % 4 + 1 AS INTEGER), 1) AS a
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  WHERE (k + {offset}) % 3 <> 0)"""


RATES = "5e-7,2.5e-6,5e-5,2.5e-4,1e-3"


def with_labels(df, replicate="replicate"):
    r = F.col(replicate)
    rates = F.split(F.lit(RATES), ",").cast("array<double>")
    return (df.withColumn("direction", F.get(F.split(F.lit("A,B,C,D"), ","),
                                             (r % 4).cast("int")))
            .withColumn("magnitude", F.when(r % 4 == 3, F.lit(0.0))
                        .otherwise(F.get(rates, (r % 5).cast("int")))))


LABELS_SQL = """substr('ABCD', CAST(replicate % 4 + 1 AS INTEGER), 1) AS direction,
         CASE WHEN replicate % 4 = 3 THEN 0.0 ELSE
           [5e-7, 2.5e-6, 5e-5, 2.5e-4, 1e-3][CAST(replicate % 5 + 1 AS INTEGER)]::DOUBLE END
           AS magnitude"""


def eval_rows(spark, sf):
    """Scored rows per replicate: events of a user as rows of a replicate."""
    p = F.col("value") / (F.col("value") + 50)
    return with_labels(table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("replicate"),
        (2 + F.col("event_id") % 198).cast("int").alias("g"), p.alias("p"),
        ((F.col("event_id") % 10) / 10.0 + 0.05).alias("w")))


EVAL_ROWS = f"""eval_rows AS (
  SELECT *, {LABELS_SQL}
  FROM (SELECT event_id, user_id AS replicate, CAST(2 + event_id % 198 AS INTEGER) AS g,
               value / (value + 50) AS p,
               (event_id % 10)::DOUBLE / 10.0::DOUBLE + 0.05::DOUBLE AS w FROM events))"""


def eval_preds(spark, sf, seeds=(0, 1, 2)):
    """Class probabilities per row and seed."""
    e = eval_rows(spark, sf).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    w = ((F.col("event_id") + 3 * F.col("seed")) % 10) / 10.0 + 0.05
    return (e.withColumn("p_A", F.col("p")).withColumn("p_B", (1 - F.col("p")) * w)
            .withColumn("p_C", (1 - F.col("p")) * (1 - w)))


EVAL_PREDS = EVAL_ROWS + """,
eval_preds AS (
  SELECT *, p AS p_A, (1 - p) * v AS p_B, (1 - p) * (1 - v) AS p_C
  FROM (SELECT e.*, seed, ((event_id + 3 * seed) % 10)::DOUBLE / 10.0::DOUBLE + 0.05::DOUBLE
          AS v FROM eval_rows e, (SELECT unnest([0, 1, 2]) AS seed)))"""


def rep_probs(spark, sf):
    """Mean probabilities per (seed, replicate) with labels and call, rounded so that calls do
    not depend on summation order."""
    from alleleflow.functions.exprs import rounded
    from alleleflow.operators.protocol import replicate_call
    cols = ["p_A", "p_B", "p_C"]
    m = (eval_preds(spark, sf).groupBy("seed", "replicate", "direction", "magnitude")
         .agg(*[rounded(F.avg(c), 9).alias(c) for c in cols]))
    return replicate_call(m, cols)


REP_PROBS = EVAL_PREDS + """,
rep_probs AS (
  SELECT *, CASE WHEN p_A >= p_B AND p_A >= p_C THEN 'A' WHEN p_B >= p_C THEN 'B' ELSE 'C' END
    AS call
  FROM (SELECT seed, replicate, direction, magnitude, round(avg(p_A), 9) AS p_A,
               round(avg(p_B), 9) AS p_B, round(avg(p_C), 9) AS p_C
        FROM eval_preds GROUP BY ALL))"""

BANDS_SQL = """bands AS (
  SELECT '5.0e-07' AS band, 5e-7::DOUBLE AS lo, 5e-7::DOUBLE AS hi UNION ALL
  SELECT '2.5e-06', 2.5e-6, 2.5e-6 UNION ALL SELECT '5.0e-05', 5e-5, 5e-5 UNION ALL
  SELECT '2.5e-04', 2.5e-4, 2.5e-4 UNION ALL SELECT 'appreciable', 2.5e-4, 1e9 UNION ALL
  SELECT 'overall', -1, 1e9)"""
# a rate lies in a band if it is within 0.1 % of a fixed rate, or above the lower end
IN_BAND = """(CASE WHEN b.lo = b.hi THEN abs(magnitude - b.lo) <= b.lo * 1e-3::DOUBLE
                   ELSE magnitude >= b.lo END)"""


def scores(spark, sf):
    return (table(spark, sf, "documents").select("doc_id", "n_chars")
            .join(table(spark, sf, "labels"), "doc_id")
            .select(F.col("doc_id").alias("id"), F.col("quality").alias("y"),
                    F.least(F.lit(1.0), F.col("n_chars") / 20000.0).alias("p")))


SCORES = """scores AS (
  SELECT d.doc_id AS id, quality AS y, least(1.0::DOUBLE, n_chars / 20000.0::DOUBLE) AS p
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def rep_obs(spark, sf):
    """Observations of many replicates: a supplier is a replicate with six loci."""
    locus = F.col("l_partkey") % 6
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("replicate"), locus.alias("locus"), flag_pop().alias("pop"),
        (F.col("l_quantity") <= 2 + 4 * locus).cast("int").alias("allele"))


REP_OBS = """rep_obs AS (
  SELECT l_suppkey AS replicate, l_partkey % 6 AS locus,
         CASE l_returnflag WHEN 'A' THEN 'P1' WHEN 'N' THEN 'P2' ELSE 'P3' END AS pop,
         CASE WHEN l_quantity <= 2 + 4 * (l_partkey % 6) THEN 1 ELSE 0 END AS allele
  FROM lineitem)"""


def rep_counts(spark, sf):
    counts = allele_table(rep_obs(spark, sf), POPS, keys=["replicate"])
    return min_copies(counts, FEATURE_DEPTH)


def features(spark, sf):
    """Labelled 28-column table, one replicate per supplier, depths 2 ... 9."""
    return with_labels(feature_matrix(rep_counts(spark, sf), FEATURE_DEPTH, ["replicate"]))


def counts_sql(obs: str, name: str, keys: str = "locus", pops=("P1", "P2", "P3"),
               alleles=(0, 1), having: str = "") -> str:
    cols = ", ".join(
        f"CAST(count(*) FILTER (pop = '{p}' AND allele = {a}) AS INTEGER) AS c{i}_{j}"
        for i, a in enumerate(alleles, 1) for j, p in enumerate(pops, 1))
    return f"{name} AS (SELECT {keys}, {cols} FROM {obs} GROUP BY {keys} {having})"


def n_sql(j: int, k: int = 2, c: str = "") -> str:
    return "(" + " + ".join(f"{c}c{i}_{j}" for i in range(1, k + 1)) + ")"


def absent_sql(n: str, a: str, g: str = "g") -> str:
    return (f"(CASE WHEN {n} - {a} < {g} THEN 0.0 ELSE exp(lgamma({n} - {a} + 1) "
            f"- lgamma({n} - {a} - {g} + 1) + lgamma({n} - {g} + 1) - lgamma({n} + 1)) END)")


def per_locus_sql(counts: str, name: str, keep: str = "locus", depths: str = "depths", k: int = 2,
                  pops: int = 3, stats=None, source: str | None = None) -> str:
    """Per-locus statistics from a counts CTE joined with a `depths` CTE."""
    qs = ", ".join(f"{absent_sql(n_sql(j, k), f'c{i}_{j}')} AS q{i}_{j}"
                   for i in range(1, k + 1) for j in range(1, pops + 1))
    sums = ", ".join(f"{statistic_sql(s, k, pops)} AS {s}" for s in stats)
    src = source or f"{counts}, {depths}"
    return (f"{name}_q AS (SELECT {keep}, g, {qs} FROM {src}),\n"
            f"{name} AS (SELECT {keep}, g, {sums} FROM {name}_q)")


def statistic_sql(stat: str, k: int, pops: int) -> str:
    kind, _, who = stat.rpartition("_")
    subset = [int(c) for c in who]
    if kind == "alpha":
        return "(" + " + ".join(f"(1 - q{i}_{subset[0]})" for i in range(1, k + 1)) + ")"
    return "(" + " + ".join(
        " * ".join(f"(1 - q{i}_{j})" if j in subset else f"q{i}_{j}"
                   for j in range(1, pops + 1)) for i in range(1, k + 1)) + ")"


def moments_sql(stats) -> str:
    return ", ".join(
        f"round(avg({s}), 6) + 0.0 AS {s}_mean, round(var_samp({s}), 6) + 0.0 AS {s}_variance, "
        f"round(stddev_samp({s}) / sqrt(count(*)), 6) + 0.0 AS {s}_se" for s in stats)


def least_n(k: int = 2, pops: int = 3, c: str = "") -> str:
    return "least(" + ", ".join(n_sql(j, k, c) for j in range(1, pops + 1)) + ")"


def features_sql(rounded: bool = False) -> str:
    """CTEs ending in `features`, the SQL twin of `features()`."""
    from alleleflow.plans.contract import BLOCKS
    need = " AND ".join(f"{n_sql(j)} >= {FEATURE_DEPTH}" for j in (1, 2, 3))
    plain = ", ".join(f"avg({s}) AS {s}_mean, var_samp({s}) AS {s}_variance, "
                      f"stddev_samp({s}) / sqrt(count(*)) AS {s}_se" for s in BLOCKS)
    return (REP_OBS + ",\n" + counts_sql("rep_obs", "rep_all", "replicate, locus")
            + f",\nrep_counts AS (SELECT * FROM rep_all WHERE {need}),\n"
            + f"depths AS (SELECT unnest(range(2, {FEATURE_DEPTH + 1})) AS g),\n"
            + per_locus_sql("rep_counts", "rep_stats", "replicate, locus", stats=BLOCKS)
            + f",\nfeatures AS (SELECT *, {LABELS_SQL} FROM (SELECT replicate, "
            f"CAST(g AS INTEGER) AS g, {moments_sql(BLOCKS) if rounded else plain} "
            f"FROM rep_stats GROUP BY replicate, g))")
