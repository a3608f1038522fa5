"""Registered queries: allele counts, rarefaction, classical statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from alleleflow.catalog import views as v
from alleleflow.functions.exprs import rounded
from alleleflow.operators import classical as cl
from alleleflow.operators import counts as ct
from alleleflow.operators import rarefaction as rf
from alleleflow.plans.contract import BLOCKS

QUERIES: dict = {}
ORACLES: dict = {}
MIN_COPIES = 4          # loci of allele_obs with fewer copies are left out
DEEP = 100              # depth cap of the deep table
DEPTHS = [2, 3, 4]


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return register


def rounded_all(df, keep, nudge=0.0):
    return df.selectExpr(*keep, *[f"round(double({c}) + {nudge!r}D, 6) + 0D AS {c}"
                                  for c in df.columns if c not in keep])


def deep_counts(spark, sf):
    return ct.allele_table(v.deep_obs(spark, sf), v.POPS)


def shallow_counts(spark, sf, locus=("locus",)):
    counts = ct.allele_table(v.allele_obs(spark, sf), v.POPS, locus=locus)
    return ct.min_copies(counts, MIN_COPIES)


NEED = " AND ".join(f"{v.n_sql(j)} >= {MIN_COPIES}" for j in (1, 2, 3))
SHALLOW = ("WITH " + v.ALLELE_OBS + ",\n" + v.counts_sql("allele_obs", "all_counts", "locus")
           + f",\ncounts AS (SELECT * FROM all_counts WHERE {NEED})")
DEEP_SQL = "WITH " + v.DEEP_OBS + ",\n" + v.counts_sql("deep_obs", "counts")
DEPTHS_SQL = f"depths AS (SELECT unnest({DEPTHS}) AS g)"
GRID_SQL = (f"depths AS (SELECT unnest(range(2, least({DEEP}, (SELECT min({v.least_n()}) "
            "FROM counts))::BIGINT + 1)) AS g)")


# ------------------------------------------------------------------ counts

@query("allele_counts", "WITH " + v.ALLELE_OBS + """
SELECT locus, pop, allele, count(*) AS n FROM allele_obs GROUP BY ALL""")
def allele_counts(spark, sf):
    return ct.allele_counts(v.allele_obs(spark, sf))


@query("max_depth", SHALLOW + f" SELECT CAST(min({v.least_n()}) AS INTEGER) AS max_depth FROM counts")
def max_depth(spark, sf):
    return ct.max_depth(shallow_counts(spark, sf))


@query("allele_frequency", "WITH " + v.GENOTYPES + """,
d AS (SELECT locus, pop, CASE WHEN a1 IS NOT NULL THEN a1 + a2 END AS dosage FROM genotypes)
SELECT locus, pop, round(avg(dosage) / (SELECT CASE WHEN max(dosage) > 1 THEN 2.0 ELSE 1.0 END
  FROM d), 6) AS freq FROM d GROUP BY locus, pop""")
def allele_frequency(spark, sf):
    g = v.genotypes(spark, sf).withColumn("dosage", F.col("a1") + F.col("a2"))
    return rounded_all(ct.allele_frequency(g), ["locus", "pop"])


OBS4_COUNTS = ("WITH " + v.OBS4 + ",\n" + v.counts_sql(
    "obs4", "counts4", "locus, chrom, pos", ("P1", "P2", "P3", "P4")))
FREQS = OBS4_COUNTS + """,
freqs AS (SELECT locus, chrom, pos, """ + ", ".join(
    f"c2_{j}::DOUBLE / {v.n_sql(j)} AS p{j}" for j in (1, 2, 3, 4)) + """ FROM counts4
  WHERE """ + " AND ".join(f"{v.n_sql(j)} > 0" for j in (1, 2, 3, 4)) + """
    AND c1_1 + c1_2 + c1_3 + c1_4 > 0 AND c2_1 + c2_2 + c2_3 + c2_4 > 0)"""


def counts4(spark, sf):
    return ct.allele_table(v.obs4(spark, sf), ["P1", "P2", "P3", "P4"],
                           locus=["locus", "chrom", "pos"])


def freqs4(spark, sf):
    return ct.site_frequencies(counts4(spark, sf))


@query("site_frequencies", FREQS + """
SELECT locus, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4
FROM freqs""")
def site_frequencies(spark, sf):
    return rounded_all(freqs4(spark, sf).drop("chrom", "pos"), ["locus"])


POLARISED = FREQS + """,
pol AS (SELECT locus, chrom, pos, """ + ", ".join(
    f"CASE WHEN p4 > 0.5 THEN 1 - p{j} ELSE p{j} END AS p{j}" for j in (1, 2, 3, 4)) + """
  FROM freqs)"""


@query("polarise_outgroup", POLARISED + """
SELECT locus, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4
FROM pol""")
def polarise_outgroup(spark, sf):
    p = ct.polarise_outgroup(freqs4(spark, sf)).drop("chrom", "pos")
    return rounded_all(p, ["locus"])


def with_bases(counts):
    """Ref, alt and ancestral base of a locus, derived from its number."""
    bases = F.split(F.lit("A,C,G,T"), ",")

    def at(x):
        return F.get(bases, (x % 4).cast("int"))
    k = F.col("locus")
    return (counts.withColumn("ref", at(k)).withColumn("alt", at(k + 1 + k % 3))
            .withColumn("aa", F.when(k % 7 == 0, F.lit(None)).otherwise(at(k + k % 5))))


def at_sql(x):
    return f"substr('ACGT', CAST(({x}) % 4 + 1 AS INTEGER), 1)"


@query("polarise_ancestral", OBS4_COUNTS + f""",
b AS (SELECT *, {at_sql('locus')} AS ref, {at_sql('locus + 1 + locus % 3')} AS alt,
        CASE WHEN locus % 7 = 0 THEN NULL ELSE {at_sql('locus + locus % 5')} END AS aa
      FROM counts4)
SELECT locus, aa, """ + ", ".join(
    f"round(CASE WHEN aa = ref THEN c2_{j} ELSE c1_{j} END::DOUBLE / {v.n_sql(j)}, 6) AS p{j}"
    for j in (1, 2, 3, 4)) + """ FROM b WHERE (aa = ref OR aa = alt) AND """ + " AND ".join(
    f"{v.n_sql(j)} > 0" for j in (1, 2, 3, 4)))
def polarise_ancestral(spark, sf):
    p = ct.polarise_ancestral(with_bases(counts4(spark, sf)))
    return rounded_all(p.select("locus", "aa", "p1", "p2", "p3", "p4"), ["locus", "aa"])


@query("heterozygosity", "WITH " + v.GENOTYPES + ",\n" + """
c AS (SELECT locus, pop, coalesce(sum(a1) + sum(a2), 0) AS alt,
             count(a1) + count(a2) AS n FROM genotypes WHERE pop <> 'P4' GROUP BY ALL)
SELECT pop, round(avg(2 * (alt::DOUBLE / n) * (1 - alt::DOUBLE / n)), 6) AS heterozygosity
FROM c WHERE n >= 12 GROUP BY pop""")
def heterozygosity(spark, sf):
    c = ct.allele_table(v.genotypes(spark, sf), v.POPS)
    return rounded_all(ct.heterozygosity(c, 12, v.POPS), ["pop"])


CONFIG = "c1_1, c1_2, c1_3, c2_1, c2_2, c2_3"


@query("joint_sfs", SHALLOW + f" SELECT {CONFIG}, count(*) AS n_loci FROM counts GROUP BY ALL")
def joint_sfs(spark, sf):
    return ct.joint_sfs(shallow_counts(spark, sf))


# ------------------------------------------------------------------ rarefaction

@query("absence_probability", SHALLOW + ",\n" + DEPTHS_SQL + """,
cells AS (""" + " UNION ALL ".join(
    f"SELECT locus, {i} AS allele, {j} AS pop_index, {v.n_sql(j)} AS n, c{i}_{j} AS copies "
    f"FROM counts" for i in (1, 2) for j in (1, 2, 3)) + f""")
SELECT locus, allele, pop_index, n, copies, CAST(g AS INTEGER) AS g,
       round({v.absent_sql('n', 'copies')} + 1e-9, 6) AS q
FROM cells, depths WHERE g <= n""")
def absence_probability(spark, sf):
    a = rf.absence_table(shallow_counts(spark, sf), DEPTHS)
    return rounded_all(a, ["locus", "allele", "pop_index", "n", "copies", "g"], 1e-9)


def _locus_query(name, stats):
    sql = (SHALLOW + ",\n" + DEPTHS_SQL + ",\n" + v.per_locus_sql("counts", "s", stats=stats)
           + " SELECT locus, CAST(g AS INTEGER) AS g, "
           + ", ".join(f"round({s} + 1e-9, 6) AS {s}" for s in stats) + " FROM s")

    @query(name, sql)
    def run(spark, sf):
        s = rf.per_locus(shallow_counts(spark, sf).drop("chrom", "pos"), max(DEPTHS), stats)
        return rounded_all(s, ["locus", "g"], 1e-9)


_locus_query("allelic_richness", [b for b in BLOCKS if b.startswith("alpha")])
_locus_query("private_richness", [b for b in BLOCKS if b.startswith("pi_")])
_locus_query("pairwise_private_richness", [b for b in BLOCKS if b.startswith("pihat")])

COMBOS = rf.combination_names(4)
NEED4 = " AND ".join(f"{v.n_sql(j)} >= 2" for j in (1, 2, 3, 4))


@query("combination_private_richness", OBS4_COUNTS + f""",
counts AS (SELECT * FROM counts4 WHERE {NEED4}),
depths AS (SELECT 2 AS g),
""" + v.per_locus_sql("counts", "s", pops=4, stats=COMBOS) + f"""
SELECT CAST(g AS INTEGER) AS g, {v.moments_sql(COMBOS)} FROM s GROUP BY g""")
def combination_private_richness(spark, sf):
    c = ct.min_copies(counts4(spark, sf), 2).drop("locus", "chrom", "pos")
    sums = rf.depth_sums(c, 2, (), COMBOS)
    return rounded_all(rf.finalise(sums, (), COMBOS), ["g"])


REGIONS = ["R0", "R1", "R2", "R3", "R4"]
COMBOS5 = rf.combination_names(5)
REGION_DEPTH = 48


@query("region_combinations", "WITH " + v.OBS5 + ",\n" + v.counts_sql(
    "obs5", "counts", pops=REGIONS, alleles=(1, 2, 3, 4, 5)) + f""",
depths AS (SELECT unnest(range(2, least({REGION_DEPTH}, (SELECT min({v.least_n(5, 5)})
  FROM counts))::BIGINT + 1)) AS g),
""" + v.per_locus_sql("counts", "s", k=5, pops=5, stats=COMBOS5) + f"""
SELECT CAST(g AS INTEGER) AS g, {v.moments_sql(COMBOS5)} FROM s GROUP BY g""")
def region_combinations(spark, sf):
    """All 31 combinations of five regions at every depth up to 48, alleles not known
    beforehand: the shape of the published rarefaction timing."""
    cells = ct.allele_cells(v.obs5(spark, sf), REGIONS).drop("locus")
    sums = rf.depth_sums(cells, REGION_DEPTH, (), COMBOS5)
    return rounded_all(rf.finalise(sums, (), COMBOS5), ["g"])


@query("depth_grid", SHALLOW + f"""
SELECT CAST(unnest(range(2, (SELECT min({v.least_n()}) FROM counts)::BIGINT + 1)) AS INTEGER) AS g
""")
def depth_grid(spark, sf):
    return rf.depth_grid(shallow_counts(spark, sf))


def _moments_sql(counts_cte):
    return (counts_cte + ",\n" + GRID_SQL + ",\n" + v.per_locus_sql("counts", "s", stats=BLOCKS)
            + f" SELECT CAST(g AS INTEGER) AS g, {v.moments_sql(BLOCKS)} FROM s GROUP BY g")


@query("rarefaction_moments", _moments_sql(SHALLOW))
def rarefaction_moments(spark, sf):
    """Uncollapsed path: every locus on its own, built-in variance."""
    c = shallow_counts(spark, sf)
    stats = rf.per_locus(c, None)
    m = rf.moments(stats)
    # depths every locus reaches
    reach = ct.max_depth(c).withColumnRenamed("max_depth", "_d")
    m = m.join(F.broadcast(reach), F.col("g") <= F.col("_d")).drop("_d", "n_loci")   # one row
    return rounded_all(m, ["g"])


def _higher_sql():
    parts = []
    for s in BLOCKS:
        parts.append(f"""round(CASE WHEN {s}_m2 < 1e-18 THEN NULL ELSE
          {s}_m3 / pow({s}_m2, 1.5) END, 4) + 0.0 AS {s}_skewness,
        round(CASE WHEN {s}_m2 < 1e-18 THEN NULL ELSE
          {s}_m4 / ({s}_m2 * {s}_m2) - 3 END, 4) + 0.0 AS {s}_kurtosis""")
    means = ", ".join(f"avg({s}) AS {s}_m" for s in BLOCKS)
    central = ", ".join(f"avg(pow({s} - {s}_m, {k})) AS {s}_m{k}" for s in BLOCKS
                        for k in (2, 3, 4))
    return (SHALLOW + ",\n" + DEPTHS_SQL + ",\n" + v.per_locus_sql("counts", "s", stats=BLOCKS)
            + f""",
mu AS (SELECT g, {means} FROM s GROUP BY g),
m AS (SELECT g, {central} FROM s JOIN mu USING (g) GROUP BY g)
SELECT CAST(g AS INTEGER) AS g, {', '.join(parts)} FROM m""")


@query("rarefaction_higher_moments", _higher_sql())
def rarefaction_higher_moments(spark, sf):
    m = rf.moments(rf.per_locus(shallow_counts(spark, sf), max(DEPTHS)), higher=True)
    return m.select("g", *[rounded(f"{s}_{k}", 4).alias(f"{s}_{k}")
                           for s in BLOCKS for k in ("skewness", "kurtosis")])


@query("feature_matrix", _moments_sql(DEEP_SQL))
def feature_matrix(spark, sf):
    """Flagship: the 28-column matrix of a three-population table."""
    return rounded_all(rf.feature_matrix(deep_counts(spark, sf), DEEP), ["g"])


@query("pair_private_ratio", DEEP_SQL + ",\n" + GRID_SQL + ",\n" + v.per_locus_sql(
    "counts", "s", stats=["pihat_13", "pihat_23"]) + """,
m AS (SELECT g, avg(pihat_13) AS p13, avg(pihat_23) AS p23 FROM s GROUP BY g)
SELECT round(avg(p13), 6) AS pihat_13, round(avg(p23), 6) AS pihat_23,
       round(avg(p23) / nullif(avg(p13), 0), 6) AS ratio FROM m""")
def pair_private_ratio(spark, sf):
    return rounded_all(rf.pair_private_ratio(rf.feature_matrix(deep_counts(spark, sf), DEEP)), [])


CAPS = [6, 8, 10, 12, 14, 16]


@query("depth_sweep", DEEP_SQL + ",\n" + GRID_SQL + ",\n" + v.per_locus_sql(
    "counts", "s", stats=BLOCKS) + f""",
f AS (SELECT g, {v.moments_sql(BLOCKS)} FROM s GROUP BY g),
caps AS (SELECT unnest({CAPS}) AS cap)
SELECT CAST(cap AS INTEGER) AS cap, CAST(count(*) AS BIGINT) AS n_depths,
       round(avg(pihat_13_mean), 5) AS pihat_13, round(avg(pihat_23_mean), 5) AS pihat_23
FROM f, caps WHERE g <= cap GROUP BY cap""")
def depth_sweep(spark, sf):
    f = rounded_all(rf.feature_matrix(deep_counts(spark, sf), max(CAPS)), ["g"])
    return rf.depth_sweep(f, CAPS).groupBy("cap").agg(
        F.count(F.lit(1)).alias("n_depths"),
        rounded(F.avg("pihat_13_mean"), 5).alias("pihat_13"),
        rounded(F.avg("pihat_23_mean"), 5).alias("pihat_23"))


@query("feature_matrix_by_replicate", "WITH " + v.features_sql(True) + """
SELECT * EXCLUDE (direction, magnitude) FROM features""")
def feature_matrix_by_replicate(spark, sf):
    f = rf.feature_matrix(v.rep_counts(spark, sf), v.FEATURE_DEPTH, ["replicate"])
    return rounded_all(f, ["replicate", "g"])


# multi-allelic loci: alleles unknown beforehand, counts held as arrays
def _multi_sql():
    k = 5
    need = " AND ".join(f"{v.n_sql(j, k)} >= {MIN_COPIES}" for j in (1, 2, 3))
    return ("WITH " + v.MULTI_OBS + ",\n"
            + v.counts_sql("multi_obs", "all_counts", alleles=(1, 2, 3, 4, 5))
            + f",\ncounts AS (SELECT * FROM all_counts WHERE {need}),\n" + DEPTHS_SQL + ",\n"
            + v.per_locus_sql("counts", "s", k=k, stats=BLOCKS)
            + f" SELECT CAST(g AS INTEGER) AS g, {v.moments_sql(BLOCKS)} FROM s GROUP BY g")


@query("multiallelic_features", _multi_sql())
def multiallelic_features(spark, sf):
    cells = ct.allele_cells(v.multi_obs(spark, sf), v.POPS)
    for name in ("c_1", "c_2", "c_3"):
        cells = cells.where(rf.cells_total(name) >= MIN_COPIES)
    return rounded_all(rf.feature_matrix(cells, max(DEPTHS)), ["g"])


def _loo_sql():
    return (DEEP_SQL.replace("SELECT locus, CAST", "SELECT locus, chrom, CAST")
            .replace("GROUP BY locus", "GROUP BY locus, chrom")
            + ",\n" + "depths AS (SELECT unnest(range(2, 11)) AS g),\n"
            + v.per_locus_sql("counts", "s", "locus, chrom", stats=BLOCKS)
            + f""",
drops AS (SELECT DISTINCT chrom AS dropped FROM counts)
SELECT dropped AS chrom, count(*) AS n_loci, CAST(g AS INTEGER) AS g, {v.moments_sql(BLOCKS)}
FROM s, drops WHERE chrom <> dropped GROUP BY dropped, g""")


@query("leave_one_block_out_features", _loo_sql())
def leave_one_block_out_features(spark, sf):
    c = ct.allele_table(v.deep_obs(spark, sf), v.POPS, locus=("locus", "chrom"))
    return rounded_all(rf.leave_one_out(c, "chrom", 10), ["chrom", "n_loci", "g"])


# ------------------------------------------------------------------ classical

def sites4(spark, sf):
    return cl.abba_baba(ct.polarise_outgroup(freqs4(spark, sf)))


SITES = POLARISED + """,
sites AS (SELECT *, (1 - p1) * p2 * p3 * (1 - p4) AS abba, p1 * (1 - p2) * p3 * (1 - p4) AS baba
  FROM pol)"""


@query("abba_baba_sites", SITES + """
SELECT locus, round(abba, 6) + 0.0 AS abba, round(baba, 6) + 0.0 AS baba FROM sites""")
def abba_baba_sites(spark, sf):
    return rounded_all(sites4(spark, sf).select("locus", "abba", "baba"), ["locus"])


@query("patterson_d", SITES + """
SELECT round((sum(abba) - sum(baba)) / nullif(sum(abba) + sum(baba), 0), 6) AS d,
       round(sum(abba), 6) AS n_abba, round(sum(baba), 6) AS n_baba FROM sites""")
def patterson_d(spark, sf):
    return rounded_all(cl.patterson_d(sites4(spark, sf)), [])


BLOCK_SUMS = SITES + """,
blocks AS (SELECT chrom, CAST(floor(pos / 500000) AS BIGINT) AS block, sum(abba) AS abba,
    sum(baba) AS baba, sum(abba - baba) AS num, sum(abba + baba) AS den, count(*) AS n_sites
  FROM sites GROUP BY ALL)"""


@query("genomic_blocks", BLOCK_SUMS + """
SELECT chrom, block, n_sites, round(num, 6) + 0.0 AS num, round(den, 6) + 0.0 AS den
FROM blocks""")
def genomic_blocks(spark, sf):
    b = cl.block_sums(sites4(spark, sf)).select("chrom", "block", "n_sites", "num", "den")
    return rounded_all(b, ["chrom", "block", "n_sites"])


@query("weighted_block_jackknife", BLOCK_SUMS + """,
t AS (SELECT sum(num) AS tn, sum(den) AS td, count(*) AS g, sum(abba) AS ta, sum(baba) AS tb
      FROM blocks),
o AS (SELECT den AS m, td, g, tn / td AS theta, (tn - num) / (td - den) AS out, ta, tb
      FROM blocks, t),
j AS (SELECT max(g) * max(theta) - sum((1 - m / td) * out) AS tj FROM o),
s AS (SELECT max(theta) AS d, max(g) AS g, max(ta) AS ta, max(tb) AS tb,
        sum(pow((td / m) * theta - (td / m - 1) * out - tj, 2) / (td / m - 1)) / max(g) AS var
      FROM o, j WHERE m <> 0)
SELECT round(d, 6) AS d, round(sqrt(var), 6) AS se, round(ta, 6) AS n_abba,
       round(tb, 6) AS n_baba, g AS n_blocks, round(d / sqrt(var), 5) AS z FROM s""")
def weighted_block_jackknife(spark, sf):
    j = cl.weighted_jackknife(cl.block_sums(sites4(spark, sf)))
    return j.select(*[rounded(c).alias(c) for c in ("d", "se", "n_abba", "n_baba")],
                    "n_blocks", rounded("z", 5).alias("z"))


def _chrom_jackknife(prefix, group=""):
    by = f"{group}, " if group else ""
    over = f"PARTITION BY {group}" if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return f"""{prefix},
cb AS (SELECT {by}chrom, sum(abba) AS abba, sum(baba) AS baba, sum(abba - baba) AS num,
         sum(abba + baba) AS den FROM sites GROUP BY ALL),
o AS (SELECT *, sum(num) OVER ({over}) AS tn, sum(den) OVER ({over}) AS td,
        count(*) OVER ({over}) AS g FROM cb),
q AS (SELECT *, tn / nullif(td, 0) AS theta, (tn - num) / nullif(td - den, 0) AS out FROM o),
r AS (SELECT {by}max(theta) AS d, max(g) AS g, sum(abba) AS ta, sum(baba) AS tb,
        sqrt((max(g) - 1) / max(g)::DOUBLE * var_pop(out) * count(out)) AS se FROM q{tail})
SELECT {by}round(d, 6) + 0.0 AS d, round(se, 6) AS se, round(ta, 6) AS n_abba,
  round(tb, 6) AS n_baba, g AS n_blocks, round(d / nullif(se, 0), 5) + 0.0 AS z"""


@query("chromosome_jackknife", _chrom_jackknife(SITES) + " FROM r")
def chromosome_jackknife(spark, sf):
    j = cl.unweighted_jackknife(cl.block_sums(sites4(spark, sf), None))
    return j.select(*[rounded(c).alias(c) for c in ("d", "se", "n_abba", "n_baba")],
                    "n_blocks", rounded("z", 5).alias("z"))


@query("f4_statistic", FREQS + " SELECT round(avg((p1 - p2) * (p3 - p4)), 6) + 0.0 AS f4 FROM freqs")
def f4_statistic(spark, sf):
    return rounded_all(cl.f4_statistic(freqs4(spark, sf)), [])


@query("f3_statistic", FREQS + " SELECT round(avg((p3 - p1) * (p3 - p2)), 6) + 0.0 AS f3 FROM freqs")
def f3_statistic(spark, sf):
    return rounded_all(cl.f3_statistic(freqs4(spark, sf)), [])


TRIOS = {"P1_P2_P3": ["p1", "p2", "p3", "p4"], "P1_P3_P2": ["p1", "p3", "p2", "p4"],
         "P2_P3_P1": ["p2", "p3", "p1", "p4"], "P2_P1_P3": ["p2", "p1", "p3", "p4"]}
TRIO_SITES = POLARISED + """,
trios AS (""" + " UNION ALL ".join(
    f"SELECT '{t}' AS trio, chrom, {c[0]} AS p1, {c[1]} AS p2, {c[2]} AS p3, {c[3]} AS p4 FROM pol"
    for t, c in TRIOS.items()) + """),
sites AS (SELECT *, (1 - p1) * p2 * p3 * (1 - p4) AS abba, p1 * (1 - p2) * p3 * (1 - p4) AS baba
  FROM trios)"""


def trio_d(spark, sf):
    return cl.d_by_trio(ct.polarise_outgroup(freqs4(spark, sf)), TRIOS)


@query("d_by_trio", _chrom_jackknife(TRIO_SITES, "trio") + " FROM r")
def d_by_trio(spark, sf):
    j = trio_d(spark, sf)
    return j.select("trio", *[rounded(c).alias(c) for c in ("d", "se", "n_abba", "n_baba")],
                    "n_blocks", rounded("z", 5).alias("z"))


@query("d_decision_rule", _chrom_jackknife(TRIO_SITES, "trio").replace(
    "SELECT trio, round(d, 6) + 0.0 AS d, round(se, 6) AS se",
    "SELECT trio, coalesce(abs(d / nullif(se, 0)) > 0.5, FALSE) AS introgressing, "
    "CASE WHEN coalesce(abs(d / nullif(se, 0)) > 0.5, FALSE) THEN 'flow' ELSE 'D' END AS call, "
    "round(se, 6) AS se") + " FROM r")
def d_decision_rule(spark, sf):
    """A threshold of 0.5 splits the stand-in trios; the default is 3."""
    j = cl.d_decision(trio_d(spark, sf), 0.5)
    return j.select("trio", "introgressing", "call", rounded("se").alias("se"),
                    rounded("n_abba").alias("n_abba"), rounded("n_baba").alias("n_baba"),
                    "n_blocks", rounded("z", 5).alias("z"))


@query("leave_one_block_out", SITES + """,
cb AS (SELECT chrom, sum(abba - baba) AS num, sum(abba + baba) AS den, count(*) AS n
       FROM sites GROUP BY chrom)
SELECT a.chrom AS dropped, CAST(sum(b.n) AS BIGINT) AS n_left,
       round(sum(b.num) / nullif(sum(b.den), 0), 6) + 0.0 AS d
FROM cb a JOIN cb b ON a.chrom <> b.chrom GROUP BY a.chrom HAVING sum(b.n) >= 1000""")
def leave_one_block_out(spark, sf):
    b = cl.leave_one_block_out(cl.block_sums(sites4(spark, sf), None), min_sites=1000)
    return rounded_all(b, ["dropped", "n_left"])


# ------------------------------------------------------------------ whole depth range
# The queries above stop at small depths; these run to each locus' own depth, DEEP at most.

ALL_DEPTHS_SQL = f"depths AS (SELECT unnest(range(2, {DEEP + 1})) AS g)"


@query("absence_probability_full", ORACLES["absence_probability"].replace(DEPTHS_SQL, ALL_DEPTHS_SQL))
def absence_probability_full(spark, sf):
    a = rf.absence_table(shallow_counts(spark, sf), range(2, DEEP + 1))
    return rounded_all(a, ["locus", "allele", "pop_index", "n", "copies", "g"], 1e-9)


def _full_locus_query(name, stats):
    sql = (SHALLOW + ",\n" + ALL_DEPTHS_SQL + ",\n" + v.per_locus_sql(
        "counts", "s", stats=stats, source=f"counts JOIN depths ON g <= {v.least_n()}")
        + " SELECT locus, CAST(g AS INTEGER) AS g, " + ", ".join(f"round({s} + 1e-9, 6) AS {s}" for s in stats) + " FROM s")

    @query(name, sql)
    def run(spark, sf):
        s = rf.per_locus(shallow_counts(spark, sf).drop("chrom", "pos"), DEEP, stats)
        return rounded_all(s, ["locus", "g"], 1e-9)


_full_locus_query("allelic_richness_full", [b for b in BLOCKS if b.startswith("alpha")])
_full_locus_query("private_richness_full", [b for b in BLOCKS if b.startswith("pi_")])
_full_locus_query("pairwise_private_richness_full", [b for b in BLOCKS if b.startswith("pihat")])


@query("leave_one_block_out_features_full", _loo_sql().replace(
    "depths AS (SELECT unnest(range(2, 11)) AS g)",
    f"lim AS (SELECT chrom, min({v.least_n()}) AS d FROM counts GROUP BY chrom),\n" + ALL_DEPTHS_SQL).replace(
    "WHERE chrom <> dropped", "WHERE chrom <> dropped AND g <= (SELECT min(d) FROM lim WHERE lim.chrom <> dropped)"))
def leave_one_block_out_features_full(spark, sf):
    c = ct.allele_table(v.deep_obs(spark, sf), v.POPS, locus=("locus", "chrom"))
    return rounded_all(rf.leave_one_out(c, "chrom", DEEP), ["chrom", "n_loci", "g"])


# ------------------------------------------------------------------ every subset of many populations

N_POPS = 12


def obs12(spark, sf):
    """Multi-allelic observations of twelve populations: nations modulo twelve."""
    return (v.table(spark, sf, "lineitem").join(v.order_nations(spark, sf), F.col("l_orderkey") == F.col("o_orderkey"))
            .selectExpr("l_suppkey AS locus", f"concat('N', c_nationkey % {N_POPS}) AS pop", "int(ceil(l_quantity / 10)) AS allele"))


@query("subset_lattice_richness", f"""WITH o AS (
  SELECT l_suppkey AS locus, c_nationkey % {N_POPS} AS pop, CAST(ceil(l_quantity / 10) AS INTEGER) AS allele, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
loci AS (SELECT DISTINCT locus FROM o), alleles AS (SELECT DISTINCT locus, allele FROM o),
pops AS (SELECT unnest(range({N_POPS})) AS pop),
full_ AS (SELECT a.locus, a.allele, p.pop, coalesce(o.n, 0) AS c FROM alleles a, pops p
  LEFT JOIN o ON o.locus = a.locus AND o.allele = a.allele AND o.pop = p.pop),
totals AS (SELECT locus, pop, sum(c) AS n FROM full_ GROUP BY ALL),
grid AS (SELECT unnest(range(2, CAST(least(min(n), 30) AS BIGINT) + 1)) AS g FROM totals),
q AS (SELECT locus, allele, g, list(CASE WHEN n - c < g THEN 0.0::DOUBLE ELSE
    exp(lgamma(n - c + 1) - lgamma(n - c - g + 1) + lgamma(n - g + 1) - lgamma(n + 1)) END ORDER BY pop) AS q
  FROM full_ JOIN totals USING (locus, pop), grid GROUP BY ALL),
l AS (SELECT locus, g, allele, list_reduce(list_prepend([1.0::DOUBLE], list_transform(q, lambda x: [x])),
    lambda v, x: list_concat(list_transform(v, lambda y: y * x[1]), list_transform(v, lambda y: y * (1 - x[1])))) AS v FROM q),
e AS (SELECT locus, g, m, v[m + 1] AS x FROM l, (SELECT unnest(range(1, {2 ** N_POPS})) AS m)),
s AS (SELECT locus, g, m, sum(x) AS x FROM e GROUP BY ALL)
SELECT CAST(g AS INTEGER) AS g, CAST(m AS INTEGER) AS subset, count(*) AS n_loci, round(avg(x), 5) + 0.0 AS mean,
  round(var_samp(x), 5) + 0.0 AS variance FROM s GROUP BY ALL""")
def subset_lattice_richness(spark, sf):
    """Private richness of all 4,095 subsets of twelve populations at every shared depth, 30 at most."""
    c = ct.allele_cells(obs12(spark, sf), [f"N{k}" for k in range(N_POPS)]).drop("locus")
    m = rf.subset_moments(c, 30)
    return m.select("g", "subset", "n_loci", rounded("mean", 5).alias("mean"), rounded("variance", 5).alias("variance"))
