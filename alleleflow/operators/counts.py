"""Allele counts per locus and population, and what follows directly from them.

A counts table has one row per (keys, locus) and a column `c{i}_{j}` for the i-th allele of
`alleles` in the j-th population of `pop_order` (both 1-based), so one map-side combined
shuffle by locus is all the data movement it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alleleflow.functions.exprs import add, nan_to_null, smallest


def copies_of(df: DataFrame, allele) -> Column:
    """Copies of `allele` carried by a row: an observation (`allele`, optional weight `n`)
    or a diploid call (`a1`, `a2`; NULL = missing)."""
    if "allele" in df.columns:
        weight = F.col("n") if "n" in df.columns else F.lit(1)
        return F.when(F.col("allele") == allele, weight).otherwise(0)
    return (F.coalesce((F.col("a1") == allele).cast("int"), F.lit(0))
            + F.coalesce((F.col("a2") == allele).cast("int"), F.lit(0)))


def called_copies(alleles=(0, 1)) -> Column:
    """Called gene copies of a diploid row: only the listed alleles count."""
    return add([F.coalesce(F.col(a).isin(*alleles).cast("int"), F.lit(0)) for a in ("a1", "a2")])


def count_columns(n_alleles: int, n_pops: int) -> list[str]:
    return [f"c{i}_{j}" for i in range(1, n_alleles + 1) for j in range(1, n_pops + 1)]


def shape_of(counts: DataFrame) -> tuple[int, int]:
    """(number of alleles, number of populations) of a counts table."""
    ij = [c[1:].split("_") for c in counts.columns
          if c[0] == "c" and c[1:].replace("_", "").isdigit()]
    return max(int(i) for i, _ in ij), max(int(j) for _, j in ij)


def total_sql(n_alleles: int, j: int) -> str:
    return "(" + " + ".join(f"c{i}_{j}" for i in range(1, n_alleles + 1)) + ")"


def total_copies(n_alleles: int, j: int) -> Column:
    return F.expr(total_sql(n_alleles, j))


def allele_table(obs: DataFrame, pop_order, alleles=(0, 1), locus=("locus",),
                 keys=()) -> DataFrame:
    """Counts table of long observations or diploid calls."""
    def copies(p, a):
        # literals are quoted by repr; populations and alleles are plain names and codes
        if "allele" in obs.columns:
            weight = "n" if "n" in obs.columns else "1"
            return f"if(pop = {p!r} AND allele = {a!r}, {weight}, 0)"
        return (f"if(pop = {p!r}, coalesce(int(a1 = {a!r}), 0) + coalesce(int(a2 = {a!r}), 0),"
                " 0)")
    aggs = [F.expr(f"int(coalesce(sum({copies(p, a)}), 0))").alias(f"c{i}_{j}")
            for i, a in enumerate(alleles, 1) for j, p in enumerate(pop_order, 1)]
    return obs.where(F.col("pop").isin(list(pop_order))).groupBy(*keys, *locus).agg(*aggs)


def allele_counts(obs: DataFrame, keys=("locus", "pop")) -> DataFrame:
    """Long form: copies of every observed allele; missing alleles are not counted."""
    if "allele" not in obs.columns:
        obs = obs.withColumn("allele", F.explode(F.array("a1", "a2")))
    weight = F.col("n") if "n" in obs.columns else F.lit(1)
    return (obs.where(F.col("allele").isNotNull())
            .groupBy(*keys, "allele").agg(F.sum(weight).alias("n")))


def allele_cells(obs: DataFrame, pop_order, locus=("locus",), keys=()) -> DataFrame:
    """Counts table for an unknown set of alleles: `cells`, one array of counts per allele.

    Observations are first summed per allele, so the collected array holds only the distinct
    alleles of one locus. It is sorted, since no statistic depends on allele labels."""
    if "allele" not in obs.columns:
        obs = obs.withColumn("allele", F.explode(F.array("a1", "a2")))
    weight = F.col("n") if "n" in obs.columns else F.lit(1)
    per_allele = (
        obs.where(F.col("pop").isin(list(pop_order)) & F.col("allele").isNotNull())
        .groupBy(*keys, *locus, "allele")
        .agg(*[F.sum(F.when(F.col("pop") == p, weight).otherwise(0)).cast("int").alias(f"c_{j}")
               for j, p in enumerate(pop_order, 1)]))
    cell = F.struct(*[f"c_{j}" for j in range(1, len(pop_order) + 1)])
    return (per_allele.groupBy(*keys, *locus)
            .agg(F.array_sort(F.collect_list(cell)).alias("cells")))


def min_copies(counts: DataFrame, minimum, exempt=()) -> DataFrame:
    """Loci with at least `minimum` called copies in every population (a number, or one per
    population); `exempt` lists 1-based populations left out, such as an outgroup."""
    k, pops = shape_of(counts)
    need = minimum if isinstance(minimum, (list, tuple)) else [minimum] * pops
    for j in range(1, pops + 1):
        if j not in exempt:
            counts = counts.where(total_copies(k, j) >= need[j - 1])
    return counts


def full_coverage(counts: DataFrame, pop: int, copies: int) -> DataFrame:
    """Loci where population `pop` has exactly `copies` called copies."""
    k, _ = shape_of(counts)
    return counts.where(total_copies(k, pop) == copies)


def polymorphic(counts: DataFrame, pops=None) -> DataFrame:
    """Biallelic loci with both alleles present among the selected populations."""
    _, n = shape_of(counts)
    pops = pops or range(1, n + 1)
    return counts.where((add([F.col(f"c1_{j}") for j in pops]) > 0)
                        & (add([F.col(f"c2_{j}") for j in pops]) > 0))


def max_depth(counts: DataFrame, keys=()) -> DataFrame:
    """Deepest usable subsample: the smallest copy number over loci and populations."""
    k, pops = shape_of(counts)
    smallest_n = smallest(total_copies(k, j) for j in range(1, pops + 1))
    return counts.groupBy(*keys).agg(F.min(smallest_n).alias("max_depth"))


def joint_sfs(counts: DataFrame, keys=(), fold: bool = False) -> DataFrame:
    """Number of loci per count configuration. With `fold`, the two alleles of a biallelic
    table are put in one order first (no statistic distinguishes them), which about halves
    the configurations."""
    k, pops = shape_of(counts)
    names = count_columns(k, pops)
    weight = F.sum("n_loci") if "n_loci" in counts.columns else F.count(F.lit(1))
    if fold:
        first, second = ([f"c{i}_{j}" for j in range(1, pops + 1)] for i in (1, 2))
        swap = (f"struct({', '.join(f'{c} AS p{j}' for j, c in enumerate(first))}) > "
                f"struct({', '.join(f'{c} AS p{j}' for j, c in enumerate(second))})")
        held = [c for c in counts.columns if c == "n_loci"]
        counts = counts.selectExpr(
            *keys, *held, *[f"if({swap}, {b}, {a}) AS {a}" for a, b in zip(first, second)],
            *[f"if({swap}, {a}, {b}) AS {b}" for a, b in zip(first, second)])
    return counts.groupBy(*keys, *names).agg(weight.alias("n_loci"))


def allele_frequency(genotypes: DataFrame, by=("locus", "pop")) -> DataFrame:
    """Mean alternate dosage over ploidy; ploidy is 2 if any dosage in the table exceeds 1."""
    g = genotypes.withColumn("_d", nan_to_null(F.col("dosage").cast("double")))
    ploidy = g.agg(F.when(F.max("_d") > 1, 2.0).otherwise(1.0).alias("ploidy"))
    return (g.groupBy(*by).agg(F.avg("_d").alias("_m"))
            .crossJoin(F.broadcast(ploidy))          # one row
            .select(*by, (F.col("_m") / F.col("ploidy")).alias("freq")))


def site_frequencies(counts: DataFrame) -> DataFrame:
    """Frequency `p{j}` of the second allele; loci that are not biallelic over all
    populations together, or lack copies in one, are dropped."""
    k, pops = shape_of(counts)
    keep = [c for c in counts.columns if c not in count_columns(k, pops)]
    seen = [add([F.col(f"c{i}_{j}") for j in range(1, pops + 1)]) > 0 for i in range(1, k + 1)]
    out = counts.where(add([s.cast("int") for s in seen]) == 2)
    for j in range(1, pops + 1):
        out = out.where(total_copies(k, j) > 0)
    # the reference allele is the first one present
    alt = [F.coalesce(*[F.when(add([s.cast("int") for s in seen[:i]]) == 2, F.col(f"c{i}_{j}"))
                        for i in range(2, k + 1)]) for j in range(1, pops + 1)]
    return out.select(*keep, *[(alt[j - 1] / total_copies(k, j)).alias(f"p{j}")
                               for j in range(1, pops + 1)])


def polarise_outgroup(freqs: DataFrame, outgroup: str = "p4") -> DataFrame:
    """Flip every population where the outgroup carries mostly the alternate allele."""
    ps = [c for c in freqs.columns if c[0] == "p" and c[1:].isdigit()]
    flip = F.col(outgroup) > 0.5
    return freqs.select(*[F.when(flip, 1 - F.col(c)).otherwise(F.col(c)).alias(c)
                          if c in ps else F.col(c) for c in freqs.columns])


def polarise_ancestral(counts: DataFrame, ref="ref", alt="alt", ancestral="aa") -> DataFrame:
    """Derived-allele frequency per population given the ancestral base. Sites whose
    ancestral base is neither allele, or with an uncalled population, are dropped."""
    _, pops = shape_of(counts)
    keep = [c for c in counts.columns if c not in count_columns(2, pops)]
    out = counts.where((F.col(ancestral) == F.col(ref)) | (F.col(ancestral) == F.col(alt)))
    for j in range(1, pops + 1):
        out = out.where(total_copies(2, j) > 0)
    derived_is_alt = F.col(ancestral) == F.col(ref)
    return out.select(*keep, *[
        (F.when(derived_is_alt, F.col(f"c2_{j}")).otherwise(F.col(f"c1_{j}"))
         / total_copies(2, j)).alias(f"p{j}") for j in range(1, pops + 1)])


def heterozygosity(counts: DataFrame, minimum: int = 12, pop_order=None) -> DataFrame:
    """Mean of 2q(1-q) per population over sites with at least `minimum` called copies."""
    _, pops = shape_of(counts)
    labels = list(pop_order or range(1, pops + 1))
    aggs = []
    for j in range(1, pops + 1):
        n = total_copies(2, j)
        q = F.col(f"c2_{j}") / n
        aggs.append(F.avg(F.when(n >= minimum, 2 * q * (1 - q))).alias(f"h{j}"))
    pairs = F.array(*[F.struct(F.lit(labels[j - 1]).alias("pop"),
                               F.col(f"h{j}").alias("heterozygosity"))
                      for j in range(1, pops + 1)])
    return counts.agg(*aggs).select(F.inline(pairs))
