"""Site and sample filters, recoding and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alleleflow.functions.exprs import add, hash_order
from alleleflow.functions.ordered import hash_rank, site_rank

BASES = ["A", "C", "G", "T"]


def biallelic_snps(variants: DataFrame) -> DataFrame:
    return variants.where((F.length("ref") == 1) & (F.length("alt") == 1)
                          & ~F.col("alt").isin(".", "*"))


def major_minor(calls: DataFrame, site=("chrom", "pos"), order: str = "sample_idx") -> DataFrame:
    """Sites with exactly two distinct bases over the selected samples. The more frequent base
    becomes ref; a tie goes to the base seen first in sample order. Four conditional counts
    per site, so no per-site list is built."""
    def carries(base):
        return add([F.coalesce((F.col(b) == base).cast("int"), F.lit(0)) for b in ("b1", "b2")])

    def first_seen(base):
        at = [F.when(F.col(b) == base, F.col(order) * 2 + i) for i, b in enumerate(("b1", "b2"))]
        return F.min(F.coalesce(*at))

    aggs = []
    for base in BASES:
        aggs += [F.sum(carries(base)).alias(f"_n{base}"), first_seen(base).alias(f"_f{base}")]
    ranked = F.array_sort(F.array(*[
        F.when(F.col(f"_n{b}") > 0, F.struct((-F.col(f"_n{b}")).alias("k"),
                                            F.col(f"_f{b}").alias("f"), F.lit(b).alias("base")))
        for b in BASES]))
    present = F.filter(ranked, lambda x: x.isNotNull())
    return (calls.groupBy(*site).agg(*aggs)
            .withColumn("_r", present).where(F.size("_r") == 2)
            .select(*site, F.col("_r")[0]["base"].alias("ref"), F.col("_r")[1]["base"].alias("alt"),
                    (-F.col("_r")[0]["k"]).alias("n_ref"), (-F.col("_r")[1]["k"]).alias("n_alt")))


def major_minor_counts(calls: DataFrame, pop_order, site=("chrom", "pos"),
                       order: str = "sample_idx") -> DataFrame:
    """Counts table of the recoded sites without going back to the calls: copies of each base
    per population are enough to choose ref and alt and to count them, so one shuffle by site
    does both `major_minor` and the counting."""
    aggs = []
    for b in BASES:
        seen = f"coalesce(if(b1 = '{b}', {order} * 2, NULL), if(b2 = '{b}', {order} * 2 + 1, NULL))"
        aggs.append(f"min({seen}) AS _f{b}")
        for j, p in enumerate(pop_order, 1):
            aggs.append(f"sum(if(pop = {p!r}, coalesce(int(b1 = '{b}'), 0) + "
                        f"coalesce(int(b2 = '{b}'), 0), 0)) AS _n{b}{j}")
    pops = range(1, len(pop_order) + 1)
    entries = ", ".join(
        f"struct(-({' + '.join(f'_n{b}{j}' for j in pops)}) AS k, _f{b} AS f, '{b}' AS base, "
        f"array({', '.join(f'_n{b}{j}' for j in pops)}) AS n)" for b in BASES)
    return (calls.where(F.col("pop").isin(list(pop_order)))
            .groupBy(*site).agg(*[F.expr(a) for a in aggs])
            .selectExpr(*site, f"array_sort(filter(array({entries}), x -> x.k < 0)) AS _r")
            .where("size(_r) = 2")
            .selectExpr(*site, "_r[0].base AS ref", "_r[1].base AS alt", *[
                f"int(_r[{i - 1}].n[{j - 1}]) AS c{i}_{j}" for i in (1, 2) for j in pops]))


def recode_to_sites(calls: DataFrame, sites: DataFrame, site=("chrom", "pos")) -> DataFrame:
    """Base calls of the kept sites as 0 (ref), 1 (alt) or NULL."""
    def code(b):
        return (F.when(F.col(b) == F.col("ref"), 0).when(F.col(b) == F.col("alt"), 1))
    return (calls.join(sites.select(*site, "ref", "alt"), list(site))
            .withColumn("a1", code("b1")).withColumn("a2", code("b2")).drop("b1", "b2"))


def ancestral_allele(variants: DataFrame, info: str = "info") -> DataFrame:
    """`aa` from the AA= entry: text before '|', trimmed, upper case, only A/C/G/T. Rows whose
    ancestral base is unknown or is neither ref nor alt are dropped."""
    # the first AA= entry decides
    raw = F.regexp_extract(F.col(info), r"(?:^|;)AA=([^;|]*)", 1)
    base = F.upper(F.trim(raw))
    return (variants.withColumn("aa", F.when(base.isin(BASES), base))
            .where((F.col("aa") == F.col("ref")) | (F.col("aa") == F.col("alt"))))


def resolve_bases(variants: DataFrame) -> DataFrame:
    """Numeric genotype codes of a single-sample call set to bases `n1`, `n2` (multi-ALT list
    allowed). Rows with a long ref, a missing allele or a non-single-base allele are dropped."""
    alts = F.split("alt", ",")

    def base(code):
        c = F.col(code)
        picked = F.when(c == 0, F.col("ref")).when(c > 0, F.get(alts, c - 1))
        return F.when(F.length(picked) == 1, picked)
    return (variants.where(F.length("ref") == 1)
            .withColumn("n1", base("a1")).withColumn("n2", base("a2"))
            .where(F.col("n1").isNotNull() & F.col("n2").isNotNull()))


def recode_against(calls: DataFrame, ref="ref", alt="alt", call_ref="call_ref") -> DataFrame:
    """Recode bases `n1`, `n2` against a panel's ref/alt into `a1`, `a2`. A different reference
    base or an allele the panel does not have drops the row."""
    def code(b):
        return F.when(F.col(b) == F.col(ref), 0).when(F.col(b) == F.col(alt), 1)
    return (calls.where(F.col(call_ref) == F.col(ref))
            .withColumn("a1", code("n1")).withColumn("a2", code("n2"))
            .where(F.col("a1").isNotNull() & F.col("a2").isNotNull()))


def last_call(calls: DataFrame, order, site=("chrom", "pos")) -> DataFrame:
    """One row per position: the last one in `order`."""
    values = [c for c in calls.columns if c not in site]
    return (calls.groupBy(*site)
            .agg(F.max_by(F.struct(*values), F.col(order)).alias("_v"))
            .select(*site, "_v.*"))


def last_bases(calls: DataFrame, order: str, site=("chrom", "pos")) -> DataFrame:
    """The last row of each position in `order` (whole numbers from 0 below 2^51) of a single-sample
    call set, resolved to bases: site, call_ref, n1, n2. Positions whose last row `resolve_bases`
    would drop are dropped. Order and bases are packed into one long, so the last row is a plain
    maximum that hashes and combines before the shuffle, with no sort of the calls."""
    def resolved(code):
        return f"CASE WHEN {code} = 0 THEN ref WHEN {code} > 0 THEN get(split(alt, ','), {code} - 1) END"

    def base(b):
        return f"bigint(if(length({b}) = 1, coalesce(instr('ACGT', {b}), 0), 0))"
    n1, n2 = resolved("a1"), resolved("a2")
    held = (f"if({order} >= 0 AND {order} < shiftleft(1L, 51), shiftleft(bigint({order}), 12), "
            f"bigint(raise_error('order does not fit 51 bits'))) + 256 * {base('ref')} + 16 * {base(n1)} + {base(n2)}")
    last = calls.select(*site, F.expr(held).alias("_v")).groupBy(*site).agg(F.max("_v").alias("_v"))

    def shown(shift):
        return f"substr('ACGT', int(shiftright(_v, {shift}) & 15), 1)"
    return (last.where("_v & 15 > 0 AND _v & 240 > 0 AND _v & 3840 > 0")
            .selectExpr(*site, f"{shown(8)} AS call_ref", f"{shown(4)} AS n1", f"{shown(0)} AS n2"))


def intersect_positions(panel: DataFrame, call_sets: dict[str, DataFrame],
                        site=("chrom", "pos")) -> DataFrame:
    """Panel sites present in every call set (each with one row per position), carrying the
    call set's columns as `<tag>_<column>`."""
    out = panel
    for tag, calls in call_sets.items():
        renamed = calls.select(*site, *[F.col(c).alias(f"{tag}_{c}")
                                        for c in calls.columns if c not in site])
        out = out.join(renamed, list(site))
    return out


def first_n_per_population(samples: DataFrame, n: int, order: str = "sample_idx") -> DataFrame:
    """First n samples of each population in header order. Spark trims every partition to n
    rows per population before the shuffle."""
    w = Window.partitionBy("pop").orderBy(order)
    return samples.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def _alleles(sites: DataFrame) -> list[str]:
    """Columns that tell sites at one position apart."""
    return [c for c in ("ref", "alt") if c in sites.columns]


def cap_per_window(sites: DataFrame, per_window: int, target: int,
                   window: str = "window_id", pos: str = "pos") -> DataFrame:
    """At most `per_window` sites per window by position and at most `target` overall, windows
    taken in order."""
    ranked = site_rank(sites, [window], pos, ties=_alleles(sites), limit=per_window)
    kept = sites.groupBy(window).agg(
        F.least(F.count(F.lit(1)), F.lit(per_window)).alias("_k"))
    before = (Window.partitionBy().orderBy(window)          # one row per window
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = kept.select(window, F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_s"))
    return (ranked.join(starts, window).where(F.col("_s") + F.col("rank") <= target)
            .drop("_s", "rank"))


def thin_evenly(sites: DataFrame, n: int, chrom: str = "chrom", pos: str = "pos",
                bin_size: int = 1_000_000) -> DataFrame:
    """n sites at the evenly spaced indices floor(k * (total - 1) / (n - 1)) of genome order;
    all sites if there are not more than n. Whether an index is one of them is decided per
    row, from the index and the total."""
    per_chrom = sites.groupBy(chrom).agg(F.count(F.lit(1)).alias("_k"))
    before = (Window.partitionBy().orderBy(chrom)           # one row per chromosome
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = per_chrom.select(chrom, F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_s"),
                              F.sum("_k").over(Window.partitionBy()).alias("_total"))
    indexed = (site_rank(sites, [chrom], pos, bin_size, ties=_alleles(sites)).join(starts, chrom)
               .withColumn("_i", F.col("_s") + F.col("rank") - 1))
    if n < 2:
        return indexed.where(F.col("_i") < n).drop("_s", "_total", "_i", "rank")
    step = (F.col("_total") - 1).cast("double") / F.lit(float(n - 1))
    guess = F.ceil(F.col("_i") / step)
    hits = [F.floor((guess + d) * step) == F.col("_i") for d in (-1, 0, 1)]
    is_last = F.col("_i") == F.col("_total") - 1
    wanted = (F.col("_total") <= n) | is_last | hits[0] | hits[1] | hits[2]
    return indexed.where(wanted).drop("_s", "_total", "_i", "rank")


def sample_fixed(df: DataFrame, n: int, key, seed=0, keys=()) -> DataFrame:
    """Uniform sample of exactly n rows (all, if fewer) without replacement: the n smallest
    values of md5(seed:key). `key` must identify a row."""
    key = [key] if isinstance(key, str) else list(key)
    hashed = df.withColumn("_h", hash_order(seed, *key))
    return hash_rank(hashed, "_h", keys, limit=n, name="_r").drop("_h", "_r")
