"""ABBA-BABA, f3 and f4 with block jackknife errors.

Sites are summed per (keys, chromosome, block) with a map-side combine; everything after that
works on block sums, of which a genome has a few thousand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alleleflow.functions.exprs import nan_to_null, ratio


def abba_baba(freqs: DataFrame, outgroup: bool = True) -> DataFrame:
    """Adds `abba` and `baba` per site; the three-population form leaves out (1 - p4)."""
    p1, p2, p3 = F.col("p1"), F.col("p2"), F.col("p3")
    tail = (1 - F.col("p4")) if outgroup else F.lit(1.0)
    return (freqs.withColumn("abba", (1 - p1) * p2 * p3 * tail)
            .withColumn("baba", p1 * (1 - p2) * p3 * tail))


def genomic_block(pos: str = "pos", size: int = 500_000) -> Column:
    return F.floor(F.col(pos) / size)


def block_sums(sites: DataFrame, block_size: int | None = 500_000, keys=(),
               chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """Per block: num = sum(abba - baba), den = sum(abba + baba). `block_size=None` makes a
    whole chromosome one block."""
    rows = sites if block_size is None else sites.withColumn("block", genomic_block(pos, block_size))
    by = [*keys, chrom] + ([] if block_size is None else ["block"])
    return rows.groupBy(*by).agg(
        F.sum("abba").alias("abba"), F.sum("baba").alias("baba"),
        F.sum(F.col("abba") - F.col("baba")).alias("num"),
        F.sum(F.col("abba") + F.col("baba")).alias("den"),
        F.count(F.lit(1)).alias("n_sites"))


def patterson_d(sites: DataFrame, keys=()) -> DataFrame:
    """D with its two counts, no error."""
    abba, baba = F.sum("abba"), F.sum("baba")
    return sites.groupBy(*keys).agg(
        ratio(abba - baba, abba + baba).alias("d"), abba.alias("n_abba"), baba.alias("n_baba"))


def _with_leave_out(blocks: DataFrame, keys) -> DataFrame:
    """Totals and the leave-this-block-out ratio beside every block sum."""
    w = Window.partitionBy(*keys)
    return (blocks
            .withColumn("_num", F.sum("num").over(w)).withColumn("_den", F.sum("den").over(w))
            .withColumn("_g", F.count(F.lit(1)).over(w))
            .withColumn("_theta", ratio(F.col("_num"), F.col("_den")))
            .withColumn("_out", ratio(F.col("_num") - F.col("num"), F.col("_den") - F.col("den"))))


def _summary(d: DataFrame, keys, se: Column) -> DataFrame:
    return (d.groupBy(*keys)
            .agg(F.first("_theta").alias("d"), se.alias("se"),
                 F.sum("abba").alias("n_abba"), F.sum("baba").alias("n_baba"),
                 F.first("_g").alias("n_blocks"))
            .withColumn("z", ratio(F.col("d"), F.col("se"))))


def weighted_jackknife(blocks: DataFrame, keys=()) -> DataFrame:
    """Weighted delete-m jackknife; a block weighs its own denominator. The error is NULL for
    fewer than two blocks or when leaving a block out empties the denominator."""
    keys = list(keys)
    d = _with_leave_out(blocks, keys)
    share = F.col("den") / F.col("_den")
    d = d.withColumn("_j", F.col("_g") * F.col("_theta")
                     - F.sum((1 - share) * F.col("_out")).over(Window.partitionBy(*keys)))
    h = F.col("_den") / F.when(F.col("den") != 0, F.col("den"))
    pseudo = h * F.col("_theta") - (h - 1) * F.col("_out")
    term = (pseudo - F.col("_j")) ** 2 / F.when(h != 1, h - 1)
    variance = F.sum(term) / F.first("_g")
    se = F.when((F.first("_g") > 1) & (F.count("_out") == F.first("_g")) & (variance > 0),
                F.sqrt(variance))
    return _summary(d, keys, se)


def unweighted_jackknife(blocks: DataFrame, keys=()) -> DataFrame:
    """Delete-one jackknife with equal weights (blocks are usually chromosomes)."""
    keys = list(keys)
    d = _with_leave_out(blocks, keys)
    spread = F.var_pop("_out") * F.count("_out")
    g = F.first("_g")
    se = F.sqrt((g - 1) / g * spread)
    return _summary(d, keys, F.when(se > 0, se))


def f4_statistic(freqs: DataFrame, keys=()) -> DataFrame:
    p = [nan_to_null(f"p{j}") for j in (1, 2, 3, 4)]
    return freqs.groupBy(*keys).agg(F.avg((p[0] - p[1]) * (p[2] - p[3])).alias("f4"))


def f3_statistic(freqs: DataFrame, target: str = "p3", a: str = "p1", b: str = "p2",
                 keys=()) -> DataFrame:
    c = nan_to_null(target)
    return freqs.groupBy(*keys).agg(
        F.avg((c - nan_to_null(a)) * (c - nan_to_null(b))).alias("f3"))


def expand_trios(freqs: DataFrame, trios) -> DataFrame:
    """One row per site and trio. `trios` maps a tag to the frequency columns that play
    P1, P2, P3 and, optionally, P4. Expanded in place: no join, no shuffle."""
    keep = [c for c in freqs.columns if not (c[0] == "p" and c[1:].isdigit())]
    structs = [F.struct(F.lit(tag).alias("trio"),
                        *[F.col(c).alias(f"p{j}") for j, c in enumerate(cols, 1)])
               for tag, cols in trios.items()]
    return freqs.select(*keep, F.inline(F.array(*structs)))


def d_by_trio(freqs: DataFrame, trios, block_size: int | None = None,
              weighted: bool = False) -> DataFrame:
    """D, error and Z of many trios in one pass over the sites."""
    with_out = all(len(c) == 4 for c in trios.values())
    sites = abba_baba(expand_trios(freqs, trios), outgroup=with_out)
    blocks = block_sums(sites, block_size, ["trio"])
    return (weighted_jackknife if weighted else unweighted_jackknife)(blocks, ["trio"])


def d_decision(d: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Significance rule on |Z|: control unless significant. D flags flow, it cannot orient it."""
    flagged = F.coalesce(F.abs("z") > threshold, F.lit(False))
    return (d.withColumn("introgressing", flagged)
            .withColumn("call", F.when(flagged, "flow").otherwise("D")))


def leave_one_block_out(blocks: DataFrame, block: str = "chrom", min_sites: int = 0) -> DataFrame:
    """D with each block dropped, as total minus block; drops that leave fewer than
    `min_sites` sites are skipped."""
    per = blocks.groupBy(block).agg(*[F.sum(c).alias(c) for c in ("num", "den", "n_sites")])
    w = Window.partitionBy()       # one row per block
    return (per.withColumn("n_left", F.sum("n_sites").over(w) - F.col("n_sites"))
            .withColumn("d", ratio(F.sum("num").over(w) - F.col("num"),
                                   F.sum("den").over(w) - F.col("den")))
            .where(F.col("n_left") >= min_sites)
            .select(F.col(block).alias("dropped"), "n_left", "d"))
