"""Sites in windows: an equi-join on genomic bins of several sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The smallest bin has 2^14 positions, each further level eight times as many.
FIRST_BITS, STEP_BITS, LEVELS = 14, 3, 16


def _level(beg: str, end: str) -> str:
    """The first level whose bins are no narrower than the window, so that it touches two bins at
    most and candidates lie no further away than about eight times its width."""
    width = f"({end}) - ({beg}) + 1"
    return "CASE " + " ".join(f"WHEN {width} <= shiftleft(1L, {FIRST_BITS + STEP_BITS * k}) THEN {k}"
                              for k in range(LEVELS)) + f" ELSE {LEVELS} END"


def _bin(pos: str, level: str) -> str:
    return f"shiftright(bigint({pos}), {FIRST_BITS} + {STEP_BITS} * {level})"


def window_bins(windows: DataFrame) -> DataFrame:
    """Windows with `_level` and one row per bin they touch (one or two). Windows without chromosome
    or ends, or whose end lies before their beginning, hold nothing and are left out."""
    sound = windows.where("chrom IS NOT NULL AND beg <= end").withColumn("_level", F.expr(_level("beg", "end")))
    return sound.withColumn("_bin", F.explode(F.expr(f"sequence({_bin('beg', '_level')}, {_bin('end', '_level')})")))


def join_windows(sites: DataFrame, windows: DataFrame, pos: str = "pos") -> DataFrame:
    """`sites` with the columns of each window (window_id, chrom, beg, end, ...) that holds them, but
    for chrom and the ends: a site in three windows has three rows, one in none has no row. Both
    ends belong to a window. A site looks once into each level that some window is on (their
    numbers, 17 at most, are all that reaches the driver), by an equi-join on chromosome, level and
    bin; adaptive execution splits bins with many sites."""
    placed = window_bins(windows)
    levels = sorted(r[0] for r in windows.where("chrom IS NOT NULL AND beg <= end").select(
        F.expr(_level("beg", "end")).alias("_level")).distinct().collect())
    extra = [c for c in windows.columns if c not in ("chrom", "beg", "end")]
    clash = set(extra) & set(sites.columns)
    if clash:
        raise ValueError(f"sites already have the columns {sorted(clash)}")
    if not levels:
        return sites.limit(0).join(windows.select(*extra).limit(0))
    looked = sites.select("*", F.explode(F.array(*[F.lit(x) for x in levels])).alias("_level"))
    looked = looked.withColumn("_bin", F.expr(_bin(f"`{pos}`", "_level")))
    hits = looked.join(placed.withColumnsRenamed({"beg": "_beg", "end": "_end"}), ["chrom", "_level", "_bin"])
    return hits.where(F.col(pos).between(F.col("_beg"), F.col("_end"))).select(*sites.columns, *extra)


def window_features(sites: DataFrame, windows: DataFrame, aggregates) -> DataFrame:
    """Aggregates of the sites of each window; windows without sites are kept, with null or zero."""
    per = join_windows(sites, windows.select("window_id", "chrom", "beg", "end")).groupBy("window_id").agg(*aggregates)
    return windows.join(per, "window_id", "left")
