"""Rarefaction statistics of allele counts and their moments across loci.

A locus enters the computation only through its counts, so loci are collapsed to distinct
count configurations with a weight before any per-depth work. Each configuration is expanded
over depths in place, its statistics are plain column arithmetic, and power sums over
(keys, depth) are combined map-side. Power sums add up, so leaving out a block is a
subtraction (`leave_one_out`)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alleleflow.functions.arrays import ship, sum_arrays
from alleleflow.functions.exprs import absent, log_factorial, smallest
from alleleflow.operators.counts import (
    count_columns, joint_sfs, shape_of, total_copies, total_sql)
from alleleflow.plans.contract import BLOCKS, FEATURES

ship(__name__)


def _is_cells(counts: DataFrame) -> bool:
    return "cells" in counts.columns


def cells_total(name: str) -> Column:
    """Copies of all alleles of a `cells` array in the population held by field `name`."""
    return F.expr(f"aggregate(cells, 0, (acc, c) -> acc + c.{name})")


def _contribution(statistic: str, absent: list[str]) -> str:
    """SQL of one allele's contribution to a statistic, from its absence probabilities.
    `alpha_j`: present in j; `<kind>_jk..`, or `<kind>_j_k_..` from ten populations on: present in exactly
    the listed populations."""
    kind, *who = statistic.split("_")
    subset = [int(c) for c in (who[0] if len(absent) < 10 else who)]
    if kind == "alpha":
        return f"(1D - {absent[subset[0] - 1]})"
    return "(" + " * ".join(f"(1D - {q})" if j in subset else q
                            for j, q in enumerate(absent, 1)) + ")"


def combination_names(pops: int) -> list[str]:
    """`private_<populations>` for all 2**pops - 1 subsets, the numbers set apart by `_`
    from ten populations on."""
    between = "" if pops < 10 else "_"
    return ["private_" + between.join(str(j) for j in s) for r in range(1, pops + 1)
            for s in combinations(range(1, pops + 1), r)]


def _copies(counts: DataFrame) -> list[Column]:
    """Copies of all alleles, one column per population."""
    if _is_cells(counts):
        return [cells_total(f) for f in counts.schema["cells"].dataType.elementType.names]
    k, pops = shape_of(counts)
    return [total_copies(k, j) for j in range(1, pops + 1)]


def per_locus(counts: DataFrame, max_depth: int | str | None = None, statistics=BLOCKS,
              first_depth: int = 2) -> DataFrame:
    """Every statistic of every row at each depth from `first_depth` to the row's own smallest
    copy number (or `max_depth`, a number or the name of a column, which is dropped). Works on
    `c{i}_{j}` columns or on `cells` arrays."""
    totals = _copies(counts)
    pops = len(totals)
    if _is_cells(counts):
        fields = counts.schema["cells"].dataType.elementType.names
        held = ["cells"]
    else:
        k, _ = shape_of(counts)
        held = count_columns(k, pops)
    keep = [c for c in counts.columns if c not in (*held, max_depth)]
    n = [f"_n{j}" for j in range(1, pops + 1)]
    top = [max_depth] if isinstance(max_depth, str) else []
    rows = counts.select(*keep, *held, *top, *[t.alias(x) for t, x in zip(totals, n)])
    both = ", ".join(n)
    deepest = f"least({both}, {max_depth})" if max_depth is not None else f"least({both})"
    # what does not depend on the depth is computed before the row is expanded
    fixed = [f"{log_factorial(x)} AS _l{x}" for x in n]
    if not _is_cells(counts):
        fixed += [f"{log_factorial(f'(_n{j} - c{i}_{j})')} AS _l{i}_{j}"
                  for i in range(1, k + 1) for j in range(1, pops + 1)]
    rows = (rows.where(f"{deepest} >= {first_depth}")
            .selectExpr(*keep, *held, *n, *fixed, f"{deepest} AS _deepest")
            .selectExpr("*", f"explode(sequence({first_depth}, _deepest)) AS g"))
    rows = rows.selectExpr("*", *[f"_l{x} - {log_factorial(f'({x} - g)')} AS _a{x}" for x in n])
    if _is_cells(counts):
        qs = ", ".join(
            absent(f"({x} - c.{f})", "g", log_factorial(f"({x} - c.{f})"), f"_a{x}") + f" AS q{j}"
            for j, (x, f) in enumerate(zip(n, fields), 1))
        rows = rows.selectExpr(*keep, "g", f"transform(cells, c -> struct({qs})) AS _q")
        per_allele = [f"q.q{j}" for j in range(1, pops + 1)]
        return rows.selectExpr(*keep, "g", *[
            f"aggregate(_q, 0D, (acc, q) -> acc + {_contribution(s, per_allele)}) AS {s}"
            for s in statistics])
    rows = rows.selectExpr(*keep, "g", *[
        f"{absent(f'(_n{j} - c{i}_{j})', 'g', f'_l{i}_{j}', f'_a_n{j}')} AS _q{i}_{j}"
        for i in range(1, k + 1) for j in range(1, pops + 1)])
    parts = [[f"_q{i}_{j}" for j in range(1, pops + 1)] for i in range(1, k + 1)]
    return rows.selectExpr(*keep, "g", *[
        " + ".join(_contribution(s, p) for p in parts) + f" AS {s}" for s in statistics])


def subset_lattice(q: str) -> str:
    """SQL of the chances of all 2^J presence patterns from an array of absence probabilities: entry
    m is the chance that exactly the populations of m's bits are present. Each population doubles
    the array, so a prefix's products are shared by all subsets that begin with it: 2^(J + 1)
    multiplications instead of J 2^J, and an expression that does not grow with J."""
    return (f"aggregate({q}, array(1D), (_v, _q) -> concat(transform(_v, _x -> _x * _q), "
            f"transform(_v, _x -> _x * (1D - _q))))")


def _as_cells(counts: DataFrame) -> DataFrame:
    """Counts as `cells`, one array of counts per allele."""
    if _is_cells(counts):
        return counts
    k, pops = shape_of(counts)
    alleles = ", ".join("struct(" + ", ".join(f"c{i}_{j} AS c_{j}" for j in range(1, pops + 1)) + ")" for i in range(1, k + 1))
    return counts.withColumn("cells", F.expr(f"array({alleles})")).drop(*count_columns(k, pops))


def absences(counts: DataFrame, max_depth: int | None = None, first_depth: int = 2) -> DataFrame:
    """Per row and depth `_q`: for each allele the array of its absence probabilities in the
    populations. What does not depend on the depth is computed before the row is expanded."""
    counts = _as_cells(counts)
    fields = counts.schema["cells"].dataType.elementType.names
    keep = [c for c in counts.columns if c != "cells"]
    cap = "array_min(_n)" if max_depth is None else f"least(array_min(_n), {max_depth})"
    rows = counts.select(*keep, F.transform("cells", lambda c: F.array(*[c[f] for f in fields])).alias("_c"),
                         F.array(*_copies(counts)).alias("_n"))
    rows = rows.where(f"{cap} >= {first_depth}").selectExpr(
        *keep, "_n", f"transform(_n, n -> {log_factorial('n')}) AS _ln", "transform(_c, c -> zip_with(_n, c, (n, x) -> n - x)) AS _rest",
        f"explode(sequence({first_depth}, {cap})) AS g")
    rows = rows.selectExpr(*keep, "g", f"transform(_rest, r -> transform(r, x -> {log_factorial('x')})) AS _lr", "_rest",
                           f"zip_with(_ln, _n, (l, n) -> l - {log_factorial('(n - g)')}) AS _all")
    q = absent("y", "g", "_lr[i][j]", "_all[j]")
    return rows.selectExpr(*keep, "g", f"transform(_rest, (r, i) -> transform(r, (y, j) -> {q})) AS _q")


def subset_richness(counts: DataFrame, max_depth: int | None = None, first_depth: int = 2) -> DataFrame:
    """Per row and depth `_subsets`, an array of the private richness of every subset of the
    populations (entry m: alleles present in exactly the populations of m's bits)."""
    rows = absences(counts, max_depth, first_depth)
    pops = len(_copies(counts))
    total = f"aggregate(_q, array_repeat(0D, {2 ** pops}), (_sum, _p) -> zip_with(_sum, {subset_lattice('_p')}, (_a, _b) -> _a + _b))"
    return rows.selectExpr(*[c for c in rows.columns if c != "_q"], f"{total} AS _subsets")


def _half_lattice(q: np.ndarray) -> np.ndarray:
    """Chances of all presence patterns of some populations, in the last axis, as `subset_lattice`
    orders them; `q` has the populations in its last axis."""
    v = np.ones((*q.shape[:-1], 1))
    for j in range(q.shape[-1]):
        v = np.concatenate([v * q[..., j:j + 1], v * (1 - q[..., j:j + 1])], axis=-1)
    return v


def _lattice_sums(cells: np.ndarray, top: int):
    """For each depth 2 ... `top`: sums and sums of squares over loci of every subset's richness.
    `cells` (loci, alleles, populations) holds counts of loci that all reach `top`; alleles without
    any copy stand for alleles that a locus lacks and add nothing.

    A pattern's chance is a product over populations, so a locus is one product of two matrices,
    patterns of the first half of the populations by patterns of the second. Chances of absence
    go from depth to depth by one factor."""
    pops = cells.shape[2]
    total = cells.sum(1, keepdims=True)
    rest, none = (total - cells).astype(float), ~cells.any(2)
    q = np.ones(cells.shape)
    for g in range(1, top + 1):
        q *= np.maximum(rest - (g - 1), 0) / (total - (g - 1))
        if g < 2:
            continue
        low, high = _half_lattice(q[..., :pops // 2]), _half_lattice(q[..., pops // 2:])
        low[none] = 0
        x = np.matmul(high.transpose(0, 2, 1), low).reshape(len(cells), -1)
        yield g, x.sum(0), np.einsum("lm,lm->m", x, x)


def subset_moments(counts: DataFrame, max_depth: int | None = None, keys=(), rows_at_once: int = 16) -> DataFrame:
    """Mean and variance over loci of every subset's private richness at every depth that all loci of
    a key reach: (keys, g, subset, n_loci, mean, variance), `subset` as the number of its bits.

    Only those depths are computed. A task forms the lattices of some loci at a time, few enough to
    stay in the cache, and adds them up; one array of sums per task, key and depth is shuffled, so
    what moves depends on depths and subsets, not on loci."""
    keys = list(keys)
    wanted = counts.select(*keys, *[c for c in counts.columns if c == "cells" or (c[0] == "c" and c[1:2].isdigit())])
    pops = len(_copies(wanted))
    top = shared_depth(wanted, max_depth, keys)
    wanted = _as_cells(wanted)
    fields = wanted.schema["cells"].dataType.elementType.names
    flat = F.flatten(F.transform("cells", lambda c: F.array(*[c[f] for f in fields])))
    rows = wanted.select(*keys, flat.alias("_c"))
    rows = rows.join(top, keys) if keys else rows.crossJoin(F.broadcast(top))       # one row
    # loci are few bytes but much work: spread them over all tasks, where adaptive execution would
    # merge them into few by size
    rows = rows.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def add_up(batches):
        held: dict = {}
        types = None
        for batch in batches:
            types = batch.schema
            counted = batch.column("_c")
            size = counted.value_lengths().to_numpy(zero_copy_only=False)
            flat, first = counted.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
            groups: dict = {}
            for k, key in enumerate(zip(*[batch.column(c).to_pylist() for c in (*keys, "_top")])):
                groups.setdefault(key, []).append(k)
            for (*key, deepest), at in groups.items():
                at = np.array(at)[np.argsort(size[at], kind="stable")]      # like numbers of alleles together
                for start in range(0, len(at), rows_at_once):
                    some = at[start:start + rows_at_once]
                    cells = np.zeros((len(some), size[some].max()), np.int64)
                    for k, row in enumerate(some):
                        cells[k, :size[row]] = flat[first[row]:first[row] + size[row]]
                    for g, x, squares in _lattice_sums(cells.reshape(len(some), -1, pops), deepest):
                        if (*key, g) not in held:
                            held[(*key, g)] = np.zeros(1 + 2 * 2 ** pops)
                        part = held[(*key, g)]
                        part[0] += len(some)
                        part[1:1 + 2 ** pops] += x
                        part[1 + 2 ** pops:] += squares
        for key, part in held.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([k], types.field(c).type) for k, c in zip(key, keys)], pa.array([key[-1]], pa.int32()),
                                              pa.array([part.tobytes()], pa.binary())], names=[*keys, "g", "v"])

    def finish(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                v = np.frombuffer(batch.column("v")[k].as_buffer())
                n, mean = v[0], v[1:1 + 2 ** pops] / v[0]
                with np.errstate(invalid="ignore", divide="ignore"):
                    variance = np.maximum(v[1 + 2 ** pops:] - n * mean ** 2, 0) / (n - 1)
                size = 2 ** pops - 1
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([batch.column(c)[k].as_py()] * size, batch.schema.field(c).type) for c in (*keys, "g")], pa.array(np.arange(1, size + 1, dtype=np.int32)),
                     pa.array(np.full(size, int(n))), pa.array(mean[1:]), pa.array(variance[1:], mask=np.isnan(variance[1:]))],
                    names=[*keys, "g", "subset", "n_loci", "mean", "variance"])

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keys) + "g int, "
    sums = sum_arrays(rows.mapInArrow(add_up, kinds + "v binary"), [*keys, "g"], "v")
    return sums.mapInArrow(finish, kinds + "subset int, n_loci long, mean double, variance double")


def shared_depth(counts: DataFrame, max_depth: int | None = None, keys=()) -> DataFrame:
    """`_top` per key: the smallest copy number over loci and populations (at most `max_depth`), where
    it is 2 or more, for columns and cells alike."""
    top = smallest(_copies(counts))
    if max_depth is not None:
        top = F.least(top, F.lit(max_depth))
    return counts.groupBy(*keys).agg(F.min(top).cast("int").alias("_top")).where("_top >= 2")


def absence_table(counts: DataFrame, depths) -> DataFrame:
    """Absence probability of every allele and population of a counts table, long form."""
    k, pops = shape_of(counts)
    keep = [c for c in counts.columns if c not in count_columns(k, pops)]
    cells = ", ".join(f"struct({i} AS allele, {j} AS pop_index, {total_sql(k, j)} AS n, "
                      f"c{i}_{j} AS copies)" for i in range(1, k + 1) for j in range(1, pops + 1))
    wanted = ", ".join(str(d) for d in depths)
    chance = absent("(n - copies)", "g", "_rest", f"(_all - {log_factorial('(n - g)')})")
    return (counts.selectExpr(*keep, f"inline(array({cells}))")
            .selectExpr("*", f"{log_factorial('n')} AS _all",
                        f"{log_factorial('(n - copies)')} AS _rest")
            .selectExpr("*", f"explode(filter(array({wanted}), d -> d <= n)) AS g")
            .selectExpr(*keep, "allele", "pop_index", "n", "copies", "g", f"{chance} AS q"))


def depth_grid(counts: DataFrame, max_depth: int | None = None, keys=()) -> DataFrame:
    """Depths 2 ... the smallest copy number over loci and populations, capped."""
    from alleleflow.operators.counts import max_depth as deepest
    top = F.col("max_depth") if max_depth is None else F.least("max_depth", F.lit(max_depth))
    return (deepest(counts, keys).where(top >= 2)
            .select(*keys, F.explode(F.sequence(F.lit(2), top)).alias("g")))


def _shift(name: str) -> float:
    # richness is at least 1 wherever it is defined, so subtracting 1 keeps every summand in
    # [0, alleles) and the variance free of cancellation
    return 1.0 if name.startswith("alpha") else 0.0


def depth_sums(counts: DataFrame, max_depth: int | None = None, keys=(), statistics=BLOCKS,
               collapse: bool = True, shared_only: bool = False) -> DataFrame:
    """Weighted count, sum and sum of squares of each statistic per (keys, g).

    Depth 0 carries the number of all loci, so that `finalise` can tell which depths every
    locus reaches. With `shared_only` no locus is expanded beyond the deepest depth that all loci
    of some key reach, which comes as one row (minima are combined before the shuffle, but
    `counts` is read once more)."""
    keys = list(keys)
    if collapse:
        if _is_cells(counts):
            weight = F.sum("n_loci") if "n_loci" in counts.columns else F.count(F.lit(1))
            rows = counts.groupBy(*keys, "cells").agg(weight.alias("n_loci"))
        else:
            k, _ = shape_of(counts)
            rows = joint_sfs(counts, keys, fold=k == 2)
        # configurations are few bytes but each is expanded over all depths: spread them over
        # all tasks, where adaptive execution would merge them into few by size
        rows = rows.repartition(
            int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    else:
        rows = counts if "n_loci" in counts.columns else counts.withColumn("n_loci", F.lit(1))
    if shared_only:
        least = counts.groupBy(*keys).agg(F.min(F.least(*_copies(counts), F.lit(max_depth))).alias("_top"))
        rows = rows.crossJoin(F.broadcast(least.agg(F.max("_top").alias("_top"))))      # one row
        max_depth = "_top"
    stats = per_locus(rows, max_depth, statistics, first_depth=0)
    aggs = ["sum(n_loci) AS n_loci"]
    for s in statistics:
        x = f"({s} - {_shift(s)}D)"
        aggs += [f"sum(n_loci * {x}) AS {s}_s1", f"sum(n_loci * {x} * {x}) AS {s}_s2"]
    return stats.groupBy(*keys, "g").agg(*[F.expr(a) for a in aggs])


def finalise(sums: DataFrame, keys=(), statistics=BLOCKS, per_depth_loci: bool = False,
             drop_n: bool = True) -> DataFrame:
    """Mean, variance (L-1) and standard error from power sums. By default only depths that
    every locus of the key reaches are kept, so that L does not change with depth."""
    keys = list(keys)
    if not per_depth_loci:
        # at most max_depth + 1 rows per key
        sums = (sums.withColumn("_all", F.max("n_loci").over(Window.partitionBy(*keys)))
                .where(F.col("n_loci") == F.col("_all")))
    cols = []
    for s in statistics:
        s1, s2 = f"{s}_s1", f"{s}_s2"
        variance = f"if(n_loci > 1, greatest({s2} - {s1} * {s1} / n_loci, 0D) / (n_loci - 1), NULL)"
        cols += [f"{s1} / n_loci + {_shift(s)}D AS {s}_mean", f"{variance} AS {s}_variance",
                 f"sqrt({variance} / n_loci) AS {s}_se"]
    head = [] if drop_n else ["n_loci"]
    return sums.where("g >= 2").selectExpr(*keys, *head, "g", *cols)


def feature_matrix(counts: DataFrame, max_depth: int | None = None, keys=(),
                   collapse: bool = True, per_depth_loci: bool = False, shared_only: bool = False) -> DataFrame:
    """The 28 contract columns per key and depth of a three-population counts table. With
    `shared_only` a second pass over the loci finds the deepest shared depth first; worth it on a
    stored table where the smallest copy number lies far below the others."""
    sums = depth_sums(counts, max_depth, keys, BLOCKS, collapse, shared_only)
    return finalise(sums, keys, BLOCKS, per_depth_loci).select(*keys, *FEATURES)


def moments(stats: DataFrame, keys=(), statistics=BLOCKS, higher: bool = False) -> DataFrame:
    """Moments of per-locus statistics without collapsing; `higher` adds skewness and excess
    kurtosis (population forms)."""
    aggs = ["count(1) AS n_loci"]
    for s in statistics:
        aggs += [f"avg({s}) AS {s}_mean", f"var_samp({s}) AS {s}_variance",
                 f"stddev_samp({s}) / sqrt(count({s})) AS {s}_se"]
        if higher:
            aggs += [f"skewness({s}) AS {s}_skewness", f"kurtosis({s}) AS {s}_kurtosis"]
    return stats.groupBy(*keys, "g").agg(*[F.expr(a) for a in aggs])


def pair_private_ratio(features: DataFrame, keys=()) -> DataFrame:
    """Model-free direction ratio: mean over depths of pihat_23 over that of pihat_13."""
    p13, p23 = F.avg("pihat_13_mean"), F.avg("pihat_23_mean")
    return features.groupBy(*keys).agg(
        p13.alias("pihat_13"), p23.alias("pihat_23"),
        F.when(p13 != 0, p23 / p13).alias("ratio"))


def depth_sweep(features: DataFrame, caps, keys=()) -> DataFrame:
    """The features repeated under each depth cap, always over the same loci."""
    cap = F.explode(F.array(*[F.lit(c) for c in caps])).alias("cap")
    return features.select(cap, *features.columns).where(F.col("g") <= F.col("cap"))


def leave_one_out(counts: DataFrame, block: str, max_depth: int | None = None, keys=(),
                  min_loci: int = 0) -> DataFrame:
    """Feature matrix with one block left out, for every block, as total minus block.
    Blocks whose removal leaves fewer than `min_loci` loci are skipped."""
    keys = list(keys)
    sums = depth_sums(counts, max_depth, [*keys, block])
    value_cols = [c for c in sums.columns if c not in (*keys, block, "g")]
    totals = sums.groupBy(*keys, "g").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    # blocks x depths is short; every (block, depth) of the grid must exist to be subtracted
    grid = sums.select(*keys, block).distinct()
    on = keys + ["g"]
    rest = (grid.join(totals, keys) if keys else grid.crossJoin(totals))
    rest = rest.join(sums, [*keys, block, "g"], "left").select(
        *keys, block, "g",
        *[(F.col(f"_t_{c}") - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in value_cols])
    out = finalise(rest.where(F.col("n_loci") > 0), [*keys, block], drop_n=False)
    return out.where(F.col("n_loci") >= min_loci).select(*keys, block, "n_loci", *FEATURES)
