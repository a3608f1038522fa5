"""Gradient boosting on quantile bins, for all folds and seeds together.

Columns are cut into bins once, and rows with the same bins become one with their number per fit and
class: trees cannot tell them apart. A round grows one tree per fit and class, level by level: one pass
over these rows adds up gradient histograms (count, gradient, curvature per feature and bin) of the
nodes of a level for every fit, where only the smaller of two siblings is counted and the other
one is its parent minus it. Rows are held as blocks of arrays, one per partition, which stay in the
executors' storage with their scores, so that a pass is one short job. There are as many blocks as cores,
more only where a block would grow too large, as every task sends one array per fit
and class; where these are many, they are added up on the way. The driver sees histograms, whose
size is set by the parameters, and trees, never rows. Scores are added to after every round and
written to the checkpoint folder every few rounds.

A fitted ensemble is a table of nested arrays (one tree a row) that column expressions walk."""

from __future__ import annotations

import operator
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alleleflow.functions.arrays import ship
from alleleflow.functions.session import checkpointed

TREE = "label_no int, label string, base double, round int, feature array<int>, threshold array<double>, value array<double>"

ship(__name__)


# ------------------------------------------------------------------ trees

@dataclass
class Trees:
    """Trees as heaps: node i has the children 2i + 1 (feature <= edge) and 2i + 2. `feature` is -1
    in a leaf; `cut` is the last bin that goes left."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(n: int, depth: int) -> "Trees":
        size = 2 ** (depth + 1) - 1
        return Trees(np.full((n, size), -1, np.int32), np.zeros((n, size), np.int32), np.zeros((n, size)))

    def parts(self, t: int, columns: np.ndarray, rows: np.ndarray, ends=()):
        """(node, its rows) of the nodes `ends` of tree `t`, or of all its leaves, where `rows` numbers
        rows of `columns` (features, rows). Only ways that lead there are walked."""
        ways = set(ends)
        for node in ends:
            while node:
                node = (node - 1) // 2
                ways.add(node)
        todo = [(0, rows)]
        while todo:
            node, rows = todo.pop()
            f = self.feature[t, node]
            if f < 0 or node in ends:
                yield node, rows
                continue
            left = columns[f].take(rows) <= self.cut[t, node]
            for child, side in ((2 * node + 1, left), (2 * node + 2, ~left)):
                if not ways or child in ways:
                    todo.append((child, rows.compress(side)))


@dataclass
class BoostedHead:
    """Per class a base score and trees (feature, threshold, value arrays); softmax of the sums.
    A missing value goes right, as does one above the threshold."""
    features: list[str]
    labels: list
    base: list[float]
    trees: list[list[tuple]]

    def rows(self) -> list[tuple]:
        return [(k, str(x), float(self.base[k]), r, *[np.asarray(a, kind).tolist() for a, kind in zip(t, (int, float, float))])
                for k, x in enumerate(self.labels) for r, t in enumerate(self.trees[k])]

    def apply(self, df: DataFrame, prefix: str = "p") -> DataFrame:
        """`df` with a probability per class, from the ensemble as one broadcast row."""
        return apply_ensemble(df, ensemble_table(df.sparkSession, self), self.features, self.labels, prefix)


def ensemble_table(spark: SparkSession, head: BoostedHead) -> DataFrame:
    return spark.createDataFrame(head.rows(), TREE)


def save_ensemble(spark: SparkSession, head: BoostedHead, path: str) -> None:
    """The trees as Parquet, one a row, with the names of the features in every row."""
    names = F.array(*[F.lit(c) for c in head.features])
    ensemble_table(spark, head).withColumn("features", names).coalesce(1).write.parquet(path)


def load_ensemble(spark: SparkSession, path: str, labels=None) -> BoostedHead:
    """A stored ensemble. `labels` gives the labels' values back where they are no strings."""
    rows = spark.read.parquet(path).orderBy("label_no", "round").collect()
    found = sorted({(r["label_no"], r["label"], r["base"]) for r in rows})
    trees: list = [[] for _ in found]
    for r in rows:
        trees[r["label_no"]].append((np.array(r["feature"], np.int32), np.array(r["threshold"]), np.array(r["value"])))
    return BoostedHead(list(rows[0]["features"]), list(labels or [x for _, x, _ in found]), [b for *_, b in found], trees)


def walk_sql(tree: str, values: str, depth: int) -> str:
    """SQL of the value that tree (a struct of arrays) gives an array of feature values."""
    step = (f"if({tree}.feature[_n] < 0, _n, 2 * _n + if(coalesce({values}[{tree}.feature[_n]] <= "
            f"{tree}.threshold[_n] AND NOT isnan({values}[{tree}.feature[_n]]), false), 1, 2))")
    return f"{tree}.value[aggregate(sequence(1, {depth}), 0, (_n, _k) -> {step})]"


def apply_ensemble(df: DataFrame, ensemble: DataFrame, features, labels, prefix: str = "p") -> DataFrame:
    """Softmax probabilities from a table of trees (one row each; model-sized). The table becomes
    one row of nested arrays, broadcast to the rows of `df`."""
    tree = F.struct("feature", "threshold", "value")
    per = ensemble.groupBy("label_no").agg(F.first("base").alias("base"), F.collect_list(tree).alias("trees"))
    depth = (len(ensemble.first()["feature"]) + 1).bit_length() - 2
    one = per.agg(F.array_sort(F.collect_list(F.struct("label_no", "base", "trees"))).alias("_model"))
    score = f"aggregate(_m.trees, _m.base, (_s, _t) -> _s + {walk_sql('_t', '_x', depth)})"
    scored = df.select("*", F.array(*[F.col(c).cast("double") for c in features]).alias("_x")).crossJoin(F.broadcast(one)).selectExpr(
        *[f"`{c}`" for c in df.columns], f"transform(_model, _m -> {score}) AS _scores")
    top = scored.selectExpr(*[f"`{c}`" for c in df.columns], "transform(_scores, _s -> exp(_s - array_max(_scores))) AS _e")
    total = "aggregate(_e, 0D, (_a, _b) -> _a + _b)"
    return top.selectExpr(*[f"`{c}`" for c in df.columns], *[f"_e[{k}] / {total} AS `{prefix}_{x}`" for k, x in enumerate(labels)])


# ------------------------------------------------------------------ bins

def quantile_edges(rows: DataFrame, features, bins: int = 64) -> list[np.ndarray]:
    """Distinct values at `bins` - 1 quantiles of each column, in one pass. A row's bin is the
    number of edges below its value; missing values have the last bin."""
    at = [k / (bins - 1) for k in range(bins - 1)]
    clean = [F.expr(f"if(isnan(double(`{c}`)), NULL, double(`{c}`))") for c in features]
    got = rows.agg(*[F.percentile_approx(c, at, 100 * bins).alias(f"_{k}") for k, c in enumerate(clean)]).first()
    return [np.unique(np.array(q or [0.0], dtype=float)) for q in got]


def _binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(values.shape, np.uint8)
    for k, e in enumerate(edges):
        v = values[:, k]
        out[:, k] = np.where(np.isnan(v), len(e), np.searchsorted(e, v, side="left"))
    return out


# ------------------------------------------------------------------ fitting

#: Bytes of a block of rows.
BLOCK = 2 ** 27


@dataclass
class _Fit:
    """What tasks need: bins of a feature, features, depth, fits and classes."""
    width: int
    n_features: int
    depth: int
    n_fits: int
    n_classes: int


def _columns(batches, fit: _Fit) -> np.ndarray:
    """Bins (features, rows) of some rows."""
    flat = np.frombuffer(b"".join(x for b in batches for x in b.column("_bins").to_pylist()), np.uint8)
    return np.ascontiguousarray(flat.reshape(-1, fit.n_features).T)


def _block(batches, fit: _Fit, base: np.ndarray) -> tuple:
    """Some rows as bins (features, rows), scores and numbers of training rows (fits, classes, rows)."""
    columns = _columns(batches, fit)
    weights = np.concatenate([_flat(b.column("_w")) for b in batches]).reshape(-1, fit.n_fits, fit.n_classes)
    weights = weights.astype(np.min_scalar_type(weights.max(initial=0)))
    return columns, np.repeat(base[:, :, None], columns.shape[1], axis=2), np.ascontiguousarray(weights.transpose(1, 2, 0))


def _flat(values: pa.Array) -> np.ndarray:
    while pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        values = values.flatten()
    return values.to_numpy(zero_copy_only=False)


def _advance(fit: _Fit, columns, scores, trees: Trees, rows=None) -> None:
    """Add the values of one round's trees to the scores of some rows, or of `rows(i)` for fit `i`."""
    everyone = np.arange(columns.shape[1])
    for t in range(len(trees.feature)):
        i, c = divmod(t, fit.n_classes)
        own = scores[i, c]
        for node, part in trees.parts(t, columns, everyone if rows is None else rows[i]):
            own[part] += trees.value[t, node]


def _tally(at, number, both, shape) -> np.ndarray:
    """(3, *shape): count, gradient and curvature of each cell, where `at` gives the rows' cells."""
    n, sums = np.zeros(np.prod(shape)), np.zeros(np.prod(shape), complex)
    np.add.at(n, at, number)
    np.add.at(sums, at, both)
    return np.stack([n, sums.real, sums.imag]).reshape(3, *shape)


def _count(fit: _Fit, columns, scores, weights, growing: Trees, wanted: np.ndarray, level: int) -> dict:
    """{tree: (wanted nodes, 3, features x bins)} of some rows: count, gradient and curvature of the
    training rows in the nodes of a level that `wanted` numbers (-1: not wanted)."""
    slots, width, out = wanted.max(axis=1) + 1, fit.width, {}
    first = 2 ** level - 1
    # cells of two features at once, whose margins are the features' own: half the work where rows are many
    pairs = [(f, columns[f].astype(np.uint16) * width + columns[f + 1]) for f in range(0, fit.n_features - 1, 2)]
    for i in range(fit.n_fits):
        mine = range(i * fit.n_classes, (i + 1) * fit.n_classes)
        if not slots[mine.start:mine.stop].any():
            continue
        number = weights[i].sum(axis=0, dtype=float)
        train = np.flatnonzero(number)
        p = np.exp(scores[i] - scores[i].max(axis=0))
        p /= p.sum(axis=0)
        for c, t in enumerate(mine):
            if not slots[t]:
                continue
            nodes = {first + k: slot for k, slot in enumerate(wanted[t, first:2 * first + 1].tolist()) if slot >= 0}
            found = [(nodes[node], part) for node, part in growing.parts(t, columns, train, nodes)]
            rows = np.concatenate([part for _, part in found])
            slot = np.repeat([k for k, _ in found], [len(part) for _, part in found])
            n, prob = number.take(rows), p[c].take(rows)
            both = np.empty(len(rows), complex)          # gradient and curvature are added up as one
            both.real, both.imag = n * prob - weights[i, c].take(rows), n * prob * (1 - prob)
            sums = np.empty((3, slots[t], fit.n_features, width))
            many = len(rows) > 2 * slots[t] * width ** 2
            if many:
                start = slot * width ** 2
                for f, cells in pairs:
                    got = _tally(start + cells.take(rows), n, both, (slots[t], width, width))
                    sums[:, :, f], sums[:, :, f + 1] = got.sum(axis=3), got.sum(axis=2)
            start = slot * width
            for f in range(2 * len(pairs) if many else 0, fit.n_features):   # a feature's counts and rows stay in the cache
                sums[:, :, f] = _tally(start + columns[f].take(rows), n, both, (slots[t], width))
            out[t] = sums.swapaxes(0, 1).reshape(slots[t], 3, -1)
    return out


def _blocks(state: DataFrame, fit: _Fit, base: np.ndarray) -> RDD:
    """The rows of a partition as one (bins, scores, numbers of training rows)."""
    def pack(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_block(batches, fit, base), 5)], pa.binary())], names=["block"])
    return state.mapInArrow(pack, "block binary").rdd.map(lambda row: pickle.loads(row[0]))


def _histograms(blocks: RDD, fit: _Fit, growing: Trees, wanted: np.ndarray, level: int, direct: int = 2 ** 26) -> dict:
    """The counts of all rows: one pass for all trees, one array per task and tree. Up to `direct`
    bytes in all go to the driver as they are, more are added up on the way."""
    def work(part):
        for block in part:
            yield from _count(fit, *block, growing, wanted, level).items()

    got = blocks.mapPartitions(work)
    parts = blocks.getNumPartitions()
    if int((wanted.max(axis=1) + 1).sum()) * 24 * fit.n_features * fit.width * parts > direct:
        got = got.reduceByKey(operator.add, parts)
    held: dict = {}
    for t, v in got.collect():
        held[t] = held[t] + v if t in held else v
    return held


def best_splits(hists: np.ndarray, least: int, penalty: float):
    """(gain, feature, bin) of each node's best split: the first of equal ones in the order of
    features and bins. Gain 0 if no split leaves `least` rows on both sides."""
    below = np.cumsum(hists, axis=3)
    total = below[:, :, :1, -1:]
    above = total - below[..., :-1]
    below = below[..., :-1]
    tg, th = total[:, 1], total[:, 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = below[:, 1] ** 2 / (below[:, 2] + penalty)
        gain += above[:, 1] ** 2 / (above[:, 2] + penalty)
        gain -= tg ** 2 / (th + penalty)
    allowed = (below[:, 0] >= least) & (above[:, 0] >= least) & (below[:, 2] > 1e-3) & (above[:, 2] > 1e-3)
    gain = np.where(allowed, gain, 0.0).reshape(len(hists), -1)
    at = gain.argmax(axis=1)
    return gain[np.arange(len(at)), at], at // below.shape[3], at % below.shape[3]


def boost(rows: DataFrame, features, label: str, labels, folds=((None, 0),), rounds: int = 150, step: float = 0.08,
          depth: int = 5, bins: int = 64, least: int = 20, penalty: float = 0.0, keep=(), renew: int = 16, one_task: int = 200_000):
    """Fit softmax boosting with one tree per class and round, one fit for each (fold column, fold)
    of `folds`, trained on the rows outside the fold; (None, 0) trains on all rows.

    Returns the heads and the table of `keep` and `_scores`: every row's scores (fits x classes doubles as
    bytes; computed when used) under the fits that hold it out, rows of other labels left out. Bin edges, which see no
    labels, come from all rows. Base scores are log class shares of the training rows. Up to
    `one_task` rows of different bins (a few megabytes of bins) each fit is grown by one task; above that, all by
    passes over the rows."""
    features, labels, keep = list(features), list(labels), list(keep)
    folds = [(c, int(f)) for c, f in folds]
    spark = rows.sparkSession
    rows = rows.where(F.col(label).isin(labels))
    edges = quantile_edges(rows, features, bins)
    fold_cols = sorted({c for c, _ in folds if c})
    fit = _Fit(max(len(e) for e in edges) + 1, len(features), depth, len(folds), len(labels))
    y_of = F.coalesce(*[F.when(F.col(label) == x, F.lit(k)) for k, x in enumerate(labels)])
    columns = list(dict.fromkeys([*keep, *fold_cols]))
    taken = rows.select(*columns, y_of.alias("_y"), F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))

    def prepare(batches):
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(features))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], batch.column("_y"), pa.array([r.tobytes() for r in _binned(x, edges)], pa.binary())],
                names=[*columns, "_y", "_bins"])

    kinds = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns] + ["_y int", "_bins binary"])
    binned = checkpointed(taken.mapInArrow(prepare, kinds))

    # rows of the same bins as one: _n in all, _w by fit and class of those outside the fit's fold
    def number(c, f, k):
        mine = F.col("_y") == k
        return F.count_if(mine if c is None else mine & ~F.col(c).eqNullSafe(F.lit(f)))

    state = checkpointed(binned.groupBy("_bins").agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.array(*[number(c, f, k) for k in range(len(labels))]) for c, f in folds]).alias("_w")))
    share = np.array([[F.sum(F.col("_w")[i][k]) for k in range(len(labels))] for i in range(len(folds))])
    total, *share = state.agg(F.count(F.lit(1)), *share.ravel()).first()
    share = np.array([n or 0 for n in share], float).reshape(len(folds), len(labels))
    base = np.log(np.maximum(share, 1e-9) / np.maximum(share.sum(axis=1, keepdims=True), 1e-9))

    # as many parts as cores, more only if their blocks would be too large: every part sends histograms
    work, cores = len(folds) * len(labels), spark.sparkContext.defaultParallelism
    parts = max(1, min(cores, total * work // 50_000))
    size = total * (len(features) + 10 * work)
    if size > parts * BLOCK:
        parts = -(-size // (cores * BLOCK)) * cores
    state = state.repartition(parts)

    def scored(state, trees):
        def work(batches):
            batches = [b for b in batches if b.num_rows]
            if not batches:
                return
            columns, scores, weights = _block(batches, fit, base)
            number = np.concatenate([b.column("_n").to_numpy() for b in batches])
            held_out = [np.flatnonzero(w.sum(axis=0, dtype=int) < number) for w in weights]
            for one in trees:
                _advance(fit, columns, scores, one, held_out)
            at = 0
            for batch in batches:
                own = np.ascontiguousarray(scores[:, :, at:at + batch.num_rows].transpose(2, 0, 1))
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("_bins"), pa.array([x.tobytes() for x in own], pa.binary())], names=["_bins", "_scores"])
        return state.mapInArrow(work, "_bins binary, _scores binary")

    grow = _fits_in_tasks if total <= one_task else _fits_by_passes
    grown = grow(state, fit, base, rounds, step, least, penalty, renew)

    heads = [BoostedHead(features, labels, base[i].tolist(), [[] for _ in labels]) for i in range(len(folds))]
    last = np.array([len(e) - 1 for e in edges])
    table = np.stack([np.pad(e, (0, fit.width - len(e)), mode="edge") for e in edges])
    for trees in grown:
        at = np.maximum(trees.feature, 0)
        threshold = np.where(trees.feature < 0, 0.0, table[at, np.minimum(trees.cut, last[at])])
        for t in range(len(at)):
            heads[t // len(labels)].trees[t % len(labels)].append((trees.feature[t], threshold[t], trees.value[t]))
    return heads, binned.join(scored(state, grown), "_bins").select(*keep, "_scores")


def _fits_by_passes(state: DataFrame, fit: _Fit, base: np.ndarray, rounds: int, step: float, least: int, penalty: float, renew: int) -> list[Trees]:
    """All rounds by passes over the blocks, one for each level. Every round gives new blocks, stored
    in place of the last; every `renew` rounds they are also checkpointed, which cuts their lineage."""
    def added(trees):
        def work(block):
            columns, scores, weights = block
            scores = scores.copy()
            _advance(fit, columns, scores, trees)
            return columns, scores, weights
        return work

    blocks, last, grown = _blocks(state, fit, base).persist(StorageLevel.MEMORY_AND_DISK), None, []
    for r in range(1, rounds + 1):
        grown.append(_grow(fit, lambda *now: _histograms(blocks, fit, *now), step, least, penalty))
        if last is not None:
            last.unpersist()             # what follows from it has been stored by the passes of this round
        last, blocks = blocks, blocks.map(added(grown[-1])).persist(StorageLevel.MEMORY_AND_DISK)
        if r % renew == 0:
            blocks.checkpoint()
    for held in (last, blocks):
        if held is not None:
            held.unpersist()
    return grown


def _dealt(state: DataFrame, n: int) -> DataFrame:
    """The training rows of each of `n` fits in a partition of their own. Dealt by ranges, finer than the
    fits: hashes put several fits into one partition and leave others empty."""
    fits = state.select("_bins", F.posexplode("_w").alias("_fit", "_w")).where(F.exists("_w", lambda x: x > 0))
    return fits.repartitionByRange(4 * n, "_fit")


def _fits_in_tasks(state: DataFrame, fit: _Fit, base: np.ndarray, rounds: int, step: float, least: int, penalty: float, renew: int) -> list[Trees]:
    """All rounds for a table small enough that a task can hold its bins: fits do not depend on
    each other, so each is one task's work. The same trees as by passes over the rows."""
    n = fit.n_fits
    one = _Fit(fit.width, fit.n_features, fit.depth, 1, fit.n_classes)

    def work(key, table):
        i = key[0].as_py()
        columns, scores, weights = _block(table.to_batches(), one, base[i:i + 1])
        out = []
        for r in range(rounds):
            trees = _grow(one, lambda *now: _count(one, columns, scores, weights, *now), step, least, penalty)
            _advance(one, columns, scores, trees)
            out.append((i, r, trees.feature.tobytes(), trees.cut.tobytes(), trees.value.tobytes()))
        return pa.table([pa.array(x) for x in zip(*out)], names=["_fit", "round", "feature", "cut", "value"])

    rows = (_dealt(state, n).groupBy("_fit").applyInArrow(work, "_fit long, round long, feature binary, cut binary, value binary")
            .collect())                                           # trees: fits x rounds rows
    out = [Trees.empty(n * fit.n_classes, fit.depth) for _ in range(rounds)]
    for row in rows:
        mine = slice(row["_fit"] * fit.n_classes, (row["_fit"] + 1) * fit.n_classes)
        for name, kind in (("feature", np.int32), ("cut", np.int32), ("value", float)):
            getattr(out[row["round"]], name)[mine] = np.frombuffer(row[name], kind).reshape(fit.n_classes, -1)
    return out


def _grow(fit: _Fit, count, step: float, least: int, penalty: float) -> Trees:
    """One round: the trees of all fits and classes, level by level. `count(trees, wanted, level)`
    gives the histograms of all rows in the wanted nodes."""
    trees = Trees.empty(fit.n_fits * fit.n_classes, fit.depth)
    wanted = np.full(trees.feature.shape, -1)
    wanted[:, 0] = 0
    known: dict = {}                         # (tree, node): histogram of the level above
    larger: dict = {}                        # (tree, node): (sibling that is counted, parent)

    def leaf(sums):
        return -step * sums[1] / (sums[2] + penalty) if sums[2] + penalty > 0 else 0.0

    for level in range(fit.depth):
        if not (wanted >= 0).any():
            break
        got = count(trees, wanted, level)
        now = {(t, int(node)): got[t][wanted[t, node]].reshape(3, fit.n_features, fit.width) for t in got for node in np.flatnonzero(wanted[t] >= 0)}
        for (t, node), (small, parent) in larger.items():
            now[(t, node)] = known[(t, parent)] - now[(t, small)]
        keys = sorted(now)
        hists = np.stack([now[k] for k in keys])
        sums = hists[:, :, 0].sum(axis=2)
        wanted, larger, known = np.full(wanted.shape, -1), {}, {}
        for k, (t, node), gain, feature, cut in zip(range(len(keys)), keys, *best_splits(hists, least, penalty)):
            if gain <= 1e-9:
                trees.value[t, node] = leaf(sums[k])
                continue
            trees.feature[t, node], trees.cut[t, node] = feature, cut
            left = hists[k, :, feature, :cut + 1].sum(axis=1)
            a, b = 2 * node + 1, 2 * node + 2
            if level == fit.depth - 1:
                trees.value[t, a], trees.value[t, b] = leaf(left), leaf(sums[k] - left)
                continue
            small, large = (a, b) if 2 * left[0] <= sums[k, 0] else (b, a)
            wanted[t, small] = wanted[t].max() + 1
            larger[(t, large)] = (small, node)
            known[(t, node)] = hists[k]
    return trees


# ------------------------------------------------------------------ use

def fit_boosted(train: DataFrame, features, label: str, labels, **options) -> BoostedHead:
    """One ensemble on all rows of `train`."""
    return boost(train, features, label, labels, **options)[0][0]


def boosted_out_of_fold(rows: DataFrame, features, label: str, labels, seeds=(0,), k: int = 5, **options) -> DataFrame:
    """Scores of held-out rows for every seed and fold, from one run for all of them. `rows` carries
    `fold_<seed>` columns; the result has the other columns but the features, seed, fold and p_<label>."""
    seeds = [int(s) for s in seeds]
    folds = [(f"fold_{s}", f) for s in seeds for f in range(k)]
    keep = [c for c in rows.columns if c not in features or c == "g"]
    state = checkpointed(boost(rows, features, label, labels, folds, keep=keep, **options)[1])
    out = [c for c in keep if not c.startswith("fold_")]
    n, width = len(labels), k

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.frombuffer(b"".join(batch.column("_scores").to_pylist())).reshape(batch.num_rows, len(seeds), width, n)
            for j, seed in enumerate(seeds):
                fold = batch.column(f"fold_{seed}").to_numpy()
                own = s[np.arange(len(s)), j, fold]
                p = np.exp(own - own.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in out], pa.array(np.full(len(s), seed, np.int32)), pa.array(fold.astype(np.int32)), *[pa.array(p[:, c]) for c in range(n)]],
                    names=[*out, "seed", "fold", *[f"p_{x}" for x in labels]])

    kinds = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in out] + ["seed int", "fold int"] + [f"`p_{x}` double" for x in labels])
    return state.mapInArrow(work, kinds)
