"""Corrections by ridge regression on Matern similarities to many landmarks.

The similarities of a row are made and used inside a task and never become columns. Their moment
matrix is gathered in square blocks, one array each, that are added up in levels; each fit is then
solved in one task, whose size is set by the number of landmarks, by an inverse that conjugate
gradients over the blocks refine. Only coefficients reach the driver."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleleflow.functions.arrays import ship, sum_arrays
from alleleflow.functions.exprs import hash_order
from alleleflow.functions.session import checkpointed
from alleleflow.operators.heads import landmark_spread
from alleleflow.operators.protocol import with_folds

ship(__name__)

SIDE = 256


def similarities(x: np.ndarray, marks: np.ndarray, scale: float) -> np.ndarray:
    """Matern similarity of order 5/2, (1 + t + t^2 / 3) exp(-t) at t = sqrt(5) distance / scale."""
    squares = (x ** 2).sum(1)[:, None] + (marks ** 2).sum(1) - 2 * x @ marks.T
    t = np.sqrt(5 * np.clip(squares, 0, None)) / scale
    return (1 + t * (1 + t / 3)) * np.exp(-t)


class Basis:
    """A fit's scaling, scaled landmarks and bandwidth."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, marks: np.ndarray, scale: float):
        self.mean, self.sd, self.marks, self.scale = mean, sd, marks, scale

    def of(self, x: np.ndarray) -> np.ndarray:
        return similarities((x - self.mean) / self.sd, self.marks, self.scale)


def basis_of(mean, sd, marks, scale: float) -> Basis:
    """The basis of some landmarks; the bandwidth is `scale` times their spread."""
    mean, sd = np.asarray(mean, float), np.asarray(sd, float)
    scaled = (np.asarray(marks, float) - mean) / sd
    return Basis(mean, sd, scaled, scale * landmark_spread(scaled))


def _vectors(batch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _spans(n: int, side: int) -> list[slice]:
    return [slice(k, min(k + side, n)) for k in range(0, n, side)]


def block_moments(rows: DataFrame, vector: str, targets, fold: str, bases: dict[int, Basis], side: int = SIDE) -> DataFrame:
    """model, i, j, v: blocks i <= j of the moment matrix of (1, targets, similarities) over the rows
    outside each model's fold, as bytes of doubles, summed over all tasks."""
    targets = list(targets)

    def work(batches):
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, at = _vectors(batch, vector), batch.column(fold).to_numpy()
            y = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in targets], axis=1)
            for model, basis in bases.items():
                train = np.flatnonzero(at != model)
                for part in np.array_split(train, max(1, -(-len(train) // 4096))):
                    a = np.concatenate([np.ones((len(part), 1)), y[part], basis.of(x[part])], axis=1)
                    spans = _spans(a.shape[1], side)
                    for i, p in enumerate(spans):
                        for j, q in enumerate(spans[i:], i):
                            block = a[:, p].T @ a[:, q]
                            key = (model, i, j)
                            held[key] = held[key] + block if key in held else block
        for (model, i, j), v in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([model], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([v.tobytes()], pa.binary())],
                names=["model", "i", "j", "v"])

    per_task = rows.select(fold, vector, *targets).mapInArrow(work, "model int, i int, j int, v binary")
    return sum_arrays(per_task, ["model", "i", "j"], "v")


class Blocks:
    """A symmetric matrix as blocks on and above the diagonal."""

    def __init__(self, blocks: dict[tuple[int, int], np.ndarray], n: int, side: int = SIDE):
        self.blocks, self.n, self.spans = blocks, n, _spans(n, side)

    def times(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, v.shape[1]))
        for (i, j), b in self.blocks.items():
            out[self.spans[i]] += b @ v[self.spans[j]]
            if i != j:
                out[self.spans[j]] += b.T @ v[self.spans[i]]
        return out

    def diagonal(self) -> np.ndarray:
        return np.concatenate([np.diag(self.blocks[(k, k)]) for k in range(len(self.spans))])


def conjugate_gradients(times, prepare, b: np.ndarray, tolerance: float = 1e-11, rounds: int = 20_000) -> tuple[np.ndarray, int]:
    """Solutions of A x = b for each column of b; `prepare` applies the preconditioner. Raises if
    the residual does not fall below `tolerance` times the right side."""
    x, r = np.zeros_like(b), b.copy()
    z = prepare(r)
    p, rz = z.copy(), (r * z).sum(0)
    size = np.sqrt((b ** 2).sum(0))
    for k in range(rounds):
        open_ = np.sqrt((r ** 2).sum(0)) > tolerance * size
        if not open_.any():
            return x, k
        ap = times(p)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(open_, rz / (p * ap).sum(0), 0.0)
        x += alpha * p
        r -= alpha * ap
        z = prepare(r)
        new = (r * z).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = z + np.where(open_, new / rz, 0.0) * p
        rz = new
    raise ValueError(f"conjugate gradients did not converge in {rounds} rounds")


def solve_ridge(m: Blocks, n_targets: int, alpha: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients (targets, features), intercepts and rounds of the ridge fits on standardised
    features and targets, from the moment matrix of (1, targets, features). Similar landmarks make
    the matrix worse conditioned with every row, so it is inverted as a whole and the rounds only
    refine the solution; blocks of its diagonal as preconditioner do not converge on large tables."""
    unit = np.zeros((m.n, 1 + n_targets))
    unit[:1 + n_targets] = np.eye(1 + n_targets)
    head = m.times(unit)                                   # the first columns of the matrix
    n, first = head[0, 0], 1 + n_targets
    mean = head[:, 0] / n
    sd = np.sqrt(np.clip(m.diagonal() / n - mean ** 2, 0, None))
    sd[sd == 0] = 1.0
    kept = np.zeros((m.n, 1))
    kept[first:] = 1.0
    inverse = kept[:, 0] / sd

    def times(v):
        u = inverse[:, None] * v
        return inverse[:, None] * (m.times(u) - n * mean[:, None] * (mean @ u)) + alpha * v

    whole = alpha * np.eye(m.n)                            # the matrix that `times` applies
    for (i, j), block in m.blocks.items():
        p, q = m.spans[i], m.spans[j]
        part = np.outer(inverse[p], inverse[q]) * (block - n * np.outer(mean[p], mean[q]))
        whole[p, q] += part
        if i != j:
            whole[q, p] += part.T
    whole = np.linalg.inv(whole)

    def prepare(r):
        return whole @ r

    b = inverse[:, None] * (head[:, 1:] - n * mean[:, None] * mean[1:first]) / sd[1:first]
    w, rounds = conjugate_gradients(times, prepare, b)
    coef = (w * sd[1:first] * inverse[:, None])[first:].T
    return coef, mean[1:first] - coef @ mean[first:], rounds


def fit_by_blocks(moments: DataFrame, n_landmarks: int, n_targets: int, alpha: float, side: int = SIDE) -> dict:
    """{model: (coefficients, intercepts)}: each model is solved in one task from its blocks."""
    p = 1 + n_targets + n_landmarks

    def work(key, table):
        spans = _spans(p, side)
        blocks = {}
        for i, j, v in zip(*[table.column(c).to_pylist() for c in ("i", "j", "v")]):
            blocks[(i, j)] = np.frombuffer(v).reshape(spans[i].stop - spans[i].start, -1)
        coef, intercept, rounds = solve_ridge(Blocks(blocks, p, side), n_targets, alpha)
        return pa.table({"model": [key[0].as_py()], "coef": [coef.tobytes()], "intercept": [intercept.tobytes()], "rounds": [rounds]})

    fits = moments.groupBy("model").applyInArrow(work, "model long, coef binary, intercept binary, rounds long").collect()
    return {r["model"]: (np.frombuffer(r["coef"]).reshape(n_targets, -1), np.frombuffer(r["intercept"])) for r in fits}


# ------------------------------------------------------------------ correction out of fold

def _outside_moments(rows: DataFrame, vector: str, fold: str) -> dict:
    """{fold: (mean, sd)} of a vector's entries over the rows outside the fold."""
    def work(batches):
        held: dict = {}
        for batch in batches:
            if batch.num_rows:
                x, at = _vectors(batch, vector), batch.column(fold).to_numpy()
                for f in np.unique(at):
                    part = x[at == f]
                    v = np.concatenate([[len(part)], part.sum(0), (part ** 2).sum(0)])
                    held[f] = held[f] + v if f in held else v
        for f, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([int(f)], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["f", "v"])

    sums = {r["f"]: np.frombuffer(r["v"]) for r in sum_arrays(
        rows.select(fold, vector).mapInArrow(work, "f int, v binary"), ["f"], "v").collect()}
    total, out = sum(sums.values()), {}
    for f, v in sums.items():
        rest = total - v
        n, d = max(rest[0], 1), (len(rest) - 1) // 2
        mean = rest[1:1 + d] / n
        sd = np.sqrt(np.clip(rest[1 + d:] / n - mean ** 2, 0, None))
        sd[sd <= 1e-9 * np.abs(mean)] = 0.0
        sd[sd == 0] = 1.0
        out[f] = (mean, sd)
    return out


def _outside_landmarks(rows: DataFrame, vector: str, key: str, fold: str, folds, n: int, seed: int) -> dict:
    """{fold: the n rows outside the fold with the smallest md5(seed:key)}. They are among the n
    first of each other fold, so folds x n rows are collected."""
    first = [rows.where(F.col(fold) == f).select(fold, vector, hash_order(seed, key).alias("_h"))
             .orderBy("_h").limit(n) for f in folds]
    drawn = sorted(reduce(DataFrame.unionByName, first).collect(), key=lambda r: r["_h"])
    return {f: np.array([r[vector] for r in drawn if r[fold] != f][:n], dtype=float) for f in folds}


def residual_correction(preds: DataFrame, vector: str, key: str, cols, residuals, group: str,
                        seed: int = 0, k: int = 5, n_landmarks: int = 1500, scale: float = 1.0,
                        alpha: float = 1.0, standardise: bool = False, side: int = SIDE) -> DataFrame:
    """base + residual fitted out of fold (new folds, seed + 137) by ridge on similarities to
    `n_landmarks` rows (all rows outside the fold, where there are fewer). Landmarks, bandwidth
    and, with `standardise`, the scaling of the vector come from the rows outside the fold. One
    pass of moments serves all folds and residuals. `vector` holds arrays without nulls."""
    residuals, cols = list(residuals), list(cols)
    fold_seed = seed + 137
    own = f"fold_{fold_seed}"
    outer = {c: f"_outer_{c}" for c in ("seed", "fold") if c in preds.columns}
    rows = checkpointed(with_folds(preds.withColumnsRenamed(outer), group, k, [fold_seed]))
    folds = sorted(r[0] for r in rows.select(own).distinct().collect())
    marks = _outside_landmarks(rows, vector, key, own, folds, n_landmarks, seed)
    n = min(len(m) for m in marks.values())
    scaling = _outside_moments(rows, vector, own) if standardise else {}
    bases = {}
    for f in folds:
        d = marks[f].shape[-1]
        bases[int(f)] = basis_of(*scaling.get(f, (np.zeros(d), np.ones(d))), marks[f][:n], scale)
    fits = fit_by_blocks(block_moments(rows, vector, residuals, own, bases, side), n, len(residuals), alpha, side)

    kept = [c for c in rows.columns if c not in (*residuals, own)]

    def correct(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, at = _vectors(batch, vector), batch.column(own).to_numpy()
            fitted = np.zeros((len(at), len(residuals)))
            for f in np.unique(at):
                coef, intercept = fits[int(f)]
                mine = np.flatnonzero(at == f)
                for part in np.array_split(mine, max(1, -(-len(mine) // 4096))):
                    fitted[part] = bases[int(f)].of(x[part]) @ coef.T + intercept
            corrected = [pa.array(batch.column(c).to_numpy(zero_copy_only=False).astype(float) + fitted[:, i]) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *corrected], names=[*kept, *[f"corrected_{c}" for c in cols]])

    kinds = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"`corrected_{c}` double" for c in cols])
    return rows.mapInArrow(correct, kinds).withColumnsRenamed({b: a for a, b in outer.items()})
