"""Model heads. Linear heads are fitted by Newton steps or from moment matrices gathered in
one pass for all seeds and folds; both become a `LinearHead`, a few coefficients applied as
plain column arithmetic."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alleleflow.functions.arrays import sum_arrays
from alleleflow.functions.exprs import add
from alleleflow.functions.session import checkpointed


# ------------------------------------------------------------------ standardisation

def scaler_of(df: DataFrame, cols) -> DataFrame:
    """One row: mean and population sd per column; a constant column keeps scale 1."""
    return df.agg(*[F.expr(f"avg(`{c}`) AS `m_{c}`") for c in cols],
                  *[F.expr(f"if(stddev_pop(`{c}`) > 0, stddev_pop(`{c}`), 1D) AS `s_{c}`")
                    for c in cols])


def standardise(train: DataFrame, apply: DataFrame, cols) -> DataFrame:
    """Columns of `apply` centred and scaled by the moments of `train`."""
    rest = [c for c in apply.columns if c not in cols]
    return apply.crossJoin(F.broadcast(scaler_of(train, cols))).selectExpr(    # one row
        *rest, *[f"(`{c}` - `m_{c}`) / `s_{c}` AS `{c}`" for c in cols])


def weight_features(df: DataFrame, cols, heavy, weight: float = 5.0) -> DataFrame:
    return df.select(*[(F.col(c) * weight).alias(c) if c in heavy and c in cols else F.col(c)
                       for c in df.columns])


# ------------------------------------------------------------------ linear heads

@dataclass
class LinearHead:
    """score_k = x . coef_k + intercept_k. `kind`: softmax, logistic or identity."""

    features: list[str]
    labels: list
    coef: np.ndarray
    intercept: np.ndarray
    kind: str = "softmax"
    meta: dict = field(default_factory=dict)

    def scores(self) -> list[str]:
        """SQL of each score; one parsed expression is far cheaper to build than a tree."""
        return [" + ".join([f"`{c}` * {float(w)!r}D" for c, w in zip(self.features, row)]
                           + [f"{float(b)!r}D"]) for row, b in zip(self.coef, self.intercept)]

    def output_columns(self, prefix: str = "p") -> list[str]:
        return [f"{prefix}_{x}" for x in self.labels]

    def apply(self, df: DataFrame, prefix: str = "p") -> DataFrame:
        names = [f"_s{i}" for i in range(len(self.coef))]
        scored = df.selectExpr("*", *[f"{s} AS {n}" for s, n in zip(self.scores(), names)])
        return _probabilities(scored, names, self.labels, self.kind, prefix)

    def to_dict(self) -> dict:
        return {"features": self.features, "labels": list(self.labels), "kind": self.kind,
                "coef": np.asarray(self.coef).tolist(),
                "intercept": np.asarray(self.intercept).tolist()}

    @staticmethod
    def from_dict(d: dict) -> "LinearHead":
        return LinearHead(d["features"], d["labels"], np.array(d["coef"]),
                          np.array(d["intercept"]), d["kind"])


def _probabilities(scored: DataFrame, names, labels, kind: str, prefix: str) -> DataFrame:
    keep = [c for c in scored.columns if c not in names]
    if kind == "identity":
        out = [F.col(n).alias(f"{prefix}_{x}") for n, x in zip(names, labels)]
    elif kind == "logistic":
        out = [(1 / (1 + F.exp(-F.col(names[0])))).alias(f"{prefix}_{labels[0]}")]
    else:
        top = F.greatest(*names)
        exps = [F.exp(F.col(n) - top) for n in names]
        out = [(e / add(exps)).alias(f"{prefix}_{x}") for e, x in zip(exps, labels)]
    return scored.select(*keep, *out)


def apply_by_fold(df: DataFrame, heads: dict, prefix: str = "p") -> DataFrame:
    """Score rows that carry `seed` and `fold` with the head of their own seed and fold, in one
    pass: the heads become a table of seeds x folds rows that is broadcast."""
    spark = df.sparkSession
    some = next(iter(heads.values()))
    k = len(some.coef)
    rows = [(int(s), int(f), *[[float(v) for v in h.coef[i]] for i in range(k)],
             [float(b) for b in h.intercept]) for (s, f), h in heads.items()]
    table = spark.createDataFrame(
        rows, "seed int, fold int, " + ", ".join(f"_w{i} array<double>" for i in range(k))
        + ", _b array<double>")
    names = [f"_s{i}" for i in range(k)]
    # the heads were just collected: seeds x folds rows
    scored = df.join(F.broadcast(table), ["seed", "fold"]).selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[" + ".join([f"`{c}` * get(_w{i}, {j})" for j, c in enumerate(some.features)])
          + f" + get(_b, {i}) AS {names[i]}" for i in range(k)])
    return _probabilities(scored, names, some.labels, some.kind, prefix)


def explode_seeds(df: DataFrame, seeds) -> DataFrame:
    """Rows with `fold_<seed>` columns to one row per seed with (seed, fold)."""
    pairs = F.array(*[F.struct(F.lit(int(s)).alias("seed"), F.col(f"fold_{s}").alias("fold"))
                      for s in seeds])
    rest = [c for c in df.columns if not c.startswith("fold_")]
    return df.select(*rest, F.inline(pairs))


# ------------------------------------------------------------------ moment matrices

def moment_sums(df: DataFrame, features, keys, seeds=None) -> DataFrame:
    """Count, sums and cross products of `features` per key: one row per key with the upper triangle
    of the moment matrix as the array `gram`; index 0 is the constant 1, so (0, 0) is the count and
    (0, j) are the sums. `moment_entries` takes it apart.

    A task reduces its Arrow batches to Gram matrices with numpy, and whole matrices are added up in
    levels, so the data moved depends on tasks, keys and features, not on rows. With `seeds`, the
    key `fold` is taken from every `fold_<seed>` column and `seed` is added."""
    keys = list(keys)
    features = list(features)
    p = len(features) + 1
    upper = np.triu_indices(p)
    source = df
    if seeds is None:
        source = df.select(*keys, *features)
        fold_cols = None
    else:
        fold_cols = {int(s): f"fold_{s}" for s in seeds}
        source = df.select(*keys, *fold_cols.values(), *features)
    out_keys = (["seed", "fold"] if seeds is not None else []) + keys
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    key_schema = [("seed int", "fold int")] if seeds is not None else []
    schema = ", ".join([*(x for pair in key_schema for x in pair),
                        *[f"{k} {types[k]}" for k in keys], "gram array<double>"])

    def flush(held):
        return pd.DataFrame([[*key, g[upper]] for key, g in held.items()],
                            columns=[*out_keys, "gram"])

    def reduce_batches(batches):
        held: dict = {}
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf[features].to_numpy(dtype=float)])
            for seed, fold in (fold_cols or {None: None}).items():
                by = ([fold] if fold else []) + keys
                groups = (pdf.groupby(by, sort=False, dropna=False).indices if by
                          else {(): np.arange(len(pdf))})
                for key, at in groups.items():
                    key = key if isinstance(key, tuple) else (key,)
                    key = (seed, *key) if fold else key
                    part = x[at]
                    held[key] = held.get(key, 0) + part.T @ part
            if len(held) > 256:              # keep memory flat for many keys
                yield flush(held)
                held = {}
        if held:
            yield flush(held)

    return sum_arrays(source.mapInPandas(reduce_batches, schema), out_keys, "gram")


def moment_entries(sums: DataFrame, keys, p: int) -> DataFrame:
    """The entries of summed moment matrices: (keys, i, j, value) with i <= j."""
    upper = np.triu_indices(p)
    index, other = (F.split(F.lit(",".join(map(str, u))), ",").cast("array<int>") for u in upper)
    return (sums.select(*keys, F.posexplode("gram").alias("_k", "value"))
            .select(*keys, F.get(index, F.col("_k")).alias("i"), F.get(other, F.col("_k")).alias("j"), "value"))


def collect_moments(sums: DataFrame, keys, p: int) -> dict[tuple, np.ndarray]:
    """Moment matrices on the driver: one row per key, never rows of data."""
    upper = np.triu_indices(p)
    out: dict[tuple, np.ndarray] = {}
    for row in sorted(sums.collect(), key=lambda r: tuple(r[k] for k in keys)):
        m = np.zeros((p, p))
        m[upper] = row["gram"]
        out[tuple(row[k] for k in keys)] = m + np.triu(m, 1).T
    return out


def discriminant_from_moments(by_class: dict, features) -> LinearHead:
    """Fisher discriminant with shared covariance and class priors, from one moment matrix per
    class. Directions without within-class variance are left out, as in an SVD solver."""
    labels = sorted(by_class)
    total = sum(m[0, 0] for m in by_class.values())
    d = len(features)
    pooled = np.zeros((d, d))
    means, priors = [], []
    for c in labels:
        m = by_class[c]
        mu = m[0, 1:] / m[0, 0]
        pooled += m[1:, 1:] - m[0, 0] * np.outer(mu, mu)
        means.append(mu)
        priors.append(m[0, 0] / total)
    pooled /= total - len(labels)
    means = np.array(means)
    scale = np.sqrt(np.clip(np.diag(pooled), 0, None))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(pooled / np.outer(scale, scale))
    kept = values > 1e-10 * max(values.max(), 1e-300)
    basis = vectors[:, kept] / np.sqrt(values[kept])
    inverse = (basis @ basis.T) / np.outer(scale, scale)
    centre = np.array(priors) @ means
    shifted = means - centre
    coef = shifted @ inverse
    intercept = (np.log(priors) - 0.5 * np.einsum("ij,ij->i", coef, shifted) - coef @ centre)
    return LinearHead(list(features), labels, coef, intercept)


def discriminant_by_fold(df: DataFrame, features, label: str, seeds=(0,), keys=()) -> dict:
    """Discriminants for every (seed, fold) from a single pass: the training moments of a fold
    are the total minus the held-out part. `df` carries `fold_<seed>` columns."""
    sums = moment_sums(df, features, [label], seeds)
    held = collect_moments(sums, ["seed", "fold", label], len(features) + 1)
    return {sf: discriminant_from_moments(m, features)
            for sf, m in leave_fold_out(held).items()}


def leave_fold_out(held: dict) -> dict:
    """{(seed, fold, label): M} to {(seed, fold): {label: total - M}}."""
    totals: dict = {}
    folds: dict = {}
    for (seed, fold, label), m in held.items():
        totals.setdefault(seed, {}).setdefault(label, 0)
        totals[seed][label] = totals[seed][label] + m
        folds.setdefault((seed, fold), {})[label] = m
    out = {}
    for (seed, fold), part in folds.items():
        train = {c: t - part.get(c, 0) for c, t in totals[seed].items()}
        out[(seed, fold)] = {c: m for c, m in train.items() if m[0, 0] > 0.5}
    return out


def ridge_from_moments(m: np.ndarray, features, alpha: float = 1.0,
                       eps: float = 0.0) -> LinearHead:
    """Ridge on standardised features and target; the target is the last column of `m`."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None)) + eps
    sd[sd == 0] = 1.0
    corr = cov / np.outer(sd, sd) * n
    w = np.linalg.solve(corr[:-1, :-1] + alpha * np.eye(len(mean) - 1), corr[:-1, -1])
    coef = w * sd[-1] / sd[:-1]
    return LinearHead(list(features), ["log_rate"], coef[None, :],
                      np.array([mean[-1] - coef @ mean[:-1]]), "identity")


def ridge_by_fold(df: DataFrame, features, target: str, alpha: float = 1.0,
                  seeds=(0,), eps: float = 0.0) -> dict:
    """Ridge heads for every (seed, fold) from one pass over the rows."""
    cols = [*features, target]
    sums = moment_sums(df.withColumn("_one", F.lit(1)), cols, ["_one"], seeds)
    held = collect_moments(sums, ["seed", "fold", "_one"], len(cols) + 1)
    return {sf: ridge_from_moments(m[1], features, alpha, eps)
            for sf, m in leave_fold_out(held).items()}


def pca_from_moments(m: np.ndarray, features, k: int = 2) -> LinearHead:
    """First k principal components of the standardised features. The sign is fixed by making
    the largest loading positive."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    sd[sd == 0] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    top = vectors[:, np.argsort(values)[::-1][:k]].T
    top *= np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])[:, None]
    coef = top / sd
    return LinearHead(list(features), [f"{i + 1}" for i in range(k)], coef, -(coef @ mean),
                      "identity", {"variance": np.sort(values)[::-1][:k].tolist()})


def pca_projection(df: DataFrame, features, k: int = 2) -> DataFrame:
    m = collect_moments(moment_sums(df.withColumn("_one", F.lit(1)), features, ["_one"]),
                        ["_one"], len(features) + 1)[(1,)]
    return pca_from_moments(m, features, k).apply(df, "pc")


def separation_table(by_class: dict, control, loci: float = 1.0) -> list[dict]:
    """Whitened shift of every class from the control and between classes, with the predicted
    two-class error Q(separation / 2)."""
    from math import erfc, sqrt
    labels = [c for c in sorted(by_class) if c != control]
    means = {c: m[0, 1:] / m[0, 0] for c, m in by_class.items()}
    pooled = sum(m[1:, 1:] - m[0, 0] * np.outer(means[c], means[c])
                 for c, m in by_class.items())
    pooled = pooled / (sum(m[0, 0] for m in by_class.values()) - len(by_class))
    scale = np.sqrt(np.clip(np.diag(pooled), 0, None))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(pooled / np.outer(scale, scale))
    kept = values > 1e-10 * max(values.max(), 1e-300)
    white = (vectors[:, kept] / np.sqrt(values[kept])).T / scale

    def row(a, b):
        s = float(np.linalg.norm(white @ (means[a] - means[b])) * np.sqrt(loci))
        return {"first": a, "second": b, "separation": s,
                "predicted_error": 0.5 * erfc(s / 2 / sqrt(2))}
    return ([row(c, control) for c in labels]
            + [row(a, b) for i, a in enumerate(labels) for b in labels[i + 1:]])


# ------------------------------------------------------------------ iterative heads

def _scale_of(m: np.ndarray, eps: float = 0.0):
    """Mean and population sd from a moment matrix; constant columns get scale 1."""
    mean = m[0, 1:] / m[0, 0]
    sd = np.sqrt(np.clip(np.diag(m)[1:] / m[0, 0] - mean ** 2, 0, None))
    sd[sd <= 1e-9 * np.maximum(np.abs(mean), 1e-300)] = 0.0
    sd = sd + eps
    sd[sd == 0] = 1.0
    return mean, sd


def fit_logistic(train: DataFrame, features, label: str, labels=None, c: float = 1.0,
                 max_iter: int = 50, eps: float = 0.0,
                 scale_on: DataFrame | None = None) -> LinearHead:
    """One logistic head on all rows of `train`, standardised by `scale_on` (by `train` if not
    given). `labels=None` fits a binary head on a 0/1 label."""
    base = train if scale_on is None else scale_on
    m = collect_moments(moment_sums(base.withColumn("_one", F.lit(1)), features, ["_one"]),
                        ["_one"], len(features) + 1)[(1,)]
    mean, sd = _scale_of(m, eps)
    rows = train.select(F.lit(-1).alias("fold_0"), label, *features)
    return _newton(rows, features, label, labels, [0], {(0, 0): (mean, sd)}, c, max_iter)[(0, 0)]


def logistic_by_fold(df: DataFrame, features, label: str, labels=None, seeds=(0,), k: int = 5,
                     c: float = 1.0, max_iter: int = 50, eps: float = 0.0) -> dict:
    """Logistic heads of every (seed, fold), each standardised by its own training rows and
    fitted together. `labels=None` fits a binary head on a 0/1 label."""
    features = list(features)
    seeds = [int(s) for s in seeds]
    rows = df.select(*[f"fold_{s}" for s in seeds], label, *features)
    held = collect_moments(moment_sums(rows.withColumn("_one", F.lit(1)), features, ["_one"],
                                       seeds), ["seed", "fold", "_one"], len(features) + 1)
    fits = {sf: _scale_of(m[1], eps) for sf, m in leave_fold_out(held).items()}
    return _newton(rows, features, label, labels, seeds, fits, c, max_iter)


def _newton(rows: DataFrame, features, label: str, labels, seeds, fits: dict, c: float,
            max_iter: int, tol: float = 1e-6) -> dict:
    """Penalised logistic fits by Newton's method, one per key (seed, fold) of `fits`, trained
    on the rows outside the fold. One pass over the rows gives loss, gradient and Hessian of
    all fits, so the number of jobs is the number of Newton steps (about ten), whatever the
    number of folds and seeds. Only coefficients are held on the driver."""
    features = list(features)
    p, binary = len(features), labels is None
    names = [1] if binary else list(labels)
    n_rows = len(names)
    size = n_rows * (p + 1)
    upper = np.triu_indices(size)
    penalty = np.ones((n_rows, p + 1)) / c
    penalty[:, 0] = 0.0
    penalty = penalty.ravel()

    def passes(theta):
        """[loss, gradient, Hessian] of the data term for each fit, summed over tasks."""
        def work(batches):
            total: dict = {}
            for pdf in batches:
                x = pdf[features].to_numpy(dtype=float)
                y = np.column_stack([(pdf[label] == v).to_numpy(dtype=float) for v in names])
                for seed in seeds:
                    fold = pdf[f"fold_{seed}"].to_numpy()
                    for (s, f), t in theta.items():
                        if s != seed:
                            continue
                        train = fold != f
                        if not train.any():
                            continue
                        mean, sd = fits[(s, f)]
                        z = np.column_stack([np.ones(train.sum()), (x[train] - mean) / sd])
                        yt = y[train]
                        score = z @ t.reshape(n_rows, p + 1).T
                        if binary:
                            loss = np.logaddexp(0, score).sum() - (yt * score).sum()
                            prob = 1 / (1 + np.exp(-score))
                        else:
                            top = score.max(1, keepdims=True)
                            norm = top + np.log(np.exp(score - top).sum(1, keepdims=True))
                            loss = (norm.sum() - (yt * score).sum())
                            prob = np.exp(score - norm)
                        grad = ((prob - yt).T @ z).ravel()
                        hess = np.zeros((size, size))
                        for a in range(n_rows):
                            for b in range(a, n_rows):
                                w = prob[:, a] * ((a == b) - prob[:, b])
                                block = (z * w[:, None]).T @ z
                                ra, rb = a * (p + 1), b * (p + 1)
                                hess[ra:ra + p + 1, rb:rb + p + 1] = block
                        out = np.concatenate([[loss], grad, hess[upper]])
                        total[(s, f)] = total.get((s, f), 0) + out
            if total:
                yield pd.DataFrame([[s, f, v] for (s, f), v in total.items()],
                                   columns=["seed", "fold", "v"])
        per_task = rows.mapInPandas(work, "seed int, fold int, v array<double>")
        return {(r["seed"], r["fold"]): np.array(r["v"])
                for r in sum_arrays(per_task, ["seed", "fold"], "v").collect()}

    theta = {sf: np.zeros(size) for sf in fits}
    best: dict = {}                                  # accepted point, its value, Newton step
    active = set(theta)
    for _ in range(max_iter):
        for sf, v in passes({sf: theta[sf] for sf in active}).items():
            t = theta[sf]
            value = v[0] + 0.5 * (penalty * t * t).sum()
            if sf in best and not value <= best[sf][1] + 1e-12 * abs(best[sf][1]):
                best[sf][2] = best[sf][2] / 2        # too far: halve the step
                if np.abs(best[sf][2]).max() < 1e-12:
                    theta[sf] = best[sf][0]
                    active.discard(sf)
                    continue
                theta[sf] = best[sf][0] - best[sf][2]
                continue
            grad = v[1:1 + size] + penalty * t
            hess = np.zeros((size, size))
            hess[upper] = v[1 + size:]
            hess = hess + np.triu(hess, 1).T + np.diag(penalty)
            step = np.linalg.lstsq(hess, grad, rcond=1e-12)[0]
            best[sf] = [t, value, step]
            if np.abs(grad).max() < tol * max(1.0, abs(value)):
                active.discard(sf)
            else:
                theta[sf] = t - step
        if not active:
            break
    for sf in active:                                # ran out of passes: the best point so far
        theta[sf] = best[sf][0] if sf in best else theta[sf]
    out = {}
    for sf, (mean, sd) in fits.items():
        t = theta[sf].reshape(n_rows, p + 1)
        w = t[:, 1:] / sd
        b = t[:, 0] - w @ mean
        out[sf] = LinearHead(features, ["gate"] if binary else names, w, b,
                             "logistic" if binary else "softmax", {"converged": sf not in active})
    return out


# ------------------------------------------------------------------ frozen model

def save_heads(spark: SparkSession, heads: dict[str, LinearHead], path: str) -> None:
    rows = [(name, json.dumps(h.to_dict())) for name, h in heads.items()]
    spark.createDataFrame(rows, "name string, head string").coalesce(1).write.json(path)


def load_heads(spark: SparkSession, path: str) -> dict[str, LinearHead]:
    return {r["name"]: LinearHead.from_dict(json.loads(r["head"]))
            for r in spark.read.schema("name string, head string").json(path).collect()}


# ------------------------------------------------------------------ landmark similarity

def landmark_rows(df: DataFrame, vector: str, key: str, n: int = 64, seed: int = 0) -> np.ndarray:
    """The n rows with the smallest md5(seed:key), collected as landmarks. Their number is a
    parameter of the model, like its features."""
    from alleleflow.functions.exprs import hash_order
    top = df.select(vector, hash_order(seed, key).alias("_h")).orderBy("_h").limit(n).collect()
    return np.array([r[vector] for r in top], dtype=float)


def landmark_spread(landmarks: np.ndarray) -> float:
    """Root mean square distance between two landmarks: the mean squared distance over pairs is
    twice the sum of the columns' sample variances. 1 where all landmarks are equal."""
    if len(landmarks) < 2:
        return 1.0
    return float(np.sqrt(2 * landmarks.var(axis=0, ddof=1).sum())) or 1.0


def _similarity(vector: str, landmarks: str, scale: str) -> str:
    """SQL of the Matern similarity of order 5/2, (1 + t + t^2 / 3) exp(-t) at t = sqrt(5) times
    distance over scale, of an array to each of an array of landmarks."""
    squares = f"zip_with({vector}, _mark, (_a, _b) -> power(_a - _b, 2))"
    t = f"sqrt(5 * aggregate({squares}, 0D, (_sum, _d) -> _sum + _d)) / {scale}"
    return f"transform(transform({landmarks}, _mark -> {t}), _t -> (1 + _t * (1 + _t / 3)) * exp(-_t))"


def landmark_similarity(df: DataFrame, vector: str, landmarks: np.ndarray, scale: float,
                        out: str = "similarity") -> DataFrame:
    """Similarity of every row's vector to each landmark, as an array of column arithmetic; the
    landmarks come as one broadcast row."""
    marks = df.sparkSession.createDataFrame([(landmarks.tolist(),)], "_marks array<array<double>>")
    return df.crossJoin(F.broadcast(marks)).selectExpr(
        *[f"`{c}`" for c in df.columns if c != out],
        f"{_similarity(f'`{vector}`', '_marks', f'{float(scale)!r}D')} AS `{out}`")


def residual_targets(preds: DataFrame, truth: str, cols, labels=None) -> DataFrame:
    """What a correction has to learn: onehot(truth) - p per class, or truth - prediction."""
    if labels is None:
        return preds.withColumn("residual", F.col(truth) - F.col(cols[0]))
    return preds.select("*", *[((F.col(truth) == x).cast("double") - F.col(c))
                               .alias(f"residual_{x}") for c, x in zip(cols, labels)])


# ------------------------------------------------------------------ curves

def curve_depths(n_depths: int, k: int = 8) -> list[int]:
    """Zero-based positions (n_depths - 1)^(j / (k - 1)) for j below k, rounded, each once."""
    last = n_depths - 1
    return sorted({min(last, round(last ** (j / max(k - 1, 1)))) for j in range(k)})


def curve_features(rows: DataFrame, statistics, k: int = 8, group: str = "replicate",
                   extra=()) -> DataFrame:
    """Each statistic at k log-spaced depths (`<statistic>_at<g>`) and its mean over depths
    (`<statistic>_curve`). All replicates must share one depth grid."""
    per = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("g").alias("d"))
    n, most, distinct = per.agg(F.min("n"), F.max("n"), F.min("d")).first()
    grid = sorted(r["g"] for r in rows.select("g").distinct().limit(n + 1).collect())
    if not n == most == distinct == len(grid):
        raise ValueError("replicates have unequal depth grids")
    depths = [grid[i] for i in curve_depths(n, k)]
    return rows.groupBy(group, *extra).agg(
        *[F.expr(f"max(if(g = {d}, {s}, NULL)) AS {s}_at{d}") for d in depths for s in statistics],
        *[F.expr(f"avg({s}) AS {s}_curve") for s in statistics])
