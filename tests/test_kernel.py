"""Ridge on landmark similarities by blocks and conjugate gradients against dense solves."""

import numpy as np
import pytest

from alleleflow.operators import kernel as kn
from alleleflow.operators.heads import ridge_from_moments
from alleleflow.operators.protocol import with_folds


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 5))
    y = np.stack([np.sin(x[:, 0]) + x[:, 1] ** 2, np.cos(x[:, 2])], axis=1)
    return x, y


@pytest.fixture(scope="module")
def preds(spark, data):
    x, y = data
    rows = [(i, i // 2, list(map(float, v)), 0.25, -0.5, float(a), float(b), 7) for i, (v, (a, b)) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, replicate int, v array<double>, p0 double, p1 double, r0 double, r1 double, seed int").repartition(3)


def dense(x, y, train, marks, alpha):
    """Predictions of a dense ridge on the similarities of all rows."""
    basis = kn.basis_of(np.zeros(x.shape[1]), np.ones(x.shape[1]), marks, 1.0)
    d = np.sqrt(((x[:, None] - marks[None]) ** 2).sum(-1)) / basis.scale
    phi = (1 + np.sqrt(5) * d + 5 / 3 * d ** 2) * np.exp(-np.sqrt(5) * d)
    out = []
    for t in y.T:
        a = np.column_stack([np.ones(train.sum()), phi[train], t[train]])
        h = ridge_from_moments(a.T @ a, [str(i) for i in range(phi.shape[1])], alpha)
        out.append(phi @ h.coef[0] + h.intercept[0])
    return np.stack(out, axis=1)


@pytest.mark.parametrize("n,side,alpha", [(40, 16, 1.0), (150, 64, 1e-3), (1500, 256, 1.0)])
def test_correction_equals_a_dense_solve(spark, data, preds, n, side, alpha):
    x, y = data
    got = {r["id"]: r for r in kn.residual_correction(preds, "v", "id", ["p0", "p1"], ["r0", "r1"], "replicate", 3, 4,
                                                      n, alpha=alpha, side=side).collect()}
    own = with_folds(preds, "replicate", 4, [140])
    fold = {r["id"]: r["fold_140"] for r in own.collect()}
    at = np.array([fold[i] for i in range(len(x))])
    marks = kn._outside_landmarks(own, "v", "id", "fold_140", range(4), n, 3)
    m = min(map(len, marks.values()))
    for f in range(4):
        want = dense(x, y, at != f, marks[f][:m], alpha)
        for i in np.flatnonzero(at == f):
            assert got[i]["corrected_p0"] == pytest.approx(0.25 + want[i, 0], abs=1e-6)
            assert got[i]["corrected_p1"] == pytest.approx(-0.5 + want[i, 1], abs=1e-6)
    assert set(got[0].asDict()) == {"id", "replicate", "v", "p0", "p1", "seed", "corrected_p0", "corrected_p1"}


def test_similarities_never_become_columns(preds):
    out = kn.residual_correction(preds, "v", "id", ["p0", "p1"], ["r0", "r1"], "replicate", n_landmarks=1500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 4000 and "_k10" not in plan


def test_gradients_of_a_hard_matrix_and_of_zero():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(60, 60)))
    a = q @ np.diag(np.logspace(-4, 3, 60)) @ q.T
    b = np.column_stack([rng.normal(size=60), np.zeros(60)])
    x, _ = kn.conjugate_gradients(lambda v: a @ v, lambda r: r, b)
    assert np.abs(a @ x - b).max() < 1e-8 and not x[:, 1].any()
    with pytest.raises(ValueError):
        kn.conjugate_gradients(lambda v: a @ v, lambda r: r, b, rounds=3)


def test_blocks_multiply_like_the_matrix():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(23, 23))
    m = m + m.T
    spans = kn._spans(23, 7)
    b = kn.Blocks({(i, j): m[p, q] for i, p in enumerate(spans) for j, q in enumerate(spans) if i <= j}, 23, 7)
    v = rng.normal(size=(23, 2))
    assert np.allclose(b.times(v), m @ v) and np.allclose(b.diagonal(), np.diag(m))


def test_many_rows_on_similar_landmarks_are_solved():
    """Landmarks that nearly repeat each other, each row counted 10,000 times."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 3))
    phi = kn.basis_of(np.zeros(3), np.ones(3), x[:400], 4.0).of(x)
    y = np.sin(x[:, :1])
    a = np.concatenate([np.ones((2000, 1)), y, phi], axis=1)
    m = 10_000 * (a.T @ a)
    spans = kn._spans(len(m), 64)
    blocks = kn.Blocks({(i, j): m[p, q] for i, p in enumerate(spans) for j, q in enumerate(spans) if i <= j}, len(m), 64)
    coef, intercept, rounds = kn.solve_ridge(blocks, 1, 1.0)
    assert rounds < 50
    order = [0, *range(2, len(m)), 1]
    head = ridge_from_moments(m[np.ix_(order, order)], [str(i) for i in range(400)], 1.0)
    assert phi @ coef[0] + intercept[0] == pytest.approx(phi @ head.coef[0] + head.intercept[0], abs=1e-5)
