"""The multi-index against brute force where the table outgrows its sample."""

import numpy as np
import pytest

from alleleflow.llm import multi_index


@pytest.mark.parametrize("spread", [None, 0.7])
def test_recall_beyond_the_sample(spark, spread):
    """12,000 vectors, 512 of them in the sample: 0.9 of the true neighbours at least."""
    rng = np.random.default_rng(5)
    n, dim = 12_000, 16
    x = rng.normal(size=(n, dim)) if spread is None else rng.normal(size=(n // 50, dim))[rng.integers(0, n // 50, n)] + spread * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:3000] = x[0]                      # one vector holds a quarter of the rows
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = multi_index.search(rows, every=60, sample=512, block=1000, together=50).toPandas()
    hits = []
    for q in range(0, n, 60):
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.abs(score[own["vec_id"]] - own["score"]).max() < 1e-9
        least = np.sort(score)[-20]
        hits.append((score[own["vec_id"]] >= least - 1e-12).mean())
        if q < 3000:                     # ties go to the smaller vec_id
            assert own["vec_id"].tolist() == [k for k in range(21 if q < 21 else 20) if k != q][:20]
    assert np.mean(hits) >= 0.9


def test_walk_falls_and_visits_each_cell_once():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 8))
    book = multi_index.Codebook(x, 8)
    cells = book.cells(x)
    counts = np.bincount(cells, minlength=64)
    for q in x[:10]:
        walked = book.walk(q, counts, 500)
        assert sorted(walked) == np.flatnonzero(counts).tolist()
        value = (book.left @ q[:4])[:, None] + (book.right @ q[4:])[None]
        assert (np.diff(value.ravel()[walked]) <= 1e-12).all()
        assert book.held_before(q, counts)[walked].tolist() == [0, *np.cumsum(counts[walked])[:-1].tolist()]
        assert counts[book.walk(q, counts, 100)].sum() >= 100


def test_blocks_hold_all_cells():
    counts = np.array([3, 0, 25, 4, 4, 4, 9, 0, 1])
    first, spread = multi_index.blocks_of(counts, 10)
    held = {}
    for cell, n in enumerate(counts):
        for k in range(spread[cell]):
            held.setdefault(first[cell] + k, []).append((cell, -(-n // spread[cell])))
    assert sorted(held) == list(range(len(held)))
    assert all(sum(n for _, n in v) <= 10 for v in held.values()) and spread[2] == 3
