"""The pipeline's near-dedup stage against brute force on exact similarities."""

import numpy as np

import corpus_pipeline
from alleleflow.llm import similar
from alleleflow.llm.shared import table

WORDS = [f"w{k}" for k in range(5000)]


def _shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)}


def _changed(rng, words, n):
    """`words` with n of them replaced, at least six words apart."""
    words = list(words)
    for k in rng.choice(len(words) // 6, n, replace=False):
        words[6 * k + 3] = f"x{rng.integers(1 << 40)}"
    return words


def test_near_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = [None, "", " \n", "a b", "A  b", "a b c", "a b c d e", "a b c d e f"]
    for k in range(30):
        base = list(rng.choice(WORDS, int(rng.integers(60, 400))))
        texts.append(" ".join(base))
        # one change in 100 words: about 0.9; two: about 0.81; three: below 0.8
        for share in (0.004, 0.01, 0.015, 0.021, 0.024, 0.03):
            texts.append(" ".join(_changed(rng, base, max(1, round(share * len(base))))))
    texts = [texts[k] for k in rng.permutation(len(texts))]
    docs = table(spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)],
                                       "doc_id long, text string, lang string, source string, n_chars long").coalesce(1), "docs")
    stored = docs.collect()
    sets = [_shingles(r["text"]) for r in stored]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                near += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert near > 100
    want = sorted(stored[k]["doc_id"] for k in range(len(sets)) if root(k) == k)
    out = corpus_pipeline.dedup_documents(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == want


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(12)
    a, b = [], []
    for _ in range(4000):
        base = [w.encode() for w in rng.choice(WORDS, 184)]
        a.append(base)
        b.append([w if isinstance(w, bytes) else w.encode() for w in _changed(rng, base, 4)])   # 180 shingles, 20 changed: 160 / 200
    shared = (similar.band_keys(a, 5, 16, 3) == similar.band_keys(b, 5, 16, 3)).any(axis=1)
    assert shared.mean() >= 0.999


def test_fingerprints_give_candidates_that_bands_miss(spark):
    """With one band of 60 minima hardly a pair shares it; close fingerprints are tested all the same."""
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(12):
        base = list(rng.choice(WORDS, 600))
        texts += [" ".join(base), " ".join(_changed(rng, base, 5))]
    docs = table(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3), "docs")
    once = similar.prints(docs, 5, 1, 60).where("bands is not null").drop("row")
    pairs = {(min(r), max(r)) for r in map(tuple, similar.print_pairs(once).collect())}
    ids = once.select("text_id", "fp").collect()
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in ids for b in ids if a[0] != b[0] and ((a[1] ^ b[1]) & (2 ** 64 - 1)).bit_count() <= 4}
    assert pairs == want and len(want) >= 3
    assert similar.first_rows(docs, 5, 1, 60).count() <= len(texts) - len(want)
