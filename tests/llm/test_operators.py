"""The text operators on odd rows (nulls, empty and long texts, repeated rows, clashing columns,
empty tables) against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alleleflow.llm import decontaminate, encode, lines, multi_index, packing, pii, sharding, simhash, substrings, toxicity, wavelet
from alleleflow.llm.components import connected_components
from alleleflow.llm.shared import table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, spans string, part int, label int"
WORDS = [f"w{k}" for k in range(40)]


def _texts():
    rng = np.random.default_rng(3)
    passage = " ".join(rng.choice(WORDS, 60))
    some = [" ".join(rng.choice(WORDS, n)) for n in (1, 4, 5, 34, 35, 90, 300)]
    return [None, "", " \n\t ", "word", "É Ünï <|endoftext|> don't 42", *some, passage, f"a b {passage} c\nd",
            some[-1], some[-1], "the " * 120, f"{passage} {passage}", some[5] + "\n" + some[5], "x" * 5000, passage]


def _docs(spark, texts, first=0):
    rows = [(None if k == 1 else first + k, t, None, "s", None, 7, "s", 1, 1) for k, t in enumerate(texts)]
    return table(spark.createDataFrame(rows + rows[-1:], COLUMNS), "docs")


@pytest.fixture(scope="module")
def docs(spark):
    return _docs(spark, _texts())


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def none(spark):
    return table(spark.createDataFrame([], COLUMNS), "none")


def _ids(text, tokenizer=encode.encoder(encode.default_path()).tokenizer):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_empty_tables(spark, none):
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (decontaminate.contained_items(none, items), packing.pack_documents(none), substrings.remove_repeats(none),
               lines.remove_similar_lines(none), simhash.components(none), pii.digest(pii.find(none)), sharding.assign(none),
               toxicity.scores(none, toxicity.learn(none, labels), "doc_id"), multi_index.search(vectors),
               wavelet.digests(wavelet.read_documents(wavelet.write_shards(none))), simhash.drop_near_duplicates(none),
               decontaminate.drop_contaminated(none, items.limit(0)), toxicity.drop_toxic(none, labels)):
        assert df.collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"aBzé İΣσς'.,!?_-²3½٣ \n\t日ß", "'s ", "<|endoftext|>", "é"]), max_size=12).map("".join))
def test_word_encoder_equals_library(text):
    enc = encode.encoder(encode.default_path())
    assert enc.encode([text])[0].tolist() == _ids(text)


def test_packing(docs, rows):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs, packing.Limits(tokens=64, segments=3, loss=64, pool=4)).collect():
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = Counter((d, tuple(_ids(t) + [2])) for d, t in rows)
    for d, pieces in by.items():
        whole = [(i, ids) for i, ids in want if i == d]
        if len(whole) == 1 and want[whole[0]] == 1:
            assert [i for r in sorted(pieces, key=lambda r: r["start"]) for i in r["ids"]] == list(whole[0][1])
    assert sum(r["length"] for v in by.values() for r in v) == sum(len(k[1]) * n for k, n in want.items())
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.cumsum([0, *[r["length"] for r in s[:-1]]]).tolist()
        assert sum(r["length"] for r in s) <= 64 and len(s) <= 3
        assert all(zlib.crc32(np.array(r["ids"], "<u4")) == r["ids_crc32"] for r in s)


def test_packing_turns_keeps_loss_limit(spark):
    rows = [(k % 5, role, " ".join(WORDS[: 5 + k])) for k in range(20) for role in ("user", "assistant", None)]
    out = packing.pack_turns(spark.createDataFrame(rows, "conv_id long, role string, text string").coalesce(1),
                             packing.Limits(tokens=128, segments=4, loss=40)).groupBy("sequence_id").agg(
        F.sum("loss_tokens").alias("l"), F.sum("length").alias("n"), F.count("*").alias("k")).collect()
    assert max(r["l"] for r in out) <= 40 and max(r["n"] for r in out) <= 128 and max(r["k"] for r in out) <= 4
    assert sum(r["n"] for r in out) == sum(len(_ids(t)) + 1 for _, _, t in rows)


def test_substrings(docs, rows):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                gone.update(range(i, i + 35))
        want[d, b" ".join(x for i, x in enumerate(w) if i not in gone).decode(), len(w), len(gone)] += 1
    assert Counter(map(tuple, substrings.remove_repeats(docs, 35).collect())) == want


def test_lines(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(WORDS, 14)) for _ in range(8)]
    texts = []
    for k in range(40):
        picked = [base[rng.integers(8)] for _ in range(3)]
        texts.append("\n".join([x.replace("w1", f"w{k}", 1) if rng.random() < 0.6 else x for x in picked] + ["", "ab"]))
    docs = _docs(spark, [None, "", "\n", *texts])
    rows = [r["text"] for r in docs.collect()]
    places = {}
    for i, t in enumerate(rows):
        for k, line in enumerate((t or "").split("\n")):
            if n := line.strip().lower():
                places.setdefault(n, (i, k))
    own = list(places)
    sets = [{x[i:i + 7] for i in range(len(x) - 6)} for x in own]
    parent = list(range(len(own)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(own)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    keep = {root(i): places[own[root(i)]] for i in range(len(own))}
    want = Counter()
    for i, t in enumerate(rows):
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip() or (i, k) in keep.values())
        want[kept] += 1
    # 40 bands: any pair at 0.8 meets, so that the result is certain
    assert Counter(r["text"] for r in lines.remove_similar_lines(docs, bands=40).collect()) == want


def test_simhash(docs, rows):
    prints = {d: simhash.fingerprint((t or "").encode(), 4) for d, t in rows}
    out = simhash.components(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["fp"] % (1 << 64) == prints[r["doc_id"]]
    ids = sorted(d for d in prints if d is not None)
    own = {r["doc_id"]: r["component_id"] for r in out}
    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                assert own[a] == own[b]
    assert own[0] == own[2] == 0 and own[1 + 4] == 5
    kept = simhash.drop_near_duplicates(docs, width=4)
    assert kept.columns == docs.columns and kept.count() == len({own[d] for d in own if d is not None})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=2), st.sets(st.integers(0, 63), max_size=4))
def test_manhattan_bound(pair, flips):
    counts = lambda x: np.array([(x >> 8 * k & 255).bit_count() for k in range(8)])
    a, b = pair
    assert np.abs(counts(a) - counts(b)).sum() <= (a ^ b).bit_count()
    c = a
    for f in flips:
        c ^= 1 << f
    groups = [sum(1 << k for k in range(64) if k // 2 * 6 // 32 == g) for g in range(6)]
    assert sum((a ^ c) & g == 0 for g in groups) >= 2


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (7, 6), (6, 5), (5, 5), (20, 21), (21, 20)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 20: 20, 21: 20}


def test_decontamination(spark, docs, rows):
    passage = rows[12][1]
    items = [(1, passage[:60]), (2, None), (3, ""), (4, "a b"), (5, passage.upper() + " zz"), (5, passage.upper() + " zz"), (6, " ".join(WORDS[::-1]))]
    frame = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")

    def cut(t):
        w = re.findall(r"\w+", (t or "").lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    want = Counter((d, i) for d, t in rows for i, x in items if cut(x) and len(cut(x) & cut(t)) >= 0.8 * len(cut(x)))
    got = decontaminate.contained_items(docs, frame)
    assert Counter((r["doc_id"], r["item_id"]) for r in got.collect()) == want and len(want) > 3
    dirty = {d for d, _ in want}
    assert decontaminate.drop_contaminated(docs, frame).count() == sum(d not in dirty for d, _ in rows)


def test_pii(spark):
    texts = [None, "", "mail a.b@c.example.com, +1 (555) 123-4567 and 4111 1111 1111 1111", "x@y@z.com 1.2.3.4.5.6.7.8 300.1.1.1 é 10.0.0.1",
             "call (555) 123-4567 or write joe(at)host(dot)com", "1234567890123456 is no card"]
    out = {r["doc_id"]: r for r in pii.digest(pii.find(_docs(spark, texts, 100))).collect()}
    assert out[102]["spans"].startswith("email:5:22,phone:24:41") and out[102]["n_card"] == 1
    assert (out[103]["n_email"], out[103]["n_ip"]) == (1, 3)
    assert out[100]["spans"] == "" and out[100]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert out[105]["n_card"] == 0


def test_label_model_finds_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    chance = np.array([0.95, 0.9, 0.85, 0.55, 0.9])
    votes = np.where(rng.random((4000, 5)) < chance, np.where(truth, 2, 1)[:, None], np.where(truth, 1, 2)[:, None])
    votes[rng.random((4000, 5)) < 0.2] = 0
    codes = (votes * 3 ** np.arange(5)).sum(1)
    post = pii.label_model(dict(Counter(codes.tolist())))
    assert np.mean([(post[c] > 0.5) == t for c, t in zip(codes.tolist(), truth)]) > 0.95


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for k in range(400):
        words = list(rng.choice(WORDS, 30))
        bad = k % 4 == 0
        if bad:
            words[rng.integers(30)] = ["idiot", "1d1ot!!", "іdiоt", "IDIOT"][k // 4 % 4]
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    labels += [(None, 1), (401, None)]
    docs = spark.createDataFrame(rows + [(500, None), (501, ""), (502, "idiot")], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model, "doc_id").collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert held and all((got[k] >= 0.5) == (k % 4 == 0) for k in held)
    assert got[500] == got[501] < 0.5 < got[502] <= 1
    clown = toxicity.Model({"clown": 3.0})
    assert clown.density("a clown fish") == 0 < clown.density("a cl0wn")


def test_sharding(docs, rows):
    out = sharding.assign(docs, 3).collect()
    assert len(out) == len(rows)
    shards = defaultdict(list)
    by_text = defaultdict(set)
    for r in out:
        shards[r["shard"]].append(r)
        by_text[r["text_crc32"]].add(r["shard"])
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in shards.values())
    assert all(len(v) == 1 for v in by_text.values())
    sizes = Counter()
    for _, t in rows:
        t = (t or "").encode()
        sizes[int(hashlib.sha256(t).hexdigest()[:15], 16)] += len(t) + 8
    best = sharding.smallest_capacity(np.array([sizes[k] for k in sorted(sizes)]), 3)
    assert max(sum(r["size"] for r in v) for v in shards.values()) == best


def test_wavelet(docs, rows):
    files = wavelet.write_shards(docs, shard_ids=500)
    got = wavelet.read_documents(files).collect()
    assert len({(r["part"], r["shard"]) for r in files.collect()}) == files.count() > 1
    got.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in got] == np.cumsum([0, *[len(r["ids"]) for r in got[:-1]]]).tolist()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((d, tuple(_ids(t) + [1])) for d, t in rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=120))
def test_wavelet_ranks(values):
    a = np.array(values, dtype="<u2")
    shard = wavelet.WaveletShard(wavelet.build(a, [len(a)], 9))
    assert shard.ids().tolist() == values
    for v in {*values[:5], 7}:
        at = [i for i, x in enumerate(values) if x == v]
        assert shard.positions(v) == at and shard.count(v) == len(at) and shard.select(v, len(at)) == -1
        assert shard.rank(v, len(values) // 2) == sum(i < len(values) // 2 for i in at)
    assert [shard.access(i) for i in range(len(values))] == values


def test_multi_index(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16)).astype("f4")
    x[100:300] = x[100]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    odd = [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [1.0] * 3, 0), (None, [1.0] * 16, 0), (1080, [None] * 16, 0)]
    got = defaultdict(list)
    for r in multi_index.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int"), centroids=8).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x = x.astype(float)
    hits = []
    assert sorted(got) == list(range(0, 600, 20))
    for q, found in got.items():
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        best = np.lexsort([np.arange(600), -score])[:20].tolist()
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert all(abs(score[v] - s) < 1e-9 for _, v, s in found)
        hits.append(len({v for _, v, _ in found} & set(best)) / 20)
    assert np.mean(hits) >= 0.9


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(9)
    rows = [(k, " ".join(rng.choice([f"v{i}" for i in range(400)], 60)) + (" idiot" if k % 10 == 0 else "")) for k in range(200)]
    item = " ".join(rng.choice([f"v{i}" for i in range(400)], 20))
    rows += [(300, rows[3][1]), (301, rows[4][1] + "\nshort tail of five words"), (302, f"clean head {item} tail"), (303, None)]
    spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in out}
    twins = [len({3, 300} & kept), len({4, 301} & kept)]
    assert twins[0] == 1 and kept - {3, 300, 4, 301, 303} == {k for k in range(200) if k % 10 and k not in (3, 4)}
