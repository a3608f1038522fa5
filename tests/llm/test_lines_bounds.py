"""Bounds, similarities and recall behind the line dedup."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from alleleflow.llm import lines

LINE = st.text(st.sampled_from("abcde é中"), min_size=7, max_size=120)


def cut(t):
    return {t[k:k + 7] for k in range(len(t) - 6)}


@settings(max_examples=80, deadline=None)
@given(st.lists(LINE, min_size=2, max_size=6))
def test_odd_maps_never_exceed_the_difference(texts):
    shingles = lines.distinct_shingles(texts, 7)
    maps = lines.odd_maps(shingles, len(texts)).view(np.uint64)
    assert lines.sizes(shingles, len(texts)).tolist() == [len(cut(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert int(np.bitwise_count(maps[i] ^ maps[j]).sum()) <= len(cut(a) ^ cut(b))


def test_odd_maps_in_parts():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(2300)]
    whole = lines.odd_maps(lines.distinct_shingles(texts, 7), len(texts))
    for k in (0, 999, 1000, 2299):
        assert (whole[k] == lines.odd_maps(lines.distinct_shingles([texts[k]], 7), 1)[0]).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(LINE, LINE), min_size=1, max_size=6), st.booleans())
def test_jaccards(pairs, akin):
    if akin:
        pairs = [(a, a[:-3] + b[:3] + a[-3:]) for a, b in pairs]
    a, b = zip(*pairs)
    want = [len(cut(x) & cut(y)) / len(cut(x) | cut(y)) for x, y in pairs]
    assert np.allclose(lines.jaccards(list(a), list(b), 7, 0.8), want)


def test_recall_at_the_registered_bands():
    """Pairs at 0.80 to 0.85 share one of 8 bands of 3 in at least 99 of 100 cases."""
    rng = random.Random(8)
    pairs = []
    while len(pairs) < 2000:
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(150))
        b = list(a)
        for k in rng.sample(range(len(b)), rng.choice((2, 3))):
            b[k] = "#"
        b = "".join(b)
        if 0.8 <= len(cut(a) & cut(b)) / len(cut(a) | cut(b)) <= 0.85:
            pairs.append((a, b))
    a, b = zip(*pairs)
    met = (lines.band_keys(list(a), 7, 8, 3) == lines.band_keys(list(b), 7, 8, 3)).any(axis=1)
    assert met.mean() >= 0.99


def test_only_shared_bands_are_kept():
    """Bands of one line, however often it is there, are dropped; all rows of the others stay."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    band, line = rng.integers(0, 300, 400) - 150, rng.integers(-3, 3, 400) << 60
    parts = [pa.RecordBatch.from_arrays([pa.array(band[a:a + 130]), pa.array(line[a:a + 130])], names=["band", "line"]) for a in range(0, 400, 130)]
    got = [tuple(r.values()) for b in lines._shared_bands([parts[0].slice(0, 0), *parts]) for r in b.to_pylist()]
    want = [(b, x) for b, x in zip(band.tolist(), line.tolist()) if len(set(line[band == b].tolist())) > 1]
    assert sorted(got) == sorted(want) and want and list(lines._shared_bands([])) == []


def test_each_line_has_its_first_place_once(spark):
    """One row per line, however many tasks hold it, with the number of these tasks."""
    texts = ["a common line\nx", "b common line\na common line", None, "a common line\nx\nx"]
    docs = lines.table(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4), "docs")
    places, _ = lines.similar_lines(docs)
    got = {r["line"]: r for r in places.collect()}
    assert places.count() == len(got) == 3
    assert sorted(got) == sorted(map(lines._line_hash, ["a common line", "b common line", "x"]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 0x10FFFF), min_size=12, max_size=40), st.integers(1, 12))
def test_polynomials(points, width):
    base, got = int(lines._BASE), lines._polynomials(np.array(points, dtype=np.uint64), width)
    want = [sum(p * base ** (width - 1 - i) for i, p in enumerate(points[k:k + width])) % (1 << 64) for k in range(len(points) - width + 1)]
    assert got.tolist() == want


def test_bands_in_blocks():
    """Blocks hold each own band once, in the block of its bin, and give the shared bands of the plain rows."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    own = [rng.integers(-2000, 2000, rng.integers(0, 9)).astype("<i8") for _ in range(700)]
    line = rng.integers(-1 << 62, 1 << 62, len(own))
    rows = sorted((b, x) for bands, x in zip(own, line.tolist()) for b in bands.tolist())
    parts = [pa.RecordBatch.from_arrays([pa.array(line[a:a + 300]), pa.array([b.tobytes() for b in own[a:a + 300]], pa.binary())], names=["line", "own"])
             for a in range(0, len(own), 300)]
    blocks = list(lines._in_blocks([parts[0].slice(0, 0), *parts]))
    assert sum(b.num_rows for b in blocks) < len(rows)
    got = []
    for b in blocks:
        for kind, data in zip(b.column("bin").to_pylist(), b.column("block").to_pylist()):
            pairs = np.frombuffer(data, "<i8").reshape(-1, 2)
            assert set((pairs[:, 0] & (lines._BINS - 1)).tolist()) == {kind}
            got += map(tuple, pairs.tolist())
    assert sorted(got) == rows
    times = {}
    for b, x in rows:
        times.setdefault(b, set()).add(x)
    shared = [tuple(r.values()) for b in lines._shared_bands_of_blocks(blocks) for r in b.to_pylist()]
    assert sorted(shared) == [r for r in rows if len(times[r[0]]) > 1] and shared


def test_bands_leave_the_first_pass_in_bytes(spark):
    """Each banded line comes with its eight bands, as own ones or as links to the task's first line."""
    docs = lines.table(spark.createDataFrame([(k, t) for k, t in enumerate(["a common line\nshort\nx", None, "a common line!\n\nx"])], "doc_id long, text string").coalesce(1), "docs")
    got = {r["line"]: r for r in lines.lines_of_tasks(docs, 7, 8, 3).collect()}
    assert sorted(got) == sorted(map(lines._line_hash, ["a common line", "a common line!", "short", "x"]))
    a, b = (got[lines._line_hash(t)] for t in ("a common line", "a common line!"))
    keys = lines.band_keys(["a common line", "a common line!"], 7, 8, 3)
    assert np.frombuffer(a["own"], "<i8").tolist() == keys[0].tolist() and not a["met"]
    assert sorted([*np.frombuffer(b["own"], "<i8").tolist(), *b["met"]]) == sorted(keys[1].tolist())
    assert b["met"] and set(b["met_firsts"]) == {a["line"]} and len(got[lines._line_hash("short")]["own"]) == 0
