"""Merkle manifest, source divergence and licence scan against brute force, on odd rows: nulls,
empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alleleflow.llm import catalog, divergence, licences, manifest
from alleleflow.llm.shared import table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos long, term string, hits int, digest int"


def _table(spark, rows):
    return table(spark.createDataFrame([(*r, "x", 5, "t", 1, 2) for r in rows], COLUMNS), "docs")


@pytest.fixture(scope="module")
def none(spark):
    return _table(spark, [])


def _odd_rows(n, seed, words=("alpha", "Beta", "gamma\n", "délta", "straße", "a1b", "_", "\n", "x" * 3000)):
    rng = np.random.default_rng(seed)
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (1, "\n", None, "s", None), (1, "\n", None, "s", None)]
    for k in range(n):
        text = " ".join(rng.choice(words, rng.integers(0, 30)))
        source = [None, "", "big", "big", "big", "big", "tiny", "ü", "z:1"][rng.integers(0, 9)]
        rows.append((int(k), text, ["en", "de", None][rng.integers(0, 3)], source, len(text)))
    return rows + rows[-2:]


# ------------------------------------------------------------------ manifest

def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_hash(*levels[-1][k:k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def _sides(levels, at):
    for level in levels[:-1]:
        first = at // 3 * 3
        yield level[first:at], level[at + 1:first + 3]
        at //= 3


def _brute_audit(rows):
    def leaf(r, text):
        return _hash(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], text)])

    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(((r[0] is not None, r[0] or 0), leaf(r, r[1]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: x[:2])
    trees = {s: _tree([x[1] for x in by[s]]) for s in sources}
    top = _tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (_, own, r) in enumerate(by[s]):
            sides = [*_sides(trees[s], at), *_sides(top, k)]
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf(r, text)
            for left, right in sides:
                now = _hash(*left, now, *right)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], _hash(*[x for a, b in sides for x in a + b]), now, now == top[-1][0]))
    return out


def test_manifest_equals_brute_force(spark):
    rows = _odd_rows(160, 1)
    got = [tuple(r) for r in manifest.audit(_table(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(_brute_audit(rows), key=repr)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("depth", [1, 2])
def test_manifest_of_several_layers(spark, depth):
    rows = [(k, f"t{k}\n", "en", "one" if k % 9 else f"s{k}", 1) for k in range(70)]
    got = [tuple(r) for r in manifest.audit(_table(spark, rows), depth).collect()]
    assert sorted(got, key=repr) == sorted(_brute_audit(rows), key=repr)


def test_manifest_of_one_row_and_of_none(spark, none):
    rows = [(4, "a\nb", None, None, None)]
    assert [tuple(r) for r in manifest.audit(_table(spark, rows)).collect()] == _brute_audit(rows)
    assert manifest.audit(none).collect() == []


def test_states_resume_like_hashlib():
    rng = np.random.default_rng(5)
    leaves = rng.integers(0, 256, (100, 32)).astype("u1")
    root, body = manifest.build_block(leaves, 5)
    assert root.hex() == _tree([x.tobytes().hex() for x in leaves])[-1][0]
    steps = manifest.block_steps(body, 100, 5, np.arange(100))
    # a state before a slot is all that the children on its left leave behind
    now = leaves.copy()
    for level in range(5):
        now = manifest.resume(now, steps[:, level])
    assert {x.tobytes() for x in now} == {root}
    steps["others"][:, :, :32] *= (steps["slot"] == 0)[:, :, None]      # what lies on the left is never read
    now = leaves.copy()
    for level in range(5):
        step = steps[:, level]
        step["others"][step["slot"] == 2] = 0
        now = manifest.resume(now, step)
    assert {x.tobytes() for x in now} == {root}


# ------------------------------------------------------------------ divergence

def _brute_divergence(rows, least, top):
    docs = [(r[2] or "", r[3] or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")]) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t in seen if seen[t] >= least)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        every = p(sum(counts.values(), Counter()))
        per = {s: p(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(-sum(abs(per[s][t] - per[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-(per[s][t] - every[t]), t.encode(), t) for t in kept if counts[s][t] and per[s][t] > every[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, x[2], -x[0], k) for k, x in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize("least,top,slots,chunk", [(30, 50, 256, 64), (2, 3, 256, 64), (2, 50, 64, 2)])
def test_divergence_equals_brute_force(spark, least, top, slots, chunk):
    rng = np.random.default_rng(7)
    rows = _odd_rows(300, 2)
    rows += [(k, " ".join(f"w{'abcdefghij'[x % 10]}{'abcdefghijklmnopqrstuvwxyz'[x // 10]}" for x in rng.geometric(0.02, 40) % 260), "fr", f"src{k % 5}", 1) for k in range(200)]
    rows += [(9, "lonely words", "xx", "only", 1), (9, None, "xx", "mute", 1)]
    got = [tuple(r) for r in divergence.divergence(_table(spark, rows), least, top, slots, chunk).collect()]
    assert sorted(got) == _brute_divergence(rows, least, top)


def test_divergence_of_nothing(spark, none):
    assert divergence.divergence(none).collect() == []


def test_counts_flushed_early_are_the_same(spark):
    rows = _table(spark, _odd_rows(80, 3))
    assert sorted(map(tuple, divergence.term_counts(rows, limit=3).collect()), key=repr) == sorted(map(tuple, divergence.term_counts(rows).collect()), key=repr)


def test_frequencies_beyond_64_bits(spark):
    n, total, v = 9_000_000_000_000, 9_100_000_000_000, 12_345
    got = spark.range(1).select(divergence.frequency(f"{n}L", f"{total}L", f"{v}L")).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 5) // (total + 5 * v)


# ------------------------------------------------------------------ licences

def _brute_base(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(k, label) for phrase, label in licences.BASE.items() for k in range(len(words))
              if words[k:k + len(phrase.split())] == phrase.split()]
    return (len(words), len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None),
            ",".join(sorted({p[1] for p in places})))


LICENCE_TEXTS = [
    None, "", " ", "license", "MIT License", "the MIT license, MIT-License\nmit license.", "GNU\nGeneral   Public License v3", "cc by", "CC BY-NC 4.0", "CC-BY",
    "mit licenses", "smit license", "apache license apache license mit license cc by by cc by", "É mit license ß 42 cc_by", "SPDX-License-Identifier: MIT",
    "// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) OR Apache-2.0 */\nx", "SPDX-License-Identifier:", "SPDX-License-Identifier: OR\nMIT",
    "License-Expression: BSD-3-Clause AND AGPL-3.0-or-later", "gnu lesser general public license", "mit license " * 4000, "word " * 50_000 + "apache license"]


def test_licences_equal_brute_force(spark):
    rows = [(k, t, None, "s", None) for k, t in enumerate(LICENCE_TEXTS)]
    rows += rows[-3:]
    got = licences.digest(licences.scan(_table(spark, rows), "doc_id")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = _brute_base(LICENCE_TEXTS[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    by = {r["doc_id"]: r for r in got}
    assert by[14]["labels"] == "mit" and by[14]["free"] is True
    assert by[15]["labels"] == "apache,classpath-exception-2.0,gpl" and by[15]["free"] is True
    assert by[18]["labels"] == "agpl,bsd" and by[18]["free"] is False
    assert by[16]["labels"] == by[17]["labels"] == "" and by[8]["labels"] == "cc-by,cc-by-nc"


def test_licences_of_nothing(none):
    assert licences.digest(licences.scan(none, "doc_id")).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["mit", "License", "cc", "BY", "gnu", "general", "public", "apache", "-", "\n", "é", "1", ", "]), max_size=40), st.sampled_from([" ", "_", ""]))
def test_base_phrases_on_arbitrary_texts(parts, between):
    text = between.join(parts)
    n, hits, _ = licences.find(text)
    base = [h for h in hits if h[1] == "base"]
    assert (n, len(base), min((h[2] for h in base), default=None), max((h[2] for h in base), default=None),
            ",".join(sorted({h[0] for h in base}))) == _brute_base(text)


_NAMES = st.sampled_from(["MIT", "GPL-3.0-only", "Apache-2.0", "Foo-1.0"])
_TREES = st.recursive(_NAMES, lambda x: st.tuples(st.sampled_from(["and", "or"]), x, x), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(_TREES)
def test_expressions_evaluate_like_their_trees(tree):
    def text(t):
        return t if isinstance(t, str) else f"({text(t[1])} {t[0].upper()} {text(t[2])})"

    def value(t):
        if isinstance(t, str):
            return {licences.family(t)}, licences.FAMILIES.get(licences.family(t), False)
        (a, x), (b, y) = value(t[1]), value(t[2])
        return a | b, (x or y) if t[0] == "or" else (x and y)

    assert licences.evaluate(licences.to_postfix(text(tree))) == value(tree)


def test_precedence_and_broken_expressions():
    def post(e):
        return " ".join(licences.to_postfix(e))
    assert post("a OR b AND c WITH d OR e") == "a b c d with and or e or"
    assert post("(a OR b) AND c") == "a b or c and"
    assert [post(e) for e in ("MIT OR", "MIT OR (", "(MIT", "MIT) x", "MIT AND (ISC OR", "MIT */ x", "MIT MIT")] == ["MIT"] * 4 + ["MIT ISC and", "MIT", "MIT"]
    assert [post(e) for e in ("", "OR MIT", "()", "(")] == [""] * 4


# ------------------------------------------------------------------ SQL

@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql_of_odd_rows(spark, tmp_path, name):
    """The registered query and its SQL agree on a table with nulls, ties and repeated rows."""
    import compare
    rows = _odd_rows(120, 11)
    _table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    cur = con.execute(catalog.ORACLES[name])
    want = compare.normal([d[0] for d in cur.description], cur.fetchall())
    assert compare.normal(df.columns, [tuple(r) for r in df.collect()]) == want
