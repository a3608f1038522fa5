"""Clashing column names, repeated and long rows, and caches of the text operators."""

import time

import pytest

from alleleflow.llm import lines, shared, similar, toxicity

CLASHING = "doc_id long, text string, _text string, _score double, score double, _row long, _packed string, _null int, _kept string, n_lines int"


@pytest.fixture(scope="module")
def clashing(spark):
    texts = [None, "", "an idiot stands here\nand goes", "a quiet line of some words\nanother line of words", "a quiet line of some words\nthird"]
    return shared.table(spark.createDataFrame([(k, t, "x", 1.5, 2.5, 7, "p", 3, "k", 4) for k, t in enumerate(texts)], CLASHING), "clashing")


def test_clashing_names(spark, clashing):
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(clashing, labels)
    assert kept.columns == clashing.columns and {(r["_text"], r["_score"]) for r in kept.collect()} == {("x", 1.5)}
    scored = toxicity.scores(clashing, toxicity.Model({"idiot": 3.0}, offset=-1.0), "doc_id", "score", "_text")
    assert sorted(scored.columns) == ["_text", "doc_id", "score"]
    assert {r["doc_id"]: r["score"] > 0.5 for r in scored.collect()} == {0: False, 1: False, 2: True, 3: False, 4: False}
    cleaned = {r["doc_id"]: r for r in lines.remove_similar_lines(clashing).collect()}
    assert cleaned[4]["text"] == "third" and cleaned[0]["text"] is None
    assert {(r["_row"], r["_packed"], r["_null"], r["_kept"]) for r in cleaned.values()} == {(7, "p", 3, "k")}
    rows = similar.drop_near_duplicates(clashing).collect()
    assert {r["_row"] for r in rows} == {7} and len(rows) == 4        # null and empty texts are equal


def test_scores_of_a_table_without_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string")
    assert toxicity.scores(rows, toxicity.Model({"idiot": 3.0}), "doc_id", "text").count() == 2


def test_training_rows_of_repeated_documents(spark):
    docs = spark.createDataFrame([(3, f"text {k}") for k in range(50)], "doc_id long, text string")
    got = toxicity.training_rows(docs, spark.createDataFrame([(3, 1), (3, 1)], "doc_id long, toxic int"), 10, folds=1 << 30)
    assert [tuple(r) for r in got.collect()] == [("text 0", 1)]


def test_density_of_a_long_text_is_linear():
    model = toxicity.Model({"clown": 3.0}, ("clown fish", "fish clown"))
    assert model.density("clown fish clown") == 0 and model.density("a clown, clown fish") == pytest.approx(3 / 2)
    begin = time.perf_counter()
    assert model.density("clown clown fish x " * 40_000) == pytest.approx(3 * 40_000 / 400)
    assert time.perf_counter() - begin < 5


def test_one_cache_owner_at_a_time():
    a, b = {1: 1}, {2: 2}
    shared.own_cache("a", a.clear)
    shared.own_cache("a", a.clear)
    assert a
    shared.own_cache("b", b.clear)
    assert not a and b
    shared.own_cache("c")
    assert not b
