"""Toxicity by a weighted lexicon and Aho-Corasick.

Texts are folded (look-alike letters of other scripts, digit and sign substitutions, case), words
are set apart by blanks, and one automaton finds all lexicon entries at word beginnings. The
weights of the hits that lie outside exception phrases are summed and divided by the root of the
number of words; a logistic curve turns that into a score. Lexicon and curve are learned from
labelled rows: at most `sample` of them, the bound of the fit. The exception phrases are given
(`Model.exceptions`), and entries have four to eight letters."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleleflow.llm.shared import free_name, in_slices, own_cache, table, text_or_empty

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
_LOOKALIKE = {
    "аᴀα": "a", "ьв": "b", "сϲ": "c", "ԁ": "d", "еёε": "e", "һ": "h", "іїιӏ": "i", "ј": "j", "кκ": "k",
    "ⅼ": "l", "мⅿ": "m", "пη": "n", "оοσ": "o", "рρ": "p", "ԛ": "q", "ѕ": "s", "тτ": "t", "υս": "u",
    "νѵ": "v", "ѡω": "w", "хχ": "x", "уγ": "y",
    "@4": "a", "3": "e", "1": "i", "0": "o", "5$": "s", "7": "t",
}
_FOLD = {ord(c): to for many, to in _LOOKALIKE.items() for c in many}
_FOLD |= {0xFF41 + k: chr(97 + k) for k in range(26)}               # full-width letters
_FOLD |= {ord(c): " " for c in "!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~2689\t\n\r\x0b\x0c¡¿«»“”„’‘…–— "}
_FOLD |= {ord(c): None for c in "​‌‍⁠﻿­"}
#: Phrases in which an entry means no harm.
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bin", "trash bag", "stupid question")
_LENGTHS = (4, 5, 6, 7, 8)
_TASK_COUNTS = 30_000       # remembered in a task; beyond, rows repeat


def fold(text: str) -> str:
    return " " + text.lower().translate(_FOLD) + " "


@dataclass
class Model:
    """Word beginnings with weights, exception phrases, and the logistic curve."""
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    offset: float = 0.0
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for word, weight in self.weights.items():
                made.add_word(" " + word, (len(word), weight))
            for phrase in self.exceptions:
                made.add_word(" " + phrase, (len(phrase), None))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def density(self, text: str | None) -> float:
        """Weight of the hits over the root of the number of words. At one word, the heaviest of
        nested entries counts; a hit that begins inside an exception phrase does not."""
        folded = fold(text or "")
        if not self.weights:
            return 0.0
        hits: dict[int, float] = {}
        began, ended = [], []          # stretches of exception phrases, in order, apart
        for end, (n, weight) in self.automaton().iter(folded):
            start = end - n + 1
            if weight is None:
                while began and start <= ended[-1]:
                    start = min(start, began.pop())
                    ended.pop()
                began.append(start)
                ended.append(end)
            else:
                hits[start] = max(hits.get(start, weight), weight)
        total = 0.0
        for at, w in hits.items():
            k = bisect_right(began, at) - 1
            if k < 0 or at > ended[k]:
                total += w
        return total / math.sqrt(len(folded.split())) if total else 0.0

    def score(self, text: str | None) -> float:
        x = self.slope * self.density(text) + self.offset
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, folds: int = 5) -> DataFrame:
    """text, toxic of at most `sample` labelled documents whose crc32(doc_id) mod `folds` is not 0,
    drawn by hash. Null ids and labels take no part. Of the rows of one id the least text
    counts, so that repeated rows do not pass the bound."""
    known = (labels.where("doc_id is not null and toxic is not null")
             .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    found = docs.select("doc_id", text_or_empty()).join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def _beginnings(rows: DataFrame) -> DataFrame:
    """beginning, before (the word before it), toxic, documents: counts per task."""
    def run(batches):
        own_cache("toxicity")
        seen: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = fold(text).split()
                found = {}
                for before, word in zip(["", *words], words):
                    for n in _LENGTHS:
                        if len(word) >= n:
                            found.setdefault(word[:n], before)
                seen.update((b, before, int(toxic > 0)) for b, before in found.items())
                if len(seen) > _TASK_COUNTS:
                    yield from flush(seen)
        yield from flush(seen)

    def flush(seen):
        if seen:
            keys, n = list(seen), list(seen.values())
            seen.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys], pa.int32()), pa.array(n, pa.int64())],
                names=["beginning", "before", "toxic", "n"])

    return rows.mapInArrow(run, "beginning string, before string, toxic int, n long")


def learn(docs: DataFrame, labels: DataFrame, sample: int = 12_000, support: int = 5, ratio: float = 2.5,
          entries: int = 5000) -> Model:
    """Fit on at most `sample` labelled rows. An entry needs `support` toxic rows in which
    different words stand before it, so that copies of a document do not make entries, and a log
    ratio of its frequencies of at least `ratio`. Of nested entries the shortest stays, unless a
    longer one is found as often. At most `entries` with the largest counts are kept."""
    rows = table(training_rows(docs, labels, sample), "training")
    n = {0: 0, 1: 0}
    for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("t")).count().collect():
        n[r["t"]] = r["count"]
    if not n[0] or not n[1]:
        return Model({}, offset=4.0 if n[1] else -4.0)
    bad = F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)
    per = (_beginnings(rows).groupBy("beginning", "before").agg(F.sum(bad).alias("bad"), F.sum(F.col("n") - bad).alias("good"))
           .groupBy("beginning").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum((F.col("bad") > 0).cast("int")).alias("places")))
    log = F.log((F.col("bad") + 0.5) / (n[1] + 1)) - F.log((F.col("good") + 0.5) / (n[0] + 1))
    found = (per.where(F.col("places") >= support).withColumn("weight", log).where(F.col("weight") >= ratio)
             .orderBy(F.desc("bad"), F.desc(F.length("beginning")), "beginning").limit(entries).collect())
    count = {r["beginning"]: r["bad"] for r in found}
    as_often = {b[:m] for b in count for m in _LENGTHS if m < len(b) and count[b] >= 0.95 * count.get(b[:m], 1 << 60)}
    kept = {r["beginning"]: r["weight"] for r in found if r["beginning"] not in as_often}
    kept = {b: w for b, w in kept.items() if not any(b[:m] in kept for m in _LENGTHS if m < len(b))}
    model = Model(kept)
    densities = rows.mapInArrow(_densities(model), "density double, toxic int").collect()
    x = np.array([r["density"] for r in densities])
    y = np.array([r["toxic"] for r in densities], dtype=float)
    model.slope, model.offset = _logistic(x, y)
    return model


def _densities(model: Model):
    def run(batch):
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.density(t) for t in batch.column("text").to_pylist()], pa.float64()),
             pa.array([int(t > 0) for t in batch.column("toxic").to_pylist()], pa.int32())], names=["density", "toxic"])
    return in_slices(run)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> tuple[float, float]:
    """Newton steps for slope and offset, with a small penalty on the slope."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    w, ridge = np.zeros(2), np.diag([penalty, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + ridge @ w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def scores(docs: DataFrame, model: Model, *columns: str, name: str = "score") -> DataFrame:
    """`columns` of `docs` and a score named `name`, 0 to 1; a passed column of that name is replaced. Null and
    empty texts have no hits. Repeated rows each have a row; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in columns if c.lower() != name.lower()]
    own = free_name("_text", columns)
    text = "text" if "text" in columns else own      # sent to Python once

    def run(batch):
        own_cache("toxicity")
        got = [shared.value.score(t) for t in batch.column(text).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(got, pa.float64())], names=[*columns, name])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns] + [f"`{name}` double"])
    given = docs.select(*columns) if text == "text" else docs.select(*columns, text_or_empty().alias(own))
    return given.mapInArrow(in_slices(run, text), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows whose score reaches `threshold`, all columns kept. Null and empty texts
    have the score of a text without hits; repeated rows stay or go together; an empty table gives
    an empty one."""
    name = free_name("_score", docs.columns)
    scored = scores(docs, learn(docs, labels), *docs.columns, name=name)
    return scored.where(F.col(name) < threshold).drop(name)
