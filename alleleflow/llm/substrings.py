"""Repeated word spans by compaction of a de Bruijn graph.

A window of `window` words is an edge of the graph. Edges are dealt into buckets by their
minimizer, the least hash among their short word runs: equal edges have equal minimizers, and the
edges of one stretch of text that share a minimizer form a path, which travels as one row with the
digest of its words. A path whose bucket holds nothing else is unique and goes. A bucket whose rows
all hold the same path has no branches: the path is compacted into one row, which a join hands to
every place where it occurs. Only branching buckets are unfolded into single edges, which are
counted by the 128-bit digest of the words at their source coordinates, and joined back likewise.
Spans are then united per document."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleleflow.llm.shared import in_slices, keyed, own_cache, packed_text, table, unpack

_RUN = 5               # words of a minimizer
_CACHED_WORDS = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word):
        from xxhash import xxh3_64_intdigest

        value = self[word] = xxh3_64_intdigest(word, 11)
        return value


_hashes = _WordHash()


def _minimizers(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimizer of each window, and the word where it first stands."""
    if len(_hashes) > _CACHED_WORDS:
        _hashes.clear()
    if not _hashes:
        own_cache("substrings", _hashes.clear)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    run = min(_RUN, window)
    n = len(h) - run + 1
    m = h[:n].copy()
    for k in range(1, run):
        m = m * _BASE + h[k:k + n]
    m = (m ^ (m >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    m ^= m >> np.uint64(29)
    at = np.arange(n, dtype=np.int32)
    left, width = window - run + 1, 1          # least of `left` runs by doubling
    while width < left:
        step = min(width, left - width)
        right = m[step:] < m[:len(m) - step]
        at = np.where(right, at[step:], at[:len(m) - step])
        m = np.minimum(m[step:], m[:len(m) - step])
        width += step
    return m, at


class Words:
    """A text's words between ASCII white space, joined by single spaces for digests."""

    def __init__(self, text: bytes):
        self.words = text.split()
        self.joined = b" ".join(self.words)
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1)
        self.first = [0, *ends.tolist()]

    def span(self, start: int, stop: int) -> bytes:
        return self.joined[self.first[start]:self.first[stop] - 1]


def paths(docs: DataFrame, window: int) -> DataFrame:
    """minimizer, digest, row, start, n: n windows from word `start` on share the minimizer, at
    one place; no two of them are equal, as it stands at another distance in each."""
    def run(batch):
        from xxhash import xxh3_64_intdigest

        out, rows = [[], [], [], []], []
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            doc = Words(text)
            if len(doc.words) < window:
                continue
            m, at = _minimizers(doc.words, window)
            starts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
            n = np.diff(np.append(starts, len(m)))
            view, first = memoryview(doc.joined), doc.first
            digest = [xxh3_64_intdigest(view[first[s]:first[s + k + window - 1] - 1]) for s, k in zip(starts.tolist(), n.tolist())]
            for column, values in zip(out, (m[starts], np.array(digest, np.uint64), starts.astype(np.int32), n.astype(np.int32))):
                column.append(values)
            rows.append(np.full(len(starts), row, dtype=np.int64))
        if rows:
            m, digest, starts, n = (np.concatenate(c) for c in out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(m.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(np.concatenate(rows)), pa.array(starts), pa.array(n)],
                names=["minimizer", "digest", "row", "start", "n"])

    return (keyed(docs, "text").where("text is not null")
            .mapInArrow(in_slices(run), "minimizer long, digest long, row long, start int, n int"))


def edges(docs: DataFrame, branching: DataFrame, window: int) -> DataFrame:
    """edge, row, start of every window in the `branching` paths (row, start, n)."""
    def run(batch):
        from xxhash import xxh3_128_digest

        edge, rows, starts = [], [], []
        for row, data, spans in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "spans"))):
            doc = Words(unpack(data))
            view, first = memoryview(doc.joined), doc.first
            for span in spans:
                for at in range(span["start"], span["start"] + span["n"]):
                    edge.append(xxh3_128_digest(view[first[at]:first[at + window] - 1]))
                    starts.append(at)
                rows.extend([row] * span["n"])
            if len(edge) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(edge, pa.binary()), pa.array(rows, pa.int64()), pa.array(starts, pa.int32())], names=["edge", "row", "start"])
                edge, rows, starts = [], [], []
        if edge:
            yield pa.RecordBatch.from_arrays([pa.array(edge, pa.binary()), pa.array(rows, pa.int64()), pa.array(starts, pa.int32())], names=["edge", "row", "start"])

    by_row = branching.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    texts = keyed(docs, "text").where("text is not null").select("row", packed_text())
    return texts.join(by_row, "row").mapInArrow(in_slices(run, limit=1 << 20), "edge binary, row long, start int")


def repeated_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """row (of `keyed`), start, n: windows start to start + n - 1 occur elsewhere, too. `docs` must
    be a stored table."""
    every = table(paths(docs, window), "every-path")
    buckets = table(every.groupBy("minimizer").agg(F.count("*").alias("places"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
                    .where("places > 1").select("minimizer", (F.col("lo") == F.col("hi")).alias("single")), "buckets")
    found = table(every.join(buckets, "minimizer").select("row", "start", "n", "single"), "paths")
    unfolded = table(edges(docs, found.where("not single"), window), "edges")
    repeated = table(unfolded.groupBy("edge").agg(F.count("*").alias("places")).where("places > 1").select("edge"), "repeated")
    return (found.where("single").select("row", "start", "n")
            .unionByName(unfolded.join(repeated, "edge").select("row", "start", F.lit(1).alias("n"))))


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Remove every word that a window covers whose words also start anywhere else in `docs`, the
    same document included. Windows are judged on the input. Returns per row doc_id, text (kept
    words joined by one space), n_words, n_removed. Null texts have no words. Words lie between
    ASCII white space and stay as they are. Extra columns are ignored; repeated rows count as
    other places; an empty table gives an empty one. `docs` must be a stored table."""
    by_row = repeated_spans(docs, window).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def run(batch):
        kept, total, gone = [], [], []
        for data, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words = unpack(data).split()
            change = np.zeros(len(words) + 1, dtype=np.int64)
            for s in spans or ():
                change[s["start"]] += 1
                change[s["start"] + s["n"] + window - 1] -= 1
            covered = np.cumsum(change)[:len(words)] > 0
            kept.append(b" ".join([words[k] for k in np.flatnonzero(~covered).tolist()]).decode("utf-8", "replace"))
            total.append(len(words))
            gone.append(int(covered.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
            names=["doc_id", "text", "n_words", "n_removed"])

    texts = keyed(docs, "doc_id", "text").select("row", "doc_id", packed_text())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (texts.join(by_row, "row", "left").select("doc_id", "text", "spans")
            .mapInArrow(in_slices(run, limit=1 << 20), f"doc_id {kind}, text string, n_words long, n_removed long"))
