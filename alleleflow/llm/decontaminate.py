"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are parted by their number of shingles into classes, each up to twice as large as the one
before. For a class whose largest item has s shingles, a document is covered by windows of 2s
shingles, s apart, so that every run of s shingles lies inside one window and the Jaccard
similarity of item and window stays high however long the document is. An item is a candidate where
a window shares at least one of its MinHash minima. The candidate is then verified by the exact
number of its shingles that the whole document holds.

Items are taken in blocks of at most `block` rows, which every task reads; documents are neither
shuffled nor cut."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleleflow.llm.shared import in_slices, own_cache, table, text_or_empty

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CACHED_WORDS = 500_000


class _WordHash(dict):
    def __missing__(self, word):
        from xxhash import xxh3_64_intdigest

        value = self[word] = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
        return value


_hashes = _WordHash()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str, width: int) -> np.ndarray:
    """64-bit hashes of the runs of `width` words, in order (lower-cased, letters and digits)."""
    words = _WORD.findall(text.lower())
    if len(words) < width:
        return np.zeros(0, dtype=np.uint64)
    if len(_hashes) > _CACHED_WORDS:
        _hashes.clear()
    if not _hashes:
        own_cache("decontaminate", _hashes.clear)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out = out * _BASE + h[k:k + n]
    return _mix(out)


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20)
    return draw.integers(1, 1 << 32, count, dtype=np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, count, dtype=np.uint32)


class ItemIndex:
    """MinHash minima of a block of items by size class, and their exact shingles."""

    def __init__(self, items: list[tuple], width: int, functions: int):
        self.multiply, self.add = _functions(functions)
        self.sets, self.minima = {}, {}
        by_class = defaultdict(list)
        for item_id, text in items:
            if len(own := np.unique(shingles(text or "", width))):
                k = len(self.sets)
                self.sets[k] = (item_id, own)
                by_class[int(len(own) - 1).bit_length()].append(k)
        for size, members in by_class.items():
            keys, owners = [], []
            for k in members:
                low = (self.sets[k][1] >> np.uint64(32)).astype(np.uint32)
                for f in range(functions):
                    keys.append(f << 32 | int((low * self.multiply[f] + self.add[f]).min()))
                    owners.append(k)
            order = np.argsort(np.array(keys, dtype=np.uint64), kind="stable")
            keys = np.array(keys, dtype=np.uint64)[order]
            # which leading bits occur per function: most windows end at this table
            bits = min(32, max(12, len(members).bit_length() + 7))
            leading = np.zeros((functions, 1 << bits), dtype=bool)
            leading[(keys >> np.uint64(32)).astype(np.int64), (keys.astype(np.uint32) >> np.uint32(32 - bits)).astype(np.int64)] = True
            self.minima[size] = keys, np.array(owners)[order], leading, np.uint32(32 - bits)

    def candidates(self, docs: list[np.ndarray]) -> list[set[int]]:
        """Of each document, the items that share a minimum with one of its windows."""
        found: list[set[int]] = [set() for _ in docs]
        sizes = sorted(self.minima)
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        if not sizes or not lengths.sum():
            return found
        low = (np.concatenate(docs) >> np.uint64(32)).astype(np.uint32)
        levels = []                     # per class: block starts, each block's document
        before, count = np.cumsum(lengths) - lengths, lengths
        for at, size in zip([0, *sizes], sizes):
            blocks = -(-count // (1 << (size - at)))
            owner = np.repeat(np.arange(len(docs)), blocks)
            first = np.cumsum(blocks) - blocks
            levels.append((before[owner] + (np.arange(len(owner)) - first[owner]) * (1 << (size - at)), owner))
            before, count = first, blocks
        for f in range(len(self.multiply)):
            least = low * self.multiply[f] + self.add[f]
            for size, (starts, owner) in zip(sizes, levels):
                least = np.minimum.reduceat(least, starts)
                window = least.copy()
                same = owner[1:] == owner[:-1]
                window[:-1][same] = np.minimum(least[:-1], least[1:])[same]
                keys, owners, leading, shift = self.minima[size]
                maybe = np.flatnonzero(leading[f][window >> shift])
                if not len(maybe):
                    continue
                want = window[maybe].astype(np.uint64) | np.uint64(f << 32)
                lo, hi = np.searchsorted(keys, want), np.searchsorted(keys, want, side="right")
                for k in np.flatnonzero(hi > lo):
                    found[owner[maybe[k]]].update(owners[lo[k]:hi[k]].tolist())
        return found

    def matches(self, texts: list[str | None], width: int, threshold: float) -> list[list[tuple]]:
        """Of each text, (item_id, shingles of the item, shared) of the items it contains."""
        docs, out = [shingles(t or "", width) for t in texts], []
        for doc, candidates in zip(docs, self.candidates(docs)):
            held, hits = np.unique(doc) if candidates else doc, []
            for k in sorted(candidates):
                item_id, own = self.sets[k]
                at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                shared = int((held[at] == own).sum())
                if shared >= threshold * len(own):
                    hits.append((item_id, len(own), shared))
            out.append(hits)
        return out


def _blocks(items: DataFrame, block: int):
    """Items in blocks of about `block` rows, each small enough for every task."""
    n = -(-items.count() // block)
    if n == 1:
        yield [tuple(r) for r in items.select("item_id", "text").collect()]
        return
    parts = table(items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("block")), "items")
    for k in range(n):
        yield [tuple(r) for r in parts.where(F.col("block") == k).select("item_id", "text").collect()]


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, functions: int = 64,
                    block: int = 1000) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds `threshold` or more of the item's distinct
    `width`-word shingles; n_shingles, n_shared and containment. Items of fewer words, null or
    empty ones match nothing; null texts match nothing. Repeated items or documents each give
    their rows. Extra columns are ignored."""
    spark = docs.sparkSession
    kind, doc_kind = (df.schema[c].dataType.simpleString() for df, c in ((items, "item_id"), (docs, "doc_id")))
    schema = f"doc_id {doc_kind}, item_id {kind}, n_shingles long, n_shared long, containment double"
    found = spark.createDataFrame([], schema)
    for rows in _blocks(items, block):
        index = spark.sparkContext.broadcast(ItemIndex(rows, width, functions))

        def run(batch, index=index):
            hits = index.value.matches(batch.column("text").to_pylist(), width, threshold)
            out = [(d, *m) for d, own in zip(batch.column("doc_id").to_pylist(), hits) for m in own]
            if out:
                ids, names, n, shared = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.column("doc_id").type), pa.array(names), pa.array(n, pa.int64()), pa.array(shared, pa.int64()),
                     pa.array([s / k for s, k in zip(shared, n)], pa.float64())],
                    names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        found = found.unionByName(docs.select("doc_id", text_or_empty()).mapInArrow(in_slices(run), schema))
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, functions: int = 64,
                      block: int = 1000) -> DataFrame:
    """`docs` without the rows that hold an item; all columns, in the same partitions."""
    for rows in _blocks(items, block):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(rows, width, functions))

        def run(batch, index=index):
            yield batch.filter(pa.array([not m for m in index.value.matches(batch.column("text").to_pylist(), width, threshold)], pa.bool_()))

        docs = docs.mapInArrow(in_slices(run), docs.schema)
    return docs
