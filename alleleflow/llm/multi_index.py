"""Approximate nearest neighbours by largest inner product: an inverted multi-index.

Both halves of the vectors are quantised separately (k-means on a bounded sample); a pair of
centroids is a cell, and the number of cells grows with the table. A query walks the cell pairs by
summed inner product, the largest first, with a heap, until the cells walked hold `reach` entries.
`reach` is fitted at every size anew: a bounded number of queries is held against the whole table,
and each of their true neighbours tells how many entries lie in the cells walked before its own.
Every vector is indexed, and all entries of the cells walked are ranked exactly. Entries and queries
meet by blocks of neighbouring cells, of bounded size: a cell that holds a third of all vectors is
spread over many blocks, and a block is repeated only for as many parts as its own queries fill."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alleleflow.llm.shared import table


def _kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    draw = np.random.default_rng(10)
    centres = points[draw.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(points, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        full = count > 0
        centres[full] = total[full] / count[full, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(1)[None] - 2 * points @ centres.T, axis=1)


def centroids_for(total: int) -> int:
    """Centroids per half: about 16 entries a cell, 64 to 512 centroids."""
    return min(512, max(64, 1 << math.ceil(math.log2(max(1, total / 16)) / 2)))


class Codebook:
    """Centroids of both halves."""

    def __init__(self, sample: np.ndarray, centroids: int):
        self.half = sample.shape[1] // 2
        self.left = _kmeans(sample[:, :self.half], centroids)
        self.right = _kmeans(sample[:, self.half:], centroids)
        self.shape = len(self.left), len(self.right)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector, left centroid times the number of right ones plus right one."""
        return _nearest(vectors[:, :self.half], self.left) * self.shape[1] + _nearest(vectors[:, self.half:], self.right)

    def walk(self, q: np.ndarray, counts: np.ndarray, reach: int) -> list[int]:
        """Cells with entries, by falling summed inner product, until they hold `reach` entries."""
        l, r = self.left @ q[:self.half], self.right @ q[self.half:]
        lo, ro = np.argsort(-l, kind="stable"), np.argsort(-r, kind="stable")
        l, r, lo, ro = (x.tolist() for x in (l[lo], r[ro], lo, ro))
        # (i, j + 1) follows (i, j); a new row begins from column 0 alone, so no pair comes twice
        heap, cells, held, width = [(-(l[0] + r[0]), 0, 0)], [], 0, self.shape[1]
        while heap and held < reach:
            _, i, j = heapq.heappop(heap)
            cell = lo[i] * width + ro[j]
            if n := counts[cell]:
                cells.append(cell)
                held += int(n)
            if j + 1 < len(ro):
                heapq.heappush(heap, (-(l[i] + r[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(lo):
                heapq.heappush(heap, (-(l[i + 1] + r[0]), i + 1, 0))
        return cells

    def held_before(self, q: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each cell the entries in the cells that come before it."""
        order = np.argsort(-(self.left @ q[:self.half])[:, None] - (self.right @ q[self.half:])[None], axis=None, kind="stable")
        out = np.empty(len(counts), dtype=np.int64)
        out[order] = np.cumsum(counts[order]) - counts[order]
        return out


def exact(entries: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """query (its number in `queries`), vec_id, cell, score: the k best of all entries for each of a bounded
    number of queries, but for its own id. A task keeps k rows a query."""
    shared = entries.sparkSession.sparkContext.broadcast((query_ids, queries))

    def best(batches):
        own, q = shared.value
        kept = None
        for pdf in batches:
            if not len(pdf):
                continue
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at:at + 4096]
                ids, cells = part["vec_id"].to_numpy(), part["cell"].to_numpy()
                score = q @ np.stack(part["v"].to_numpy()).T
                score[own[:, None] == ids[None]] = -np.inf
                ids, cells = np.broadcast_to(ids, score.shape), np.broadcast_to(cells, score.shape)
                if kept is not None:
                    score, ids, cells = (np.concatenate(x, axis=1) for x in zip(kept, (score, ids, cells)))
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                kept = [np.take_along_axis(x, top, axis=1) for x in (score, ids, cells)]
        if kept is not None:
            score, ids, cells = kept
            number = np.repeat(np.arange(len(q)), score.shape[1])
            out = pd.DataFrame({"query": number, "vec_id": ids.ravel(), "cell": cells.ravel(), "score": score.ravel()})
            yield out[out["score"] > -np.inf]

    found = entries.mapInPandas(best, "query int, vec_id long, cell int, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def fitted_reach(book: Codebook, entries: DataFrame, counts: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float) -> int:
    """Entries to walk so that the cells walked hold `share` of the true neighbours of the given
    queries, k and the query itself at least."""
    before = []
    near: dict[int, list[int]] = {}
    for r in exact(entries, query_ids, queries, k).collect():      # k rows a query
        near.setdefault(r["query"], []).append(r["cell"])
    for number, cells in near.items():
        before.extend(book.held_before(queries[number], counts)[cells].tolist())
    return max(k + 1, math.ceil(np.quantile(before, share, method="higher")) + 1) if before else k + 1


def blocks_of(counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first block and its number of blocks: neighbouring cells share a block of
    about `block` entries, a larger cell has blocks of its own."""
    first, spread, at, room = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), -1, 0
    for cell in np.flatnonzero(counts).tolist():
        n = int(counts[cell])
        if n > block:
            first[cell], spread[cell] = at + 1, -(-n // block)
            at, room = at + spread[cell], 0
        else:
            if n > room:
                at, room = at + 1, block
            first[cell] = at
            room -= n
    return first, spread


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles): rows with an id and a vector that is neither null, empty nor zero and
    has finite components only."""
    v = F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (vectors.select("vec_id", v.alias("v")).where("vec_id is not null and v is not null")
            .where(F.forall("v", fine) & F.exists("v", lambda x: x != 0)))


def search(vectors: DataFrame, every: int = 20, k: int = 20, centroids: int | None = None, sample: int = 8192,
           share: float = 0.97, probes: int = 256, block: int = 8192, together: int = 8192) -> DataFrame:
    """The k vectors of largest inner product for each query (vec_id divisible by `every`) among
    all other rows: query_id, rank from 1, vec_id, score (double precision, on the original
    vectors); equal scores by smaller vec_id. Takes vec_id and embedding; extra columns are
    ignored. Repeated rows are entries and queries of their own. Vectors whose length is not the sample's most
    frequent one take no part, as those that `valid_vectors` drops. An empty table gives an empty one.

    The codebook is fitted on at most `sample` vectors, the walk on at most `probes` queries: it reaches
    `share` of their true neighbours. A task meets about `block` entries with `together` queries."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = valid_vectors(vectors)
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(10)), "vec_id").limit(sample).collect()
    if not drawn:
        return spark.createDataFrame([], schema)
    dim = int(pd.Series([len(r["v"]) for r in drawn]).mode().iloc[0])
    rows = table(rows.where(F.size("v") == dim), "vectors")
    fitted = Codebook(np.array([r["v"] for r in drawn if len(r["v"]) == dim]), centroids or centroids_for(rows.count()))
    book = spark.sparkContext.broadcast(fitted)

    def index(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=book.value.cells(np.stack(pdf["v"].to_numpy())).astype(np.int32))

    entries = table(rows.mapInPandas(index, "vec_id long, v array<double>, cell int"), "entries")
    counts = np.zeros(fitted.shape[0] * fitted.shape[1], dtype=np.int64)
    for r in entries.groupBy("cell").count().collect():       # at most 512 squared
        counts[r["cell"]] = r["count"]
    queries = entries.where(F.col("vec_id") % every == 0)
    probe = queries.select("vec_id", "v").orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(probes).collect()
    if not probe:
        return spark.createDataFrame([], schema)
    reach = fitted_reach(fitted, entries, counts, np.array([r["vec_id"] for r in probe]), np.array([r["v"] for r in probe]), k, share)
    known = spark.sparkContext.broadcast((counts, *blocks_of(counts, block)))

    def route(batches):
        counts, first, spread = known.value
        names = ["block", "query_id", "q", "cells"]
        for pdf in batches:
            out = []
            for vec_id, v in zip(pdf["vec_id"], pdf["v"]):
                met: dict[int, list[int]] = {}
                for cell in book.value.walk(np.asarray(v), counts, reach):
                    for n in range(first[cell], first[cell] + spread[cell]):
                        met.setdefault(int(n), []).append(cell)
                out += [(n, vec_id, v, sorted(cells)) for n, cells in met.items()]
                if len(out) > 2000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    def place(batches):
        _, first, spread = known.value
        for pdf in batches:
            cell = pdf["cell"].to_numpy()
            yield pdf.assign(block=first[cell] + pdf.pop("h").to_numpy() % spread[cell])

    tasks = max(spark.sparkContext.defaultParallelism, -(-int(queries.count()) // 1000))
    asked = table(queries.select("vec_id", "v").repartition(tasks, "vec_id")
                  .mapInPandas(route, "block long, query_id long, q array<double>, cells array<int>"), "asked")
    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / together).alias("parts"))
    dealt = (entries.withColumn("h", F.xxhash64("vec_id", F.lit(12))).mapInPandas(place, "vec_id long, v array<double>, cell int, block long")
             .join(parts, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "cell", "vec_id", "v"))
    asked = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(13)), F.col("parts"))).drop("parts")

    def rank(asked: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(dealt):
            dealt = dealt.sort_values(["cell", "vec_id"])
            matrix, ids, cells = np.stack(dealt["v"].to_numpy()), dealt["vec_id"].to_numpy(), dealt["cell"].to_numpy()
            for query_id, q, own in zip(asked["query_id"], asked["q"], asked["cells"]):
                lo, hi = np.searchsorted(cells, own), np.searchsorted(cells, own, side="right")
                at = np.concatenate([np.arange(x, y) for x, y in zip(lo, hi)])
                at = at[ids[at] != query_id]
                rough = matrix[at] @ q
                if len(at) > k:      # all that may tie with the k-th
                    at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - 1e-9]
                score = (matrix[at] * q).sum(axis=1)
                best = np.lexsort([ids[at], -score])[:k]
                found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[at[best]], "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ["block", "part"]
    found = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
