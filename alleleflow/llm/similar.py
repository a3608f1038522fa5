"""Near-duplicate documents: SimHash and MinHash over word shingles, exact Jaccard, one document per component.

Texts are collapsed to their words in lower case, so that any number of copies counts once. Texts
whose SimHash fingerprints meet in the popcount grid are compared; most pairs at 0.8 differ in more
bits, so MinHash bands find candidates beside them. Texts
that share a band are compared with the band's most frequent text, then those that it does not join
with the rest of the band, as far as sizes, distances and odd maps leave them. Every link is an
exact Jaccard similarity of word shingles."""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleleflow.llm import simhash
from alleleflow.llm.components import connected_components
from alleleflow.llm.lines import _BASE, _MAP, distinct, minima, odd_maps, sizes
from alleleflow.llm.shared import free_name, in_slices, keyed, own_cache, packed_text, table, text_or_empty, unpack

_TASK_TEXTS = 300_000       # remembered in a task; beyond, rows repeat
_NO_WORD = 0x5851F42D4C957F2D


def _words(data: bytes) -> list[bytes]:
    return data.lower().split()


def shingle_hashes(texts: list[list[bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' shingles of `width` words, one after the other, and where each
    text begins. Texts have a word at least; with fewer than `width` they are one shingle."""
    from xxhash import xxh3_64_intdigest

    lengths = np.fromiter((max(len(t), width) for t in texts), np.int64, len(texts))
    padded = (chain(map(xxh3_64_intdigest, t), [_NO_WORD] * (width - len(t))) for t in texts)
    points = np.fromiter(chain.from_iterable(padded), np.uint64, int(lengths.sum()))
    n = len(points) - width + 1
    h = points[:n].copy()
    for k in range(1, width):
        h = h * _BASE + points[k:k + n]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    ends = np.cumsum(lengths)
    inside = np.ones(len(points), dtype=bool)
    for k in range(1, width):
        inside[ends - k] = False
    return h[inside[:n]], np.concatenate([[0], np.cumsum(lengths - width + 1)[:-1]])


def band_keys(texts: list[list[bytes]], width: int, bands: int, rows: int) -> np.ndarray:
    h, starts = shingle_hashes(texts, width)
    return minima((h >> np.uint64(32)).astype(np.uint32), starts, bands, rows)


def prints(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """row, text_id (of the words), and once per task and text: bands, size (number of distinct
    shingles), odd map and SimHash fingerprint. Texts without words have no bands."""
    names = ["row", "text_id", "bands", "size", *_MAP, "fp"]

    def run(batches):
        from xxhash import xxh3_64_intdigest

        own_cache("similar")
        seen: set[int] = set()

        def each(batch):
            if len(seen) > _TASK_TEXTS:
                seen.clear()
            ids, new, at = [], [], []
            for k, data in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = _words(data)
                ids.append(h := xxh3_64_intdigest(b" ".join(words)))
                if words and h not in seen:
                    seen.add(h)
                    new.append(words)
                    at.append(k)
            place = np.full(len(ids), -1)
            place[at] = np.arange(len(at))
            take = pa.array(place, mask=place < 0)
            if new:
                h, starts = shingle_hashes(new, width)
                keys, shingles = minima((h >> np.uint64(32)).astype(np.uint32), starts, bands, rows), distinct(h, starts)
                size, maps = sizes(shingles, len(new)), odd_maps(shingles, len(new))
            else:
                keys, maps, size = np.zeros((0, bands), np.int64), np.zeros((0, len(_MAP)), np.int64), []
            fps = np.array([simhash.fingerprint(b" ".join(t), width) for t in new], dtype=np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1, dtype=np.int32) * bands), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.array(ids, dtype=np.uint64).view(np.int64)), lists.take(take), pa.array(size, pa.int32()).take(take)]
                + [pa.array(np.ascontiguousarray(maps[:, k])).take(take) for k in range(len(_MAP))] + [pa.array(fps, pa.int64()).take(take)], names=names)

        yield from in_slices(each)(batches)

    schema = "row long, text_id long, bands array<long>, size int, " + ", ".join(f"{m} long" for m in (*_MAP, "fp"))
    return keyed(docs, "text").select("row", text_or_empty()).mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """a, b, jaccard: the exact similarity of the texts of `pairs` (a, b)."""
    def run(batches):
        @lru_cache(8)
        def shingles(data):
            words = _words(unpack(data))
            return set(zip(*[words[k:] for k in range(width)])) if len(words) >= width else {tuple(words)}

        def each(batch):
            out = []
            for x, y in zip(batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist()):
                x, y = shingles(x), shingles(y)
                both = len(x & y)
                out.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "jaccard"])

        yield from in_slices(each, "a_text", 1 << 20)(batches)

    joined = pairs.join(texts.toDF("b", "b_text"), "b").join(texts.toDF("a", "a_text"), "a")
    return joined.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long, jaccard double")


def print_pairs(once: DataFrame, bits: int = 4) -> DataFrame:
    """a, b: texts whose fingerprints `fp` differ in `bits` or fewer bits, by way of one text for each
    distinct fingerprint."""
    marks = table(once.groupBy("fp").agg(F.min("text_id").alias("mark")), "marks")
    equal = once.select("text_id", "fp").distinct().join(marks, "fp").where("text_id <> mark").select(F.col("text_id").alias("a"), F.col("mark").alias("b"))
    near = simhash.close_pairs(marks.select("fp"), bits).toDF("fp_a", "fp_b")
    near = near.join(marks.toDF("fp_a", "a"), "fp_a").join(marks.toDF("fp_b", "b"), "fp_b").select("a", "b")
    return equal.unionByName(near).distinct()


def first_rows(docs: DataFrame, width: int = 5, bands: int = 16, rows: int = 3, threshold: float = 0.8) -> DataFrame:
    """keep: the first row of each component of texts that links of `threshold` or more join.
    Candidates come from SimHash fingerprints and from bands; a pair at 0.8 shares a band with a probability of 0.99999."""
    printed = table(prints(docs, width, bands, rows), "prints")
    own = table(printed.groupBy("text_id").agg(F.min("row").alias("first"), F.count("*").alias("n")), "texts")
    once = printed.where("bands is not null").drop("row")
    members = once.select(F.explode("bands").alias("band"), "text_id").distinct().join(own.select("text_id", "n"), "text_id")
    members = table(members, "members")
    often = (members.groupBy("band").agg(F.max(F.struct("n", "text_id")).alias("m"), F.min("text_id").alias("least"), F.max("text_id").alias("most"))
             .where("least <> most").select("band", F.col("m.text_id").alias("lead")))
    met = table(members.join(table(often, "leads"), "band").select("band", "text_id", "lead"), "met")
    printed_pairs = table(print_pairs(once), "print-pairs")
    wanted = (met.select("text_id").unionByName(printed_pairs.select(F.explode(F.array("a", "b")).alias("text_id")))
              .distinct().join(own, "text_id").select("text_id", "first"))
    texts = table(keyed(docs, "text", key="first").select("first", packed_text()).join(wanted, "first").select("text_id", "text"), "packed")
    tested = table(verified(met.where("text_id <> lead").select(F.col("text_id").alias("a"), F.col("lead").alias("b")).distinct(), texts, width), "tested")
    by_print = verified(printed_pairs, texts, width).where(F.col("jaccard") >= threshold).select("a", "b")
    linked = table(tested.where(F.col("jaccard") >= threshold).select("a", "b").unionByName(by_print).distinct(), "linked")
    grouped = table(connected_components(linked), "grouped")
    # Texts unlike their band's lead, against all of that band that are not joined to them yet
    sketch = table(once.dropDuplicates(["text_id"]).drop("bands", "fp").join(met.select("text_id").distinct(), "text_id"), "sketches")
    far = (met.where("text_id <> lead").join(tested.toDF("text_id", "lead", "jaccard"), ["text_id", "lead"])
           .join(sketch, "text_id").join(grouped.toDF("text_id", "own"), "text_id", "left")
           .select("band", "text_id", "size", "jaccard", F.coalesce("own", "text_id").alias("own"), *_MAP))
    far = table(far, "far")
    other = far.toDF("other_band", "other", "other_size", "other_jaccard", "other_own", *[f"other_{m}" for m in _MAP])
    room = 1 - threshold + 1e-9
    unlike = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"other_{m}"))) for m in _MAP), F.lit(0))
    again = (far.where(F.col("jaccard") < threshold).join(other, (F.col("band") == F.col("other_band")) & (F.col("own") != F.col("other_own"))
                         & (F.abs(F.col("jaccard") - F.col("other_jaccard")) <= room)
                         & (F.least("size", "other_size") >= (threshold - 1e-9) * F.greatest("size", "other_size"))
                         & (unlike <= room / (1 + threshold) * (F.col("size") + F.col("other_size"))))
             .select(F.greatest("text_id", "other").alias("a"), F.least("text_id", "other").alias("b")).distinct())
    more = verified(table(again, "again"), texts, width).where(F.col("jaccard") >= threshold).select("a", "b")
    groups = connected_components(linked.unionByName(more)).toDF("text_id", "component")
    return own.join(groups, "text_id", "left").groupBy(F.coalesce("component", "text_id").alias("component")).agg(F.min("first").alias("keep"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """`docs`, a stored table, with the first row of each component only; all its columns. Null and
    empty texts are equal; repeated rows go; an empty table gives an empty one."""
    row = free_name("_row", docs.columns)
    kept = first_rows(docs, width, threshold=threshold).select(F.col("keep").alias(row))
    return keyed(docs, *docs.columns, key=row).join(kept, row, "left_semi").drop(row)
