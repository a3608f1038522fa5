"""SimHash near-duplicates through segment popcounts.

A 64-bit fingerprint is embedded as the bit counts of its segments. The Manhattan distance of two
embeddings is at most the Hamming distance of the fingerprints: each differing bit changes one
count by one. So fingerprints within d bits agree in all counts of at least `blocks - d` of the
`blocks` groups of segments; these agreeing counts are the cells of a grid, on which fingerprints
meet in an equi-join. Pairs in a cell are filtered by the Manhattan distance over bytes, then by
the exact distance. Fingerprints are collapsed to distinct ones before, whatever their number of
documents."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleleflow.llm.components import connected_components
from alleleflow.llm.shared import in_slices, keyed, table, text_or_empty

_SEGMENTS = 32     # of two bits: counts 0 to 2


def fingerprint(data: bytes, width: int, seed: int = 42) -> int:
    """SimHash of the text's `width`-word shingles (lower-cased in ASCII, words between ASCII white
    space, repeats included; fewer words: the whole sequence; none: zero)."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1:].tolist()
    first = [0, *(ends + 1).tolist()][:n]
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(first, last)], dtype="<u8")
    bits = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 4096):
        bits += np.unpackbits(hashes[k:k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *columns: str, width: int = 4) -> DataFrame:
    """`columns` of `docs` and `fp`, the fingerprint as a long (null text: empty)."""
    def run(batch):
        fps = [fingerprint(t, width) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in columns] + [pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=[*columns, "fp"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns] + ["fp long"])
    return docs.select(*columns, text_or_empty()).mapInArrow(in_slices(run), schema)


def _counts(fp, lo: int, hi: int):
    """Bit counts of two-bit segments lo to hi, packed two bits each."""
    odd = F.lit(0x5555555555555555).cast("long")
    a, b = F.col(fp).bitwiseAND(odd), F.shiftright(fp, 1).bitwiseAND(odd)
    packed = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))
    mask = (1 << 2 * (hi - lo)) - 1
    return F.shiftrightunsigned(packed, 2 * lo).bitwiseAND(F.lit(mask).cast("long"))


def close_pairs(distinct: DataFrame, bits: int = 4, blocks: int = 6) -> DataFrame:
    """(a, b) of distinct fingerprints `fp` at `bits` or fewer differing bits, each at least once.
    `blocks`, more than `bits`, sets the grid: more blocks give smaller cells and more of them
    (`blocks` over `bits`), for more fingerprints."""
    edges = [round(k * _SEGMENTS / blocks) for k in range(blocks + 1)]
    spans = list(zip(edges[:-1], edges[1:]))
    cells = []
    for k, chosen in enumerate(combinations(spans, blocks - bits)):
        key, at = F.lit(k).cast("long"), 0
        for lo, hi in chosen:
            key = F.shiftleft(key, 2 * (hi - lo)).bitwiseOR(_counts("fp", lo, hi))
            at += 2 * (hi - lo)
        cells.append(key if at <= 56 else F.xxhash64(key))
    cells = table(distinct.select("fp", F.explode(F.array(*cells)).alias("cell")), "cells")
    a, b = cells.toDF("a", "cell"), cells.toDF("b", "other")
    byte = lambda c, k: F.bit_count(F.shiftright(F.col(c), 8 * k).bitwiseAND(F.lit(255).cast("long")))
    manhattan = sum((F.abs(byte("a", k) - byte("b", k)) for k in range(8)), F.lit(0))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    return a.join(b, (F.col("cell") == F.col("other")) & (F.col("a") < F.col("b")) & (manhattan <= bits) & near).select("a", "b")


def components(docs: DataFrame, bits: int = 4, blocks: int = 6, width: int = 4) -> DataFrame:
    """doc_id, row, fp and component_id, the smallest doc_id that links of `bits` or fewer
    differing bits reach. Null doc_ids join their component and count as larger than any other;
    a component of nulls alone has null. Texts without words share fingerprint zero. Extra columns
    are ignored; repeated rows stay; an empty table gives an empty one."""
    rows = table(fingerprints(keyed(docs, "doc_id", "text"), "doc_id", "row", width=width), "fingerprints")
    own = table(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("row").alias("first")), "distinct")
    linked = connected_components(close_pairs(own.select("fp"), bits, blocks)).withColumnRenamed("node", "fp")
    group = own.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    whole = group.groupBy("component").agg(F.min("least").alias("component_id"), F.min("first").alias("keep"))
    names = table(group.join(whole, "component").select("fp", "component_id", "keep"), "named")
    return rows.join(names, "fp").select("doc_id", "row", "fp", "component_id", "keep")


def drop_near_duplicates(docs: DataFrame, bits: int = 4, width: int = 5) -> DataFrame:
    """`docs`, a stored table, with the first row of each component only; all its columns."""
    kept = components(docs, bits, width=width).where("row = keep").select(F.col("row").alias("_row"))
    return keyed(docs, *docs.columns, key="_row").join(kept, "_row", "left_semi").drop("_row")
