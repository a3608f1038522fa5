"""Divergence of a language's sources by the frequencies of their terms, from count-level bitmaps.

Terms that stand in enough documents of a language are dealt into blocks of 256, of like frequency.
In a block, the terms that a source uses c times are one bitmap of 256 bits; AND and popcount of two
sources' bitmaps give the number of terms with the counts (c, d), which is multiplied by the
distance of the two frequencies. Terms that one or both sources lack follow by complement, from the
bitmaps' sizes and the number of terms. All numbers are whole.

Counts are summed in the tasks before they are shuffled, so a source that holds a third of all
documents weighs no more than its vocabulary; pairs are formed between at most 64 sources by 64 in
one task, and their number is that of the result."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alleleflow.llm.shared import in_slices, table, text_or_empty

#: Letters and everything beyond ASCII stay, A-Z in lower case; other characters part terms.
_FOLD = bytes(k if k >= 128 or 97 <= k <= 122 else k + 32 if 65 <= k <= 90 else 32 for k in range(256))
SCALE, SMOOTH = 1_000_000_000, 5
_SLOTS, _CHUNK = 256, 64
_GROUP = "lang string, source string"


def _task_counts(limit: int):
    """Per task: lang, source, term, n (occurrences), docs (documents with it), flushed at `limit`
    entries; and a row without term for every group seen."""
    def run(batches):
        held: dict = {}
        state = {"size": 0}

        def flush():
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(terms) + 1)), pa.array([source] * (len(terms) + 1)),
                     pa.array([t.decode("utf-8", "replace") for t in terms] + [None], pa.string()),
                     pa.array([*n.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, terms), 0], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
            held.clear()
            state["size"] = 0

        def each(batch):
            for lang, source, text in zip(*[batch.column(c).to_pylist() for c in ("lang", "source", "text")]):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                found = Counter(text.encode("utf-8", "surrogatepass").translate(_FOLD).split())
                n.update(found)
                docs.update(found.keys())
                state["size"] += len(n) - before + 1
                if state["size"] >= limit:
                    yield from flush()

        yield from in_slices(each)(batches)
        yield from flush()

    return run


def term_counts(docs: DataFrame, limit: int = 100_000) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of every term in every group, and a
    row without term per group. Null lang, source and text count as ''."""
    rows = docs.select(*[text_or_empty(c) for c in ("lang", "source", "text")])
    return (rows.mapInArrow(_task_counts(limit), _GROUP + ", term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def frequency(count: str, total: str, terms: str) -> F.Column:
    """1 + floor(SCALE (count + 5) / (total + 5 terms)), exact beyond 64 bits."""
    return F.expr(f"1 + cast(({SCALE} * cast({count} + {SMOOTH} as decimal(20,0))) div (cast({total} as decimal(20,0)) + {SMOOTH} * {terms}) as long)")


def kept_terms(counts: DataFrame, least: int, slots: int = _SLOTS) -> DataFrame:
    """lang, term, total, block, bit: terms in at least `least` documents of a language, dealt into
    blocks by falling frequency. Blocks are cut inside range partitions, so no language's terms
    meet in one task."""
    spark = counts.sparkSession
    kept = (counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
            .where(F.col("docs") >= least).drop("docs"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("lang"), F.desc("total"), F.col("term")]
    at = F.monotonically_increasing_id()
    return table(kept.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                 .withColumn("_at", at).select("lang", "term", "total", F.expr(f"_at div {slots}").alias("block"),
                                               (F.col("_at") % slots).cast("int").alias("bit")), "terms")


def _spans(sorted_keys: list[np.ndarray]) -> list[int]:
    change = np.zeros(len(sorted_keys[0]), bool)
    change[0] = True
    for k in sorted_keys:
        change[1:] |= k[1:] != k[:-1]
    return [*np.flatnonzero(change).tolist(), len(change)]


def pair_sums(numbers, levels, p, maps, left: np.ndarray, right: np.ndarray, chunk: int) -> np.ndarray:
    """What one block adds to the pairs (left source, right source), beyond what its terms would
    add if both sources lacked them. `numbers`, `levels`' frequencies `p` and bitmaps `maps` (four
    words) stand for the sources' count levels in the block, sorted by source; `left` and `right`
    map places to the frequency at count 0; a source's place is its number % chunk."""
    out = np.zeros((len(left), len(right)), np.int64)
    none = np.abs(left[:, None] - right[None, :])
    size = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    first, second = levels
    # terms of one source, as if the other lacked them
    for k in first:
        a = numbers[k] % chunk
        out[a] += size[k] * (np.abs(p[k] - right) - none[a])
    for k in second:
        b = numbers[k] % chunk
        out[:, b] += size[k] * (np.abs(left - p[k]) - none[:, b])
    if not len(first) or not len(second):
        return out
    # terms of both: what they add instead
    b = numbers[second] % chunk
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    for k in first:
        a = numbers[k] % chunk
        joint = np.bitwise_count(maps[second] & maps[k]).sum(axis=1, dtype=np.int64)
        change = np.abs(p[k] - p[second]) - np.abs(p[k] - right[b]) - np.abs(left[a] - p[second]) + none[a, b]
        out[a, b[cuts]] += np.add.reduceat(joint * change, cuts)
    return out


def _pair_task(chunk: int):
    def run(batches):
        yield from _pair_rows(batches, chunk)
    return run


def _pair_rows(batches, chunk: int):
    """Sums per pair of sources from sorted rows: a head with the chunks' frequencies at count 0,
    then the levels of both chunks. One pair of chunks is held at a time."""
    key, sums, held = None, None, []

    def flush():
        a, b = np.nonzero(np.ones_like(sums[0]))
        lang, i, j = key
        keep = (i != j) | (a < b)
        a, b = a[keep], b[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(a), pa.string()), pa.array(a + i * chunk, pa.int64()), pa.array(b + j * chunk, pa.int64()), pa.array(sums[0][a, b])],
            names=["lang", "a", "b", "part"])

    def work(t):
        nonlocal key, sums
        langs = t.column("lang").combine_chunks().dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False)
        i, j, block = (t.column(c).to_numpy() for c in ("i", "j", "block"))
        number, p = t.column("number").to_numpy(), t.column("p").to_numpy()
        maps = np.stack([t.column(f"w{k}").to_numpy() for k in range(4)], axis=1).view(np.uint64)
        cuts = _spans([code, i, j, block])
        for x, y in zip(cuts[:-1], cuts[1:]):
            now = (langs.dictionary[int(code[x])].as_py(), int(i[x]), int(j[x]))
            left, right = (np.array(t.column(c)[x].as_py(), np.int64) for c in ("zero_i", "zero_j"))
            if now != key:
                if key is not None:
                    yield from flush()
                key, sums = now, [np.zeros((len(left), len(right)), np.int64)]
            rows = np.arange(x + 1, y)
            side = number[rows] // chunk
            sums[0] += pair_sums(number, (rows[side == now[1]], rows[side == now[2]]), p, maps, left, right, chunk)

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= 20_000:
            t = pa.Table.from_batches(held).combine_chunks()
            heads = np.flatnonzero(t.column("number").to_numpy() < 0)
            if len(heads) > 1:
                yield from work(t.slice(0, heads[-1]))
                t = t.slice(heads[-1])
            held, rows = t.to_batches(), t.num_rows
    if held:
        yield from work(pa.Table.from_batches(held).combine_chunks())
    if key is not None:
        yield from flush()


def divergence(docs: DataFrame, least: int = 30, top: int = 50, slots: int = _SLOTS, sources: int = _CHUNK) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: every other source of the language, with
    the summed distance of their terms' frequencies. Part `term`: the `top` terms that the source
    uses more often than its language, with the difference. A term counts if at least `least`
    documents of the language hold it. Null lang, source and text are ''; a group without terms
    has all counts 0; a language without kept terms has pairs of value 0; repeated rows count
    each; an empty table gives an empty one; other columns are ignored. A bitmap
    has `slots` bits, 256 at most; a task pairs `sources` sources with as many."""
    counts = table(term_counts(docs), "term-counts")
    terms = kept_terms(counts, least, slots)
    spoken = counts.select("lang", "source").distinct()
    used = table(counts.where("term is not null").join(terms, ["lang", "term"])
                 .select("lang", "source", "term", "n", "total", "block", "bit"), "used")
    per_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = (spoken.join(per_lang, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["v", "lang_n", "group_n"])
              .withColumn("number", number.cast("long")))
    zero = F.when(F.col("v") > 0, frequency("0L", "group_n", "v")).otherwise(F.lit(0))
    groups = table(groups.withColumn("zero", zero), "groups")

    # count levels as bitmaps
    word = F.expr("bit div 64")
    one = F.expr("shiftleft(1L, bit % 64)")
    maps = used.groupBy("lang", "source", "block", "n").agg(
        *[F.bit_or(F.when(word == k, one).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(4)])
    levels = (maps.join(groups.select("lang", "source", "number", "v", "group_n"), ["lang", "source"])
              .select("lang", "block", "number", frequency("n", "group_n", "v").alias("p"), *[f"w{k}" for k in range(4)]))
    chunk = F.expr(f"number div {sources}")
    chunks = groups.groupBy("lang", chunk.alias("chunk")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("number", "zero"))), lambda x: x["zero"]).alias("zeros"))
    last = groups.groupBy("lang").agg(F.max(chunk).alias("last"))
    dealt = levels.join(last, "lang").withColumn("_other", F.explode(F.expr("sequence(0L, last)"))).select(
        "lang", F.least(chunk, "_other").alias("i"), F.greatest(chunk, "_other").alias("j"), "block", "number", "p", *[f"w{k}" for k in range(4)])
    dealt = table(dealt, "levels")
    heads = dealt.select("lang", "i", "j", "block").distinct()
    for side in ("i", "j"):
        heads = heads.join(chunks.select("lang", F.col("chunk").alias(side), F.col("zeros").alias(f"zero_{side}")), ["lang", side])
    nothing = F.lit(None).cast("array<long>")
    rows = dealt.withColumns({"zero_i": nothing, "zero_j": nothing}).unionByName(heads.select(
        "lang", "i", "j", "block", F.lit(-1).cast("long").alias("number"), F.lit(0).cast("long").alias("p"),
        *[F.lit(0).cast("long").alias(f"w{k}") for k in range(4)], "zero_i", "zero_j"))
    parts = (rows.repartition("lang", "i", "j", "block").sortWithinPartitions("lang", "i", "j", "block", "number")
             .mapInArrow(_pair_task(sources), "lang string, a long, b long, part long")
             .groupBy("lang", "a", "b").agg(F.sum("part").alias("part")))
    names = groups.select("lang", "number", "source", "zero", "v")
    # every pair of sources of a language is a row of the result
    pairs = (names.withColumnsRenamed({"number": "a", "zero": "zero_a"})
             .join(names.drop("v").withColumnsRenamed({"number": "b", "source": "item", "zero": "zero_b"}), "lang").where("a <> b")
             .withColumns({"_low": F.least("a", "b"), "_high": F.greatest("a", "b")})
             .join(parts.select("lang", F.col("a").alias("_low"), F.col("b").alias("_high"), "part"), ["lang", "_low", "_high"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     (F.coalesce("part", F.lit(0)) + F.col("v") * F.abs(F.col("zero_a") - F.col("zero_b"))).alias("value")))

    mine, general = frequency("n", "group_n", "v"), frequency("total", "lang_n", "v")
    over = (used.join(groups.select("lang", "source", "v", "group_n", "lang_n"), ["lang", "source"])
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (mine - general).alias("value"))
            .where("value > 0"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (pairs.withColumn("rank", F.row_number().over(order))
            .unionByName(over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)))
