"""Fuzzy line dedup: MinHash over character shingles, exact Jaccard, one line per component.

Lines are compared without outer white space and in lower case. A task handles each distinct line
once and links lines that share a band to the band's first line in the task; only that one is
shuffled to meet its likes from other tasks. So a band holds a tree of links, not all its pairs,
and a line or band that fills a third of the table costs a row per task. Links are verified by
exact Jaccard similarity. A line that fails against its band's first line is compared with every
other line that has the same first one and is not joined to it already, so that no component is
split whose links a band can show. Sizes and odd maps (1,024 bits, each the parity of the shingles
that fall on it) rule most unlike pairs out before texts are read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alleleflow.llm.components import connected_components
from alleleflow.llm.shared import free_name, in_slices, keyed, own_cache, table

_TASK_LINES, _TASK_BANDS = 300_000, 600_000     # remembered in a task, or linked at once; beyond, rows repeat
_PART = 200                                     # lines or pairs compared at once; their shingles stay in the cache
_BINS = 1024                                    # of bands, which are shuffled in blocks
_WORDS = 16                                     # of 64 bits in a line's map
_MAP = [f"m{k}" for k in range(_WORDS)]
_PLAIN = {"parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "1"}  # hashes and texts that hardly repeat
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _normal(line: str) -> str:
    return line.strip().lower()


def _line_hash(line: str) -> int:
    return _line_hashes([line])[0]


def _line_hashes(lines: list[str]) -> list[int]:
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(x, 5) for x in lines], dtype=np.uint64).view(np.int64).tolist()


def shingle_hashes(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all lines' shingles, one after the other, and where each line begins. Lines
    have `width` characters at least."""
    h, starts = wide_hashes(lines, width)
    return (h >> np.uint64(32)).astype(np.uint32), starts


def wide_hashes(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with all 64 bits."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    h = _polynomials(points, width)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    ends = np.cumsum(lengths)
    inside = np.ones(len(points), dtype=bool)
    for k in range(1, width):
        inside[ends - k] = False
    starts = np.concatenate([[0], np.cumsum(lengths - width + 1)[:-1]])
    return h[inside[:len(h)]], starts


def _polynomials(points: np.ndarray, width: int) -> np.ndarray:
    """Of all `width` numbers in a row, the polynomial in _BASE with these coefficients, modulo 2^64:
    from each length to twice that, and by one more where the binary digits of `width` say so."""
    h, length = points if width > 1 else points.copy(), 1
    for digit in f"{width:b}"[1:]:
        longer = h[:-length] * np.uint64(pow(int(_BASE), length, 1 << 64))
        longer += h[length:]
        h, length = longer, 2 * length
        if digit == "1":
            longer = h[:-1] * _BASE
            longer += points[length:]
            h, length = longer, length + 1
    return h


def band_keys(lines: list[str], width: int, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per line and band."""
    parts = [lines[k:k + _PART] for k in range(0, len(lines), _PART)]
    return np.concatenate([minima(*shingle_hashes(part, width), bands, rows) for part in parts])


def minima(h: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of the sets of 32-bit hashes in `h` that begin at `starts`."""
    draw = np.random.default_rng(4)
    multiply = draw.integers(1, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    add = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    keys = np.zeros((len(starts), bands), dtype=np.uint64)
    drawn = np.empty_like(h)
    for f in range(bands * rows):
        np.multiply(h, multiply[f], out=drawn)
        drawn += add[f]
        least = np.minimum.reduceat(drawn, starts)
        b = f // rows
        key = (keys[:, b] ^ least) * _BASE + np.uint64(f + 1)
        keys[:, b] = key ^ (key >> np.uint64(29))
    return keys.view(np.int64)


def _occurrences(text: str):
    """(position, normal form) of the lines that are not blank."""
    for k, line in enumerate(text.split("\n")):
        if normal := line.strip().lower():
            yield k, normal


def lines_of_tasks(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """line (hash), row, position: where each line first stands in a task's rows. own holds the keys
    of the bands it is the task's first line of, eight bytes each, met those of its other bands and
    met_firsts their first lines; all are empty for lines shorter than `width`."""
    def run(batches):
        own_cache("lines")
        seen: set[int] = set()

        def each(batch):
            """Hash, row, position and band keys of the lines that are new, and whether they have bands."""
            if len(seen) > _TASK_LINES:
                seen.clear()
            found = [(line, row, k) for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist())
                     for k, line in _occurrences(text)]
            places, long = [], {}
            for h, (line, row, k) in zip(_line_hashes([line for line, _, _ in found]), found):
                if h not in seen:
                    seen.add(h)
                    if len(line) >= width:
                        long[len(places)] = line
                    places.append((h, row, k))
            if not places:
                return
            h, at, k = (np.array(c, dtype=np.int64) for c in zip(*places))
            keys, banded = np.zeros((len(h), bands), dtype=np.int64), np.zeros(len(h), dtype=bool)
            if long:
                where = list(long)
                banded[where] = True
                keys[where] = band_keys(list(long.values()), width, bands, rows)
            yield h, at, k, keys, banded

        def linked(parts):
            h, at, k, keys, banded = map(np.concatenate, zip(*parts))
            first = np.zeros(keys.shape, dtype=np.int64)
            if banded.any():
                band, line = keys[banded].ravel(), np.repeat(h[banded], bands)
                order = np.argsort(band, kind="stable")
                starts = np.flatnonzero(np.append(True, band[order[1:]] != band[order[:-1]]))
                met = np.empty_like(line)
                met[order] = np.repeat(line[order[starts]], np.diff(np.append(starts, len(order))))
                first[banded] = met.reshape(-1, bands)
            itself = (first == h[:, None]) & banded[:, None]
            other = ~itself & banded[:, None]
            ends = np.cumsum(8 * itself.sum(1)).tolist()
            data = keys[itself].tobytes()

            def lists(values, chosen):
                return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(chosen.sum(1))]), pa.int32()), pa.array(values[chosen]))
            return pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(at), pa.array(k, pa.int32()), pa.array([data[a:b] for a, b in zip([0, *ends], ends)], pa.binary()), lists(keys, other), lists(first, other)],
                names=["line", "row", "position", "own", "met", "met_firsts"])

        parts, n = [], 0
        for part in in_slices(each, limit=1 << 20)(batches):
            parts.append(part)
            n += len(part[0]) * bands
            if n > _TASK_BANDS:
                yield linked(parts)
                parts, n = [], 0
        if parts:
            yield linked(parts)

    return (keyed(docs, "text").where("text is not null")
            .mapInArrow(run, "line long, row long, position int, own binary, met array<long>, met_firsts array<long>"))


def _in_blocks(batches):
    """The (band, line) of all lines' own bands, as blocks: bin of the bands and, sixteen bytes each, its rows."""
    for batch in batches:
        own = batch.column("own").to_pylist()
        band = np.frombuffer(b"".join(own), np.int64)
        line = np.repeat(batch.column("line").to_numpy(), np.fromiter(map(len, own), np.int64, len(own)) // 8)
        if not len(band):
            continue
        kind = (band & (_BINS - 1)).astype(np.uint16)
        order = np.argsort(kind, kind="stable")
        kind, data = kind[order], np.stack([band[order], line[order]], axis=1).tobytes()
        starts = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
        ends = np.append(starts[1:], len(kind))
        yield pa.RecordBatch.from_arrays([pa.array(kind[starts].astype(np.int32)), pa.array([data[16 * a:16 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())],
                                         names=["bin", "block"])


def _shared_bands_of_blocks(batches):
    """`_shared_bands` of rows in blocks; all blocks of a bin are in the task."""
    rows = (np.frombuffer(b"".join(b.column("block").to_pylist()), np.int64).reshape(-1, 2) for b in batches)
    return _shared_bands(pa.RecordBatch.from_arrays([pa.array(r[:, 0]), pa.array(r[:, 1])], names=["band", "line"]) for r in rows)


def _shared_bands(batches):
    """The rows (band, line) of the bands that several lines hold; all rows of a band are in the
    task. Sixteen bytes a row are sorted as arrays, most of which are dropped."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    band, line = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("band", "line"))
    order = np.argsort(band)
    band, line = band[order], line[order]
    starts = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
    several = np.minimum.reduceat(line, starts) < np.maximum.reduceat(line, starts)
    keep = np.repeat(several, np.diff(np.append(starts, len(band))))
    yield pa.RecordBatch.from_arrays([pa.array(band[keep]), pa.array(line[keep])], names=["band", "line"])


def candidates(places: DataFrame, lines: DataFrame) -> DataFrame:
    """line, first for the lines that share a band, `first` being the line of the band that
    most tasks hold (of equals the one whose hash has the smallest upper 40 bits): a text that was copied and edited is nearer to
    its copies than these to one another. `lines` has the number of tasks that hold a line as "count"."""
    met = (places.select("line", "own").mapInArrow(_in_blocks, "bin int, block binary").repartition("bin")
           .mapInArrow(_shared_bands_of_blocks, "band long, line long"))
    local = (places.select("line", F.inline(F.arrays_zip(F.col("met").alias("band"), F.col("met_firsts").alias("first"))))
             .select("band", F.explode(F.array("line", "first")).alias("line")))
    members = table(met.unionByName(local).distinct(), "members", **_PLAIN)
    often = lines.where("count > 1").select("line", "count")
    order = F.least(F.coalesce("count", F.lit(1)), F.lit(1 << 22)) * F.lit(1 << 40) + F.shiftright(F.bitwise_not("line"), 24)
    first = (members.join(often, "line", "left").groupBy("band").agg(F.max_by("line", order).alias("first")))
    return members.join(table(first, "firsts", **_PLAIN), "band").where("line <> first").select("line", "first").distinct()


def distinct_shingles(lines: list[str], width: int) -> np.ndarray:
    """Number of the line (at most 2^20 of them) in the upper 20 bits and 44 bits of hash below,
    for all lines' distinct shingles, in ascending order."""
    return distinct(*wide_hashes(lines, width))


def distinct(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The same for the sets of 64-bit hashes in `h` that begin at `starts`."""
    both = np.repeat(np.arange(len(starts), dtype=np.uint64) << np.uint64(44), np.diff(np.append(starts, len(h))))
    both |= h >> np.uint64(20)
    both.sort()
    return both[np.append(True, both[1:] != both[:-1])]


def odd_maps(shingles: np.ndarray, n: int) -> np.ndarray:
    """Maps of the `n` sets in `shingles` (as from `distinct_shingles`); their bits tell whether an
    odd number of hashes falls on them. Two sets differ in at least as many shingles as their maps
    differ in bits, and only what differs fills the maps, however much the sets share."""
    size = 64 * _WORDS
    maps = np.empty((n, _WORDS), dtype=np.int64)
    for part in range(0, n, _PART):
        stop = min(part + _PART, n)
        some = shingles[slice(*np.searchsorted(shingles, np.array([part, stop], dtype=np.uint64) << np.uint64(44)))]
        spots = ((some >> np.uint64(44)) - np.uint64(part)) * np.uint64(size)
        spots += some & np.uint64(size - 1)
        bits = np.bincount(spots.view(np.int64), minlength=(stop - part) * size).astype(np.uint8) & 1
        maps[part:stop] = np.packbits(bits.reshape(-1, size), axis=1, bitorder="little").view("<i8")
    return maps


def sizes(shingles: np.ndarray, n: int) -> np.ndarray:
    """Number of elements of each of the `n` sets in `shingles`."""
    return np.bincount((shingles >> np.uint64(44)).view(np.int64), minlength=n)


def line_texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """line, its normal form, number of distinct shingle hashes and odd map, of the lines in
    `wanted` (line, row, position)."""
    def run(batch):
        out: dict[int, str] = {}
        for text, positions in zip(batch.column("text").to_pylist(), batch.column("positions").to_pylist()):
            lines = text.split("\n")
            some = [_normal(lines[k]) for k in positions]
            out.update(zip(_line_hashes(some), some))
        texts = list(out.values())
        size, maps = np.empty(len(texts), dtype=np.int32), np.empty((len(texts), _WORDS), dtype=np.int64)
        for part in range(0, len(texts), _PART):
            some = texts[part:part + _PART]
            shingles = distinct_shingles(some, width)
            size[part:part + _PART], maps[part:part + _PART] = sizes(shingles, len(some)), odd_maps(shingles, len(some))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(out), pa.int64()), pa.array(texts, pa.string()), pa.array(size)]
            + [pa.array(np.ascontiguousarray(maps[:, k])) for k in range(_WORDS)], names=["line", "line_text", "size", *_MAP])

    by_row = wanted.groupBy("row").agg(F.collect_list("position").alias("positions"))
    texts = keyed(docs, "text").where("text is not null")
    return texts.join(by_row, "row").mapInArrow(in_slices(run, limit=1 << 20), "line long, line_text string, size int, " + ", ".join(f"{m} long" for m in _MAP))


def _exact(a: str, b: str, width: int) -> float:
    x, y = ({s[k:k + width] for k in range(len(s) - width + 1)} for s in (a, b))
    shared = len(x & y)
    return shared / (len(x) + len(y) - shared)


def jaccards(a: list[str], b: list[str], width: int, threshold: float) -> np.ndarray:
    """Jaccard similarities of the shingle sets of a[k] and b[k]. 44-bit hashes settle what is
    clear; pairs within 0.02 of `threshold`, and small sets, are counted on the shingles themselves."""
    x, y = distinct_shingles(a, width), distinct_shingles(b, width)
    both = np.concatenate([x, y])
    both.sort()
    shared = sizes(both[1:][both[1:] == both[:-1]], len(a))
    union = sizes(x, len(a)) + sizes(y, len(a)) - shared
    out = shared / union
    for k in np.flatnonzero((np.abs(out - threshold) <= 0.02) | (union <= 50)).tolist():
        out[k] = _exact(a[k], b[k], width)
    return out


def _with_both(pairs: DataFrame, what: DataFrame) -> DataFrame:
    """`pairs` (line, first) as "pair", with the rows of `what` (line, ...) of the line as "own" and of
    the first one as "lead". Both sides are the same plan, so that `what` is shuffled once."""
    return (pairs.alias("pair").join(what.alias("lead"), F.col("pair.first") == F.col("lead.line"))
            .join(what.alias("own"), F.col("pair.line") == F.col("own.line")))


def verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """line, first, jaccard: the similarity of `pairs` (line, first)."""
    def run(batch):
        for part in range(0, batch.num_rows, _PART):
            some = batch.slice(part, _PART)
            found = jaccards(some.column("line_text").to_pylist(), some.column("first_text").to_pylist(), width, threshold)
            yield pa.RecordBatch.from_arrays([some.column("line"), some.column("first"), pa.array(found)], names=["line", "first", "jaccard"])

    both = _with_both(pairs, texts.select("line", "line_text"))
    return (both.select("pair.*", "own.line_text", F.col("lead.line_text").alias("first_text"))
            .mapInArrow(in_slices(run, "line_text", 1 << 20), "line long, first long, jaccard double"))


def _never_null(df: DataFrame) -> DataFrame:
    """`df` with sizes and maps that Spark knows to hold no null. Without the tests for nulls the code
    of `_may_be_similar` is short enough for the JVM to compile it."""
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("size", *_MAP)})


def _may_be_similar(threshold: float, one: str, other: str):
    """Condition on sizes and odd maps that all pairs at `threshold` or more meet; the names of the
    columns begin with `one` and `other`."""
    size, size_2 = F.col(f"{one}size"), F.col(f"{other}size")
    unlike = sum((F.bit_count(F.col(f"{one}{m}").bitwiseXOR(F.col(f"{other}{m}"))) for m in _MAP), F.lit(0))
    return ((F.least(size, size_2) >= (threshold - 1e-9) * F.greatest(size, size_2))
            & (unlike <= (1 - threshold + 1e-9) / (1 + threshold) * (size + size_2)))


def similar_lines(docs: DataFrame, width: int = 7, bands: int = 8, rows: int = 3, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The table of first places (line, row, position; count: tasks that hold the line), and these places with the component
    (line, component, row, position) of the lines that links at `threshold` or more join to other lines. A pair at 0.8 shares a band with a
    probability of 0.997."""
    places = table(lines_of_tasks(docs, width, bands, rows), "places", **_PLAIN)
    # a row holds one place of a line at most
    lines = table(places.groupBy("line").agg(F.count("*").alias("count"), F.min("row").alias("row"), F.min_by("position", "row").alias("position")), "first-places", **_PLAIN)
    found = table(candidates(places, lines), "candidates", **_PLAIN)
    wanted = found.select(F.explode(F.array("line", "first")).alias("line")).distinct()
    wanted = table(lines.join(wanted, "line").select("line", "row", "position"), "wanted", **_PLAIN)
    texts = table(line_texts(docs, wanted, width), "lines", **_PLAIN)
    maps = _never_null(texts.drop("line_text"))
    pairs = table(_with_both(found, maps).select("pair.*", _may_be_similar(threshold, "own.", "lead.").alias("near")), "pairs", **_PLAIN)
    tested = table(verified(pairs.where("near").select("line", "first"), texts, width, threshold), "tested")
    grouped = table(connected_components(tested.where(F.col("jaccard") >= threshold).select(F.col("line").alias("a"), F.col("first").alias("b"))), "grouped")
    # Lines unlike the first one of their bands, against all lines with that first one that are not
    # joined to them yet. Two lines can be similar only if their sizes are, if their distances from
    # the first one differ by no more than their own distance may, and if few bits of their maps differ.
    own = Window.partitionBy("first")
    unlike = pairs.where(~F.col("near")).select("line", "first", F.lit(None).cast("double").alias("jaccard"))
    members = table(tested.unionByName(unlike).join(grouped.toDF("line", "own"), "line", "left")
                    .withColumn("own", F.coalesce("own", "line")).withColumn("failed", F.coalesce(F.col("jaccard") < threshold, F.lit(True)))
                    .withColumn("n", F.count("*").over(own)).withColumn("any_failed", F.max("failed").over(own))
                    .where("n > 1 and any_failed").drop("n", "any_failed").join(maps, "line"), "members", **_PLAIN)
    members = _never_null(members)
    other = members.toDF(*["other_" + c for c in members.columns])
    distances = F.abs(F.col("jaccard") - F.col("other_jaccard"))
    again = (members.where("failed").join(other, (F.col("first") == F.col("other_first")) & (F.col("own") != F.col("other_own"))
                                          & (~F.col("other_failed") | (F.col("line") < F.col("other_line")))
                                          & (distances.isNull() | (distances <= 1 - threshold + 1e-9)) & _may_be_similar(threshold, "", "other_"))
             .select(F.greatest("line", "other_line").alias("line"), F.least("line", "other_line").alias("first")).distinct())
    again = table(again, "again")
    few = texts.join(again.select(F.explode(F.array("line", "first")).alias("line")).distinct(), "line", "left_semi")
    more = verified(again, few, width, threshold).where(F.col("jaccard") >= threshold)
    joined = (more.join(grouped.toDF("line", "a"), "line", "left").join(grouped.toDF("first", "b"), "first", "left")
              .select(F.coalesce("a", "line").alias("a"), F.coalesce("b", "first").alias("b")))
    merged = connected_components(joined).toDF("component", "least")
    # a line of a merged component may have no link of the first kind
    nodes = grouped.toDF("line", "component").unionByName(merged.join(grouped.select("component").distinct(), "component", "left_anti")
                                                          .select(F.col("component").alias("line"), "component"))
    return lines, nodes.join(merged, "component", "left").select("line", F.coalesce("least", "component").alias("component")).join(wanted, "line")


def remove_similar_lines(docs: DataFrame, width: int = 7, bands: int = 8, rows: int = 3, threshold: float = 0.8) -> DataFrame:
    """`docs` with the first line of each component of equal or similar lines, in table order, and
    without the others; n_lines and n_removed are added (of lines that are not blank; blank lines
    stay, null texts stay null). All columns are kept, n_chars is not
    recomputed; columns named n_lines and n_removed are replaced. Lines shorter
    than `width` characters are similar only if equal. Repeated rows lose their lines to the first
    of them; an empty table gives an empty one. `docs` must be a stored table."""
    places, groups = similar_lines(docs, width, bands, rows, threshold)
    groups = table(groups.select("component", F.struct("row", "position").alias("at")), "groups")
    gone = groups.join(groups.groupBy("component").agg(F.min("at").alias("least")), "component").where("at <> least")
    # a first place is its position, one of them that goes the position's complement beside it
    marks = places.select("row", "position").unionByName(gone.select("at.row", F.bitwise_not("at.position").alias("position")))
    docs = docs.drop("n_lines", "n_removed")
    columns = docs.columns
    own_row, marks_at = (free_name(n, columns) for n in ("_row", "_marks"))

    def run(batch):
        texts, total, gone = [], [], []
        for text, marks in zip(batch.column("text").to_pylist(), batch.column(marks_at).to_pylist()):
            stay, n, out = set(marks or ()), 0, []
            stay -= {~k for k in stay if k < 0}
            for k, line in enumerate((text or "").split("\n")):
                if line and not line.isspace():
                    n += 1
                    if k not in stay:
                        continue
                out.append(line)
            texts.append(None if text is None else "\n".join(out))
            total.append(n)
            gone.append(n - sum(k >= 0 for k in stay))
        arrays = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays + [pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*columns, "n_lines", "n_removed"])

    marks = marks.groupBy("row").agg(F.collect_list("position")).toDF(own_row, marks_at)
    joined = keyed(docs, *columns, key=own_row).join(marks, own_row, "left").drop(own_row)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["n_lines long, n_removed long"])
    return joined.mapInArrow(in_slices(run, "text", 1 << 20), schema)
