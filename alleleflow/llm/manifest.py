"""Merkle manifest of a dataset, with retained hash states.

A leaf is the SHA-256 of a row's fields; every three consecutive nodes of a source become the
SHA-256 of their hexadecimal digests, up to the source's subroot, and the subroots likewise the
root. A digest in hexadecimal is one SHA-256 block, so a parent's hash state before each child is
eight words: the manifest keeps them, and folding a replaced leaf resumes the state in front of it
with the replacement and the siblings on its right only.

A source's leaves are cut into blocks of 3^8; a block's nodes and states are one row, blocks are
the leaves of the next layer, and 3 layers hold 2.8e11 leaves. Nothing but numbers of layers
reaches the driver, no task holds more than a few blocks, and texts are never shuffled."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alleleflow.llm.shared import table

ARITY = 3
#: Levels in a block.
DEPTH = 8
_STEP = np.dtype([("count", "u1"), ("slot", "u1"), ("state", "u1", 32), ("others", "u1", 64)])
_PARENT = np.dtype([("digest", "u1", 32), ("states", "u1", 64)])


# ------------------------------------------------------------------ SHA-256 on arrays of rows

def _fixed() -> tuple[np.ndarray, np.ndarray]:
    """Initial state and round constants: fractions of square and cube roots of primes."""
    primes = [p for p in range(2, 312) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    start = [math.isqrt(p << 64) & 0xFFFFFFFF for p in primes[:8]]
    rounds = []
    for p in primes:
        x = round(p ** (1 / 3) * 2 ** 32)
        while x ** 3 > p << 96:
            x -= 1
        while (x + 1) ** 3 <= p << 96:
            x += 1
        rounds.append(x & 0xFFFFFFFF)
    return np.array(start, np.uint32), np.array(rounds, np.uint32)


_START, _ROUNDS = _fixed()
_HEX = np.frombuffer("".join(f"{k:02x}" for k in range(256)).encode(), "u1").reshape(256, 2)


def _turn(x, k):
    return (x >> np.uint32(k)) | (x << np.uint32(32 - k))


def absorb(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """States (8, n) after one block of 16 words (16, n) each."""
    w = list(words)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        if t >= 16:
            x, y = w[1], w[14]
            w.append(w[0] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[9]
                     + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
            del w[0]
        word = w[t] if t < 16 else w[15]
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + _ROUNDS[t] + word
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([a, b, c, d, e, f, g, h]) + state


def hex_words(digests: np.ndarray) -> np.ndarray:
    """(16, n) words of the hexadecimal text of (n, 32) digests."""
    return np.ascontiguousarray(_HEX[digests].reshape(len(digests), 64)).view(">u4").astype(np.uint32).T


def _words(stored: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(stored).view(">u4").astype(np.uint32).T


def _stored(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.T).astype(">u4").view("u1")


def _finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """(n, 32) digests after the closing block of messages of so many blocks."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0], last[15] = 0x80000000, blocks.astype(np.uint32) * 512
    return _stored(absorb(state, last))


def parents(digests: np.ndarray) -> np.ndarray:
    """The parents of consecutive nodes: digests, and the states before the second and third child."""
    n = -(-len(digests) // ARITY)
    count = np.full(n, ARITY)
    count[-1] = len(digests) - ARITY * (n - 1)
    out = np.zeros(n, _PARENT)
    state = np.repeat(_START[:, None], n, axis=1)
    for slot in range(ARITY):
        here = count > slot
        state[:, here] = absorb(state[:, here], hex_words(digests[slot::ARITY]))
        if slot + 1 < ARITY:
            out["states"][:, 32 * slot:32 * slot + 32] = _stored(state)
    out["digest"] = _finish(state, count)
    return out


def resume(digests: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Parents' digests with each child replaced: the retained state takes the new digest, then
    the siblings on its right."""
    state = absorb(_words(step["state"]), hex_words(digests))
    right = step["count"] - step["slot"] - 1
    for k in range(ARITY - 1):
        here = np.flatnonzero(right > k)
        if len(here):
            at = 32 * (step["slot"][here] + k)[:, None] + np.arange(32)
            state[:, here] = absorb(state[:, here], hex_words(np.take_along_axis(step["others"][here], at, axis=1)))
    return _finish(state, step["count"])


def _levels_of(n: int, levels: int) -> list[int]:
    out = [n]
    for _ in range(levels):
        out.append(-(-out[-1] // ARITY))
    return out


def build_block(digests: np.ndarray, levels: int) -> tuple[bytes, bytes]:
    """Root and stored body (leaves, then the parents of each level) of a block."""
    body, root = [digests.tobytes()], digests
    for _ in range(levels):
        up = parents(root)
        body.append(up.tobytes())
        root = up["digest"]
    return root[0].tobytes(), b"".join(body)


def block_steps(body: bytes, n: int, levels: int, at: np.ndarray) -> np.ndarray:
    """(len(at), levels) steps from the leaves `at` to the block's root, read from its body."""
    out = np.zeros((len(at), levels), _STEP)
    sizes = _levels_of(n, levels)
    nodes, offset = np.frombuffer(body, "u1", 32 * n).reshape(n, 32), 32 * n
    start = _stored(_START[:, None])
    for level in range(levels):
        size = sizes[level]
        up = np.frombuffer(body, _PARENT, sizes[level + 1], offset)
        offset += up.nbytes
        above, slot = at // ARITY, at % ARITY
        step = out[:, level]
        step["count"] = np.minimum(ARITY, size - ARITY * above)
        step["slot"] = slot
        states = np.concatenate([np.repeat(start, len(at), axis=0), up["states"][above]], axis=1).reshape(-1, ARITY, 32)
        step["state"] = states[np.arange(len(at)), slot]
        for k in range(ARITY - 1):
            other = ARITY * above + k + (slot <= k)
            there = other < size
            step["others"][:, 32 * k:32 * k + 32] = np.where(there[:, None], nodes[np.minimum(other, size - 1)], 0)
        nodes, at = up["digest"], above
    return out


# ------------------------------------------------------------------ order and layers

def _field(c: str) -> Column:
    value = F.col(c).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(text: str | Column = "text") -> Column:
    """SHA-256 of doc_id, source, lang, n_chars and the text, as 32 bytes."""
    value = F.col(text) if isinstance(text, str) else text
    last = F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[_field(c) for c in ("doc_id", "source", "lang", "n_chars")], last), 256))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`rows` with `pos` (from 0) in the order of `order` within `group`, nulls first, and the
    group's `total`. Rows are range partitioned over all groups, so one large group, or many equal
    rows, spread over many tasks; offsets come from one count per group and partition."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order, "_tie")]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    at = table(tied.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie")
               .withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = at.groupBy(*group, part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.coalesce(F.sum("n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a table, so that its size on disk decides whether it is broadcast
    shifts = table(counts.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)], "_part",
                                 (before - F.col("first")).alias("_shift"), F.sum("n").over(whole).alias("total")), "shifts")
    same = part == F.col("_part")
    for k, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return at.join(shifts, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "total")


def _height(total: Column) -> Column:
    """Levels until so many nodes are one."""
    return F.coalesce(*[F.when(total <= ARITY ** h, F.lit(h)) for h in range(40)])


def whole_groups(batches, least: int = ARITY ** DEPTH):
    """Batches of sorted rows that hold whole (source, block) groups, `least` rows or more each
    but for the last; and where in them each group begins."""
    held: list = []

    def joined():
        t = pa.Table.from_batches(held).combine_chunks()
        sources = t.column("source").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        blocks = t.column("block").to_numpy()
        return t, np.flatnonzero(np.r_[True, (sources[1:] != sources[:-1]) | (blocks[1:] != blocks[:-1])])

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            t, starts = joined()
            if starts[-1]:
                yield t.slice(0, starts[-1]), starts[:-1]
                t = t.slice(starts[-1])
            held, rows = t.to_batches(), t.num_rows
    if held:
        yield joined()


def _digests(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(-1, 32)


def _blocks(rows: DataFrame, depth: int) -> DataFrame:
    """One row per block of (source, pos, digest, height): source, block, n, levels, height (left
    above it), digest (the block's root) and body."""
    def run(batches):
        for t, starts in whole_groups(batches):
            digests, ends = _digests(t.column("digest")), [*starts[1:], t.num_rows]
            sources, blocks = t.column("source"), t.column("block")
            heights = t.column("height").to_numpy()
            for a, b in zip(starts, ends):
                levels = min(depth, int(heights[a]))
                root, body = build_block(digests[a:b], levels)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sources[int(a)].as_py()], pa.string()), pa.array([blocks[int(a)].as_py()]), pa.array([int(b - a)], pa.int32()),
                     pa.array([levels], pa.int32()), pa.array([int(heights[a]) - levels], pa.int32()), pa.array([root], pa.binary()), pa.array([body], pa.binary())],
                    names=["source", "block", "n", "levels", "height", "digest", "body"])

    cut = rows.select("source", F.expr(f"pos div {ARITY ** depth}").alias("block"), "pos", "digest", "height")
    return (cut.repartition("source", "block").sortWithinPartitions("source", "block", "pos")
            .mapInArrow(run, "source string, block long, n int, levels int, height int, digest binary, body binary"))


def _layers(rows: DataFrame, highest: int, depth: int) -> list[DataFrame]:
    """Tables of blocks, from the leaves up to one block per source."""
    out = []
    for _ in range(max(1, -(-highest // depth))):
        out.append(table(_blocks(rows, depth), "blocks", compression="none"))
        rows = out[-1].select("source", F.col("block").alias("pos"), "digest", "height")
    return out


def _child_paths(blocks: DataFrame, depth: int) -> DataFrame:
    """source, pos, path of the nodes below `blocks`, which carry their own `path`."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for first in range(0, row["n"], 512):
                    at = np.arange(first, min(first + 512, row["n"]))
                    steps = block_steps(row["body"], row["n"], row["levels"], at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["source"]] * len(at), pa.string()), pa.array(row["block"] * ARITY ** depth + at),
                         pa.array([s.tobytes() + row["path"] for s in steps], pa.binary())], names=["source", "pos", "path"])

    return blocks.select("source", "block", "n", "levels", "body", "path").mapInArrow(run, "source string, pos long, path binary")


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    p = paths.select(F.col("source").alias("_s"), F.col("pos").alias("_p"), "path")
    return blocks.join(p, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_p"))).drop("_s", "_p")


def _down(layers: list[DataFrame], paths: DataFrame, depth: int) -> DataFrame:
    """Blocks of the lowest layer with their paths, from the paths of the highest layer's blocks."""
    for blocks in reversed(layers[1:]):
        paths = _child_paths(_with_paths(blocks, paths), depth)
    return _with_paths(layers[0], paths)


@dataclass
class Manifest:
    """`leaves`: source, pos, digest and the other columns of the rows. `blocks`: the stored blocks
    of leaves, each with its path (steps up to the root) and `subroot`. `root`: 32 bytes, None for
    an empty table."""
    leaves: DataFrame
    blocks: DataFrame
    root: bytes | None
    depth: int = DEPTH


def build(rows: DataFrame, depth: int = DEPTH) -> Manifest:
    """The manifest of `rows`: source, doc_id, digest (32 bytes) and any other columns. Leaves of a
    source ascend by doc_id (null first), rows of one doc_id by digest; equal rows are leaves of
    their own. An empty table has no root."""
    leaves = numbered(rows, ["source"], ["doc_id", "digest"])
    tallest = leaves.agg(F.max("total")).first()[0]
    if tallest is None:
        empty = leaves.select("source", F.col("pos").alias("block"), F.lit(0).alias("n"), F.lit(0).alias("levels"),
                              F.col("digest").alias("body"), F.col("digest").alias("path"), F.col("digest").alias("subroot"))
        return Manifest(leaves, empty, None, depth)

    def height(n):
        return next(h for h in range(40) if n <= ARITY ** h)

    low = _layers(leaves.select("source", "pos", "digest", _height(F.col("total")).alias("height")), height(tallest), depth)
    sub = numbered(low[-1].select("source", "digest"), [], ["source"])
    n_sources = sub.agg(F.max("total")).first()[0]
    one = F.lit(None).cast("string")
    top = _layers(sub.select(one.alias("source"), "pos", "digest", _height(F.col("total")).alias("height")), height(n_sources), depth)
    root = bytes(top[-1].first()["digest"])
    roof = top[-1].select("source", F.col("block").alias("pos"), F.lit(b"").alias("path"))
    above = _child_paths(_down(top, roof, depth), depth).select(F.col("pos").alias("_pos"), "path")
    subroots = sub.join(above, F.col("pos") == F.col("_pos")).select("source", F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"))
    subroots = table(subroots, "subroots", compression="none")
    blocks = _down(low, subroots.drop("subroot"), depth)
    named = subroots.select(F.col("source").alias("_s"), "subroot")
    blocks = blocks.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return Manifest(leaves, blocks, root, depth)


def fold(manifest: Manifest, replacement: str = "digest", columns=("doc_id",)) -> DataFrame:
    """For every leaf: `columns`, leaf, subroot, proof_sha256 (of the siblings' hexadecimal digests
    from the leaf up) and folded_root, all hexadecimal: the root that results when the column
    `replacement` (32 bytes) stands in the leaf's place. A block and its leaves meet in one task,
    the block first."""
    columns, depth = list(columns), manifest.depth
    rows = manifest.leaves
    types = {c: rows.schema[c].dataType.simpleString() for c in columns}
    heads = manifest.blocks.selectExpr(
        "source", "block", "-1L AS pos", "body", "n", "levels", "path", "subroot",
        *[f"CAST(NULL AS {t}) AS `{c}`" for c, t in types.items() if c != "source"], "CAST(NULL AS BINARY) AS _new")
    body = rows.select(
        "source", F.expr(f"pos div {ARITY ** depth}").alias("block"), "pos", F.lit(None).cast("binary").alias("body"), F.lit(None).cast("int").alias("n"),
        F.lit(None).cast("int").alias("levels"), F.lit(None).cast("binary").alias("path"), F.lit(None).cast("binary").alias("subroot"),
        *[c for c in columns if c != "source"], F.col(replacement).alias("_new"))

    def run(batches):
        for t, starts in whole_groups(batches):
            yield from _fold_rows(t, starts, columns, ARITY ** depth)

    schema = ", ".join([f"`{c}` {types[c]}" for c in columns] + ["leaf string", "subroot string", "proof_sha256 string", "folded_root string"])
    return (heads.unionByName(body).repartition("source", "block").sortWithinPartitions("source", "block", "pos")
            .mapInArrow(run, schema))


def _fold_rows(t: pa.Table, starts, columns, size: int):
    ends = [*starts[1:], t.num_rows]
    kept, steps, subroots, leaves = [], [], [], []
    for a, b in zip(starts, ends):
        a, b = int(a), int(b)
        head = {c: t.column(c)[a].as_py() for c in ("body", "n", "levels", "path", "subroot")}
        at = t.column("pos").slice(a + 1, b - a - 1).to_numpy() % size
        inside = block_steps(head["body"], head["n"], head["levels"], at)
        above = np.frombuffer(head["path"], _STEP)
        steps.append(np.concatenate([inside, np.broadcast_to(above, (len(at), len(above)))], axis=1))
        leaves.append(np.frombuffer(head["body"], "u1", 32 * head["n"]).reshape(-1, 32)[at])
        subroots += [head["subroot"].hex()] * len(at)
        kept += range(a + 1, b)
    rows = t.take(pa.array(kept, pa.int64()))
    longest = max(s.shape[1] for s in steps)
    path = np.zeros((len(kept), longest), _STEP)
    first = 0
    for s in steps:
        path[first:first + len(s), :s.shape[1]] = s
        first += len(s)
    now = _digests(rows.column("_new")).copy()
    siblings = []
    for level in range(longest):
        step = path[:, level]
        here = np.flatnonzero(step["count"])
        if len(here):
            now[here] = resume(now[here], step[here])
        text = _HEX[step["others"]].reshape(len(step), 128)
        text = np.where(np.arange(128) < 64 * (np.maximum(step["count"], 1) - 1)[:, None], text, 0)
        siblings.append(np.ascontiguousarray(text).view("S128")[:, 0].tolist())
    proofs = [hashlib.sha256(b"".join(x)).hexdigest() for x in zip(*siblings)] if siblings else [hashlib.sha256().hexdigest()] * len(kept)
    yield pa.RecordBatch.from_arrays(
        [rows.column(c).combine_chunks() for c in columns]
        + [pa.array([x.tobytes().hex() for x in np.concatenate(leaves)], pa.string()), pa.array(subroots, pa.string()), pa.array(proofs, pa.string()),
           pa.array([x.tobytes().hex() for x in now], pa.string())],
        names=[*columns, "leaf", "subroot", "proof_sha256", "folded_root"])


def audit(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of `docs`
    (columns doc_id, source, lang, n_chars, text; others are ignored). Rows whose doc_id has an
    even CRC-32 are folded as if the line feeds of their text were gone; a null doc_id or text is
    never changed. Empty and null texts, and repeated rows, are leaves like any other; an empty
    table gives an empty one."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = table(docs.select("doc_id", "source", leaf_digest().alias("digest"), leaf_digest(changed).alias("fresh")),
                 "leaves", compression="none")
    manifest = build(rows, depth)
    root = manifest.root.hex() if manifest.root else None
    out = fold(manifest, "fresh")
    return out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.lit(root)).alias("verified"))
