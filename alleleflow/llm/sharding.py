"""Shards of near-equal bytes: minimax partition of ordered groups into contiguous shards.

Groups (rows of equal text) are ordered by the hash of their text and never split. The capacity is
the smallest one for which a greedy pass needs no more shards than there are; it is found by binary
search. Under it, cuts are placed so that what is left is spread evenly over the shards left. The driver never sees all groups: it starts from sums over 2^16 hash ranges and, level by
level, opens only those ranges in which a cut can still fall, until these are single groups. A
level gives the driver a number of rows that depends on the number of shards alone."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleleflow.llm.shared import table

_TOP, _MORE, _ALL = 16, 8, 60     # bits of the first level, of each further one, and of a key


def greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Cut where a shard would exceed `capacity`: numbers of units in each shard and before, or
    None if that needs more than `shards`. `ends`: running sum of the units' sizes."""
    cuts, at, before = [], 0, 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, before + capacity, side="right"))
        cuts.append(at)
        if at == len(ends):
            return cuts + [at] * (shards - len(cuts))
        before = int(ends[at - 1]) if at else 0
    return None


def even(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts as of `greedy`, none above a feasible `capacity`, each shard as near as can be to the bytes
    left over the shards left. No shard is empty if there are units enough."""
    n = len(ends)
    starts = np.concatenate([[0], ends])
    least = [n]         # from behind: a cut before these leaves more than the shards left can hold
    for _ in range(shards - 1):
        least.append(int(np.searchsorted(starts, starts[least[-1]] - capacity, side="left")))
    cuts, at = [], 0
    for left, low in zip(range(shards, 0, -1), reversed(least)):
        before = int(starts[at])
        aim = before + (int(starts[-1]) - before) / left
        near = int(np.searchsorted(starts, aim, side="left"))
        if near > at and aim - starts[near - 1] < starts[min(near, n)] - aim:
            near -= 1
        near = max(min(near, n - left + 1), at + 1, low)
        at = min(near, int(np.searchsorted(starts, before + capacity, side="right")) - 1)
        cuts.append(at)
    return cuts


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Binary search of the least feasible capacity over units that stay whole."""
    ends = np.cumsum(sizes.astype(np.int64))
    total = int(ends[-1]) if len(ends) else 0
    lo, hi = max(-(-total // shards), int(sizes.max(initial=0))), total
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if greedy(ends, mid, shards) is not None else (mid + 1, hi)
    return lo


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """Upper keys (excluded) of all shards but the last. groups: key (long below 2^60), size."""
    def sums(level: int, rows: DataFrame):
        return (rows.groupBy(F.shiftright("key", _ALL - level).alias("k"))
                .agg(F.sum("size").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect())

    # a unit: first key, size, level, whether a single key
    units = sorted((r["k"] << (_ALL - _TOP), r["size"], _TOP, r["lo"] == r["hi"]) for r in sums(_TOP, groups))
    while units:
        sizes = np.array([u[1] for u in units], dtype=np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        high = smallest_capacity(sizes, shards)
        low = max(-(-total // shards), max((u[1] for u in units if u[3]), default=0))
        # cut j lies between what j shards of the least and of the largest possible capacity hold
        opened = set()
        for j in range(1, shards):
            a = int(np.searchsorted(ends, j * low - int(sizes.max()), side="left"))
            b = int(np.searchsorted(ends, j * high, side="right"))
            opened.update(i for i in range(max(0, a), min(b + 1, len(units))) if not units[i][3])
        if not opened:
            break
        fine = []
        for level in sorted({units[i][2] for i in opened}):
            want = [units[i][0] >> (_ALL - level) for i in opened if units[i][2] == level]
            part = groups.where(F.shiftright("key", _ALL - level).isin(want))
            more = min(level + _MORE, _ALL)
            fine += [(r["k"] << (_ALL - more), r["size"], more, r["lo"] == r["hi"] or more == _ALL) for r in sums(more, part)]
        units = sorted([u for i, u in enumerate(units) if i not in opened] + fine)
    if not units:
        return []
    sizes = np.array([u[1] for u in units], dtype=np.int64)
    cuts = even(np.cumsum(sizes), smallest_capacity(sizes, shards), shards)
    return [units[c][0] if c < len(units) else 1 << _ALL for c in cuts[:-1]]


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 8), text_crc32, shard, slot (gapless from 0 in
    each shard, by doc_id, nulls first). Rows of equal text (null: empty) share a shard. Extra
    columns are ignored; repeated rows have a slot each; an empty table gives an empty one."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long").alias("key"))
    rows = table(rows, "sized")
    groups = table(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    cuts = cut_keys(groups, shards)
    shard = F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["shard", "doc_id", "key"]
    ranged = (rows.withColumn("shard", shard).repartitionByRange(n, *order).sortWithinPartitions(*order)
              .select("doc_id", "size", "text_crc32", "shard", F.spark_partition_id().alias("part")))

    def number(batches):
        """Running number of a row within its partition and shard."""
        last, seen = -1, 0
        for batch in batches:
            s = batch.column("shard").to_numpy()
            first = np.flatnonzero(np.diff(s, prepend=s[0]) != 0)
            start = np.zeros(len(s), dtype=np.int64)
            start[first] = first
            at = np.arange(len(s)) - np.maximum.accumulate(start)
            if s[0] == last:
                at[:first[0] if len(first) else None] += seen
            last, seen = s[-1], int(at[-1]) + 1
            yield batch.append_column("at", pa.array(at))

    numbered = table(ranged.mapInArrow(number, "doc_id long, size long, text_crc32 long, shard int, part int, at long"), "numbered")
    # one row per partition and shard that meet: less than partitions + shards, as shards are ranges
    counts = numbered.groupBy("shard", "part").agg(F.count("*").alias("n")).orderBy("shard", "part").collect()
    base, before = [], {}
    for r in counts:
        base.append((r["shard"], r["part"], before.get(r["shard"], 0)))
        before[r["shard"]] = base[-1][2] + r["n"]
    bases = F.broadcast(spark.createDataFrame(base, "shard int, part int, base long"))
    return (numbered.join(bases, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("at")).alias("slot")))
