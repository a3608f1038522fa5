"""Helpers of the text operators: tables cut from their lineage, row keys, byte-bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Only a
    local session that names none gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def table(df: DataFrame, what: str, **options) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and return the table: lineage ends
    there, and a lost executor costs no more than the tasks that it ran."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, *columns: str, key: str = "row") -> DataFrame:
    """`columns` of `docs` and `key`, a number for each row. A stored table that is read twice in
    the same partitions gives the same numbers, and no shuffle is needed for them: `docs` must be
    such a table, or be written as one first."""
    return docs.select(*columns, F.monotonically_increasing_id().alias(key))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def free_name(stem: str, columns: list[str]) -> str:
    """`stem`, lengthened until no column of that name, in any case, is there."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


_filled: dict[str, Callable[[], None]] = {}


def own_cache(owner: str, clear: Callable[[], None] | None = None) -> None:
    """A reused Python worker keeps the word cache of one owner at a time: those that others
    filled are emptied. `clear` empties the owner's."""
    for other in [name for name in _filled if name != owner]:
        _filled.pop(other)()
    if clear:
        _filled[owner] = clear


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice's texts hold about `limit` bytes, one row at least."""
    offsets = batch.column(column).buffers()[1]
    if batch.num_rows == 0:
        return
    if offsets is None:      # no text at all
        yield batch
        return
    array = batch.column(column)
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    ends = np.frombuffer(offsets, dtype=kind)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
        stop = min(max(stop, at + 1), batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def in_slices(f, column: str = "text", limit: int = 2 << 20):
    """For mapInArrow: `f` on slices of bounded bytes instead of on whole batches."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, column, limit):
                yield from f(part)
    return run


def packed_text(name: str = "text") -> Column:
    """The text (null: empty) as a zstd frame, for shuffles of whole texts."""
    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        return texts.map(lambda t: squeeze((t or "").encode("utf-8", "surrogatepass")))

    return pack(F.col(name)).alias(name)


def unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)
