"""Sums of whole arrays per key: matrices and histograms are never taken apart into entries."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ship(module: str) -> None:
    """Send the functions of an imported module to tasks as they are, so that executors need not
    have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def doubles(values: pa.Array) -> list[np.ndarray]:
    """The rows of an Arrow column of double arrays, or of their bytes."""
    if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type):
        return [np.frombuffer(v.as_buffer()) for v in values]
    flat = values.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def sum_arrays(df: DataFrame, keys, column: str, spread: int = 32, parts: int | None = None) -> DataFrame:
    """Element-wise sums of the column `column` (arrays of doubles, or their bytes, of equal lengths
    within a key) per `keys`, in levels: the arrays of a key, at most one per task of `df` say, first meet in `spread` groups and
    then in one, so that no task adds up more than a share of them. Arrays travel as they are. With
    `parts` = 1 (all of `df` in one partition, one array per key) nothing is left to add."""
    keys = list(keys)
    df = df.select(*keys, column)
    if parts == 1:
        return df
    schema = df.schema

    def add_up(batches):
        held: dict = {}
        types = None
        for batch in batches:
            types = batch.schema
            values = batch.column(column)
            for key, v in zip(zip(*[batch.column(k).to_pylist() for k in keys]), doubles(values)):
                if key in held:
                    held[key] += v
                else:
                    held[key] = v.copy()
        for key, v in held.items():
            v = v.tobytes() if pa.types.is_binary(types.field(column).type) else v
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([x], types.field(k).type) for k, x in zip(keys, key)], pa.array([v], types.field(column).type)],
                schema=pa.schema([types.field(k) for k in (*keys, column)]))

    salted = df.withColumn("_salt", F.spark_partition_id() % spread)
    for by in ([*keys, "_salt"], keys):
        salted = salted.repartition(*by).select(*keys, column).mapInArrow(add_up, schema)
        if by is not keys:
            salted = salted.select(*keys, column)
    return salted
