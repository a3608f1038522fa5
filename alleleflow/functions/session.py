"""Session helpers: cluster-safe lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_path(spark, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back, so that iterative fits
    neither recompute it nor lose it with an executor. The folder is the session's
    spark.checkpoint.dir; only where none is set (local tests) a temporary one is used."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoint_dir(spark) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def small_side(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """`df` marked for broadcast if it has at most `max_rows` rows, otherwise unchanged, so that
    the join falls back to a shuffle. Meant for tables derived from sample lists, which are
    cheap to count."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
