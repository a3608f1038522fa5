"""A store of site tables that join without a shuffle: each is bucketed by position once, when it is
written, and sorted inside its buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("chrom", "pos")


def write_store(sites: DataFrame, name: str, buckets: int = 64, keys=KEYS) -> DataFrame:
    """`sites` as the table `name` of the session's warehouse, in `buckets` buckets of one sorted file
    each, and the table read back. Tables that shall be joined need the same number of buckets; a
    bucket should hold some hundred megabytes. The buckets are cut by the whole key, so a crowded
    region is spread over all of them."""
    (sites.repartition(buckets, *keys).sortWithinPartitions(*keys).write.mode("overwrite")
     .bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name))
    return sites.sparkSession.table(name)


def drop_store(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def intersect_stores(spark: SparkSession, panel: str, call_sets: dict[str, str], keys=KEYS) -> DataFrame:
    """Sites of the stored table `panel` that all stored call sets (tag: table) hold, with the call
    sets' columns as `<tag>_<column>`. Call sets have one row per position."""
    def renamed(tag, name):
        t = spark.table(name)
        return t.select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in t.columns if c not in keys])
    # the tables meet bucket by bucket: a broadcast would only copy one of them to everyone
    return reduce(lambda a, b: a.hint("merge").join(b.hint("merge"), list(keys)),
                  [renamed(t, n) for t, n in call_sets.items()], spark.table(panel))
