"""Exact ranks and running sums without a single-task sort.

Each helper cuts the order into buckets, counts per bucket, turns the counts into offsets
(one short table), and ranks only inside buckets. A window over all rows of one key is never
needed, so a key that holds a third of the data is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alleleflow.functions.exprs import col

INF = float("inf")


def bucket_rank(df: DataFrame, bucket: str, order, keys=(), limit: int | None = None,
                name: str = "rank") -> DataFrame:
    """1-based rank inside `keys` by (bucket, *order). With `limit`, buckets that start after
    the limit are dropped before the row-level shuffle, then ranks above it are dropped."""
    keys = list(keys)
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys).orderBy(bucket)
    offsets = counts.select(
        *keys, bucket,
        F.coalesce(F.sum("_n").over(by_key.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"))
    if limit is not None:
        offsets = offsets.where(F.col("_before") < limit)
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    out = (df.join(offsets, [*keys, bucket])
           .withColumn(name, F.col("_before") + F.row_number().over(inside))
           .drop("_before"))
    return out if limit is None else out.where(F.col(name) <= limit)


def hash_rank(df: DataFrame, order_hash: str, keys=(), limit: int | None = None,
              digits: int = 4, name: str = "rank") -> DataFrame:
    """Rank by a hexadecimal hash column. Its leading digits are uniform buckets, so every
    bucket holds about 1/16**digits of the rows. The hash must come from a unique key."""
    b = df.withColumn("_bucket", F.substring(order_hash, 1, digits))
    return bucket_rank(b, "_bucket", [order_hash], keys, limit, name).drop("_bucket")


def site_rank(df: DataFrame, keys=("chrom",), pos: str = "pos", bin_size: int = 1_000_000,
              ties=(), limit: int | None = None, name: str = "rank") -> DataFrame:
    """Rank of a site inside `keys` by position; a bucket is one genomic bin."""
    b = df.withColumn("_bin", F.floor(F.col(pos) / bin_size))
    return bucket_rank(b, "_bin", [pos, *ties], keys, limit, name).drop("_bin")


def value_splits(df: DataFrame, values, n: int | None = None) -> list[list[float]]:
    """At most n-1 approximate quantiles of each column, in one pass: the only thing that
    reaches the driver. By default there are more buckets than shuffle partitions."""
    if n is None:
        n = max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = [i / n for i in range(1, n)]
    got = df.agg(*[F.percentile_approx(F.col(v).cast("double"), at, 20 * n)
                   for v in values]).first()
    return [sorted(set(q or [])) for q in got]


def prefix_sums(df: DataFrame, value: str, sums: dict[str, Column], keys=(),
                n_splits: int | None = None, splits: list[float] | None = None) -> DataFrame:
    """One row per distinct (keys, value) with each sum, the sum over smaller values
    (`<name>_below`) and the sum over the whole key (`<name>_total`).

    Rows are first collapsed to distinct values (map-side combined), then ordered inside
    range buckets. Results do not depend on where the splits fall."""
    keys, names = list(keys), list(sums)
    rows = df.where(F.col(value).isNotNull())
    if splits is None:
        splits = value_splits(rows, [value], n_splits)[0]
    distinct = rows.groupBy(*keys, value).agg(*[e.alias(n) for n, e in sums.items()])
    distinct = distinct.withColumn("_v", F.col(value).cast("double"))
    inner = splits or [0.0]
    distinct = Bucketizer(splits=[-INF, *inner, INF], inputCol="_v", outputCol="_bucket",
                          handleInvalid="keep").transform(distinct).drop("_v")
    by_key = Window.partitionBy(*keys).orderBy("_bucket")
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    offsets = distinct.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(n) for n in names])
    offsets = offsets.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}_before") for n in names],
        *[F.sum(n).over(Window.partitionBy(*keys)).alias(f"{n}_total") for n in names])
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    return distinct.join(offsets, [*keys, "_bucket"]).select(
        *keys, value, *names,
        *[(F.col(f"_{n}_before") + F.coalesce(F.sum(n).over(inside), F.lit(0)))
          .alias(f"{n}_below") for n in names],
        *[f"{n}_total" for n in names])


def exact_median(df: DataFrame, value: str, keys=(), name: str = "median") -> DataFrame:
    """Exact median per key (mean of the two middle values for an even count)."""
    p = prefix_sums(df, value, {"n": F.count(F.lit(1))}, keys)
    lower = F.floor((F.col("n_total") + 1) / 2)
    upper = F.floor((F.col("n_total") + 2) / 2)

    def holds(position):
        return (F.col("n_below") < position) & (position <= F.col("n_below") + F.col("n"))

    return p.groupBy(*keys).agg(
        ((F.max(F.when(holds(lower), col(value))) + F.max(F.when(holds(upper), col(value))))
         / 2).alias(name))
