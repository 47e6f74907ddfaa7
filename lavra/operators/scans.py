"""Running values within a group, without gathering a group in one task.

A group is cut into buckets along its order. Within a bucket a window computes the
running value; between buckets one row each carries it on. ``bucket`` must not fall
along the order. Groups and buckets may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of one value of an integer order that make a bucket.
ROWS = 256


def _carried(df: DataFrame, keys: list[str], per: DataFrame) -> DataFrame:
    """``df`` with the columns of ``per``, a row a group and bucket."""
    names = [*keys, "__bucket"]
    right = per.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(names)], *[c for c in per.columns if c not in names])
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(right[f"__{i}"]) for i, k in enumerate(names)])
    return df.join(right, same).drop(*[f"__{i}" for i in range(len(names))], "__bucket")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, bucket: Column, name: str, own: bool = False) -> DataFrame:
    """Sum of ``value`` over the rows before in the group, with ``own`` this row too; 0 for none."""
    x = df.withColumn("__v", value).withColumn("__bucket", bucket)
    w = W.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    x = x.withColumn("__local", F.coalesce(F.sum("__v").over(w), F.lit(0)))
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    per = x.groupBy(*keys, "__bucket").agg(F.sum("__v").alias("__t"))
    per = per.select(*keys, "__bucket", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__carry"))
    return _carried(x, keys, per).withColumn(name, F.col("__local") + F.col("__carry")).drop("__v", "__local", "__carry")


def last_before(df: DataFrame, keys: list[str], order: list[str], value: Column, bucket: Column, name: str, after: bool = False) -> DataFrame:
    """The last value that is not null in the rows before, or with ``after`` the first in the rows behind; null for none."""
    x = df.withColumn("__v", value).withColumn("__bucket", bucket)
    local, across = W.partitionBy(*keys, "__bucket").orderBy(*order), W.partitionBy(*keys).orderBy("__bucket")
    place = F.struct(*order)
    held = F.col("__v").isNotNull()
    if after:
        x = x.withColumn("__local", F.first("__v", ignorenulls=True).over(local.rowsBetween(1, W.unboundedFollowing)))
        per = x.groupBy(*keys, "__bucket").agg(F.min_by("__v", F.when(held, place)).alias("__t"))
        per = per.select(*keys, "__bucket", F.first("__t", ignorenulls=True).over(across.rowsBetween(1, W.unboundedFollowing)).alias("__carry"))
    else:
        x = x.withColumn("__local", F.last("__v", ignorenulls=True).over(local.rowsBetween(W.unboundedPreceding, -1)))
        per = x.groupBy(*keys, "__bucket").agg(F.max_by("__v", F.when(held, place)).alias("__t"))
        per = per.select(*keys, "__bucket", F.last("__t", ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1)).alias("__carry"))
    return _carried(x, keys, per).withColumn(name, F.coalesce("__local", "__carry")).drop("__v", "__local", "__carry")


def by_rows(column: str) -> Column:
    """Buckets of an integer order."""
    return F.floor(F.col(column) / ROWS)


def by_day(column: str) -> Column:
    """Buckets of an order in time."""
    return F.to_date(column)
