"""Prefix sums over long tables without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the dense key in one bucket.
BUCKET = 1 << 16


def running_start(rows: DataFrame, value: str, order: str, name: str, size: int) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over rows of lesser ``order``.

    ``order`` is dense in 0..size-1. Buckets are summed first; only their sums,
    one a BUCKET of rows, go through a window of one partition.
    """
    if size <= BUCKET:
        before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))
    cut = rows.withColumn("_bucket", F.floor(F.col(order) / BUCKET))
    sums = cut.groupBy("_bucket").agg(F.sum(value).alias("_sum"))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(starts, "_bucket").withColumn(name, (F.col("_start") + F.col("_local")).cast("long")).drop("_bucket", "_start", "_local")
