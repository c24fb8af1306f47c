"""Global ranks and running sums that don't need all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.shared import materialize

#: Up to so many rows a plain global window (one task) is the faster way.
ONE_TASK_ROWS = 200_000


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows range-partitioned by ``order`` and written once, so that the partition of a row never changes; equal
    keys are always in one partition."""
    return materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")


def global_rank(df: DataFrame, order: list[Column], name: str, rows: int | None = None, ties: bool = True) -> DataFrame:
    """Adds ``name``: RANK (or ROW_NUMBER if not ``ties``) over all rows by ``order``.

    Over ``ONE_TASK_ROWS`` rows, the rank within range partitions plus the sizes of the partitions before: one number
    per partition is all that is joined. Equal rows share a rank; an empty table stays empty."""
    rows = df.count() if rows is None else rows
    fn = F.rank if ties else F.row_number
    if rows <= ONE_TASK_ROWS:
        return df.withColumn(name, fn().over(W.orderBy(*order)).cast("long"))
    ranged = _ranged(df, order)
    sizes = ranged.groupBy("_part").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return ranged.join(before, "_part").withColumn(name, (fn().over(W.partitionBy("_part").orderBy(*order)) + F.col("_before")).cast("long")).drop("_part", "_before")


def running_sum(df: DataFrame, order: list[Column], value: str, name: str, rows: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows up to this one in the total order ``order``; nulls count 0."""
    rows = df.count() if rows is None else rows
    frame = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    v = F.coalesce(F.col(value), F.lit(0))
    if rows <= ONE_TASK_ROWS:
        return df.withColumn(name, F.sum(v).over(frame(W.orderBy(*order))))
    ranged = _ranged(df, order)
    sizes = ranged.groupBy("_part").agg(F.sum(v).alias("_s"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    return ranged.join(before, "_part").withColumn(name, F.sum(v).over(frame(W.partitionBy("_part").orderBy(*order))) + F.col("_before")).drop("_part", "_before")


def budget_prefix(df: DataFrame, order: list[Column], size: str, budget: int | None, rows: int | None = None) -> DataFrame:
    """The longest prefix by ``order`` whose sizes sum up to ``budget`` at most: whole rows, and a row that does not fit
    cuts off all after it. ``order`` must be total. None is no limit."""
    if budget is None:
        return df
    return running_sum(df, order, size, "_running", rows).where(F.col("_running") <= budget).drop("_running")
