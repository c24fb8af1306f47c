"""Integrity and publication of derived tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one side only, with ``side`` (a or b)."""
    return a.subtract(b).withColumn("side", F.lit("a")).unionByName(b.subtract(a).withColumn("side", F.lit("b")))


def differential(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, action)``: what to delete and what to insert so that ``old`` holds the keys of ``new``; identical sides
    give no rows. Both anti-joins compare distinct keys and share their partitioning. Null keys equal one another."""
    one, two = (df.select(*keys).distinct() for df in (old, new))
    same = lambda x, y: [x[k].eqNullSafe(y[k]) for k in keys]
    gone = one.join(two, same(one, two), "left_anti").withColumn("action", F.lit("delete"))
    added = two.join(one, same(two, one), "left_anti").withColumn("action", F.lit("insert"))
    return gone.unionByName(added)


def changes(stored: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """``(key, change)`` of each key: new, changed, same or deleted, by null-safe comparison of versions."""
    s, c = stored.select(F.col(key).alias("_k"), F.col(version).alias("_v")), current.select(key, version)
    j = c.join(s, c[key] == s["_k"], "full_outer")
    change = F.when(F.col("_k").isNull(), "new").when(c[key].isNull(), "deleted").when(c[version].eqNullSafe(F.col("_v")), "same").otherwise("changed")
    return j.select(F.coalesce(c[key], F.col("_k")).alias(key), change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key, and the others of ``new`` added."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def content_hash(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by, rows, digest)``: one digest of the multiset of rows (of each value of ``by``), whatever their order and
    partitioning.

    Four independent 64-bit hashes of each row are summed exactly, so everything combines map-side and no task holds
    more than four numbers; the digest is that of the sums and the count."""
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(k), row).cast("decimal(20,0)")).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *sums).select(*by, "rows", F.sha2(F.concat_ws(",", "rows", "s0", "s1", "s2", "s3"), 256).alias("digest"))


def reusable(wanted: DataFrame, cache: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``wanted`` with the cached ``value`` of equal keys (null where there is none, which is what is left to compute).
    Of several cached rows of a key the smallest value counts."""
    c = cache.groupBy(*keys).agg(F.min(value).alias(value))
    return wanted.join(c, list(keys), "left")
