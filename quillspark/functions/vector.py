"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if a vector is null or their lengths differ."""
    value = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), value)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def usable(a: Column) -> Column:
    """Not null, finite and not all zero."""
    n = norm(a)
    return a.isNotNull() & n.isNotNull() & ~F.isnan(n) & (n > 0) & (n < float("inf"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, null where a vector is not usable."""
    return F.when(usable(a) & usable(b), dot(a, b) / (norm(a) * norm(b)))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(usable(a), F.transform(a, lambda x: x.cast("double") / n))


def mean_pool(df: DataFrame, keys: list[str], vec_col: str) -> DataFrame:
    """``(keys, vector)``: the sum of the unit vectors of each group, made unit length again. Unusable vectors are left
    out; a group of them, or one whose sum is zero, gives no row. The sum per place is combined map-side, so a group of
    any size costs one row per place and partition."""
    unit_rows = df.select(*keys, unit(F.col(vec_col)).alias("_u")).where(F.col("_u").isNotNull())
    places = unit_rows.select(*keys, F.posexplode("_u").alias("_p", "_x")).groupBy(*keys, "_p").agg(F.sum("_x").alias("_s"))
    whole = places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_s"))), lambda r: r["_s"]).alias("_v"))
    return whole.select(*keys, unit(F.col("_v")).alias("vector")).where(F.col("vector").isNotNull())
