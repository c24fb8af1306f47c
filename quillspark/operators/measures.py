"""Estimates, retrieval metrics and corpus measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Recent samples that count, samples needed, percentile and margin (percent) of a budget.
RECENT, LEAST_SAMPLES, PERCENTILE, MARGIN = 200, 20, 0.95, 125


def duration_regression(samples: DataFrame, group: str, x: str, y: str, at: int) -> DataFrame:
    """``(group, samples, seconds)``: duration = rate * size through the origin over all samples of a group, in whole
    seconds rounded up; y in milliseconds. Null where there is no sample with a size. Sums are exact decimals."""
    dx, dy = F.col(x).cast("decimal(18,0)"), F.col(y).cast("decimal(18,0)")
    s = samples.groupBy(group).agg(F.count("*").alias("samples"), F.sum(dx * dy).cast("decimal(38,0)").alias("_xy"), F.sum(dx * dx).cast("decimal(38,0)").alias("_xx"))
    seconds = F.ceil(F.lit(float(at)) * F.col("_xy").cast("double") / (F.lit(1000.0) * F.col("_xx").cast("double"))).cast("long")
    return s.select(group, "samples", F.when(F.col("_xx") > 0, seconds).alias("seconds"))


def token_budget(usage: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``(group, samples, budget)``: 1.25 times the interpolated 95th percentile of the latest 200 values of a group,
    rounded up; null under 20 values. Only the latest rows reach the percentile (a window with a limit per group)."""
    w = W.partitionBy(group).orderBy(F.desc(order))
    recent = usage.where(F.col(value).isNotNull()).select(group, order, value).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= RECENT)
    p = recent.groupBy(group).agg(F.count("*").alias("samples"), F.percentile(value, PERCENTILE).alias("_p"))
    budget = F.floor((F.ceil("_p") * MARGIN + 99) / 100).cast("long")
    return p.select(group, "samples", F.when((F.col("samples") >= LEAST_SAMPLES) & (F.col("_p") > 0), budget).alias("budget"))


def size_report(df: DataFrame, group: str, size: str) -> DataFrame:
    """Count, sum, median, 95th percentile by nearest rank, maximum and the numbers of very large items per group."""
    n = F.count("*").over(W.partitionBy(group))
    r = df.where(F.col(size).isNotNull()).select(group, F.col(size).cast("long").alias("_s")).withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy("_s"))).withColumn("_n", n)
    return r.groupBy(group).agg(
        F.count("*").alias("items"), F.sum("_s").alias("total"), F.floor(F.percentile("_s", 0.5)).cast("long").alias("median"),
        F.max(F.when(F.col("_r") == F.greatest(F.floor(F.col("_n") * 0.95), F.lit(1)), F.col("_s"))).alias("p95"), F.max("_s").alias("largest"),
        F.count_if(F.col("_s") > 2000).alias("over_2000"), F.count_if(F.col("_s") > 5000).alias("over_5000"),
    )


def retrieval_metrics(ranked: DataFrame, case: str, position: str, grade: str, relevant: DataFrame | None = None) -> DataFrame:
    """``(case, precision_at_10, reciprocal_rank, ndcg_at_10, recall_at_50, unjudged_at_10)`` of ranked results with a
    grade each (null: not judged). The ideal order is that of all judged items of the case (``relevant``; without it,
    those of the result)."""
    g = F.coalesce(grade, F.lit(0))
    gain = lambda g, p: (F.pow(F.lit(2.0), g) - 1) / F.log2(p + 1)
    rows = ranked.select(case, F.col(position).alias("_p"), g.alias("_g"), F.col(grade).isNull().alias("_u"))
    got = rows.groupBy(case).agg(
        (F.count_if((F.col("_p") <= 10) & (F.col("_g") > 0)) / 10).alias("precision_at_10"),
        F.coalesce(F.max(F.when(F.col("_g") > 0, 1 / F.col("_p"))), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.sum(F.when(F.col("_p") <= 10, gain(F.col("_g"), F.col("_p")))), F.lit(0.0)).alias("_dcg"),
        F.count_if((F.col("_p") <= 50) & (F.col("_g") > 0)).alias("_hits"),
        F.count_if((F.col("_p") <= 10) & F.col("_u")).alias("unjudged_at_10"),
    )
    judged = (relevant if relevant is not None else ranked).where(F.col(grade) > 0).select(case, F.col(grade).alias("_g"))
    ideal = judged.withColumn("_i", F.row_number().over(W.partitionBy(case).orderBy(F.desc("_g")))).groupBy(case).agg(F.sum(F.when(F.col("_i") <= 10, gain(F.col("_g"), F.col("_i")))).alias("_ideal"), F.count("*").alias("_all"))
    j = got.join(ideal, case, "left")
    return j.select(case, "precision_at_10", "reciprocal_rank", F.coalesce(F.try_divide("_dcg", "_ideal"), F.lit(0.0)).alias("ndcg_at_10"), F.coalesce(F.try_divide("_hits", "_all"), F.lit(0.0)).alias("recall_at_50"), "unjudged_at_10")


def compare_metrics(base: DataFrame, candidate: DataFrame, case: str, better: dict[str, int], tolerance: float = 1e-12) -> DataFrame:
    """``(case, metric, change)``: improved, worse or same for each metric; ``better`` gives 1 where more is better and
    -1 where less is. Cases of one side only are missing or added."""
    out = None
    for metric, sign in better.items():
        b, c = base.select(F.col(case).alias("_c"), F.col(metric).alias("_b")), candidate.select(case, F.col(metric).alias("_n"))
        d = (F.col("_n") - F.col("_b")) * sign
        change = F.when(F.col("_c").isNull(), "added").when(F.col(case).isNull(), "missing").when(d > tolerance, "improved").when(d < -tolerance, "worse").otherwise("same")
        part = b.join(c, F.col("_c") == F.col(case), "full_outer").select(F.coalesce(F.col(case), F.col("_c")).alias(case), F.lit(metric).alias("metric"), change.alias("change"))
        out = part if out is None else out.unionByName(part)
    return out


def folder_rollup(df: DataFrame, path: str) -> DataFrame:
    """``(folder, own, total)``: rows in each folder and in its whole subtree, folders without rows of their own
    included. Rows are counted per folder first; only these few are expanded to their prefixes."""
    own = df.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("_f")).agg(F.count("*").alias("_n"))
    parts = F.split("_f", "/")
    prefixes = own.select("_f", "_n", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("folder"))
    return prefixes.groupBy("folder").agg(F.sum(F.when(F.col("folder") == F.col("_f"), F.col("_n")).otherwise(0)).alias("own"), F.sum("_n").alias("total"))


def category_of(path: Column) -> Column:
    """The folder of a path without the language root."""
    return F.regexp_replace(F.regexp_replace(path, r"^(ro|en)/", ""), r"/?[^/]*$", "")


def latest_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
