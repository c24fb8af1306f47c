"""Spans, ranges, headings and greedy packing."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.shared import sequential


def sweep(spans: DataFrame, id_col: str = "id", first: str = "product", second: str = "condition") -> DataFrame:
    """``(id, begin, finish, kind)``: overlapping spans (``begin, finish, kind``) resolved, ``first`` winning where both
    kinds cover a place, neighbours of one kind merged. Empty and null spans give nothing.

    Events of +1 and -1 with running sums, then gaps and islands; all windows are per text, never global."""
    ok = spans.where(F.col("finish") > F.col("begin"))
    events = ok.select(id_col, F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("d")), F.struct(F.col("finish").alias("at"), F.lit(-1).alias("d")))).alias("e"), "kind")
    delta = events.groupBy(id_col, F.col("e.at").alias("at")).agg(F.sum(F.when(F.col("kind") == first, F.col("e.d")).otherwise(0)).alias("a"), F.sum(F.when(F.col("kind") == second, F.col("e.d")).otherwise(0)).alias("b"))
    w = W.partitionBy(id_col).orderBy("at")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    pieces = delta.select(id_col, F.col("at").alias("begin"), F.lead("at").over(w).alias("finish"), F.sum("a").over(run).alias("na"), F.sum("b").over(run).alias("nb"))
    named = pieces.where("finish IS NOT NULL AND (na > 0 OR nb > 0)").withColumn("kind", F.when(F.col("na") > 0, first).otherwise(second))
    v = W.partitionBy(id_col).orderBy("begin")
    new = F.coalesce(((F.lag("finish").over(v) != F.col("begin")) | (F.lag("kind").over(v) != F.col("kind"))).cast("int"), F.lit(1))
    island = named.withColumn("_n", new).withColumn("_i", F.sum("_n").over(v.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(id_col, "_i", "kind").agg(F.min("begin").alias("begin"), F.max("finish").alias("finish")).select(id_col, "begin", "finish", "kind")


def range_gaps(df: DataFrame, group: Sequence[str], begin: str, finish: str) -> DataFrame:
    """``(group, begin, finish, problem, size)``: gaps and overlaps between consecutive ranges of a group."""
    w = W.partitionBy(*group).orderBy(begin, finish)
    before = F.max(finish).over(w.rowsBetween(W.unboundedPreceding, -1))
    d = df.withColumn("_p", before).where(F.col("_p").isNotNull()).withColumn("size", F.col(begin) - F.col("_p") - 1)
    return d.where("size <> 0").select(*group, begin, finish, F.when(F.col("size") > 0, "gap").otherwise("overlap").alias("problem"), F.abs("size").alias("size"))


def headings(lines: DataFrame) -> DataFrame:
    """``(id, n, level, title, body_end, subtree_end, path)`` of the Markdown headings in a ``(id, n, line)`` table, page
    markers left out: the line after the heading's own text, the line after its subtree, and the chain of titles."""
    h = lines.where(F.col("line").rlike(r"^\s{0,3}#{1,6}\s+\S") & ~F.col("line").rlike(r"(?i)^\s{0,3}#{1,6}\s+(?:pagina|page)\s+\d+(?:\s+(?:din|of)\s+\d+)?\s*#*\s*$"))
    h = h.select("id", "n", F.length(F.regexp_extract("line", r"^\s{0,3}(#{1,6})\s", 1)).alias("level"), F.regexp_replace(F.regexp_extract("line", r"^\s{0,3}#{1,6}\s+(.+?)\s*$", 1), r"\s*#*\s*$", "").alias("title"))
    last = lines.groupBy("id").agg((F.max("n") + 1).alias("_end"))
    w = W.partitionBy("id").orderBy("n")
    after = w.rowsBetween(1, W.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= k, F.col("n"))).over(after) for k in range(1, 7)]
    subtree = ends[5]
    for k in range(5, 0, -1):
        subtree = F.when(F.col("level") == k, ends[k - 1]).otherwise(subtree)
    # the open heading of each level: the last one of that level, unless a higher one came after it
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    seen = {k: F.max(F.when(F.col("level") == k, F.struct("n", "title"))).over(upto) for k in range(1, 7)}
    h = h.withColumn("body_end", F.lead("n").over(w)).withColumn("subtree_end", subtree)
    for k in range(1, 7):
        h = h.withColumn(f"_s{k}", seen[k])
    chain = []
    for k in range(1, 7):
        closed = F.lit(False)
        for j in range(1, k):
            closed = closed | F.coalesce(F.col(f"_s{j}.n") > F.col(f"_s{k}.n"), F.lit(False))
        chain.append(F.when((F.col("level") >= k) & ~closed, F.col(f"_s{k}.title")))
    return h.withColumn("path", F.concat_ws(" > ", *chain)).join(last, "id").select("id", "n", "level", "title", F.coalesce("body_end", "_end").alias("body_end"), F.coalesce("subtree_end", "_end").alias("subtree_end"), "path")


def scope_at(points: DataFrame, scopes: DataFrame, id_col: str = "id", point: str = "n", start: str = "n", value: str = "title") -> DataFrame:
    """As-of join: for each point the last scope that starts at or before it in the same text (null if none). One union
    and one window per text instead of a range join."""
    a = points.select(id_col, F.col(point).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_v"))
    b = scopes.select(id_col, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.col(value).cast("string").alias("_v"))
    w = W.partitionBy(id_col).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_s", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(id_col, F.col("_at").alias(point), F.col("_s").alias("scope"))


class _Taken:
    """Disjoint spans kept sorted, so that a new one is compared with its two neighbours only."""

    def __init__(self):
        self.begins: list[int] = []
        self.ends: list[int] = []

    def add(self, b: int, f: int) -> bool:
        k = bisect_right(self.begins, b)
        if f <= b or (k and self.ends[k - 1] > b) or (k < len(self.begins) and self.begins[k] < f):
            return False
        self.begins.insert(k, b)
        self.ends.insert(k, f)
        return True


def non_overlapping(spans: DataFrame, id_col: str = "id") -> DataFrame:
    """Greedy choice of spans (``begin, finish, priority``) within each text, by priority, then length, then place; each
    choice depends on those before. Empty and null spans are left out."""
    ok = spans.where("finish > begin").withColumn("_len", F.col("begin") - F.col("finish"))
    picked = sequential(ok, [id_col], ["priority", "_len", "begin", "finish"], _Taken, lambda s, r: s.add(r["begin"], r["finish"]), "_kept", "boolean")
    return picked.where("_kept").drop("_kept", "_len")


def pack(sizes: Iterator[int], limit: int) -> list[int]:
    """Batch numbers for items in order: a new batch where the limit would be passed, an oversized item alone."""
    out, batch, used = [], 0, 0
    for s in sizes:
        if used and used + s > limit:
            batch, used = batch + 1, 0
        out.append(batch)
        used += s
        if s > limit:
            batch, used = batch + 1, 0
    return out


def pack_batches(df: DataFrame, group: str, order: Sequence[str], size: str, limit: int) -> DataFrame:
    """Adds ``batch``: first fit in order within each group; null sizes count 0. Sequential by nature; the groups are
    streamed over, whatever their number and size."""

    def step(state: list[int], row: dict) -> int:
        s = int(row[size] or 0)
        if state[1] and state[1] + s > limit:
            state[0], state[1] = state[0] + 1, 0
        batch = state[0]
        state[1] += s
        if s > limit:
            state[0], state[1] = batch + 1, 0
        return batch

    return sequential(df, [group], list(order), lambda: [0, 0], step, "batch", "int")
