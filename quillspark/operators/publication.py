"""What a generation must be before it is published: cached decisions, packed requests, completeness, consistency."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.sync import VersionedTarget
from quillspark.shared import sequential

# What one request holds at most, and the value that a later decision may replace.
MOST_RELATIONS, MOST_UNITS, MOST_SIZE, UNKNOWN = 20, 6, 24_000, "unknown"


def merge_cache(stored: DataFrame, computed: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value, origin)``: stored decisions with computed ones inserted where there is none (``inserted``) and put in
    place of those that are ``UNKNOWN`` (``upgraded``); all others stay as they are (``stored``). Of several computed
    decisions of a key the least counts; null keys meet nothing and are left out."""
    one = computed.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("_new"))
    old = stored.where(F.col(key).isNotNull()).select(key, F.col(value).alias("_old"), F.lit(True).alias("_is"))
    both = old.join(one, key, "full")
    origin = F.when(F.col("_is").isNull(), "inserted").when((F.col("_old") == UNKNOWN) & F.col("_new").isNotNull() & (F.col("_new") != UNKNOWN), "upgraded").otherwise("stored")
    return both.select(key, F.when(origin == "stored", F.col("_old")).otherwise(F.col("_new")).alias(value), origin.alias("origin"))


def grouped_mentions(found: DataFrame, units: DataFrame, unit: str, fragment: str) -> DataFrame:
    """``(unit, mentions array<struct<begin, finish, entry>>, repeated)``: the mentions of each unit with offsets from its
    own beginning. ``found`` holds ``fragment, begin, finish, entry``; ``units`` holds ``unit, fragment, unit_begin,
    unit_end``. Mentions that reach over the end of a unit are none of it; equal ones are gathered once and counted."""
    inside = found.join(units, fragment).where((F.col("begin") >= F.col("unit_begin")) & (F.col("finish") <= F.col("unit_end")))
    moved = inside.select(unit, (F.col("begin") - F.col("unit_begin")).alias("begin"), (F.col("finish") - F.col("unit_begin")).alias("finish"), "entry")
    one = moved.groupBy(unit, "begin", "finish", "entry").agg((F.count("*") - 1).alias("_more"))
    return one.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("begin", "finish", "entry"))).alias("mentions"), F.sum("_more").alias("repeated"))


def pack_requests(rows: DataFrame, bucket: str, order: Sequence[str], relations: str, size: str, most_relations: int = MOST_RELATIONS, most_units: int = MOST_UNITS, most_size: int = MOST_SIZE) -> DataFrame:
    """``rows`` (one a unit) with ``batch``, counted from 0 in each bucket: in order, a unit begins a new batch when with it
    the batch would hold more relations, units or characters than a request may. A unit over a limit by itself is a batch
    of its own. The rows of a bucket stream through one task with three numbers as state."""

    def step(state: list[int], row: dict) -> int:
        need = (row[relations] or 0, 1, row[size] or 0)
        held = state[1:]
        if held[1] and any(h + n > most for h, n, most in zip(held, need, (most_relations, most_units, most_size))):
            state[:] = [state[0] + 1, 0, 0, 0]
        state[1:] = [h + n for h, n in zip(state[1:], need)]
        return state[0]

    return sequential(rows, [bucket], list(order), lambda: [0, 0, 0, 0], step, "batch", "int")


def incomplete(work: DataFrame, decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, problem)``: keys of work without a decision (``missing``), decisions without work (``unexpected``) and keys
    decided more than once (``repeated``). No rows mean that the decisions are complete."""
    keys = list(keys)
    w = work.select(*keys).distinct().withColumn("_w", F.lit(True))
    d = decisions.groupBy(*keys).agg(F.count("*").alias("_n"))
    both = w.join(d, keys, "full")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_w").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
    return both.select(*keys, problem.alias("problem")).where(F.col("problem").isNotNull())


def publish_checked(target: VersionedTarget, rows: DataFrame, based_on: int | None, check: Callable[[DataFrame], DataFrame], whole: bool = True) -> int:
    """Publish ``rows`` only if ``check`` (rows that say what is wrong) finds nothing in them: prepared, checked and then
    swapped in by one compare-and-set; ValueError with the first findings otherwise, and nothing is published. The rows
    are written once and checked as they were written."""
    from quillspark.shared import materialize

    ready = materialize(rows, "prepared")
    wrong = check(ready).limit(5).collect()
    if wrong:
        raise ValueError(f"not published: {wrong}")
    return target.publish(ready, based_on, whole=whole)


@contextmanager
def snapshot(target: VersionedTarget):
    """All reads within the block see one version, whatever is published meanwhile: gives a function that reads it. A
    version that was vacuumed while it was read is an error at the end of the block rather than a wrong result."""
    version = target.version()
    before = target.manifest(version)
    yield lambda schema=None: target.current(schema, version)
    if version is not None and target.manifest(version) != before:
        raise RuntimeError("the version was changed while it was read")


def score_problems(scores: DataFrame, titles: DataFrame, ranking: DataFrame, fragment: str, entity: str, topic: str) -> DataFrame:
    """``(entity, topic, problem)`` of precomputed scores: ``ranking`` where L3 is not the entity's count of positive or mixed
    topics, ``title`` where L1 is not the number of titles that name both, ``negative`` counts, ``twice`` where a pair has
    more than one row. ``ranking`` holds ``entity, eligible``."""
    named = titles.groupBy(entity, topic).agg(F.countDistinct(fragment).alias("_titles"))
    own = scores.groupBy(entity, topic).agg(F.count("*").alias("_n"), *(F.max(c).alias(c) for c in ("l1", "l2", "l3")))
    both = own.join(named, [entity, topic], "left").join(ranking.select(entity, "eligible"), entity, "left")
    problem = (
        F.when(F.col("_n") > 1, "twice").when(F.least("l1", "l2", "l3") < 0, "negative")
        .when(F.col("l1") != F.coalesce("_titles", F.lit(0)), "title").when(F.col("l3") != F.coalesce("eligible", F.lit(0)), "ranking")
    )
    return both.select(entity, topic, problem.alias("problem")).where(F.col("problem").isNotNull())
