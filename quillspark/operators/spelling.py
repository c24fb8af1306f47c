"""Spelling repair from corpus counts, repeated until nothing changes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import ACCENTED, FOLDED, plain
from quillspark.operators.generation import content_hash
from quillspark.shared import materialize

# Gates of the repairs.
TYPO_LENGTH, TYPO_OWN, TYPO_FREQUENCY, TYPO_TIMES = 5, 2, 100, 30
SPLIT_LENGTH, PIECE_LENGTH, PIECE_FREQUENCY = 8, 5, 100
# Letters at the end that an edit leaves, length from which any edit is a typo, frequency from which the
# first letter may change, and how many times as frequent as the second best a fix is.
ENDING, SAFE_LENGTH, FIRST_LETTER_FREQUENCY, SECOND_BEST = 2, 7, 300, 5
MOST_PASSES = 16
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_WORD = re.compile(r"[^\W\d_]+")
_FOLD = str.maketrans(ACCENTED, FOLDED)


def dropped(word: str) -> set[str]:
    """The word and the words with one letter less. Words one edit apart share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def one_edit(word: str, fix: str) -> bool:
    """Whether the words are one edit apart: a letter dropped, added or changed, or two neighbours swapped."""
    k = next((i for i, (x, y) in enumerate(zip(word, fix)) if x != y), min(len(word), len(fix)))
    a, b = word[k:], fix[k:]
    if len(a) == len(b):
        return bool(a) and ((a[1:] == b[1:] and b[0] in LETTERS) or (a[:2] == b[1::-1] and len(a) > 1 and a[2:] == b[2:]))
    return a[1:] == b if len(a) > len(b) else a == b[1:] and b[0] in LETTERS


def acceptable(word: str, fix: str, frequency: int) -> bool:
    """Whether an edit is a typo rather than an inflection: the last two letters stay, short words only by a swap, and
    the first letter changes only towards a very frequent word."""
    if word[-ENDING:] != fix[-ENDING:] or (word[0] != fix[0] and frequency < FIRST_LETTER_FREQUENCY):
        return False
    return len(word) >= SAFE_LENGTH or (len(word) == len(fix) and sorted(word) == sorted(fix))


def typo_fixes(counts: DataFrame, dictionary: DataFrame, frequency: int = TYPO_FREQUENCY) -> DataFrame:
    """``(word, fix)`` for rare words (``counts``: word, n) outside the ``dictionary`` (word): the dictionary word one
    edit away that is frequent, ``TYPO_TIMES`` times as frequent as the word, and five times as the second best.

    Distinct rare words and frequent ones meet where they are equal but for one letter dropped from either."""
    rare = counts.where((F.length("word") >= TYPO_LENGTH) & (F.col("n") <= TYPO_OWN)).join(dictionary.select("word"), "word", "left_anti")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, n, k) for w, n in zip(*(c.to_pylist() for c in b.columns)) if w.isascii() for k in dropped(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["word", "n", "key"])

    keyed = lambda df: df.select("word", "n").mapInArrow(keys, "word string, n bigint, key string")
    known = keyed(counts.join(dictionary.select("word"), "word", "left_semi").where(F.col("n") >= frequency)).select(F.col("word").alias("fix"), F.col("n").alias("known"), "key")
    met = keyed(rare).join(known, "key").where(F.col("known") >= F.greatest(F.lit(frequency), TYPO_TIMES * F.col("n"))).select("word", "fix", "known").distinct()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([one_edit(w, f) and acceptable(w, f, k) for w, f, k in zip(*(b.column(c).to_pylist() for c in ("word", "fix", "known")))], pa.bool_()))

    good = met.select("word", "fix", "known").mapInArrow(judge, "word string, fix string, known bigint")
    w = W.partitionBy("word").orderBy(F.desc("known"), "fix")
    return good.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("known").over(w)).where("_r = 1 AND (_next IS NULL OR " f"known >= {SECOND_BEST} * _next)").select("word", "fix")


def split_fixes(counts: DataFrame, dictionary: DataFrame, function_words: list[str], frequency: int = PIECE_FREQUENCY) -> DataFrame:
    """``(word, fix)`` for long rare words outside the dictionary that are two frequent words (or a frequent and a
    function word) written together; the split with the most frequent rarer piece wins."""
    rare = counts.where((F.length("word") >= SPLIT_LENGTH) & (F.col("n") <= 3)).join(dictionary.select("word"), "word", "left_anti")
    cuts = rare.select("word", F.explode(F.sequence(F.lit(2), F.length("word") - 2)).alias("k")).select("word", F.expr("substring(word, 1, k)").alias("a"), F.expr("substring(word, k + 1)").alias("b"))
    whole = counts.join(dictionary.select("word"), "word", "left_semi").where((F.length("word") >= PIECE_LENGTH) & (F.col("n") >= frequency)).select("word", "n")
    functional = dictionary.sparkSession.createDataFrame([(w, 1_000_000) for w in sorted(set(function_words))], "word string, n bigint")
    pieces = whole.unionByName(functional).groupBy("word").agg(F.max("n").alias("n"))
    a, b = (pieces.select(F.col("word").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    met = cuts.join(a, "a").join(b, "b").where(~(F.col("a").isin(function_words) & F.col("b").isin(function_words)))
    return met.groupBy("word").agg(F.max_by(F.concat_ws(" ", "a", "b"), F.struct(F.least("na", "nb"), "a")).alias("fix"))


def written_forms(df: DataFrame, text_col: str, fixes: DataFrame) -> DataFrame:
    """``fixes`` with each fix in the spelling, accents included, in which the texts have it most often."""
    wanted = fixes.select(F.col("fix").alias("plain")).distinct()
    forms = df.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"\p{L}+"), F.lit(0))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    best = forms.withColumn("plain", plain("form")).join(wanted, "plain", "left_semi").groupBy("plain").agg(F.max_by("form", F.struct("n", "form")).alias("form"))
    return fixes.join(best, fixes["fix"] == best["plain"], "left").select("word", F.coalesce("form", "fix").alias("fix"))


def folded(text: str) -> str:
    """``functions.text.plain`` of one string."""
    return text.lower().translate(_FOLD)


def carried(word: str, fix: str, accents: bool) -> str:
    """``fix`` in place of ``word``: the letters that the fix leaves keep accents and case of the word, those that it
    changes have the accents of the fix if ``accents``."""
    old, new = folded(word), folded(fix)
    if len(old) != len(word) or len(new) != len(fix):
        return fix
    k = next((i for i, (x, y) in enumerate(zip(old, new)) if x != y), min(len(old), len(new)))
    rest = min(len(old), len(new)) - k
    e = next((i for i in range(rest) if old[-1 - i] != new[-1 - i]), rest)
    middle = (fix if accents else new)[k : len(new) - e]
    return word[:k] + (middle.upper() if word.isupper() else middle) + word[len(word) - e :]


def apply_fixes(df: DataFrame, id_col: str, text_col: str, fixes: DataFrame) -> DataFrame:
    """``(id, text, changes)``: whole words replaced, keeping lower or upper case; words in title case are names and
    stay. Words meet the fixes by their folded form, as they are counted, and keep their accents. Fixes reach the rows by
    a join on their words, so the table of fixes may be of any size. Words are letters only: a fix never changes a number."""
    kind = df.schema[id_col].dataType.simpleString()
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    uses = own.select("id", F.explode(F.array_distinct(F.regexp_extract_all(plain("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word")).join(fixes, "word").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("word", "fix"))).alias("m"))
    joined = own.join(uses, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n = [], []
            for t, pairs in zip(b.column("text").to_pylist(), b.column("m").to_pylist()):
                done = 0
                if t and pairs:
                    to = dict(pairs)
                    accents = folded(t) != t.lower()

                    def sub(m: re.Match) -> str:
                        nonlocal done
                        fix = to.get(folded(m[0]))
                        if fix is None or not (m[0].islower() or m[0].isupper()):
                            return m[0]
                        done += 1
                        return carried(m[0], fix, accents)

                    t = _WORD.sub(sub, t)
                texts.append(t)
                n.append(done)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string()), pa.array(n, pa.int32())], names=["id", "text", "changes"])

    return joined.mapInArrow(run, f"id {kind}, text string, changes int")


def stabilize(df: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = MOST_PASSES) -> tuple[DataFrame, int]:
    """``step`` applied until the table no longer changes, and the number of passes. Each pass is written to the shared
    folder, so lineage stays short and an executor may be lost; a state seen before is a cycle, hence an error."""
    state = materialize(df, "pass")
    seen = [content_hash(state, state.columns).first().digest]
    for n in range(1, most + 1):
        state = materialize(step(state), "pass")
        now = content_hash(state, state.columns).first().digest
        if now == seen[-1]:
            return state, n
        if now in seen:
            raise RuntimeError("the passes go in a cycle")
        seen.append(now)
    raise RuntimeError(f"no stable state after {most} passes")
