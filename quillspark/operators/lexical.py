"""Lexical retrieval: postings, BM25, share of words, phrases."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.shared import materialize

K1, B = 1.2, 0.75
#: Share of an expression's words that a fragment must hold, and the boosts of phrases and headings.
SHARE, PHRASE_BOOST, HEADING_BOOST, SLOP = 0.75, 2.0, 2.0, 1


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(term, id, tf, positions)``, the inverted file of a text column; positions from 0. Terms are plain words."""
    words = df.select(F.col(id_col).alias("id"), F.posexplode(T.words(text_col)).alias("pos", "term"))
    return words.groupBy("term", "id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def term_frequency(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25(df: DataFrame, id_col: str, text_col: str, terms: Sequence[str]) -> DataFrame:
    """``(id, bm25)`` of the rows that hold a term: sum over terms of ln(1 + (n - df + 0.5) / (df + 0.5)) times
    tf (k1 + 1) / (tf + k1 (1 - b + b len / avglen)), k1 = 1.2 and b = 0.75.

    The statistics are one row of one aggregation over all rows; the terms of a question are few, so the frequencies are
    counted in place instead of exploding the corpus. Rows with a null text count as empty ones of the collection."""
    terms = list(dict.fromkeys(terms))
    rows = df.select(F.col(id_col).alias("id"), T.words(text_col).alias("w"))
    rows = rows.select("id", F.size("w").alias("len"), *(term_frequency(F.col("w"), t).alias(f"tf{k}") for k, t in enumerate(terms)))
    rows = materialize(rows, "frequencies")  # texts are read and cut into words once, for the statistics and the scores
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avglen"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))))
    score = F.lit(0.0)
    for k in range(len(terms)):
        tf, docs = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log(1 + (F.col("n") - docs + 0.5) / (docs + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avglen")))
    hit = F.lit(False)
    for k in range(len(terms)):
        hit = hit | (F.col(f"tf{k}") > 0)
    return rows.where(hit).join(F.broadcast(stats)).select("id", score.alias("bm25"))  # stats is one row


def store_postings(df: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Write the inverted file of a text column under ``path``: postings sorted by term, so that a question reads the row
    groups of its terms only, the lengths of the texts, and one row of statistics."""
    inverted = df.select(F.col(id_col).alias("id"), F.explode(T.words(text_col)).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    inverted.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")
    df.select(F.col(id_col).alias("id"), F.size(T.words(text_col)).alias("len")).write.parquet(f"{path}/lengths")
    lengths = df.sparkSession.read.parquet(f"{path}/lengths")
    lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avglen")).write.parquet(f"{path}/statistics")


def stored_bm25(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame:
    """``(id, bm25)`` as ``bm25`` gives it, from the inverted file under ``path``: no text is read. Ids must be unique."""
    hits = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(*dict.fromkeys(terms)))
    found = materialize(hits, "hits")
    docs = found.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the question
    stats = spark.read.parquet(f"{path}/statistics")
    rows = found.join(F.broadcast(docs), "term").join(spark.read.parquet(f"{path}/lengths"), "id").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avglen")))
    return rows.groupBy("id").agg(F.sum(part).alias("bm25"))


def holds_share(words: Column, terms: Sequence[str], share: float = SHARE) -> Column:
    """Whether at least ``share`` of the distinct terms (rounded up, one at least) occur in any order."""
    terms = list(dict.fromkeys(terms))
    held = sum((F.array_contains(words, t).cast("int") for t in terms), F.lit(0))
    return held >= max(1, math.ceil(len(terms) * share))


def holds_phrase(words: Column, phrase: Sequence[str], slop: int = 0) -> Column:
    """Whether the words of ``phrase`` stand in this order with up to ``slop`` other words in between in all."""
    if not phrase:
        return F.lit(False)
    gaps = r"(?: [\p{L}\p{N}]+){0," + str(slop) + "}"
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    if slop == 0:
        return F.contains(text, F.lit(f" {' '.join(phrase)} "))
    return text.rlike(" " + (gaps + " ").join(phrase) + " ")


def expression_match(df: DataFrame, id_col: str, text_col: str, heading_col: str, expression: str) -> DataFrame:
    """``(id, weight)`` of the rows one expression of a question matches: in text or heading (times 2), the share of
    words in any order counts 1 and the words as a phrase with slop 2 more. An expression without words matches none."""
    terms = [w for w in expression_words(expression)]
    if not terms:
        return df.select(F.col(id_col).alias("id"), F.lit(0.0).alias("weight")).limit(0)
    weight = F.lit(0.0)
    for col, boost in ((text_col, 1.0), (heading_col, HEADING_BOOST)):
        w = T.words(col)
        weight = weight + F.when(holds_share(w, terms), boost).otherwise(0.0)
        if len(terms) > 1:
            weight = weight + F.when(holds_phrase(w, terms, SLOP), boost * PHRASE_BOOST).otherwise(0.0)
    return df.select(F.col(id_col).alias("id"), weight.alias("weight")).where(F.col("weight") > 0)


def expression_words(expression: str, most: int = 32) -> list[str]:
    """Words of an expression of the question (on the driver): plain, the generic ones left out unless alone."""
    import re

    table = str.maketrans(T.ACCENTED, T.FOLDED)
    own = re.findall(r"[^\W_]+", expression.lower().translate(table))[:most]
    return [w for w in own if w not in T.GENERIC_WORDS] or own
