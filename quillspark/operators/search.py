"""Hybrid search: conditions, BM25 rank and cosine rank fused by a formula, cut by a size budget."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import vector as V
from quillspark.functions.formula import SEARCH_DEFAULT, search_formula
from quillspark.operators import lexical, ranking
from quillspark.shared import materialize

NO_RANK = float("inf")
#: Characters put before a heading and its text where the evidence is shown, by language.
HEADING_OVERHEAD = {"ro": len("Secțiune: ") + 2, "en": len("Section: ") + 2}


@dataclass(frozen=True)
class Signals:
    conditions: bool = True
    lexical: bool = True
    semantic: bool = True

    @staticmethod
    def parse(code: str) -> Signals:
        letters = set(code.strip().upper())
        if not letters or letters - set("ABC"):
            raise ValueError("signals are a non-empty choice of A, B and C")
        return Signals("A" in letters, "B" in letters, "C" in letters)

    def effective(self, conditions: Sequence[str]) -> Signals:
        """Without a condition in the question the first signal can't contribute; alone it stays, finding nothing."""
        if self.conditions and not conditions and (self.lexical or self.semantic):
            return Signals(False, self.lexical, self.semantic)
        return self

    def best(self, source: str = SEARCH_DEFAULT, k: float = 10) -> float:
        """The highest score a fragment can reach with these signals."""
        p = float(self.conditions)
        return search_formula(source, k).value(P1=p, P2=p, L=1.0 if self.lexical else NO_RANK, V=1.0 if self.semantic else NO_RANK, K=k)


def scope(chunks: DataFrame, language: str | None = None, categories: Sequence[str] | None = None) -> DataFrame:
    """The fragments a search looks at, filtered before any rank or statistic. None is no filter; an empty list of
    categories gives no rows."""
    out = chunks if language is None else chunks.where(F.col("language") == language)
    return out if categories is None else out.where(F.col("category_id").isin(*categories) if categories else F.lit(False))


def overlaps(array_col: str, names: Sequence[str]) -> Column:
    """1 if the array shares a name with ``names``, else 0; null and empty arrays share none."""
    if not names:
        return F.lit(0)
    return F.coalesce(F.arrays_overlap(F.col(array_col), F.array(*map(F.lit, names))).cast("int"), F.lit(0))


def evidence_size(language: str) -> Column:
    """Characters of a fragment as evidence: its text, and its heading with what is put before it."""
    heading = F.trim(F.coalesce(F.col("heading"), F.lit("")))
    return F.coalesce(F.col("char_count"), F.length("text"), F.lit(0)) + F.when(heading != "", F.length(heading) + HEADING_OVERHEAD[language]).otherwise(0)


def cosine_ranks(pool: DataFrame, rows: int | None = None) -> DataFrame:
    """``(chunk_id, cosine, semantic)``: the rank of each cosine within the pool, and no rank (infinity) at or below the
    pool's median. Ties share a rank; unusable vectors have no cosine and no rank."""
    # the rank reads the cosines, the median the ranks: each computed once, kept as a narrow table
    own = materialize(pool.where(F.col("cosine").isNotNull()).select("chunk_id", "cosine"), "cosines")
    ranked = materialize(ranking.global_rank(own, [F.desc("cosine")], "_rank", rows), "cosine-ranks")
    n = ranked.count()
    # the value at a place is the least of those that rank so high: no task holds the values to find the middle
    at = lambda place: F.min(F.when(F.col("_rank") <= place, F.col("cosine")))
    median = ranked.agg(((at((n + 1) // 2) + at(n // 2 + 1)) / 2).alias("_median"))
    gated = F.when(F.col("cosine") > F.col("_median"), F.col("_rank").cast("double")).otherwise(F.lit(NO_RANK))
    return ranked.join(F.broadcast(median)).select("chunk_id", "cosine", gated.alias("semantic"))  # one row


def hybrid_search(
    chunks: DataFrame, language: str, conditions: Sequence[str] = (), terms: Sequence[str] = (), vector: Sequence[float] | None = None,
    signals: Signals = Signals(), categories: Sequence[str] | None = None, formula: str = SEARCH_DEFAULT, k: float = 10, budget: int | None = None,
) -> DataFrame:
    """``(chunk_id, score, relevance, p1, p2, lexical, semantic, evidence_chars)`` in no particular order.

    pool -> ranks -> score -> prefix, on narrow columns: P1 and P2 tell whether the fragment's primary or secondary
    conditions name one of the question's, L is the rank of its BM25 among the matches, V the gated rank of its cosine;
    missing ranks are infinite. Signals that are off are constants, so nothing is read or computed for them. Fragments
    with a positive score are kept, and of these the longest prefix by (score descending, id) within ``budget``
    characters of evidence. Texts are fetched for the survivors only (``with_texts``). Rows with a null id can't be
    told apart and are left out; an empty pool gives an empty result."""
    signals = signals.effective(conditions)
    pool = scope(chunks, language, categories).where(F.col("chunk_id").isNotNull())
    rows = pool.count()  # of the filter columns only; tells whether ranks need more than one task
    size = evidence_size(language).alias("evidence_chars")
    p1 = overlaps("primary_medical_conditions", conditions) if signals.conditions else F.lit(0)
    p2 = overlaps("secondary_medical_conditions", conditions) if signals.conditions else F.lit(0)
    ranked = pool.select("chunk_id", p1.alias("p1"), p2.alias("p2"), size)
    if signals.lexical and terms:
        scores = lexical.bm25(pool, "chunk_id", "text", terms).withColumnRenamed("id", "chunk_id")
        lex = ranking.global_rank(scores.withColumn("bm25", F.round("bm25", 9)), [F.desc("bm25")], "_l", rows).select("chunk_id", F.col("_l").cast("double").alias("lexical"))
        ranked = ranked.join(lex, "chunk_id", "left").withColumn("lexical", F.coalesce("lexical", F.lit(NO_RANK)))
    else:
        ranked = ranked.withColumn("lexical", F.lit(NO_RANK))
    if signals.semantic and vector is not None:
        q = F.array(*(F.lit(float(x)) for x in vector))
        sims = pool.select("chunk_id", F.round(V.cosine(F.col("embedding"), q), 9).alias("cosine"))
        ranked = ranked.join(cosine_ranks(sims, rows).drop("cosine"), "chunk_id", "left").withColumn("semantic", F.coalesce("semantic", F.lit(NO_RANK)))
    else:
        ranked = ranked.withColumn("semantic", F.lit(NO_RANK))
    compiled = search_formula(formula, k)
    scored = ranked.withColumn("score", compiled.column({"P1": F.col("p1"), "P2": F.col("p2"), "L": F.col("lexical"), "V": F.col("semantic"), "K": k})).where(F.col("score") > 0)
    kept = ranking.budget_prefix(scored, [F.desc("score"), F.asc("chunk_id")], "evidence_chars", budget, rows)
    return kept.withColumn("relevance", F.col("score") / signals.best(formula, k) * 100)


def with_texts(hits: DataFrame, chunks: DataFrame, columns: Sequence[str] = ("source_relative_path", "heading", "text")) -> DataFrame:
    """Late materialisation: the wide columns of the few rows that survived. The planner broadcasts the ids if they are
    as few as a search leaves, so the wide side is scanned without a shuffle; it falls back to a merge join by itself."""
    return hits.join(chunks.select("chunk_id", *columns), "chunk_id")


def minimum_relevance(hits: DataFrame, least: float) -> DataFrame:
    return hits if least <= 0 else hits.where(F.coalesce("relevance", F.lit(0.0)) >= least)


def priority_violations(hits: DataFrame) -> DataFrame:
    """``(chunk_id, position)`` of the hits that name a primary condition but stand after one that does not."""
    placed = ranking.global_rank(hits, [F.desc("score"), F.asc("chunk_id")], "position", ties=False)
    first = hits.where("p1 = 0").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("chunk_id").alias("c"))).alias("_first"))
    own = F.struct((-F.col("score")).alias("s"), F.col("chunk_id").alias("c"))
    return placed.where("p1 = 1").join(F.broadcast(first), F.col("_first") < own).select("chunk_id", F.col("position").cast("int").alias("position"))  # one row


def embedding_windows(df: DataFrame, id_col: str, text_col: str, width: int = 1400, overlap: int = 240) -> DataFrame:
    """``(id, window, text)``: windows of ``width`` characters, each beginning ``width - overlap`` after the one before;
    the last one reaches the end. Null and empty texts give none."""
    n, step = F.length(text_col), width - overlap
    count = F.when(n <= width, 1).otherwise(F.ceil((n - width) / F.lit(step)) + 1).cast("int")
    own = df.where(n > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"), F.explode(F.sequence(F.lit(0), count - 1)).alias("window"))
    return own.select("id", "window", F.col("_t").substr(F.col("window") * step + 1, F.lit(width)).alias("text"))


def embedding_context(df: DataFrame) -> Column:
    """What is put before a fragment's text when it is embedded: category path, file stem and heading."""
    stem = F.regexp_replace(F.element_at(F.split("source_relative_path", "/"), -1), r"\.md$", "")
    return F.concat_ws(" | ", F.array_join(F.split("category_id", "/"), " > "), stem, F.when(F.trim("heading") != "", F.trim("heading")))


def query_text(question: str) -> str:
    return " ".join(question.split())


def expressions(question: str) -> list[str]:
    """The question cut at commas, expressions of the same plain words once."""
    seen, out = set(), []
    for part in question.split(","):
        key = tuple(lexical.expression_words(part))
        if key and key not in seen:
            seen.add(key)
            out.append(part.strip())
    return out


