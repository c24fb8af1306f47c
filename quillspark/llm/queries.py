"""Queries p2 to p10 with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import align, canonical, encode, leak, lookalike, ocr, permindex, split, subjects
from quillspark.shared import table


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    return ocr.repair_scans(table(spark, d, "chunks"), path_col="source_relative_path", titles=ocr.document_titles(table(spark, d, "documents")))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select("chunk_id", "heading", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.defects(_repaired(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return permindex.similar_pairs(*permindex.similar_classes(table(spark, d, "chunks"), 0.95))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return permindex.similar_classes(table(spark, d, "chunks"), 0.95)[1]


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return permindex.nearest(chunks, chunks.where("chunk_id % 50 = 0"), 10)


def p3_unusable(spark: SparkSession, d: str) -> DataFrame:
    """The report of vectors that no search can use."""
    return permindex.unusable_vectors(table(spark, d, "chunks"))


def p4_aligned(spark: SparkSession, d: str) -> DataFrame:
    return align.align_sentences(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_aligned(spark, d).select("chunk_id_a", "sentence_a", "chunk_id_b", "sentence_b")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).select("chunk_id").distinct()


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_forms(table(spark, d, "chunks")).select("chunk_id", "heading_form", "text_form")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look(lookalike.consistent_forms(table(spark, d, "chunks")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look_pairs(p6_classes(spark, d))


def p7_mapped(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    lists = {
        "herb_name": canonical.herb_names(t("herbs"), t("herb_aliases")),
        "top_condition": canonical.condition_names(t("medical_conditions"), t("medical_condition_synonyms")),
    }
    return canonical.map_messages(t("message_classifications"), lists)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_mapped(spark, d).select("message_id", "field", "ref_id").distinct()


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The report of values that name no entry, with the number of messages."""
    return p7_mapped(spark, d).where("ref_id = 0").groupBy("field", "value").agg(F.countDistinct("message_id").alias("messages"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encode.decode_corpus(p8_ids(spark, d)).select("doc_id", F.sha2("content", 256).alias("text_sha256"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_passages(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).where(F.col("longest_run") >= leak.WINDOW).select("doc_id", "item_id").distinct()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_shares(table(spark, d, "documents"), table(spark, d, "labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(p10_shares(spark, d)).select("doc_id", "subject_id").distinct()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and words of each area: the composition of the corpus."""
    areas = subjects.subject_areas(p10_shares(spark, d))
    by = areas.groupBy("subject_id").agg(F.countDistinct("doc_id").alias("documents"), F.sum(F.col("share") * F.col("body_words")).cast("long").alias("words"))
    names = table(spark, d, "subject_areas").select("subject_id", "name")
    return names.join(by, "subject_id", "left").na.fill(0, ["documents", "words"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_unusable": """
WITH w AS (SELECT len(embedding) AS width FROM chunks WHERE len(embedding) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)
SELECT * FROM (SELECT chunk_id, CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) = 0 THEN 'empty' WHEN len(embedding) != (SELECT width FROM w) THEN 'length'
  WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'value' WHEN len(list_filter(embedding, lambda x: x != 0)) = 0 THEN 'zero' END AS reason FROM chunks)
WHERE reason IS NOT NULL""",
        "p5_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 2000",
        "p8_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    }
