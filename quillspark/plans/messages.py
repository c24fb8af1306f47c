"""Queries on messages, reports and spelling with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import clean as C
from quillspark.operators import display as D
from quillspark.operators import messages as M
from quillspark.operators import spelling
from quillspark.shared import materialize, table


def recommendation_labels(spark, d):
    c = table(spark, d, "benchmark")
    label, rest = M.split_label(F.regexp_replace("text", r", (?=[^,]*$)", " - "))
    return c.select("item_id", label.alias("label"), F.length(rest).alias("rest"))


def validated_answers(spark, d):
    b = table(spark, d, "message_classifications").where("herb_name IS NOT NULL").select("message_id", F.to_json(F.struct(F.when(F.col("needs_clarification"), "uncertain").otherwise("complete").alias("status"), F.array(F.struct(F.lit("warning").alias("type"), F.col("herb_name").alias("text")), F.struct(F.lit("advice").alias("type"), F.col("herb_name").alias("text"))).alias("messages"))).alias("answer")).distinct()
    return M.valid_answers(b, "answer").select("message_id", F.size("valid_messages").alias("valid"), F.coalesce("problem", F.lit("")).alias("problem"))


def merged_messages(spark, d):
    m = table(spark, d, "message_classifications").where("herb_name IS NOT NULL").select("session_id", F.lit(0).alias("rank"), F.col("message_id").cast("int").alias("position"), F.lit("warning").alias("type"), F.col("herb_name").alias("ro"), F.concat("herb_name", F.lit(" "), "language").alias("en")).distinct()
    return M.merge_messages(m, "session_id").where("kept").groupBy("session_id").agg(F.count("*").alias("kept"))


def group_winners(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", F.col("l_linenumber").alias("rank"), F.col("l_orderkey").cast("int").alias("position"), F.when(F.col("l_returnflag") == "R", "warning").when(F.col("l_returnflag") == "A", "interaction").otherwise("contraindication").alias("type"), F.lit("").alias("ro"), F.lit("").alias("en"))
    return M.group_winners(li, ["l_partkey"]).select("l_partkey", "rank", "position")


def merged_reports(spark, d):
    c = table(spark, d, "chunks").select("category_id", F.lit("text").alias("section"), F.col("chunk_id").cast("int").alias("position"), F.md5(F.coalesce("text", F.lit(""))).alias("text"), F.array("language", F.col("business_category")).alias("evidence"))
    return M.merge_reports(c, "category_id").select("category_id", "text", "position", F.size("evidence").alias("evidence"))


def top_requests(spark, d):
    rows = []
    for i, q in enumerate(("top 10 plante", "Care sunt cele mai bune uleiuri?", "primele 5", "top 0 plante", "top plante și uleiuri", "topul pentru durere", "bună ziua")):
        r = M.parse_top(q)
        rows.append((i, r is not None, r.count if r else None, r.category if r else None, r.clarify if r else None))
    return spark.createDataFrame(rows, "question int, is_top boolean, count int, category string, clarify string")


def deduplicated_messages(spark, d):
    m = M.latest_requests(table(spark, d, "message_classifications"), "message_id", [F.asc("received_at")])
    return m.select("message_id", "session_id", M.clock((F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6).alias("delay"))


def _word_counts(spark, d):
    return C.unigrams(table(spark, d, "chunks"), "language", "text").groupBy("word").agg(F.sum("n").alias("n"))


def _typo_fixes(counts):
    return spelling.typo_fixes(counts, counts.where("n >= 20").select("word"), 20)


def _split_fixes(counts):
    return spelling.split_fixes(counts, counts.where("n >= 20").select("word"), ["de", "la", "cu", "the", "of"], 20)


def typo_fixes(spark, d):
    return _typo_fixes(_word_counts(spark, d))


def split_fixes(spark, d):
    return _split_fixes(_word_counts(spark, d))


def spelled_texts(spark, d):
    """All chunks with both kinds of fixes; a word that has both is split."""
    c = table(spark, d, "chunks").select("chunk_id", "text")
    counts = materialize(_word_counts(spark, d), "counts")
    splits = materialize(_split_fixes(counts), "splits")
    typos = materialize(_typo_fixes(counts).join(splits, "word", "left_anti"), "typos")
    fixes = splits.unionByName(spelling.written_forms(c, "text", typos))
    return spelling.apply_fixes(c, "chunk_id", "text", fixes).where("changes > 0").select("id", "changes")


def highlights(spark, d):
    return D.per_row(table(spark, d, "chunks"), "chunk_id", "text", lambda t: D.highlight_ranges(t, ["acidul", "organic", "durere"]), [("begin", "int"), ("finish", "int")])


def quotations(spark, d):
    return D.per_row(table(spark, d, "documents"), "doc_id", "text", D.quote_spans, [("begin", "int"), ("finish", "int")])


def translation_segments(spark, d):
    s = D.per_row(table(spark, d, "documents"), "doc_id", "text", D.segments, [("part", "string"), ("translate", "boolean")])
    return s.groupBy("id").agg(F.sum(F.length("part")).alias("characters"))


def display_forms(spark, d):
    return D.display_forms(table(spark, d, "chunks"), "text")


def preferred_aliases(spark, d):
    h, a = table(spark, d, "herbs"), table(spark, d, "herb_aliases")
    names = h.select(F.col("id").alias("entity"), T.normalized("ro").alias("name"), F.when(F.col("category") == "plante", 0).otherwise(1).alias("role")).unionByName(a.select(F.col("herb_id").alias("entity"), T.normalized("name").alias("name"), F.lit(1).alias("role")))
    return D.preferred_alias(names.withColumn("text", F.lit(1))).select("name", "entity")


def evidence_identity(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return li.select(D.identity("l_suppkey", "l_partkey").alias("identity")).groupBy("identity").agg(F.count("*").alias("n"))


def heading_sizes(spark, d):
    c = table(spark, d, "chunks").select(F.length("heading").alias("size"), (F.col("business_category") == "R1").alias("section")).where("size IS NOT NULL")
    return D.size_threshold(c, "size", "section").select(F.coalesce("threshold", F.lit(-1.0)).alias("threshold"))


_NAMES = "highlights quotations translation_segments display_forms preferred_aliases evidence_identity heading_sizes recommendation_labels validated_answers merged_messages group_winners merged_reports top_requests deduplicated_messages typo_fixes split_fixes spelled_texts".split()


def queries():
    return {n: globals()[n] for n in _NAMES}


def oracle_sql():
    w = T.words_sql
    counts = f"SELECT word, count(*) AS n FROM (SELECT unnest({w('text')}) AS word FROM chunks) GROUP BY 1"
    return {
        "translation_segments": "SELECT doc_id AS id, length(text) AS characters FROM documents WHERE length(text) > 0",
        "display_forms": f"SELECT plain, min(w) AS shown FROM (SELECT DISTINCT {T.plain_sql('w')} AS plain, w FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM chunks) WHERE {T.plain_sql('w')} <> w) GROUP BY 1 HAVING count(*) = 1",
        "preferred_aliases": f"WITH m AS (SELECT id AS entity, {T.normalized_sql('ro')} AS name, CASE WHEN category = 'plante' THEN 0 ELSE 1 END AS role FROM herbs UNION ALL SELECT herb_id, {T.normalized_sql('name')}, 1 FROM herb_aliases) SELECT DISTINCT name, entity FROM m WHERE role = (SELECT min(x.role) FROM m x WHERE x.name = m.name)",
        "evidence_identity": "SELECT sha256('{\"l_suppkey\":' || l_suppkey || ',\"l_partkey\":' || l_partkey || '}') AS identity, count(*) AS n FROM lineitem GROUP BY 1",
        "heading_sizes": "SELECT coalesce(CASE WHEN a >= 5 AND b >= 5 AND x - y >= 1 THEN (x + y) / 2 END, -1) AS threshold FROM (SELECT count(*) FILTER (business_category = 'R1') AS a, count(*) FILTER (business_category <> 'R1') AS b, median(length(heading)) FILTER (business_category = 'R1') AS x, median(length(heading)) FILTER (business_category <> 'R1') AS y FROM chunks WHERE heading IS NOT NULL)",
        "group_winners": "SELECT l_partkey, rank, position FROM (SELECT l_partkey, l_linenumber AS rank, l_orderkey AS position, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END, l_orderkey) AS n FROM lineitem) WHERE n = 1",
        "merged_reports": "SELECT category_id, text, min(position) AS position, count(DISTINCT e) AS evidence FROM (SELECT category_id, chunk_id AS position, md5(coalesce(text, '')) AS text, unnest([language, business_category]) AS e FROM chunks) GROUP BY category_id, text",
        "deduplicated_messages": "SELECT message_id, session_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS delay FROM (SELECT message_id, session_id, CAST(floor((epoch_us(received_at) - epoch_us(created_at)) / 1e6) AS BIGINT) AS s, row_number() OVER (PARTITION BY message_id ORDER BY received_at) AS n FROM message_classifications) WHERE n = 1",
        "validated_answers": f"SELECT message_id, CASE WHEN trim(herb_name) <> '' AND length(herb_name) <= 240 AND len(regexp_split_to_array(trim(herb_name), '\\s+')) <= 40 AND NOT regexp_matches(herb_name, '[\\r\\n]') AND NOT regexp_matches(herb_name, '^\\s*(?:[-*•]|\\d+[.)])\\s') AND NOT regexp_matches(regexp_replace(herb_name, '\\p{{Latin}}', '', 'g'), '\\p{{L}}') THEN 1 ELSE 0 END AS valid, '' AS problem FROM (SELECT DISTINCT message_id, herb_name, needs_clarification FROM message_classifications WHERE herb_name IS NOT NULL)",
        "split_fixes": f"WITH c AS ({counts}), d AS (SELECT word FROM c WHERE n >= 20), r AS (SELECT word FROM c WHERE length(word) >= 8 AND n <= 3), p AS (SELECT word, n FROM c WHERE n >= 20 AND length(word) >= 5 UNION ALL SELECT unnest(['de', 'la', 'cu', 'the', 'of']), 1000000), q AS (SELECT word, max(n) AS n FROM p GROUP BY 1), k AS (SELECT word, left(word, i) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(2, length(word) - 1)) AS i FROM r)) SELECT k.word, arg_max(a || ' ' || b, (least(x.n, y.n), a)) AS fix FROM k JOIN q x ON x.word = k.a JOIN q y ON y.word = k.b WHERE NOT (a IN ('de', 'la', 'cu', 'the', 'of') AND b IN ('de', 'la', 'cu', 'the', 'of')) GROUP BY 1",
    }
