"""Search queries over ``chunks`` with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vector as V
from quillspark.functions.formula import search_formula
from quillspark.operators import lexical, search
from quillspark.plans import with_whole
from quillspark.shared import table

# The question that the queries ask.
CONDITIONS = ["Durere de cot", "Crampă de umăr", "Iritație de spate", "Durere de deget"]
TERMS = ["acidul", "organic", "temperatura", "infuzia"]
VECTOR = [round(math.sin(0.7 * i + 0.3), 6) for i in range(64)]
BUDGET = 60_000

_WORDS = T.words_sql("text")
_VEC = "[" + ", ".join(f"{x}::DOUBLE" for x in VECTOR) + "]"
_CONDS = "[" + ", ".join(f"'{c}'" for c in CONDITIONS) + "]"
_E = "CAST(embedding AS DOUBLE[])"
_DOT = f"list_sum(list_transform(range(1, 65), lambda i: {_E}[i] * {_VEC}[i]))"
_NORM = f"sqrt(list_sum(list_transform({_E}, lambda x: x * x)))"
_QNORM = repr(math.sqrt(sum(x * x for x in VECTOR)))
_COSINE = f"CASE WHEN len(embedding) = 64 AND {_NORM} > 0 THEN round({_DOT} / ({_NORM} * {_QNORM}), 9) END"
_SIZE = "coalesce(char_count, length(text), 0) + CASE WHEN trim(coalesce(heading, '')) <> '' THEN length(trim(heading)) + {} ELSE 0 END"
_FORMULA = search_formula()


def _bm25_sql(source: str, terms=TERMS) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{k}" for k, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(terms)))
    s = " + ".join(f"ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * len / avglen))" for k in range(len(terms)))
    hit = " OR ".join(f"tf{k} > 0" for k in range(len(terms)))
    return f"SELECT chunk_id, {s} AS bm25 FROM (SELECT chunk_id, len(w) AS len, {tf} FROM (SELECT chunk_id, {_WORDS} AS w FROM {source})) r, (SELECT count(*) AS n, avg(len) AS avglen, {df} FROM (SELECT len(w) AS len, {tf} FROM (SELECT {_WORDS} AS w FROM {source}))) s WHERE {hit}"


def semantic_rank(spark, d):
    q = F.array(*(F.lit(x) for x in VECTOR))
    pool = table(spark, d, "chunks").select("chunk_id", F.round(V.cosine(F.col("embedding"), q), 9).alias("cosine"))
    return search.cosine_ranks(pool).where(F.col("semantic") < search.NO_RANK).select("chunk_id", F.round("cosine", 6).alias("cosine"), F.col("semantic").cast("long").alias("rank"), F.round(11 / (10 + F.col("semantic")), 9).alias("score"))


def _bm25(spark, d):
    pool = search.scope(table(spark, d, "chunks"), "ro")
    return lexical.bm25(pool, "chunk_id", "text", TERMS).withColumnRenamed("id", "chunk_id")


def bm25_topk(spark, d):
    return _bm25(spark, d).select("chunk_id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "chunk_id").limit(100)


def postings(spark, d):
    p = lexical.postings(table(spark, d, "chunks"), "chunk_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"), F.sum(F.element_at("positions", 1)).alias("first_positions"))


EXPRESSION = "despre acidul organic la temperatura camerei"


def terms_match_fraction(spark, d):
    w = T.words("text")
    return table(spark, d, "chunks").where(lexical.holds_share(w, lexical.expression_words(EXPRESSION))).select("chunk_id")


def phrase_match(spark, d):
    w = T.words("text")
    return table(spark, d, "chunks").select("chunk_id", lexical.holds_phrase(w, ["acidul", "organic"]).alias("exact"), lexical.holds_phrase(w, ["infuzia", "digestia"], 1).alias("slop1")).where("exact OR slop1")


def expression_weights(spark, d):
    return lexical.expression_match(table(spark, d, "chunks"), "chunk_id", "text", "heading", EXPRESSION)


def condition_overlap(spark, d):
    return table(spark, d, "chunks").select("chunk_id", search.overlaps("primary_medical_conditions", CONDITIONS).alias("p1"), search.overlaps("secondary_medical_conditions", CONDITIONS).alias("p2"))


def category_scope(spark, d):
    c = search.scope(table(spark, d, "chunks"), "en", ["plante/munte", "plante/somn", "carti/sport"])
    return c.groupBy("category_id").agg(F.count("*").alias("chunks"), F.countDistinct("source_relative_path").alias("documents"), F.count_if(F.size("primary_medical_conditions") > 0).alias("with_conditions"))


def _search(spark, d, code="ABC", budget=BUDGET):
    s = search.Signals.parse(code)
    return search.hybrid_search(table(spark, d, "chunks"), "ro", CONDITIONS, TERMS, VECTOR, s, budget=budget)


def hybrid_search(spark, d):
    hits = _search(spark, d)
    return hits.select("chunk_id", F.round("score", 9).alias("score"), F.round("relevance", 6).alias("relevance"), "p1", "p2", *(F.when(F.col(c) < search.NO_RANK, F.col(c)).otherwise(0).cast("long").alias(c) for c in ("lexical", "semantic")))


def hybrid_signals(spark, d):
    out = None
    for code in ("ABC", "AB", "AC", "BC", "A", "B", "C"):
        part = _search(spark, d, code, None).agg(F.lit(code).alias("signals"), F.count("*").alias("hits"), F.round(F.sum("score"), 4).alias("total"), F.round(F.max("relevance"), 4).alias("best"))
        out = part if out is None else out.unionByName(part)
    return out


def hybrid_with_texts(spark, d):
    hits = search.with_texts(_search(spark, d), table(spark, d, "chunks"))
    return hits.select("chunk_id", "source_relative_path", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def minimum_relevance(spark, d):
    return search.minimum_relevance(_search(spark, d, "ABC", None), 30.0).select("chunk_id", F.round("relevance", 6).alias("relevance"))


def priority_violations(spark, d):
    return search.priority_violations(_search(spark, d, "ABC", None))


def embedding_windows(spark, d):
    return search.embedding_windows(table(spark, d, "chunks"), "chunk_id", "text").select("id", "window", F.md5("text").alias("text_md5"))


def embedding_context(spark, d):
    c = table(spark, d, "chunks")
    return c.select("chunk_id", search.embedding_context(c).alias("context"))


def mean_pool(spark, d):
    v = V.mean_pool(table(spark, d, "chunks"), ["category_id"], "embedding")
    return v.select("category_id", F.round(F.element_at("vector", 1), 6).alias("first"), F.round(F.element_at("vector", 64), 6).alias("last"))


def vector_norms(spark, d):
    return table(spark, d, "chunks").select("chunk_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.coalesce(V.usable(F.col("embedding")), F.lit(False)).alias("usable"))


def query_words(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.query_words("text").alias("words"), T.meaningful(T.words("text")).alias("meaningful"))


def queries():
    return {f.__name__: f for f in (semantic_rank, bm25_topk, postings, terms_match_fraction, phrase_match, expression_weights, condition_overlap, category_scope, hybrid_search, hybrid_signals, hybrid_with_texts, minimum_relevance, priority_violations, embedding_windows, embedding_context, mean_pool, vector_norms, query_words)}


_SEM = f"""sims AS (SELECT chunk_id, {_COSINE} AS cosine FROM pool),
sem AS (SELECT chunk_id, CASE WHEN cosine > (SELECT quantile_cont(cosine, 0.5) FROM sims) THEN CAST(rank() OVER (ORDER BY cosine DESC) AS DOUBLE) ELSE 'Infinity'::DOUBLE END AS semantic, cosine FROM sims WHERE cosine IS NOT NULL)"""


def _ranked_sql(code: str) -> str:
    a, b, c = ("A" in code, "B" in code, "C" in code)
    p = lambda col: f"CASE WHEN list_has_any(coalesce({col}, []), {_CONDS}) THEN 1 ELSE 0 END" if a else "0"
    score = _FORMULA.sql({"P1": "p1", "P2": "p2", "L": "lexical", "V": "semantic", "K": "10"})
    best = search.Signals.parse(code).best()
    return f"""pool AS (SELECT * FROM chunks WHERE language = 'ro'), {_SEM},
lex AS (SELECT chunk_id, CAST(rank() OVER (ORDER BY round(bm25, 9) DESC) AS DOUBLE) AS l FROM ({_bm25_sql('pool')})),
ranked AS (SELECT p.chunk_id, {p('primary_medical_conditions')} AS p1, {p('secondary_medical_conditions')} AS p2, {"coalesce(lex.l, 'Infinity'::DOUBLE)" if b else "'Infinity'::DOUBLE"} AS lexical,
  {"coalesce(sem.semantic, 'Infinity'::DOUBLE)" if c else "'Infinity'::DOUBLE"} AS semantic, {_SIZE.format(search.HEADING_OVERHEAD['ro'])} AS evidence_chars
  FROM pool p LEFT JOIN lex USING (chunk_id) LEFT JOIN sem USING (chunk_id)),
scored AS (SELECT *, {score} AS score, {score} / {best!r} * 100 AS relevance FROM ranked),
hits AS (SELECT * FROM scored WHERE score > 0),
kept AS (SELECT * FROM (SELECT *, sum(evidence_chars) OVER (ORDER BY score DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS running FROM hits) WHERE running <= {BUDGET})"""


def oracle_sql():
    return with_whole(_sql(), {"postings": "first_positions"})


def _sql():
    terms = lexical.expression_words(EXPRESSION)
    share = " + ".join(f"CASE WHEN list_contains({{w}}, '{t}') THEN 1 ELSE 0 END" for t in dict.fromkeys(terms))
    need = max(1, math.ceil(len(set(terms)) * lexical.SHARE))
    joined = "' ' || array_to_string({w}, ' ') || ' '"
    slop = "( [\\p{{L}}\\p{{N}}]+){{0,1}}"
    phrase = (slop + " ").join(terms)
    weight = " + ".join(
        f"CASE WHEN {share.format(w=w)} >= {need} THEN {boost} ELSE 0.0 END + CASE WHEN regexp_matches({joined.format(w=w)}, ' {phrase.format()} ') THEN {boost * 2} ELSE 0.0 END"
        for w, boost in ((T.words_sql("text"), 1.0), (T.words_sql("heading"), 2.0))
    )
    signals = " UNION ALL ".join(f"(WITH {_ranked_sql(c)} SELECT '{c}' AS signals, count(*) AS hits, round(sum(score), 4) AS total, round(max(relevance), 4) AS best FROM hits)" for c in ("ABC", "AB", "AC", "BC", "A", "B", "C"))
    rank = lambda c: f"CASE WHEN {c} < 'Infinity'::DOUBLE THEN CAST({c} AS BIGINT) ELSE 0 END AS {c}"
    generic = ", ".join(f"'{w}'" for w in T.GENERIC_WORDS)
    return {
        "semantic_rank": f"WITH pool AS (SELECT * FROM chunks), {_SEM} SELECT chunk_id, round(cosine, 6) AS cosine, CAST(semantic AS BIGINT) AS rank, round(11 / (10 + semantic), 9) AS score FROM sem WHERE semantic < 'Infinity'::DOUBLE",
        "bm25_topk": f"WITH pool AS (SELECT * FROM chunks WHERE language = 'ro') SELECT chunk_id, round(bm25, 6) AS bm25 FROM ({_bm25_sql('pool')}) ORDER BY 2 DESC, 1 LIMIT 100",
        "postings": f"SELECT term, count(DISTINCT chunk_id) AS docs, count(*) AS occurrences, sum(pos) FILTER (first) AS first_positions FROM (SELECT chunk_id, term, pos, row_number() OVER (PARTITION BY chunk_id, term ORDER BY pos) = 1 AS first FROM (SELECT chunk_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM (SELECT chunk_id, {_WORDS} AS w FROM chunks))) GROUP BY term",
        "terms_match_fraction": f"SELECT chunk_id FROM chunks WHERE {share.format(w=_WORDS)} >= {need}",
        "phrase_match": f"SELECT * FROM (SELECT chunk_id, contains({joined.format(w=_WORDS)}, ' acidul organic ') AS exact, regexp_matches({joined.format(w=_WORDS)}, ' infuzia( [\\p{{L}}\\p{{N}}]+){{0,1}} digestia ') AS slop1 FROM chunks) WHERE exact OR slop1",
        "expression_weights": f"SELECT * FROM (SELECT chunk_id AS id, CAST({weight} AS DOUBLE) AS weight FROM chunks) WHERE weight > 0",
        "condition_overlap": f"SELECT chunk_id, CASE WHEN list_has_any(coalesce(primary_medical_conditions, []), {_CONDS}) THEN 1 ELSE 0 END AS p1, CASE WHEN list_has_any(coalesce(secondary_medical_conditions, []), {_CONDS}) THEN 1 ELSE 0 END AS p2 FROM chunks",
        "category_scope": "SELECT category_id, count(*) AS chunks, count(DISTINCT source_relative_path) AS documents, count(*) FILTER (len(primary_medical_conditions) > 0) AS with_conditions FROM chunks WHERE language = 'en' AND category_id IN ('plante/munte', 'plante/somn', 'carti/sport') GROUP BY 1",
        "hybrid_search": f"WITH {_ranked_sql('ABC')} SELECT chunk_id, round(score, 9) AS score, round(relevance, 6) AS relevance, p1, p2, {rank('lexical')}, {rank('semantic')} FROM kept",
        "hybrid_signals": signals,
        "hybrid_with_texts": f"WITH {_ranked_sql('ABC')} SELECT chunk_id, source_relative_path, md5(coalesce(text, '')) AS text_md5 FROM kept JOIN chunks USING (chunk_id)",
        "minimum_relevance": f"WITH {_ranked_sql('ABC')} SELECT chunk_id, round(relevance, 6) AS relevance FROM hits WHERE relevance >= 30",
        "priority_violations": f"WITH {_ranked_sql('ABC')} SELECT chunk_id, position FROM (SELECT *, row_number() OVER w AS position, max(CASE WHEN p1 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY score DESC, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM hits WINDOW w AS (ORDER BY score DESC, chunk_id)) WHERE p1 = 1 AND seen = 1",
        "embedding_windows": "SELECT chunk_id AS id, i AS window, md5(substr(text, CAST(i * 1160 + 1 AS BIGINT), 1400)) AS text_md5 FROM (SELECT chunk_id, text, unnest(range(0, CASE WHEN length(text) <= 1400 THEN 1 ELSE CAST(ceil((length(text) - 1400) / 1160.0) AS BIGINT) + 1 END)) AS i FROM chunks WHERE length(text) > 0)",
        "embedding_context": "SELECT chunk_id, concat_ws(' | ', replace(category_id, '/', ' > '), regexp_replace(string_split(source_relative_path, '/')[-1], '\\.md$', ''), CASE WHEN trim(heading) <> '' THEN trim(heading) END) AS context FROM chunks",
        "mean_pool": f"WITH u AS (SELECT category_id, unnest({_E}) / {_NORM} AS x, unnest(range(1, 65)) AS p FROM chunks WHERE len(embedding) = 64 AND {_NORM} > 0), s AS (SELECT category_id, p, sum(x) AS s FROM u GROUP BY ALL), n AS (SELECT category_id, sqrt(sum(s * s)) AS n, max(s) FILTER (p = 1) AS a, max(s) FILTER (p = 64) AS b FROM s GROUP BY 1) SELECT category_id, round(a / n, 6) AS first, round(b / n, 6) AS last FROM n WHERE n > 0",
        "vector_norms": f"SELECT chunk_id, round({_NORM}, 6) AS norm, coalesce({_NORM} > 0, false) AS usable FROM chunks",
        "query_words": f"SELECT item_id, {T.query_words_sql('text')} AS words, list_filter({_WORDS}, lambda w: length(w) >= 4 AND NOT list_contains([{generic}], w)) AS meaningful FROM benchmark",
    }
