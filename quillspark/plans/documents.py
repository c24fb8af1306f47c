"""Queries on documents: cleaning, structure, spans, fragments, state over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import clean as C
from quillspark.operators import fragment, resolve, rules, spans
from quillspark.operators import search as S
from quillspark.plans import with_whole
from quillspark.shared import table
from quillspark.streaming import state


def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(C.clean_text("text")).alias("cleaned"))


def folded_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(C.collapse_blank_lines(C.fold_diacritics("text"))).alias("folded"))


def collapsed_blanks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.length(T.collapse_blank("text")), F.lit(-1)).alias("n"))


def exact_duplicates(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.groupBy(F.md5("text").alias("k")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


def credit_lines(spark, d):
    return C.credit_lines(table(spark, d, "documents"), "doc_id", "text").select("id", "n")


def repeated_headers(spark, d):
    return C.repeated_headers(table(spark, d, "documents"), "doc_id", "text", 2)


def number_bag(spark, d):
    return C.numbers(table(spark, d, "documents"), "doc_id", "text").groupBy("number").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


def missing_numbers(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", C.clean_text("text").alias("cleaned"))
    return C.missing_numbers(C.numbers(docs, "doc_id", "text"), C.numbers(docs, "doc_id", "cleaned"))


def unigrams(spark, d):
    return C.unigrams(table(spark, d, "chunks"), "language", "text")


def bigrams(spark, d):
    return C.bigrams(table(spark, d, "chunks"), "language", "text")


def language_vote(spark, d):
    return C.language_vote(table(spark, d, "documents"), "doc_id", "text")


def cleaned_documents(spark, d):
    c = C.clean_documents(table(spark, d, "documents"), "doc_id", "text")
    return c.select("id", F.md5("text").alias("text"), F.size("removed").alias("removals"))


def removed_characters(spark, d):
    return C.removed_characters(C.clean_documents(table(spark, d, "documents"), "doc_id", "text"))


def heading_structure(spark, d):
    return spans.headings(C.lines(table(spark, d, "documents"), "doc_id", "text"))


def line_scopes(spark, d):
    ls = C.lines(table(spark, d, "documents"), "doc_id", "text")
    s = spans.scope_at(ls.select("id", "n"), spans.headings(ls))
    return s.groupBy("id", "scope").agg(F.count("*").alias("lines")).na.fill("", ["scope"])


def _word_spans(spark, d):
    w = table(spark, d, "chunks").select("chunk_id", F.posexplode(T.words("text")).alias("at", "w"))
    kind = F.when(F.col("w").isin("ulei", "oil", "acidul", "acid"), "product").when(F.col("w").isin("durere", "pain", "organic", "de"), "condition")
    return w.select(F.col("chunk_id").alias("id"), F.col("at").alias("begin"), (F.col("at") + F.when(kind == "product", 2).otherwise(3)).alias("finish"), kind.alias("kind")).where("kind IS NOT NULL")


def span_sweep(spark, d):
    return spans.sweep(_word_spans(spark, d))


def range_gaps(spark, d):
    c = table(spark, d, "chunks").where("line_start IS NOT NULL AND line_end IS NOT NULL").select("source_relative_path", "line_start", "line_end").distinct()
    return spans.range_gaps(c, ["source_relative_path"], "line_start", "line_end")


def greedy_spans(spark, d):
    s = _word_spans(spark, d).withColumn("priority", F.when(F.col("kind") == "product", 0).otherwise(1))
    return spans.non_overlapping(s)


def batch_packing(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "source_relative_path", F.octet_length("text").alias("size"))
    return spans.pack_batches(c, "source_relative_path", ["chunk_id"], "size", 2000)


def token_budget_prefix(spark, d):
    c = table(spark, d, "chunks").where("language = 'en'").select("chunk_id", F.octet_length(F.to_json(F.struct("chunk_id", "text"))).alias("size"))
    from quillspark.operators import ranking

    return ranking.budget_prefix(c, [F.desc("size"), F.asc("chunk_id")], "size", 3 * 20_000).select("chunk_id")


def rank_budget_prefix(spark, d):
    from quillspark.operators import ranking

    return ranking.budget_prefix(table(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], "n_chars", 100_000).select("doc_id")


def _terms(spark, d):
    """The dictionary of conditions: a fixed dimension."""
    c, s = table(spark, d, "medical_conditions"), table(spark, d, "medical_condition_synonyms")
    names = c.select("name", F.explode(F.array("name", "en")).alias("term")).unionByName(c.join(s, c["id"] == s["condition_id"]).select("name", F.col("synonym").alias("term")))
    return [(r.name, r.term) for r in names.where("term IS NOT NULL").orderBy("name", "term").collect()]


def fragments(spark, d):
    f = fragment.fragment_documents(table(spark, d, "documents"), _terms(spark, d), "doc_id", "text")
    return f.select("id", "fragment", "line_start", "line_end", "path", "category", "primary", "secondary")


def condition_spans(spark, d):
    return fragment.condition_spans(table(spark, d, "chunks"), _terms(spark, d), "chunk_id", "text")


def resolved_questions(spark, d):
    return resolve.resolve_questions(table(spark, d, "message_classifications").where("top_condition IS NOT NULL").select("message_id", "top_condition").distinct(), _terms(spark, d), "message_id", "top_condition")


def close_names(spark, d):
    names = [r.ro for r in table(spark, d, "herbs").select("ro").distinct().collect()]  # a fixed dimension
    return resolve.close_names(table(spark, d, "message_classifications").where("herb_name IS NOT NULL").select("message_id", "herb_name").distinct(), names, "message_id", "herb_name")


def polarity_rules(spark, d):
    """Candidates are all pairs of a product word and a condition named in one chunk, decided by the ordered rules."""
    chunks = table(spark, d, "chunks")
    found = fragment.condition_spans(chunks, _terms(spark, d), "chunk_id", "text").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("begin", "finish"))).alias("conditions"))
    c = chunks.join(found, F.col("chunk_id") == F.col("id"))
    products = F.regexp_extract_all("text", F.lit(r"(?i)([\p{L}']+-[\p{L}]+)"), F.lit(1))
    return rules.classify_pairs(c.select(F.col("chunk_id").alias("identity"), F.col("text").alias("unit"), "heading", products.alias("products"), "conditions"))


def rate_limit(spark, d):
    return state.rate_limit(table(spark, d, "events").select("event_id", "ts", "user_id"), "user_id", "ts", "event_id", 2, 7200)


def session_expiry(spark, d):
    return state.sessions(table(spark, d, "events"), "user_id", "ts")


def event_windows(spark, d):
    return state.event_windows(table(spark, d, "events"), "ts", "event_type")


def question_expressions(spark, d):
    rows = [(i, x) for i, q in enumerate(("Durere de cot, acidul organic ,  ACIDUL organic", "despre tot, ,ce?", "")) for x in S.expressions(S.query_text(q))]
    return spark.createDataFrame(rows, "question int, expression string")


_NAMES = """clean_text folded_text collapsed_blanks exact_duplicates credit_lines repeated_headers number_bag missing_numbers unigrams bigrams language_vote cleaned_documents removed_characters heading_structure
line_scopes span_sweep range_gaps greedy_spans batch_packing token_budget_prefix rank_budget_prefix fragments condition_spans resolved_questions close_names polarity_rules rate_limit session_expiry event_windows
question_expressions""".split()


def queries():
    return {n: globals()[n] for n in _NAMES}


def oracle_sql():
    return with_whole(_sql(), {"number_bag": "n", "session_expiry": "session"})


def _sql():
    w = T.words_sql
    lines = "SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents WHERE text IS NOT NULL"
    num = lambda c: f"SELECT doc_id AS id, number, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({c}, '{C.NUMBER}')) AS number FROM documents) GROUP BY ALL"
    stop = lambda k: "[" + ", ".join(f"'{x}'" for x in C.STOP_WORDS[k]) + "]"
    key = lambda e: f"array_to_string(regexp_extract_all(translate(lower(regexp_replace(trim({e}), '(?i)\\.(pdf|docx?|txt|rtf|odt|md)$', '')), '{C.FOLD_FROM}', '{C.FOLD_TO}'), '[\\p{{L}}\\p{{N}}]+'), ' ')"
    same = "(key = title OR (length(key) >= 12 AND length(title) >= 12 AND (contains(key, title) OR contains(title, key))))"
    sp = f"SELECT chunk_id AS id, pos AS begin, pos + CASE WHEN kind = 'product' THEN 2 ELSE 3 END AS finish, kind FROM (SELECT chunk_id, pos, CASE WHEN w IN ('ulei', 'oil', 'acidul', 'acid') THEN 'product' WHEN w IN ('durere', 'pain', 'organic', 'de') THEN 'condition' END AS kind FROM (SELECT chunk_id, unnest(w) AS w, unnest(range(0, len(w))) AS pos FROM (SELECT chunk_id, {w('text')} AS w FROM chunks))) WHERE kind IS NOT NULL"
    heads = f"""l AS ({lines}), h AS (SELECT id, n, length(regexp_extract(line, '^\\s{{0,3}}(#{{1,6}})\\s', 1)) AS level, regexp_replace(regexp_extract(line, '^\\s{{0,3}}#{{1,6}}\\s+(.+?)\\s*$', 1), '\\s*#*\\s*$', '') AS title FROM l
WHERE regexp_matches(line, '^\\s{{0,3}}#{{1,6}}\\s+\\S') AND NOT regexp_matches(line, '{C.PAGE_HEADING}'))"""
    return {
        "clean_text": f"SELECT doc_id, md5({C.clean_text_sql('text')}) AS cleaned FROM documents",
        "folded_text": f"SELECT doc_id, md5(regexp_replace(translate(text, '{C.FOLD_FROM}', '{C.FOLD_TO}'), '{C.BLANK_RUN}', chr(10) || chr(10), 'g')) AS folded FROM documents",
        "collapsed_blanks": f"SELECT doc_id, coalesce(length({T.collapse_blank_sql('text')}), -1) AS n FROM documents",
        "exact_duplicates": "SELECT md5(text) AS k, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "credit_lines": f"SELECT id, n FROM ({lines}) WHERE (regexp_matches(line, '{C.CREDIT}') OR (n < 300 AND regexp_matches(line, '{C.FRONT_CREDIT}'))) AND length(trim(line)) < 200",
        "repeated_headers": f"WITH l AS (SELECT id, trim(line) AS line FROM ({lines}) WHERE trim(line) <> ''), t AS (SELECT DISTINCT id, {key('regexp_replace(line, chr(94) || chr(35) || chr(92) || chr(115) || chr(43), chr(0) )').replace(', chr(0) )', ', ' + chr(39) * 2 + ')')} AS title FROM l WHERE regexp_matches(line, '^#\\s+\\S')), c AS (SELECT id, line, count(*) AS n FROM l WHERE NOT regexp_matches(line, '^#{{1,6}}\\s') AND NOT regexp_matches(line, '{C.DOSE}') GROUP BY ALL HAVING count(*) >= 2), k AS (SELECT *, {key('regexp_replace(line, ' + chr(39) + '[\\s\\-–—|:]*\\d{1,4}\\s*$' + chr(39) + ', ' + chr(39) * 2 + ')')} AS key FROM c) SELECT DISTINCT id, line, n - 1 AS removed FROM k JOIN t USING (id) WHERE title <> '' AND {same}",
        "number_bag": f"SELECT number, sum(n) AS n, count(*) AS documents FROM ({num('text')}) GROUP BY 1",
        "missing_numbers": f"SELECT b.id, b.number, b.n - coalesce(a.n, 0) AS missing FROM ({num('text')}) b LEFT JOIN ({num(C.clean_text_sql('text'))}) a USING (id, number) WHERE b.n > coalesce(a.n, 0)",
        "unigrams": f"SELECT language, word, count(*) AS n FROM (SELECT language, unnest({w('text')}) AS word FROM chunks) GROUP BY ALL",
        "bigrams": f"SELECT language, a, b, count(*) AS n FROM (SELECT language, unnest(list_slice(w, 1, len(w) - 1)) AS a, unnest(list_slice(w, 2, len(w))) AS b FROM (SELECT language, {w('line')} AS w FROM (SELECT language, unnest(string_split(text, chr(10))) AS line FROM chunks)) WHERE len(w) > 1) GROUP BY ALL",
        "language_vote": f"SELECT id, CASE WHEN n = 0 THEN 'none' WHEN ro > en * 1.5 THEN 'ro' WHEN en > ro * 1.5 THEN 'en' ELSE 'mix' END AS language FROM (SELECT id, len(w) AS n, len(list_filter(w, lambda x: list_contains({stop('ro')}, x))) AS ro, len(list_filter(w, lambda x: list_contains({stop('en')}, x))) AS en FROM (SELECT doc_id AS id, {w('text')} AS w FROM documents))",
        "heading_structure": f"WITH {heads}, e AS (SELECT id, max(n) + 1 AS e FROM l GROUP BY 1) SELECT h.id, h.n, h.level, h.title, coalesce((SELECT min(x.n) FROM h x WHERE x.id = h.id AND x.n > h.n), e.e) AS body_end, coalesce((SELECT min(x.n) FROM h x WHERE x.id = h.id AND x.n > h.n AND x.level <= h.level), e.e) AS subtree_end, (SELECT string_agg(a.title, ' > ' ORDER BY a.n) FROM h a WHERE a.id = h.id AND a.n <= h.n AND (a.n = h.n OR a.level < h.level) AND NOT EXISTS (SELECT 1 FROM h z WHERE z.id = h.id AND z.n > a.n AND z.n <= h.n AND z.level <= a.level)) AS path FROM h JOIN e ON e.id = h.id",
        "line_scopes": f"WITH {heads} SELECT id, scope, count(*) AS lines FROM (SELECT l.id, coalesce(h.title, '') AS scope FROM l ASOF LEFT JOIN h ON l.id = h.id AND l.n >= h.n) GROUP BY ALL",
        "span_sweep": f"WITH s AS ({sp}), ev AS (SELECT id, begin AS pos, 1 AS d, kind FROM s UNION ALL SELECT id, finish, -1, kind FROM s), g AS (SELECT id, pos, sum(CASE WHEN kind = 'product' THEN d ELSE 0 END) AS a, sum(CASE WHEN kind = 'condition' THEN d ELSE 0 END) AS b FROM ev GROUP BY id, pos), p AS (SELECT id, pos AS begin, lead(pos) OVER w AS finish, sum(a) OVER w AS na, sum(b) OVER w AS nb FROM g WINDOW w AS (PARTITION BY id ORDER BY pos)), k AS (SELECT id, begin, finish, CASE WHEN na > 0 THEN 'product' ELSE 'condition' END AS kind FROM p WHERE finish IS NOT NULL AND (na > 0 OR nb > 0)), i AS (SELECT *, sum(f) OVER (PARTITION BY id ORDER BY begin) AS i FROM (SELECT *, CASE WHEN lag(finish) OVER v = begin AND lag(kind) OVER v = kind THEN 0 ELSE 1 END AS f FROM k WINDOW v AS (PARTITION BY id ORDER BY begin))) SELECT id, min(begin) AS begin, max(finish) AS finish, kind FROM i GROUP BY id, i, kind",
        "range_gaps": "SELECT source_relative_path, line_start, line_end, CASE WHEN size > 0 THEN 'gap' ELSE 'overlap' END AS problem, abs(size) AS size FROM (SELECT *, line_start - max(line_end) OVER (PARTITION BY source_relative_path ORDER BY line_start, line_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS size FROM (SELECT DISTINCT source_relative_path, line_start, line_end FROM chunks WHERE line_start IS NOT NULL AND line_end IS NOT NULL)) WHERE size <> 0",
        "rank_budget_prefix": "SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS r FROM documents) WHERE r <= 100000",
        "session_expiry": "WITH f AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 3600000000 THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM f) SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS events, CASE WHEN epoch_us(max(ts)) - epoch_us(min(ts)) >= 14400000000 THEN 'age' ELSE 'idle' END AS expired_by FROM s GROUP BY ALL",
        "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL",
    }
