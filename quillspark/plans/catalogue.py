"""Queries on the catalogue, on publication and on sessions, and the document rules on authored cases, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import catalogue as K
from quillspark.operators import clean as C
from quillspark.operators import fragment, rules, units
from quillspark.operators import lexical as L
from quillspark.operators import publication as P
from quillspark.operators import search as S
from quillspark.plans import documents
from quillspark.shared import materialize, scratch_dir, table
from quillspark.streaming import state


def _names(spark, d):
    """Romanian and English names of the products and their aliases, with the language that says how they inflect."""
    h, a = table(spark, d, "herbs"), table(spark, d, "herb_aliases")
    own = h.select("id", F.explode(F.array(F.struct(F.col("ro").alias("name"), F.lit("ro").alias("language")), F.struct(F.col("en").alias("name"), F.lit("en").alias("language")), F.struct(F.col("latin").alias("name"), F.lit("la").alias("language")))).alias("x")).select("id", "x.*")
    language = F.when(F.col("kind") == "ro_regional", "ro").when(F.col("kind") == "en_alt", "en").otherwise("la")
    return own.unionByName(a.select(F.col("herb_id").alias("id"), "name", language.alias("language")))


def catalogue_mentions(spark, d):
    forms = K.inflected_names(_names(spark, d), "id", "name", "language").withColumnRenamed("id", "entry")
    return K.mentions(table(spark, d, "chunks"), forms, "chunk_id", "text", "entry")


def mention_owners(spark, d):
    forms = K.inflected_names(_names(spark, d), "id", "name", "language").withColumnRenamed("id", "entry")
    return K.preferred_owners(K.mentions(table(spark, d, "chunks"), forms, "chunk_id", "text", "entry"), "entry")


def catalogue_lookup(spark, d):
    named = _names(spark, d).select("id", T.normalized("name").alias("name")).where("name != ''").distinct()
    names = [(r.id, r.name) for r in named.orderBy("name", "id").collect()]  # a fixed dimension; lookup checks its size
    return K.lookup(table(spark, d, "message_classifications"), names, "herb_name")


def sibling_order(spark, d):
    return K.sibling_order(table(spark, d, "herbs").select("id", "category", "en"), "category", "en", "id")


def name_order(spark, d):
    own = table(spark, d, "herbs").select("id", K.natural_key(F.col("ro")).alias("name"))
    return own.withColumn("position", F.dense_rank().over(K.W.partitionBy(F.lit(1)).orderBy("name")))


def alias_maps(spark, d):
    m = K.alias_maps(table(spark, d, "herb_aliases"), "herb_id", "kind", "name")
    kinds = F.array_sort(F.map_keys("names"))
    return m.select("herb_id", F.size("names").alias("kinds"), F.array_join(kinds, ",").alias("names"), F.coalesce(F.size(F.try_element_at("names", F.lit("ro_regional"))), F.lit(0)).alias("regional"), F.map_contains_key("names", "en_alt").alias("english"))


def cache_merge(spark, d):
    stored = table(spark, d, "herbs").where("family IS NOT NULL").select(F.col("id").alias("key"), F.when(F.col("ranking") < 100, "unknown").otherwise(F.col("category")).alias("value"))
    return P.merge_cache(stored, table(spark, d, "herb_aliases").select(F.col("herb_id").alias("key"), F.col("kind").alias("value")), "key", "value")


def packed_requests(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", F.coalesce("category_id", F.lit("")).alias("bucket"), F.greatest(F.size("primary_medical_conditions"), F.lit(0)).alias("relations"), F.coalesce(F.length("text"), F.lit(0)).alias("characters"))
    return P.pack_requests(c, "bucket", ["chunk_id"], "relations", "characters")


def packed_limits(spark, d):
    """Per bucket its units, and how many batches of several units break a limit."""
    b = packed_requests(spark, d).groupBy("bucket", "batch").agg(F.count("*").alias("n"), F.sum("relations").alias("r"), F.sum("characters").alias("c"))
    over = (F.col("n") > 1) & ((F.col("n") > P.MOST_UNITS) | (F.col("r") > P.MOST_RELATIONS) | (F.col("c") > P.MOST_SIZE))
    gaps = F.max("batch") + 1 - F.count("*")
    return b.groupBy("bucket").agg(F.sum("n").alias("units"), F.count_if(over).alias("broken"), gaps.cast("long").alias("gaps"))


def incomplete_decisions(spark, d):
    """Conditions named in texts are the work, those of titles the decisions."""
    c = table(spark, d, "chunks")
    work = c.select("chunk_id", F.explode("primary_medical_conditions").alias("condition"))
    return P.incomplete(work, c.select("chunk_id", F.explode("secondary_medical_conditions").alias("condition")), ["chunk_id", "condition"])


def event_joins(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    found = state.joined_events(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), "user_id", "ts", "6 HOURS")
    return found.groupBy("event_id").agg(F.count("*").alias("clicks"), F.max("before_event_id").alias("last_click"))


def limited_sessions(spark, d):
    return state.limited_sessions(table(spark, d, "events"), "user_id", "ts", "event_id")


# Authored documents: the cases that no table holds, with what must come out.
AUTHORED = [
    (1, "# Ghid practic de plante\n\nISBN 973-1\nEditura Casei\nText bun.\n\nGhid practic de plante 3\nGhid practic de plante 3\nGhid practic de plante 3\nGhid practic de plante 3\nGhid practic de plante 3\nSfârșit."),
    (2, "Tel. 0745 123 456 sau 12 mg\nNimic.\nIubire"),
    (3, "# Text\nx\n" + "y " * 900 + "\n# Bibliografie\n" + "\n".join(f"Autor {k}, Carte ..... {100 + k}" for k in range(12))),
    (4, None),
    (5, "### Pagina 3\n\nUn rând."),
]


def _authored(spark):
    return spark.createDataFrame(AUTHORED, "doc_id long, text string")


def authored_credits(spark, d):
    return C.credit_lines(_authored(spark), "doc_id", "text").select("id", "n")


def authored_headers(spark, d):
    return C.repeated_headers(_authored(spark), "doc_id", "text")


def authored_removals(spark, d):
    cleaned = C.clean_documents(_authored(spark), "doc_id", "text")
    return cleaned.select("id", F.explode("removed").alias("r")).groupBy("id", "r.rule").agg(F.count("*").alias("removals"))


# Authored units: text, product, condition, label and code that must come out (null where no rule answers).
POLARITY = [
    ("Mușețelul ajută în tuse.", "Mușețelul", "tuse", "positive", "adjacent_cue"),
    ("Evitați mușețelul în tuse.", "mușețelul", "tuse", "caution", "explicit_prohibition"),
    ("Mușețelul nu se administrează în tuse.", "Mușețelul", "tuse", "caution", "explicit_prohibition"),
    ("Mușețelul crește în pajiști, unde tuse nu este.", "Mușețelul", "tuse", "unclear", "description"),
    ("## Contraindicații\n\nMușețelul și tuse.", "Mușețelul", "tuse", "caution", "warning_section"),
    ("Ajută în tuse:\n\n- Mușețelul, tuse", "Mușețelul", "tuse", "positive", "list_scope"),
    ("Evitați în tuse:\n\n- Mușețelul, tuse", "Mușețelul", "tuse", "caution", "avoidance_list"),
    ("| Plantă | Indicații | Contraindicații |\n|---|---|---|\n| Mușețel | tuse | febră |", "Mușețel", "tuse", "positive", "table_column"),
    ("| Plantă | Indicații | Contraindicații |\n|---|---|---|\n| Mușețel | tuse | febră |", "Mușețel", "febră", "caution", "table_column"),
    ("| Recomandat | Doza |\n|---|---|\n| Mușețel în tuse | 5 g |", "Mușețel", "tuse", "positive", "recommended_dose"),
    ("Se iau 2 capsule de mușețel pe zi pentru tuse.", "mușețel", "tuse", "positive", "administration"),
    ("Nu se iau 2 capsule de mușețel pentru tuse.", "mușețel", "tuse", "caution", "administration"),
    ("Consultați medicul înainte de mușețel în tuse.", "mușețel", "tuse", "caution", "consultation"),
    ("Mușețelul și tuse, în bibliografie.", "Mușețelul", "tuse", "unclear", "source_reference"),
    ("Mușețelul ajută în tuse, numai dacă este cald.", "Mușețelul", "tuse", None, None),
    ("Despre mușețel. Despre tuse.", "mușețel", "tuse", None, None),
]


def authored_polarity(spark, d):
    rows = [(k, t, [(t.index(p), t.index(p) + len(p), "plante")], [(t.rindex(c), t.rindex(c) + len(c))]) for k, (t, p, c, _, _) in enumerate(POLARITY, 1)]
    df = spark.createDataFrame(rows, "identity long, text string, products array<struct<begin:int,finish:int,category:string>>, conditions array<struct<begin:int,finish:int>>")
    return rules.classify_units(df).select("identity", F.coalesce("label", F.lit("none")).alias("label"), F.coalesce("code", F.lit("none")).alias("code"))


def text_units(spark, d):
    """Units of the documents by kind."""
    return units.text_units(table(spark, d, "documents"), "doc_id", "text").groupBy("id", "kind").agg(F.count("*").alias("n"))


def unit_polarity(spark, d):
    """All pairs of a product and a condition named in one unit of a chunk, by the ordered rules."""
    chunks = table(spark, d, "chunks").where("chunk_id IS NOT NULL")
    found = fragment.condition_spans(chunks, documents._terms(spark, d), "chunk_id", "text").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("begin", "finish"))).alias("conditions"))
    names = F.regexp_extract_all("text", F.lit(r"([\p{L}']+-[\p{L}]+)"), F.lit(1))
    # places of the names: what stands before the k-th of them, split at the names
    parts = F.split("text", r"[\p{L}']+-[\p{L}]+")
    before = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_names"), F.lit(1))), lambda k: F.aggregate(F.slice("_parts", F.lit(1), k.cast("int")), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice("_names", F.lit(1), (k - 1).cast("int")), F.lit(0), lambda n, x: n + F.length(x)))
    c = chunks.select(F.col("chunk_id").alias("identity"), "text", names.alias("_names"), parts.alias("_parts")).where(F.size("_names") > 0)
    spans = F.zip_with("_names", before, lambda name, b: F.struct(b.alias("begin"), (b + F.length(name)).alias("finish"), F.lit("plante").alias("category")))
    texts = c.join(found, F.col("identity") == F.col("id")).select("identity", "text", spans.alias("products"), "conditions")
    return rules.classify_units(texts).groupBy("identity").agg(F.count("*").alias("pairs"), F.count("label").alias("decided"), F.count_if(F.col("label") == "positive").alias("positive"), F.count_if(F.col("label") == "caution").alias("caution"))


def number_invariant(spark, d):
    """Numbers that cleaning lost unaccounted, of all documents: none."""
    docs = materialize(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"), "documents")
    return C.unaccounted_numbers(docs, materialize(C.clean_documents(docs, "doc_id", "text"), "cleaned"), "doc_id", "text")


def stored_bm25(spark, d):
    path = f"{scratch_dir(spark)}/inverted-{uuid.uuid4().hex}"
    L.store_postings(table(spark, d, "chunks"), "chunk_id", "text", path)
    return L.stored_bm25(spark, path, ["acidul", "organic", "durere"]).select(F.col("id").alias("chunk_id"), F.round("bm25", 6).alias("bm25"))


def authored_violations(spark, d):
    hits = spark.createDataFrame([(1, 9.0, 1), (2, 8.0, 0), (3, 8.0, 1), (4, 7.0, 0), (5, 1.0, 1)], "chunk_id long, score double, p1 int")
    return S.priority_violations(hits)


_NAMES = """catalogue_mentions mention_owners catalogue_lookup sibling_order name_order alias_maps cache_merge packed_requests packed_limits incomplete_decisions event_joins limited_sessions
authored_credits authored_headers authored_removals authored_violations authored_polarity number_invariant stored_bm25 text_units unit_polarity""".split()


def queries():
    return {n: globals()[n] for n in _NAMES}


def oracle_sql():
    natural = f"array_to_string(list_transform(regexp_extract_all({T.normalized_sql('ro')}, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN lpad(p, 12, '0') ELSE p END), '')"
    values = lambda rows: ", ".join("(" + ", ".join(f"CAST({v} AS {t})" if t != "VARCHAR" else f"'{v}'" for v, t in r) + ")" for r in rows)
    long = lambda *v: [(x, "BIGINT") for x in v]
    return {
        "sibling_order": "SELECT id, category, en, CAST(row_number() OVER (PARTITION BY category ORDER BY lower(en) NULLS LAST, id) AS INTEGER) AS position FROM herbs",
        "name_order": f"SELECT id, name, CAST(dense_rank() OVER (ORDER BY name) AS INTEGER) AS position FROM (SELECT id, {natural} AS name FROM herbs)",
        "alias_maps": "SELECT herb_id, CAST(count(DISTINCT kind) AS INTEGER) AS kinds, string_agg(DISTINCT kind, ',' ORDER BY kind) AS names, CAST(count(DISTINCT name) FILTER (WHERE kind = 'ro_regional') AS INTEGER) AS regional, bool_or(kind = 'en_alt') AS english FROM herb_aliases WHERE kind IS NOT NULL GROUP BY herb_id",
        "cache_merge": """WITH o AS (SELECT id AS key, CASE WHEN ranking < 100 THEN 'unknown' ELSE category END AS old FROM herbs WHERE family IS NOT NULL), c AS (SELECT herb_id AS key, min(kind) AS new FROM herb_aliases WHERE kind IS NOT NULL GROUP BY 1)
SELECT key, CASE WHEN o.key IS NULL OR (old = 'unknown' AND new <> 'unknown') THEN new ELSE old END AS value, CASE WHEN o.key IS NULL THEN 'inserted' WHEN old = 'unknown' AND new <> 'unknown' THEN 'upgraded' ELSE 'stored' END AS origin FROM o FULL JOIN c USING (key)""",
        "packed_limits": "SELECT coalesce(category_id, '') AS bucket, count(*) AS units, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS gaps FROM chunks GROUP BY 1",
        "incomplete_decisions": """WITH w AS (SELECT DISTINCT chunk_id, unnest(primary_medical_conditions) AS condition FROM chunks), s AS (SELECT chunk_id, unnest(secondary_medical_conditions) AS condition FROM chunks), d AS (SELECT chunk_id, condition, count(*) AS n FROM s GROUP BY ALL)
SELECT * FROM (SELECT chunk_id, condition, CASE WHEN n IS NULL THEN 'missing' WHEN k IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' END AS problem FROM (SELECT *, 1 AS k FROM w) FULL JOIN d USING (chunk_id, condition)) WHERE problem IS NOT NULL""",
        "event_joins": "SELECT p.event_id, count(*) AS clicks, max(c.event_id) AS last_click FROM events p JOIN events c ON c.user_id = p.user_id AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 6 HOUR WHERE p.event_type = 'purchase' AND c.event_type = 'click' GROUP BY 1",
        "authored_credits": f"SELECT * FROM (VALUES {values([[(1, 'BIGINT'), (2, 'INTEGER')], [(1, 'BIGINT'), (3, 'INTEGER')]])}) AS t(id, n)",
        "authored_headers": f"SELECT * FROM (VALUES {values([[(1, 'BIGINT'), ('Ghid practic de plante 3', 'VARCHAR'), (4, 'BIGINT')]])}) AS t(id, line, removed)",
        "authored_removals": f"SELECT * FROM (VALUES {values([[(1, 'BIGINT'), ('credit', 'VARCHAR'), (2, 'BIGINT')], [(1, 'BIGINT'), ('header', 'VARCHAR'), (4, 'BIGINT')], [(2, 'BIGINT'), ('phone', 'VARCHAR'), (1, 'BIGINT')], [(2, 'BIGINT'), ('label', 'VARCHAR'), (1, 'BIGINT')], [(3, 'BIGINT'), ('furniture:bibliography', 'VARCHAR'), (1, 'BIGINT')], [(5, 'BIGINT'), ('page_marker', 'VARCHAR'), (1, 'BIGINT')]])}) AS t(id, rule, removals)",
        "number_invariant": "SELECT doc_id AS id, CAST('' AS VARCHAR) AS number, CAST(0 AS BIGINT) AS missing FROM documents WHERE false",
        "stored_bm25": f"""WITH w AS (SELECT chunk_id, {T.words_sql('text')} AS w FROM chunks), f AS (SELECT chunk_id, len(w) AS len, unnest(['acidul', 'organic', 'durere']) AS term, w FROM w), t AS (SELECT chunk_id, len, term, len(list_filter(w, lambda x: x = term)) AS tf FROM f),
s AS (SELECT count(*) AS n, avg(len(w)) AS avglen FROM w), d AS (SELECT term, count(*) AS df FROM t WHERE tf > 0 GROUP BY 1)
SELECT chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen))), 6) AS bm25 FROM t JOIN d USING (term), s WHERE tf > 0 GROUP BY 1""",
        "authored_polarity": f"SELECT * FROM (VALUES {values([[(k, 'BIGINT'), (label or 'none', 'VARCHAR'), (code or 'none', 'VARCHAR')] for k, (_, _, _, label, code) in enumerate(POLARITY, 1)])}) AS t(identity, label, code)",
        "authored_violations": f"SELECT * FROM (VALUES {values([[*long(3), (3, 'INTEGER')], [*long(5), (5, 'INTEGER')]])}) AS t(chunk_id, position)",
    }
