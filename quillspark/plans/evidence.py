"""Evidence, catalogue, publication and measurement queries with their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.formula import product_formula
from quillspark.operators import evidence as E
from quillspark.operators import generation as G
from quillspark.operators import measures as M
from quillspark.plans import with_whole
from quillspark.shared import table

_LABEL = "CASE WHEN l_returnflag = 'R' THEN 'positive' WHEN l_returnflag = 'A' AND l_linenumber >= 5 THEN 'mixed' WHEN l_returnflag = 'A' THEN 'caution' ELSE 'unclear' END"
_EV = f"SELECT l_orderkey AS fragment, l_suppkey AS entity, p_brand AS topic, {_LABEL} AS label, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey"
_FOLDED = f"SELECT fragment, entity, topic, CASE min(CASE WHEN label IN ('positive', 'mixed') THEN 0 WHEN label = 'caution' THEN 1 ELSE 2 END) WHEN 0 THEN 'positive' WHEN 1 THEN 'caution' ELSE 'unclear' END AS label FROM ({_EV}) GROUP BY ALL"
_COUNTS = ", ".join(f"count(*) FILTER (label = '{x}') AS {x}_count" for x in E.LABELS)
_STATE = "CASE WHEN mixed_count > 0 OR (positive_count > 0 AND caution_count > 0) THEN 'mixed' WHEN positive_count > 0 THEN 'positive' WHEN caution_count > 0 THEN 'caution' ELSE 'unclear' END"
_PAIRS = f"SELECT *, {_STATE} AS state FROM (SELECT entity, topic, {_COUNTS} FROM ({_EV}) GROUP BY ALL)"


def _evidence(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag", "l_linenumber")
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return li.join(part, li["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("fragment"), F.col("l_suppkey").alias("entity"), F.col("p_brand").alias("topic"), F.expr(_LABEL).alias("label"), "l_linenumber")


def pair_states(spark, d):
    return E.pair_states(_evidence(spark, d))


def fragment_folding(spark, d):
    folded = E.fold_fragment(_evidence(spark, d), "fragment", "entity", "topic")
    return folded.groupBy("entity", "label").agg(F.count("*").alias("n"))


def positive_ranking(spark, d):
    entities = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"))
    return E.zero_preserving_ranking(entities, pair_states(spark, d), "entity", {"ranking": F.col("state") == "positive"})


_EFFECT = "CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'prohibition' WHEN l_returnflag = 'A' THEN 'precaution' WHEN l_returnflag = 'R' THEN 'none' ELSE 'unknown' END"


def _cautions(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("topic"), F.expr(_EFFECT).alias("effect"), (F.col("l_discount") > 0.05).alias("recommended"), (F.col("l_linenumber") == 1).alias("model_only"))
    li = li.withColumn("effect", E.corroborate(F.col("effect"), F.col("model_only")))
    return E.fold_cautions(li, ["entity", "topic"])


def caution_pairs(spark, d):
    return _cautions(spark, d)


def caution_ranking(spark, d):
    entities = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"))
    return E.zero_preserving_ranking(entities, _cautions(spark, d), "entity", {"cautions": F.col("effect").isin("prohibition", "precaution"), "prohibitions": F.col("effect") == "prohibition", "recommended": F.col("recommended")})


def _scores(spark, d):
    ev = _evidence(spark, d)
    return E.condition_scores(ev.where("l_linenumber = 1"), ev, E.pair_states(ev), "fragment", "entity", "topic")


def condition_scores(spark, d):
    return _scores(spark, d)


def condition_top(spark, d):
    return E.top_of_topic(_scores(spark, d), "topic", "entity", 10).select("topic", "position", "entity", "score")


def _mentions(spark, d):
    names = table(spark, d, "herbs").select(F.col("id").alias("name_id"), F.explode(F.array("ro", "en")).alias("name"))
    return E.phrase_mentions(table(spark, d, "chunks"), names, "chunk_id", "text")


def product_mentions(spark, d):
    return _mentions(spark, d).groupBy("name_id").agg(F.countDistinct("id").alias("chunks"), F.count("*").alias("mentions"), F.sum("position").alias("positions"))


def cooccurrence(spark, d):
    topics = table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), F.explode(F.array_union(F.coalesce("primary_medical_conditions", F.array().cast("array<string>")), F.coalesce("secondary_medical_conditions", F.array().cast("array<string>")))).alias("condition"))
    return E.cooccurrence(_mentions(spark, d), topics).select("name_id", "condition")


def cooccurrence_ranking(spark, d):
    entities = table(spark, d, "herbs").select(F.col("id").alias("name_id"))
    per = cooccurrence(spark, d).groupBy("name_id").agg(F.countDistinct("condition").alias("ranking"))
    return entities.join(per, "name_id", "left").na.fill(0, ["ranking"])


def product_catalog(spark, d):
    c = E.folded_catalog(table(spark, d, "herbs"), table(spark, d, "herb_aliases"), "id", "herb_id", ["ro_regional", "latin_synonyms", "en_alt"])
    return c.select("id", "ro", "ro_regional", "latin_synonyms", "en_alt")


def top_products(spark, d):
    top = table(spark, d, "herbs").orderBy(F.desc("ranking"), "id").limit(25)
    return E.folded_catalog(top, table(spark, d, "herb_aliases"), "id", "herb_id", ["ro_regional", "latin_synonyms", "en_alt"]).select("id", "ranking", "ro_regional", "en_alt")


def unambiguous_names(spark, d):
    names = table(spark, d, "herbs").select("id", F.explode(F.array("ro", "en", "latin")).alias("name")).where("name IS NOT NULL").unionByName(table(spark, d, "herb_aliases").select(F.col("herb_id").alias("id"), "name"))
    return E.unambiguous(names.select("id", T.normalized("name").alias("name")), "name", "id")


def condition_dictionary(spark, d):
    c, s = table(spark, d, "medical_conditions"), table(spark, d, "medical_condition_synonyms")
    terms = s.groupBy(F.col("condition_id").alias("id")).agg(F.sort_array(F.collect_set("synonym")).alias("synonyms"))
    return c.join(terms, "id", "left").select("id", T.normalized("name").alias("name"), "en", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"))


def catalog_checks(spark, d):
    h = table(spark, d, "herbs")
    shared = h.groupBy(T.normalized("ro").alias("name")).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n")).select(F.lit("shared_names").alias("check"), "n")
    per = h.groupBy("category").agg(F.count("*").alias("n")).select(F.concat(F.lit("category "), "category").alias("check"), "n")
    nulls = h.agg(F.count_if(F.col("family").isNull()).alias("n")).select(F.lit("without_family").alias("check"), "n")
    marks = h.agg(F.count_if(F.col("ro").rlike(r"[%_\\]")).alias("n")).select(F.lit("wildcards").alias("check"), "n")
    return shared.unionByName(per).unionByName(nulls).unionByName(marks)


def literal_lookup(spark, d):
    wanted = spark.createDataFrame([("urechea-pițigoiului %_",), ("GHEARA-DIHORULUI",), ("%",)], "wanted string")
    h = table(spark, d, "herbs")
    return h.join(F.broadcast(wanted), F.lower("ro") == F.lower("wanted")).select("id", "ro", "wanted")  # three literal rows


def optional_predicate(spark, d, category: str | None = None, kind: str | None = "en_alt"):
    h, a = table(spark, d, "herbs"), table(spark, d, "herb_aliases")
    if category is not None:
        h = h.where(F.col("category") == category)
    if kind is not None:
        a = a.where(F.col("kind") == kind)
    return h.join(a, h["id"] == a["herb_id"]).groupBy("category").agg(F.count("*").alias("aliases"))


def evidence_page(spark, d):
    ev = _evidence(spark, d).where("entity = 7").join(E.pair_states(_evidence(spark, d).where("entity = 7")).where("state IN ('positive', 'mixed')").select("entity", "topic"), ["entity", "topic"])
    return E.page(ev.select("fragment", "topic", "label", "l_linenumber"), [F.asc("fragment"), F.asc("l_linenumber"), F.asc("topic")], 20, 20)


def evidence_counts(spark, d):
    c = table(spark, d, "chunks")
    return c.select("source_relative_path", F.explode("secondary_medical_conditions").alias("condition")).groupBy("condition").agg(F.count("*").alias("chunks"), F.countDistinct("source_relative_path").alias("documents"))


def integrity_diff(spark, d):
    pairs = pair_states(spark, d).select("entity", "topic", "state")
    other = E.pair_states(_evidence(spark, d).where("l_linenumber < 7")).select("entity", "topic", "state")
    return G.symmetric_difference(pairs, other)


def differential_publish(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_quantity")
    old, new = li.where("l_shipdate < '1997-01-01'"), li.where("l_quantity > 3")
    return G.differential(old, new, ["l_suppkey", "l_partkey"])


def bag_difference(spark, d):
    li = table(spark, d, "lineitem")
    a, b = li.where("l_linenumber <= 2").select("l_suppkey", "l_returnflag"), li.where("l_linenumber = 2").select("l_suppkey", "l_returnflag")
    return a.exceptAll(b).groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))


def document_changes(spark, d):
    stored = table(spark, d, "chunks").groupBy("source_relative_path").agg(F.max(F.lower(F.trim("source_sha256"))).alias("version")).withColumnRenamed("source_relative_path", "relative_path")
    current = table(spark, d, "documents").select("relative_path", F.col("sha256").alias("version"))
    return G.changes(stored, current, "relative_path", "version")


def upsert(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    old, new = o.where("o_orderpriority <> '1-URGENT'"), o.where("o_orderstatus = 'F'").withColumn("o_orderstatus", F.lit("X"))
    return G.upsert(old, new, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def vector_reuse(spark, d):
    c = table(spark, d, "chunks")
    cache = c.where("business_category = 'R1' AND embedding IS NOT NULL").select("source_relative_path", F.lower("text_sha256").alias("h"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))
    wanted = c.select("chunk_id", "source_relative_path", F.lower("text_sha256").alias("h"))
    return G.reusable(wanted, cache, ["source_relative_path", "h"], "first").select("chunk_id", "first").na.fill(-9.0, ["first"])


def source_manifest(spark, d):
    c = table(spark, d, "chunks").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), "language")
    return c.groupBy("language").agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.sort_array(F.collect_set(F.substring("h", 1, 4))), ","), 256).alias("digest"))


def source_fingerprints(spark, d):
    """The manifest over whole rows: texts, embeddings and metadata of chunks and documents per language, and the
    catalogues. ``source_manifest`` is as its SQL states it, from four digits of the distinct texts."""
    sources = {"chunks": "language", "documents": "lang", "herbs": None, "herb_aliases": None, "medical_conditions": None, "medical_condition_synonyms": None}
    parts = [(name, table(spark, d, name), by) for name, by in sources.items()]
    hashed = [G.content_hash(t.withColumn("_by", F.col(by) if by else F.lit("")), t.columns, ["_by"]).select(F.lit(name).alias("source"), F.col("_by").alias("language"), "rows", "digest") for name, t, by in parts]
    return functools.reduce(lambda a, b: a.unionByName(b), hashed)


def term_containment(spark, d):
    t = table(spark, d, "herbs").select("id", T.words("ro").alias("w"))
    grams = t.select("id", F.size("w").alias("n"), F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.size("w") - i + 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", i, k), " ").alias("g")))))).alias("x"))
    whole = t.select(F.col("id").alias("inner_id"), F.array_join("w", " ").alias("g"))
    return grams.select("id", F.col("x.g").alias("g")).join(whole, "g").where("id <> inner_id").select("id", "inner_id").distinct()


def word_sets(spark, d):
    t = table(spark, d, "medical_conditions").select("id", F.array_sort(F.array_distinct(F.filter(T.words("name"), lambda w: F.length(w) > 2))).alias("w"))
    other = table(spark, d, "medical_conditions").select(F.col("id").alias("other"), F.array_sort(F.array_distinct(F.filter(T.words("name"), lambda w: F.length(w) > 2))).alias("v"))
    pairs = t.select("id", "w", F.explode("w").alias("k")).join(other.select("other", "v", F.explode("v").alias("k")), "k").select("id", "other", "w", "v").distinct().where("id <> other")
    n = F.size(F.array_intersect("w", "v"))
    return pairs.select("id", "other", n.alias("common"), ((n == F.size("w")) & (F.size("w") < F.size("v"))).alias("proper_subset"))


def secondary_without_primary(spark, d):
    c = table(spark, d, "chunks")
    return c.select("chunk_id", E.without(F.col("secondary_medical_conditions"), F.col("primary_medical_conditions")).alias("kept"))


def ordered_distinct(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.array_distinct(T.words("text")).alias("w"))
    return w.select("item_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("words"))


def canonical_conditions(spark, d):
    m = table(spark, d, "message_classifications").where("top_condition IS NOT NULL").select("message_id", "received_at", "top_condition")
    c = table(spark, d, "medical_conditions")
    names = c.select("id", "name", F.explode(F.array("name", "en")).alias("term"))
    syn = table(spark, d, "medical_condition_synonyms").join(c, F.col("condition_id") == F.col("id")).select("id", "name", F.col("synonym").alias("term"))
    out = E.canonical_labels(m, names.unionByName(syn), "top_condition")
    return out.groupBy("top_condition").agg(F.countDistinct("message_id").alias("messages"))


def benefit_score(spark, d):
    names = table(spark, d, "herbs").select("id", "ranking", F.explode(F.array("ro", "en", "latin")).alias("name")).where("name IS NOT NULL").select("id", "ranking", T.normalized("name").alias("k"))
    m = table(spark, d, "message_classifications").where("herb_name IS NOT NULL").select("session_id", T.normalized("herb_name").alias("k")).where("k <> ''").distinct()
    return m.join(names, "k").groupBy("session_id").agg(F.max("ranking").alias("best"))


def event_json(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("props").alias("with_props"), F.countDistinct(F.expr("json_object_keys(props)")).alias("shapes"))


def enum_order(spark, d):
    kind = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2)
    return table(spark, d, "orders").orderBy(kind, "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


def section_order(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.bround(F.max("l_extendedprice"), 0).alias("best"), F.countDistinct("l_partkey").alias("benefits"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return s.orderBy(F.desc("best"), F.desc("benefits"), F.desc("total"), "l_suppkey").limit(30)


def reference_numbers(spark, d):
    from pyspark.sql import Window as W

    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    first = li.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first"))
    return first.withColumn("number", F.dense_rank().over(W.partitionBy("l_orderkey").orderBy("first", "l_suppkey"))).select("l_orderkey", "l_suppkey", "number")


def label_citations(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy("p_type").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_orderkey").alias("orders"))


def report_merge(spark, d):
    c = table(spark, d, "chunks").where("heading IS NOT NULL")
    x = c.groupBy(T.normalized("heading").alias("section")).agg(F.min("chunk_id").alias("first"), F.array_sort(F.collect_set("category_id")).alias("evidence"))
    return x.where(F.col("section") != "")


def constant_relation(spark, d):
    v = spark.createDataFrame([("plante", "plants"), ("uleiuri", "oils"), ("suplimente", "supplements")], "category string, english string")
    return table(spark, d, "herbs").join(F.broadcast(v), "category").groupBy("english").agg(F.count("*").alias("n"))  # three literal rows


def amplified(spark, d):
    copies = spark.range(1, 4).withColumnRenamed("id", "copy")
    return table(spark, d, "region").crossJoin(F.broadcast(copies)).groupBy("r_name").agg(F.sum("copy").alias("copies"))  # the benchmark's duplicate amplification, three copies


def duration_regression(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("x"), F.col("o_custkey").alias("y"))
    return M.duration_regression(o, "o_orderpriority", "x", "y", 5_000_000_000)


def token_budget(spark, d):
    return M.token_budget(table(spark, d, "events"), "event_type", "event_id", "value")


def fragment_sizes(spark, d):
    return M.size_report(table(spark, d, "chunks").select("business_category", F.length("text").alias("size")), "business_category", "size")


def _ranking_of_labels(spark, d, by: str):
    from pyspark.sql import Window as W

    li = table(spark, d, "lineitem")
    w = W.partitionBy("l_suppkey").orderBy(F.desc(by), "l_orderkey", "l_linenumber")
    return li.select(F.col("l_suppkey").alias("query"), F.row_number().over(w).alias("position"), F.when(F.col("l_returnflag") != "N", F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") % 4).otherwise(0)).alias("grade"))


def retrieval_metrics(spark, d):
    m = M.retrieval_metrics(_ranking_of_labels(spark, d, "l_quantity"), "query", "position", "grade")
    return m.select("query", *(F.round(c, 6).alias(c) for c in ("precision_at_10", "reciprocal_rank", "ndcg_at_10", "recall_at_50")), "unjudged_at_10")


def metric_means(spark, d):
    m = retrieval_metrics(spark, d)
    ordered = F.array_sort(F.collect_list("ndcg_at_10"))
    return m.agg(F.round(F.avg("precision_at_10"), 6).alias("precision"), F.round(F.percentile("recall_at_50", 0.5), 6).alias("median_recall"), F.element_at(ordered, F.ceil(F.count("*") * 0.95).cast("int")).alias("p95_ndcg"))


def regression_compare(spark, d):
    a = M.retrieval_metrics(_ranking_of_labels(spark, d, "l_quantity"), "query", "position", "grade")
    b = M.retrieval_metrics(_ranking_of_labels(spark, d, "l_extendedprice"), "query", "position", "grade")
    return M.compare_metrics(a, b, "query", {"precision_at_10": 1, "recall_at_50": 1, "unjudged_at_10": -1})


def category_rollup(spark, d):
    return M.folder_rollup(table(spark, d, "documents").select(M.category_of(F.col("relative_path")).alias("folder_path")), "folder_path")


def category_selection(spark, d):
    r = category_rollup(spark, d)
    return r.where(F.col("folder").isin("plante", "plante/munte", "plante/somn")).agg(F.sum("own").alias("documents"))


_NAMES = """pair_states fragment_folding positive_ranking caution_pairs caution_ranking condition_scores condition_top product_mentions cooccurrence cooccurrence_ranking product_catalog
top_products unambiguous_names condition_dictionary catalog_checks literal_lookup optional_predicate evidence_page evidence_counts integrity_diff differential_publish bag_difference document_changes
upsert vector_reuse source_manifest source_fingerprints term_containment word_sets secondary_without_primary ordered_distinct canonical_conditions benefit_score event_json enum_order section_order reference_numbers
label_citations report_merge constant_relation amplified duration_regression token_budget fragment_sizes retrieval_metrics metric_means regression_compare category_rollup category_selection""".split()


def queries():
    return {n: globals()[n] for n in _NAMES}


def oracle_sql():
    return with_whole(_sql(), {"product_mentions": "positions", "fragment_sizes": "total", "category_rollup": "own", "category_selection": "documents"})


def _sql():
    eff = f"CASE WHEN l_linenumber = 1 AND ({_EFFECT}) = 'prohibition' THEN 'unknown' ELSE {_EFFECT} END"
    caution = f"SELECT entity, topic, ['prohibition', 'precaution', 'none', 'unknown'][CAST(min(o) AS BIGINT) + 1] AS effect, bool_or(r) AS recommended FROM (SELECT l_suppkey AS entity, l_partkey AS topic, l_discount > 0.05 AS r, list_position(['prohibition', 'precaution', 'none', 'unknown'], {eff}) - 1 AS o FROM lineitem) GROUP BY ALL"
    eligible = f"SELECT entity, topic FROM ({_PAIRS}) WHERE state IN ('positive', 'mixed')"
    scores = f"""WITH ev AS ({_EV}), el AS ({eligible}),
l1 AS (SELECT entity, topic, count(DISTINCT fragment) AS l1 FROM ev WHERE l_linenumber = 1 GROUP BY ALL),
l2 AS (SELECT entity, topic, count(DISTINCT fragment) AS l2 FROM ev JOIN el USING (entity, topic) GROUP BY ALL),
l3 AS (SELECT entity, count(DISTINCT topic) AS l3 FROM el GROUP BY ALL),
s AS (SELECT entity, topic, coalesce(l1, 0) AS l1, coalesce(l2, 0) AS l2, l3 FROM el LEFT JOIN l1 USING (entity, topic) LEFT JOIN l2 USING (entity, topic) JOIN l3 USING (entity))"""
    formula = product_formula().sql({"L1": "l1", "L2": "l2", "L3": "l3"})
    w = T.words_sql
    names = f"SELECT id AS name_id, {w('n')} AS w FROM (SELECT id, unnest([ro, en]) AS n FROM herbs)"
    mentions = f"""WITH nm AS (SELECT DISTINCT name_id, array_to_string(w, ' ') AS gram, len(w) AS n FROM ({names}) WHERE len(w) > 0),
t AS (SELECT chunk_id AS id, {w('text')} AS w FROM chunks),
g AS (SELECT id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM t, (SELECT DISTINCT n FROM nm) WHERE len(w) >= n),
m AS (SELECT g.id, nm.name_id, g.i - 1 AS position FROM g JOIN nm ON g.n = nm.n AND array_to_string(list_slice(g.w, g.i, g.i + g.n - 1), ' ') = nm.gram)"""
    pairs = mentions + ", c AS (SELECT chunk_id AS id, unnest(list_distinct(list_concat(coalesce(primary_medical_conditions, []), coalesce(secondary_medical_conditions, [])))) AS condition FROM chunks), p AS (SELECT DISTINCT name_id, condition FROM m JOIN c USING (id))"
    alias = lambda k: f"coalesce((SELECT list(DISTINCT a.name ORDER BY a.name) FROM herb_aliases a WHERE a.herb_id = h.id AND a.kind = '{k}'), []) AS {k}"
    metrics = lambda by: f"""r AS (SELECT l_suppkey AS query, row_number() OVER (PARTITION BY l_suppkey ORDER BY {by} DESC, l_orderkey, l_linenumber) AS p, CASE WHEN l_returnflag <> 'N' THEN CASE WHEN l_returnflag = 'R' THEN l_linenumber % 4 ELSE 0 END END AS g FROM lineitem),
got AS (SELECT query, count(*) FILTER (p <= 10 AND g > 0) / 10.0 AS precision_at_10, coalesce(max(CASE WHEN g > 0 THEN 1.0 / p END), 0) AS reciprocal_rank, sum(CASE WHEN p <= 10 THEN (pow(2, coalesce(g, 0)) - 1) / log2(p + 1) END) AS dcg, count(*) FILTER (p <= 50 AND g > 0) AS hits, count(*) FILTER (p <= 10 AND g IS NULL) AS unjudged_at_10 FROM r GROUP BY 1),
ideal AS (SELECT query, sum(CASE WHEN i <= 10 THEN (pow(2, g) - 1) / log2(i + 1) END) AS ideal, count(*) AS n FROM (SELECT query, g, row_number() OVER (PARTITION BY query ORDER BY g DESC) AS i FROM r WHERE g > 0) GROUP BY 1),
m AS (SELECT query, round(precision_at_10, 6) AS precision_at_10, round(reciprocal_rank, 6) AS reciprocal_rank, round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS ndcg_at_10, round(coalesce(hits / nullif(n, 0), 0), 6) AS recall_at_50, unjudged_at_10, hits / nullif(n, 0) AS rec FROM got LEFT JOIN ideal USING (query))"""  # noqa: E731
    rollup = "SELECT folder, sum(CASE WHEN folder = f THEN 1 ELSE 0 END) AS own, count(*) AS total FROM (SELECT f, unnest(list_transform(range(1, len(string_split(f, '/')) + 1), lambda k: array_to_string(list_slice(string_split(f, '/'), 1, k), '/'))) AS folder FROM (SELECT regexp_replace(regexp_replace(relative_path, '^(ro|en)/', ''), '/?[^/]*$', '') AS f FROM documents)) GROUP BY 1"
    norm = T.normalized_sql
    state_pairs = lambda where: f"SELECT entity, topic, {_STATE} AS state FROM (SELECT entity, topic, {_COUNTS} FROM ({_EV}) WHERE {where} GROUP BY ALL)"
    return {
        "pair_states": _PAIRS,
        "fragment_folding": f"SELECT entity, label, count(*) AS n FROM ({_FOLDED}) GROUP BY ALL",
        "positive_ranking": f"SELECT s_suppkey AS entity, count(p.entity) AS ranking FROM supplier LEFT JOIN ({_PAIRS}) p ON p.entity = s_suppkey AND p.state = 'positive' GROUP BY 1",
        "caution_pairs": caution,
        "caution_ranking": f"SELECT s_suppkey AS entity, count(*) FILTER (effect IN ('prohibition', 'precaution')) AS cautions, count(*) FILTER (effect = 'prohibition') AS prohibitions, count(*) FILTER (recommended) AS recommended FROM supplier LEFT JOIN ({caution}) p ON p.entity = s_suppkey GROUP BY 1",
        "condition_scores": scores + " SELECT * FROM s",
        "condition_top": scores + f" SELECT topic, position, entity, score FROM (SELECT *, {formula} AS score, row_number() OVER (PARTITION BY topic ORDER BY {formula} DESC, l3 DESC, entity) AS position FROM s) WHERE position <= 10",
        "product_mentions": mentions + " SELECT name_id, count(DISTINCT id) AS chunks, count(*) AS mentions, sum(position) AS positions FROM m GROUP BY 1",
        "cooccurrence": pairs + " SELECT * FROM p",
        "cooccurrence_ranking": pairs + " SELECT h.id AS name_id, count(p.condition) AS ranking FROM herbs h LEFT JOIN p ON p.name_id = h.id GROUP BY 1",
        "product_catalog": f"SELECT h.id, h.ro, {alias('ro_regional')}, {alias('latin_synonyms')}, {alias('en_alt')} FROM herbs h",
        "top_products": f"SELECT h.id, h.ranking, {alias('ro_regional')}, {alias('en_alt')} FROM (SELECT * FROM herbs ORDER BY ranking DESC, id LIMIT 25) h",
        "unambiguous_names": f"SELECT name, min(id) AS id FROM (SELECT id, {norm('n')} AS name FROM (SELECT id, unnest([ro, en, latin]) AS n FROM herbs UNION ALL SELECT herb_id, name FROM herb_aliases) WHERE n IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT id) = 1",
        "condition_dictionary": f"SELECT c.id, {norm('c.name')} AS name, c.en, coalesce((SELECT list(DISTINCT s.synonym ORDER BY s.synonym) FROM medical_condition_synonyms s WHERE s.condition_id = c.id), []) AS synonyms FROM medical_conditions c",
        "catalog_checks": f"SELECT 'shared_names' AS check, count(*) AS n FROM (SELECT {norm('ro')} AS k FROM herbs GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'category ' || category, count(*) FROM herbs GROUP BY 1 UNION ALL SELECT 'without_family', count(*) FROM herbs WHERE family IS NULL UNION ALL SELECT 'wildcards', count(*) FROM herbs WHERE regexp_matches(ro, '[%_\\\\]')",
        "literal_lookup": "SELECT id, ro, wanted FROM herbs JOIN (VALUES ('urechea-pițigoiului %_'), ('GHEARA-DIHORULUI'), ('%')) v(wanted) ON lower(ro) = lower(wanted)",
        "optional_predicate": "SELECT category, count(*) AS aliases FROM herbs JOIN herb_aliases ON id = herb_id WHERE kind = 'en_alt' GROUP BY 1",
        "evidence_page": f"SELECT fragment, topic, label, l_linenumber FROM ({_EV}) JOIN ({eligible}) USING (entity, topic) WHERE entity = 7 ORDER BY fragment, l_linenumber, topic LIMIT 20 OFFSET 20",
        "evidence_counts": "SELECT condition, count(*) AS chunks, count(DISTINCT p) AS documents FROM (SELECT source_relative_path AS p, unnest(secondary_medical_conditions) AS condition FROM chunks) GROUP BY 1",
        "integrity_diff": f"WITH a AS ({state_pairs('true')}), b AS ({state_pairs('l_linenumber < 7')}) SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
        "differential_publish": "WITH o AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate < '1997-01-01'), n AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 3) SELECT *, 'delete' AS action FROM (FROM o EXCEPT FROM n) UNION ALL SELECT *, 'insert' FROM (FROM n EXCEPT FROM o)",
        "bag_difference": "SELECT l_suppkey, l_returnflag, count(*) AS n FROM (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber <= 2 EXCEPT ALL SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber = 2) GROUP BY ALL",
        "document_changes": "SELECT coalesce(c.relative_path, s.p) AS relative_path, CASE WHEN s.p IS NULL THEN 'new' WHEN c.relative_path IS NULL THEN 'deleted' WHEN c.sha256 IS NOT DISTINCT FROM s.v THEN 'same' ELSE 'changed' END AS change FROM documents c FULL JOIN (SELECT source_relative_path AS p, max(lower(trim(source_sha256))) AS v FROM chunks GROUP BY 1) s ON s.p = c.relative_path",
        "upsert": "WITH n AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'), u AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n) SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM u GROUP BY 1",
        "vector_reuse": "WITH k AS (SELECT source_relative_path, lower(text_sha256) AS h, min(round(CAST(embedding[1] AS DOUBLE), 6)) AS first FROM chunks WHERE business_category = 'R1' AND embedding IS NOT NULL GROUP BY ALL) SELECT c.chunk_id, coalesce(k.first, -9.0) AS first FROM chunks c LEFT JOIN k ON k.source_relative_path = c.source_relative_path AND k.h = lower(c.text_sha256)",
        "source_manifest": "SELECT language, count(*) AS rows, sha256(array_to_string(list(DISTINCT h ORDER BY h), ',')) AS digest FROM (SELECT language, left(sha256(coalesce(text, '')), 4) AS h FROM chunks) GROUP BY 1",
        "term_containment": f"WITH t AS (SELECT id, ' ' || {norm('ro')} || ' ' AS n FROM herbs) SELECT a.id, b.id AS inner_id FROM t a JOIN t b ON a.id <> b.id AND contains(a.n, b.n)",
        "word_sets": f"WITH t AS (SELECT id, list_distinct(list_filter({w('name')}, lambda x: length(x) > 2)) AS w FROM medical_conditions) SELECT a.id, b.id AS other, len(list_intersect(a.w, b.w)) AS common, len(list_intersect(a.w, b.w)) = len(a.w) AND len(a.w) < len(b.w) AS proper_subset FROM t a JOIN t b ON a.id <> b.id AND list_has_any(a.w, b.w)",
        "secondary_without_primary": "SELECT chunk_id, list_filter(coalesce(secondary_medical_conditions, []), lambda x: NOT list_contains(coalesce(primary_medical_conditions, []), x)) AS kept FROM chunks",
        "ordered_distinct": f"SELECT item_id, len(w) AS n, md5(array_to_string(w, ' ')) AS words FROM (SELECT item_id, list_transform(list_sort(list_transform(list_distinct(w), lambda x: list_position(w, x))), lambda i: w[i]) AS w FROM (SELECT item_id, {w('text')} AS w FROM benchmark))",
        "canonical_conditions": f"WITH d AS (SELECT k, min(name) AS n FROM (SELECT {norm('t')} AS k, name FROM (SELECT name, unnest([name, en]) AS t FROM medical_conditions UNION ALL SELECT c.name, s.synonym FROM medical_condition_synonyms s JOIN medical_conditions c ON c.id = s.condition_id)) GROUP BY 1) SELECT coalesce(d.n, m.top_condition) AS top_condition, count(DISTINCT message_id) AS messages FROM message_classifications m LEFT JOIN d ON d.k = {norm('m.top_condition')} WHERE m.top_condition IS NOT NULL GROUP BY 1",
        "benefit_score": f"WITH n AS (SELECT ranking, {norm('n')} AS k FROM (SELECT ranking, unnest([ro, en, latin]) AS n FROM herbs) WHERE n IS NOT NULL), m AS (SELECT DISTINCT session_id, {norm('herb_name')} AS k FROM message_classifications WHERE herb_name IS NOT NULL) SELECT session_id, max(ranking) AS best FROM m JOIN n USING (k) WHERE k <> '' GROUP BY 1",
        "event_json": "SELECT event_type, count(*) AS n, count(props) AS with_props, count(DISTINCT json_keys(props)) AS shapes FROM events GROUP BY 1",
        "enum_order": "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END, o_orderdate, o_orderkey LIMIT 50",
        "section_order": "SELECT * FROM (SELECT l_suppkey, round_even(max(l_extendedprice), 0) AS best, count(DISTINCT l_partkey) AS benefits, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1) ORDER BY best DESC, benefits DESC, total DESC, l_suppkey LIMIT 30",
        "reference_numbers": "SELECT l_orderkey, l_suppkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY first, l_suppkey) AS number FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first FROM lineitem GROUP BY ALL)",
        "label_citations": "SELECT p_type, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
        "report_merge": f"SELECT * FROM (SELECT {norm('heading')} AS section, min(chunk_id) AS first, list(DISTINCT category_id ORDER BY category_id) AS evidence FROM chunks WHERE heading IS NOT NULL GROUP BY 1) WHERE section <> ''",
        "constant_relation": "SELECT english, count(*) AS n FROM herbs JOIN (VALUES ('plante', 'plants'), ('uleiuri', 'oils'), ('suplimente', 'supplements')) v(category, english) USING (category) GROUP BY 1",
        "amplified": "SELECT r_name, CAST(sum(copy) AS BIGINT) AS copies FROM region, generate_series(1, 3) g(copy) GROUP BY 1",
        "duration_regression": "SELECT o_orderpriority, samples, CAST(ceil(CAST(5000000000 AS DOUBLE) * CAST(xy AS DOUBLE) / (1000.0 * CAST(xx AS DOUBLE))) AS BIGINT) AS seconds FROM (SELECT o_orderpriority, count(*) AS samples, sum(CAST(x AS HUGEINT) * y) AS xy, sum(CAST(x AS HUGEINT) * x) AS xx FROM (SELECT o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS x, o_custkey AS y FROM orders) GROUP BY 1)",
        "token_budget": "SELECT event_type, samples, CASE WHEN samples >= 20 AND p > 0 THEN CAST(floor((ceil(p) * 125 + 99) / 100) AS BIGINT) END AS budget FROM (SELECT event_type, count(*) AS samples, quantile_cont(value, 0.95) AS p FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events WHERE value IS NOT NULL) WHERE n <= 200 GROUP BY 1)",
        "fragment_sizes": "SELECT g AS business_category, count(*) AS items, sum(s) AS total, CAST(floor(quantile_cont(s, 0.5)) AS BIGINT) AS median, max(CASE WHEN r = greatest(floor(n * 0.95), 1) THEN s END) AS p95, max(s) AS largest, count(*) FILTER (s > 2000) AS over_2000, count(*) FILTER (s > 5000) AS over_5000 FROM (SELECT business_category AS g, length(text) AS s, row_number() OVER (PARTITION BY business_category ORDER BY length(text)) AS r, count(*) OVER (PARTITION BY business_category) AS n FROM chunks WHERE text IS NOT NULL) GROUP BY 1",
        "retrieval_metrics": f"WITH {metrics('l_quantity')} SELECT * EXCLUDE (rec) FROM m",
        "metric_means": f"WITH {metrics('l_quantity')} SELECT round(avg(precision_at_10), 6) AS precision, round(quantile_cont(recall_at_50, 0.5), 6) AS median_recall, list_sort(list(ndcg_at_10))[CAST(ceil(count(*) * 0.95) AS BIGINT)] AS p95_ndcg FROM m",
        "regression_compare": f"WITH a AS (WITH {metrics('l_quantity')} SELECT * FROM m), b AS (WITH {metrics('l_extendedprice')} SELECT * FROM m), "
        + "u AS (SELECT query, unnest(['precision_at_10', 'recall_at_50', 'unjudged_at_10']) AS metric, unnest([b.precision_at_10 - a.precision_at_10, coalesce(b.rec, 0) - coalesce(a.rec, 0), a.unjudged_at_10 - b.unjudged_at_10]) AS d, b.query IS NULL AS gone FROM a LEFT JOIN b USING (query)) SELECT query, metric, CASE WHEN gone OR d IS NULL THEN 'missing' WHEN d > 1e-12 THEN 'improved' WHEN d < -1e-12 THEN 'worse' ELSE 'same' END AS change FROM u",
        "category_rollup": rollup,
        "category_selection": f"SELECT sum(own) AS documents FROM ({rollup}) WHERE folder IN ('plante', 'plante/munte', 'plante/somn')",
    }
