import hashlib
import itertools

from pyspark.sql import functions as F

from quillspark.operators import evidence as E
from quillspark.operators import generation as G
from quillspark.operators import measures as M
from quillspark.operators import messages as ms
from quillspark.plans import evidence as plans


def test_every_label_combination(spark):
    rows, want = [], {}
    for k, labels in enumerate(c for n in range(1, 5) for c in itertools.combinations(E.LABELS, n)):
        rows += [(k, 1, x) for x in labels]
        s = set(labels)
        want[k] = "mixed" if "mixed" in s or {"positive", "caution"} <= s else "positive" if "positive" in s else "caution" if "caution" in s else "unclear"
    rows.append((99, 1, None))
    want[99] = "unclear"
    got = E.pair_states(spark.createDataFrame(rows, "entity int, topic int, label string"))
    assert {r.entity: r.state for r in got.collect()} == want


def test_zero_counts_survive(spark):
    e = spark.createDataFrame([(1,), (2,)], "k int")
    p = spark.createDataFrame([(1, "positive"), (1, "caution")], "k int, state string")
    got = E.zero_preserving_ranking(e, p, "k", {"n": F.col("state") == "positive"})
    assert {(r.k, r.n) for r in got.collect()} == {(1, 1), (2, 0)}


def test_cautions(spark):
    d = spark.createDataFrame([(1, "none", False), (1, "prohibition", True), (2, "unknown", False), (2, "precaution", False)], "k int, effect string, recommended boolean")
    assert {(r.k, r.effect, r.recommended) for r in E.fold_cautions(d, ["k"]).collect()} == {(1, "prohibition", True), (2, "precaution", False)}


def test_mentions_whole_words_and_accents(spark):
    t = spark.createDataFrame([(1, "Ceai de MUȘEȚEL verde, musetel."), (2, None), (3, "mușețelul")], "id long, text string")
    n = spark.createDataFrame([(7, "mușețel"), (8, "mușețel verde"), (9, ""), (10, None)], "name_id int, name string")
    got = {(r.id, r.name_id, r.position) for r in E.phrase_mentions(t, n, "id", "text").collect()}
    assert got == {(1, 7, 2), (1, 7, 4), (1, 8, 2)}
    assert E.phrase_mentions(t, n.limit(0), "id", "text").count() == 0


def test_scores(spark):
    ev = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a", "x"), (2, "b", "x")], "f int, e string, t string")
    pairs = spark.createDataFrame([("a", "x", "positive"), ("b", "x", "caution"), ("c", "x", "mixed")], "e string, t string, state string")
    got = {(r.e, r.l1, r.l2, r.l3) for r in E.condition_scores(ev.where("f = 1"), ev, pairs, "f", "e", "t").collect()}
    assert got == {("a", 1, 2, 1), ("c", 0, 0, 1)}


def test_generation(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "y")], "k int, v string")
    assert {(r.k, r.side) for r in G.symmetric_difference(a, b).collect()} == {(1, "a"), (3, "b")}
    assert {(r.k, r.action) for r in G.differential(a, b, ["k", "v"]).collect()} == {(1, "delete"), (3, "insert")}
    assert G.differential(a, a, ["k", "v"]).count() == 0
    h = lambda df: G.content_hash(df, df.columns).first()
    assert h(a) == h(a.repartition(7).orderBy(F.desc("k"))) and h(a) != h(b) and h(a) != h(a.distinct())
    assert h(a.limit(0)).rows == 0
    got = {(r.k, r.change) for r in G.changes(a.distinct(), b.withColumn("v", F.when(F.col("k") == 3, "y")), "k", "v").collect()}
    assert got == {(1, "deleted"), (2, "same"), (3, "new")}


def test_fingerprints_see_every_change(spark, tmp_path):
    def digests(rows):
        spark.createDataFrame(rows, "chunk_id long, language string, text string, embedding array<float>").write.mode("overwrite").parquet(f"{tmp_path}/chunks.parquet")
        return {(r.source, r.language): (r.rows, r.digest) for r in plans.source_fingerprints(spark, str(tmp_path)).collect()}

    for name in ("documents", "herbs", "herb_aliases", "medical_conditions", "medical_condition_synonyms"):
        spark.createDataFrame([(1, "ro")], "id int, lang string").write.parquet(f"{tmp_path}/{name}.parquet")
    seen = {}  # two texts whose SHA-256 begins with the same four digits
    a, b = next((seen[h], f"t{k}") for k in range(10_000) if seen.setdefault(h := hashlib.sha256(f"t{k}".encode()).hexdigest()[:4], f"t{k}") != f"t{k}")
    base = [(1, "ro", a, [1.0]), (2, "ro", a, [2.0]), (3, "en", "x", None)]
    first = digests(base)
    assert len(first) == 7 and first["chunks", "ro"][0] == 2 and first == digests(base[::-1])
    for other in ([*base[:1], (2, "ro", b, [2.0]), base[2]], [*base[:1], (2, "ro", a, [2.5]), base[2]], base[:1] + base[2:], [*base, base[0]]):
        after = digests(other)
        assert after["chunks", "ro"] != first["chunks", "ro"] and after["chunks", "en"] == first["chunks", "en"]


def test_estimates(spark):
    s = spark.createDataFrame([("m", 100, 2000), ("m", 300, 6000), ("z", 0, 5)], "g string, x long, y long")
    assert {(r.g, r.seconds) for r in M.duration_regression(s, "g", "x", "y", 1000).collect()} == {("m", 20), ("z", None)}
    u = spark.createDataFrame([("a", i, float(i)) for i in range(300)] + [("b", 1, 5.0)], "g string, id long, v double")
    got = {r.g: (r.samples, r.budget) for r in M.token_budget(u, "g", "id", "v").collect()}
    p = 100 + 0.95 * 199
    assert got == {"a": (200, (-(-p // 1) * 125 + 99) // 100), "b": (1, None)}


def test_metrics_and_rollup(spark):
    r = spark.createDataFrame([(1, 1, 0), (1, 2, 3), (1, 3, None), (2, 1, 0)], "q int, p int, g int")
    got = {x.query if "query" in x else x.q: x for x in M.retrieval_metrics(r, "q", "p", "g").collect()}
    assert got[1].precision_at_10 == 0.1 and got[1].reciprocal_rank == 0.5 and got[1].unjudged_at_10 == 1 and 0.6 < got[1].ndcg_at_10 < 0.64
    assert got[2].ndcg_at_10 == 0 and got[2].recall_at_50 == 0
    d = spark.createDataFrame([("a/b",), ("a/b/c",), ("a/b/c",), (None,)], "f string")
    assert {(x.folder, x.own, x.total) for x in M.folder_rollup(d, "f").collect()} == {("a", 0, 3), ("a/b", 1, 3), ("a/b/c", 2, 2)}


def test_messages(spark):
    rows = [("p", 0, 0, "warning", "Același text.", "one"), ("p", 0, 1, "contraindication", "acelasi TEXT", "two"), ("p", 1, 0, "contraindication", "alt", "Two!"), ("q", 0, 0, "warning", None, "x")]
    got = {(r.product, r.rank, r.position): r.kept for r in ms.merge_messages(spark.createDataFrame(rows, "product string, rank int, position int, type string, ro string, en string"), "product").collect()}
    assert got == {("p", 0, 0): False, ("p", 0, 1): True, ("p", 1, 0): False, ("q", 0, 0): True}
    j = spark.createDataFrame([(1, '{"status":"complete","messages":[{"type":"warning","text":"ok"},{"type":"x","text":"no"},{"type":"warning","text":"a\\nb"},{"type":"warning","text":"кот"}]}'), (2, "nope"), (3, '{"status":"odd"}'), (4, None)], "id int, a string")
    got = {r.id: (len(r.valid_messages), r.problem) for r in ms.valid_answers(j, "a").collect()}
    assert got == {1: (1, None), 2: (0, "not_an_answer"), 3: (0, "unknown_status"), 4: (0, "not_an_answer")}
    label, rest = ms.split_label(F.col("t"))
    s = spark.createDataFrame([("Mușețel: ceai de trei ori",), ("Tei – infuzie",), ("Soc pentru tuse",), ("Mentă (2 g) pe zi",), ("fără nume",)], "t string")
    assert [(r.l, r.r) for r in s.select(label.alias("l"), rest.alias("r")).collect()] == [("Mușețel", "ceai de trei ori"), ("Tei", "infuzie"), ("Soc", "pentru tuse"), ("Mentă", "(2 g) pe zi"), ("", "fără nume")]
    assert ms.parse_top("top 10 plante") == ms.TopRequest(10, "plante") and ms.parse_top("top plante pentru tuse") is None


def test_display():
    from quillspark.operators import display as D

    assert D.highlight_ranges("Un  CEAI\n de mușețel", ["ceai", "musetel", "de"]) == [(3, 18)] and D.highlight_ranges("", ["a"]) == []
    text = "Propoziția unu. " * 200
    spans = D.quote_spans(text)
    assert "".join(text[a:b] for a, b in spans) == text and all(b - a <= 1000 and text[a:b].endswith(". ") for a, b in spans)
    assert D.quote_spans("x" * 2500) == [(0, 1000), (1000, 2000), (2000, 2500)] and D.quote_spans("") == []
    md = "Vezi [aici](http://x/1) și `cod` acum.\n```\nbloc\n```\nfinal"
    parts = D.segments(md)
    assert "".join(p for p, _ in parts) == md and [p for p, t in parts if not t] == ["[aici](http://x/1)", "`cod`", "```\nbloc\n```"]
