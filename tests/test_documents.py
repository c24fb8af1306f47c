import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import clean as C
from quillspark.operators import fragment as fr
from quillspark.operators import resolve, rules, spans, spelling
from quillspark.plans import documents as plan_documents
from quillspark.plans import messages as plan_messages
from quillspark.sources import files
from quillspark.streaming import state


def test_clean_text_keeps_lines_and_numbers(spark):
    rows = [(1, "a [b](http://x.y/12) c\n<a href='q'>d</a>  e \nwww.site.ro a@b.ro f­g ﬁ"), (2, None), (3, "")]
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id int, text string").select("id", C.clean_text("text").alias("t")).collect()}
    assert got[1] == "a b c\nd e\n fg fi" and got[2] is None and got[3] == ""


def test_document_rules():
    meta = "---\nsource_path: x\n---\n\n# T\n"
    assert C.strip_metadata(meta) == "# T\n" and C.strip_metadata("---\na: b\n---\nx") == "---\na: b\n---\nx"
    assert C.strip_page_markers("a\n\n### Pagina 3\n\nb\n<!-- Pagina PDF 8 -->\nc")[0] == "a\n\nb\nc"
    toc = "# Cuprins\n" + "\n".join(f"Capitolul {i} ..... {i}" for i in range(20))
    assert C.strip_furniture(toc + "\n# Text\nx")[0] == "# Text\nx"
    assert C.strip_furniture(toc.replace("..... 3", "500 mg") + "\n# Text\nx")[1] == []
    for phone in ("0745 123 456", "+40 21 319 6390", "1-800-555-0199"):
        assert C.is_phone(phone, False, "", "")
    for other in ("4.200.000", "12.03.2015", "9789731234567", "100000/1998", "000000000"):
        assert not C.is_phone(other, False, "", "")
    assert not C.is_phone("0745 123 456", False, "", " mg")
    text, gone = C.strip_contacts("Sunați la tel. 0745 123 456.\ntel: 021 319 6390\n500 mg")
    assert text == "Sunați la.\n500 mg" and len(gone) >= 3
    cleaned, removed = C.clean_document(meta + "Sunați: 0745123456\n\n\n\nrest 12")
    assert "0745" not in cleaned and "\n\n\n" not in cleaned and "rest 12" in cleaned and removed


def test_headers_and_numbers(spark):
    text = "# Cartea mea\n" + "Cartea mea 12\n" + "\n".join(["Cartea mea"] * 5) + "\nalt\n5 mg\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "Editura X\n© 2015 Y\nisbn 5")], "id int, text string")
    assert [(r.line, r.removed) for r in C.repeated_headers(df, "id", "text").collect()] == [("Cartea mea", 4)]
    assert {(r.id, r.n) for r in C.credit_lines(df, "id", "text").collect()} == {(3, 0), (3, 1), (3, 2)}
    a, b = C.numbers(df, "id", "text"), C.numbers(df.withColumn("text", F.regexp_replace("text", "12", "")), "id", "text")
    assert [(r.number, r.missing) for r in C.missing_numbers(a, b).collect()] == [("12", 1)]
    assert C.missing_numbers(a, b, spark.createDataFrame([(1, "12", 1)], "id int, number string, n long")).count() == 0


def test_headings_and_scopes(spark):
    df = spark.createDataFrame([(1, "# A\nx\n## B\ny\n### Pagina 3\n## C\n# D ##\nz"), (2, "fără"), (3, None)], "id int, text string")
    got = [(r.title, r.body_end, r.subtree_end, r.path) for r in spans.headings(C.lines(df, "id", "text")).orderBy("n").collect()]
    assert got == [("A", 2, 6, "A"), ("B", 5, 5, "A > B"), ("C", 6, 6, "A > C"), ("D", 8, 8, "D")]
    s = {(r.id, r.n): r.scope for r in spans.scope_at(C.lines(df, "id", "text").select("id", "n"), spans.headings(C.lines(df, "id", "text"))).collect()}
    assert s[1, 1] == "A" and s[1, 3] == "B" and s[1, 7] == "D" and s[2, 0] is None


def test_spans(spark):
    rows = [(1, 0, 5, "condition"), (1, 3, 8, "product"), (1, 8, 9, "product"), (1, 4, 4, "product"), (2, None, 3, "product")]
    df = spark.createDataFrame(rows, "id int, begin int, finish int, kind string")
    assert sorted((r.begin, r.finish, r.kind) for r in spans.sweep(df).collect()) == [(0, 3, "condition"), (3, 9, "product")]
    p = df.withColumn("priority", F.when(F.col("kind") == "product", 1).otherwise(0))
    assert sorted((r.begin, r.finish) for r in spans.non_overlapping(p).collect()) == [(0, 5), (8, 9)]
    g = spark.createDataFrame([("a", 1, 3), ("a", 5, 6), ("a", 6, 9), ("b", 1, 2)], "g string, b int, f int")
    assert {(r.b, r.problem, r.size) for r in spans.range_gaps(g, ["g"], "b", "f").collect()} == {(5, "gap", 1), (6, "overlap", 1)}
    q = spark.createDataFrame([("a", i, s) for i, s in enumerate([5, 5, 20, 3, None, 8])], "g string, o int, s int")
    got = [r.batch for r in spans.pack_batches(q, "g", ["o"], "s", 10).orderBy("o").collect()]
    assert got == spans.pack([5, 5, 20, 3, 0, 8], 10) == [0, 0, 1, 2, 2, 3]


TERMS = [("Adenom", "Adenom"), ("Adenom colonic", "Adenom colonic"), ("Gripă", "Gripă"), ("Gripă", "influenza")]


def test_phrases_prefer_the_longest():
    p = fr.Phrases.of(TERMS)
    assert p.found("Despre adenomul colonic și gripei") == ["Adenom colonic", "Gripă"] and p.found("adenom") == ["Adenom"] and p.found("") == []


def test_fragments(spark):
    text = "# Carte\nintro\n## Gripa\nceai\n### Detalii\nmai mult\n## Altele\ndespre adenom\n## Rest\nnimic\n### Pagina 4\nnimic"
    got = [(f[4], f[1], f[2], f[3], f[5], f[6]) for f in fr.fragments(text, fr.Phrases.of(TERMS))]
    assert got == [("D1", 1, 2, "Carte", [], []), ("R1", 3, 6, "Carte > Gripa", ["Gripă"], []), ("R2", 7, 8, "Carte > Altele", [], ["Adenom"]), ("D1", 9, 12, "Carte > Rest", [], [])]
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "\n\n")], "id int, text string")
    assert {r.id for r in fr.fragment_documents(df, TERMS, "id", "text").collect()} == {1}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n", max_size=900), max_size=12))
def test_pieces_cover_the_text(parts):
    lines = list(enumerate("".join(parts).split("\n"), 1))
    pieces = fr.cut_pieces(lines)
    assert all(len(p) <= fr.MOST and p.strip() == p for p, _, _ in pieces)
    assert all(1 <= a <= b <= len(lines) for _, a, b in pieces)
    whole = "".join("\n".join(s for _, s in lines).split())
    assert not whole or (pieces and whole.startswith("".join(pieces[0][0].split())) and whole.endswith("".join(pieces[-1][0].split())))


def test_resolution(spark):
    r = resolve.Resolver(TERMS)
    assert r.expression("GRIPA").conditions == ("Gripă",) and r.expression("GRIPA").whole
    assert r.expression("adenom colonicc").whole and not r.expression("ceva pentru adenom colonic rapid").whole
    assert r.expression("ceva pentru adenom colonic rapid").rest == "ceva pentru rapid"
    assert r.expression("nimic").conditions == () and r.question("gripa, , adenom")[1].conditions == ("Adenom",)
    df = spark.createDataFrame([(1, "gripa"), (2, None), (3, "")], "id int, text string")
    assert {x.id for x in resolve.resolve_questions(df, TERMS, "id", "text").collect()} == {1}


def test_rules(spark):
    unit = "Tinctura de tei ajută la tuse. Persoanele cu gripă evită socul. Lista: tei, soc"
    at = lambda w, k=0: (unit.index(w, k), unit.index(w, k) + len(w))
    assert rules.decide(rules.Candidate(unit, "", at("tei"), at("tuse"))).label == "positive"
    assert rules.decide(rules.Candidate(unit, "", at("soc"), at("gripă"))).label == "caution"
    assert rules.decide(rules.Candidate(unit, "", at("tei"), at("tei"))).code == "shared_mention"
    assert rules.decide(rules.Candidate("xx", "", (0, 9), (0, 1))).code == "place_outside_unit"
    rows = [(1, unit, None, *at("tei"), *at("tuse")), (2, None, None, 0, 1, 0, 1), (3, "soc și tei", "", 0, 3, 7, 10)]
    got = {r.identity: r.label for r in rules.classify(spark.createDataFrame(rows, "identity int, unit string, heading string, p0 int, p1 int, c0 int, c1 int")).collect()}
    assert got == {1: "positive", 2: "unclear", 3: None}


def test_every_pair_of_a_chunk_is_judged(spark, tmp_path):
    text = "Ceai-verde ajută la tuse. Persoanele cu gripă evită ulei-fin, nu ceai-verde."
    spark.createDataFrame([(1, text, None), (2, "ceai-verde", ""), (3, None, None)], "chunk_id int, text string, heading string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(1, "Tuse", None), (2, "Gripă", None)], "id int, name string, en string").write.parquet(f"{tmp_path}/medical_conditions.parquet")
    spark.createDataFrame([], "condition_id int, synonym string").write.parquet(f"{tmp_path}/medical_condition_synonyms.parquet")
    rows = plan_documents.polarity_rules(spark, str(tmp_path)).collect()
    got = {(text[r.p0 : r.p1], r.p0, text[r.c0 : r.c1]): r.label for r in rows}
    names = [("Ceai-verde", 0), ("ulei-fin", text.index("ulei-fin")), ("ceai-verde", text.index("ceai-verde"))]
    assert len(rows) == 6 and set(got) == {(*n, c) for n in names for c in ("tuse", "gripă")}
    assert got[(*names[0], "tuse")] == "positive" and got[(*names[1], "gripă")] == got[(*names[2], "gripă")] == "caution"


def test_one_edit():
    assert all(spelling.one_edit(a, b) for a, b in (("abc", "acb"), ("abc", "ab"), ("abc", "abcd"), ("abc", "xbc"), ("abc", "bac")))
    assert not any(spelling.one_edit(a, b) for a, b in (("abc", "abc"), ("abc", "cba"), ("abc", "ab1"), ("abc", "a"), ("abc", "bca")))


def test_spelling(spark):
    counts = spark.createDataFrame([("medicament", 500), ("medciament", 1), ("tratamentul", 400), ("tratamentulmedicament", 1), ("medicamentx", 1)], "word string, n long")
    d = counts.where("n >= 400").select("word")
    assert {(r.word, r.fix) for r in spelling.typo_fixes(counts, d).collect()} == {("medciament", "medicament")}
    assert {(r.word, r.fix) for r in spelling.split_fixes(counts, d, ["de"]).collect()} == {("tratamentulmedicament", "tratamentul medicament")}
    texts = spark.createDataFrame([(1, "Un medciament, Medciament MEDCIAMENT"), (2, None)], "id int, text string")
    fixed = {r.id: (r.text, r.changes) for r in spelling.apply_fixes(texts, "id", "text", spelling.typo_fixes(counts, d)).collect()}
    assert fixed == {1: ("Un medicament, Medciament MEDICAMENT", 2), 2: (None, 0)}
    out, n = spelling.stabilize(spark.range(3).withColumn("x", F.lit(5)), lambda df: df.withColumn("x", F.greatest(F.col("x") - 1, F.lit(3))))
    assert n == 3 and {r.x for r in out.collect()} == {3}


def test_spelling_of_accented_words_and_both_languages(spark, tmp_path):
    texts = [(1, "Două medciamentoasă, PĂMNT, medicamentoasă"), (2, "medciamentoasa, pamnt"), (3, "după tratamentulpământ")]
    fixes = [("medciamentoasa", "medicamentoasă"), ("pamnt", "pământ"), ("tratamentulpamant", "tratamentul pamant")]
    got = spelling.apply_fixes(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame(fixes, "word string, fix string"))
    assert {r.id: (r.text, r.changes) for r in got.collect()} == {1: ("Două medicamentoasă, PĂMÂNT, medicamentoasă", 2), 2: ("medicamentoasa, pamant", 2), 3: ("după tratamentul pământ", 1)}
    right = " ".join(["medicamentoasă tratamentul grădina"] * 700)
    rows = [(1, "ro", right), (2, "ro", "o medciamentoasă"), (3, "ro", "la tratamentulgrădina"), (4, "en", "medciamentoasa"), (5, "ro", "medicamentoasă"), (6, "ro", None)]
    spark.createDataFrame(rows, "chunk_id int, language string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    assert {(r.id, r.changes) for r in plan_messages.spelled_texts(spark, str(tmp_path)).collect()} == {(2, 1), (3, 1), (4, 1)}


def test_rate_limit(spark):
    t0 = dt.datetime(2025, 1, 1)
    secs = [0, 1, 2, 59, 60, 61, 200]
    df = spark.createDataFrame([("k", i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate(secs)] + [("z", 9, None)], "k string, i long, ts timestamp")
    got = [r.admitted for r in state.rate_limit(df, "k", "ts", "i", 2, 60).orderBy("i").collect()]
    assert got == [True, True, False, False, True, True, True]  # blocked events aren't recorded; at exactly 60 s the first no longer counts


def test_sessions(spark):
    t0 = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([("u", t0 + dt.timedelta(minutes=m)) for m in (0, 59, 119, 120)] + [("w", t0 + dt.timedelta(minutes=50 * k)) for k in range(6)], "k string, ts timestamp")
    got = {(r.k, r.session): (r.events, r.expired_by) for r in state.sessions(df, "k", "ts").collect()}
    assert got == {("u", 1): (2, "idle"), ("u", 2): (2, "idle"), ("w", 1): (6, "age")}


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([("k", i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2])], "k string, i long, ts timestamp")
    df.write.parquet(f"{tmp_path}/in")
    stream = files.read_parquet_stream(spark, f"{tmp_path}/in", df.schema)
    for name, out in (("limited", state.rate_limit_stream(stream, "k", "ts", "i", 2, 60)), ("windows", state.event_windows(stream, "ts", "k"))):
        q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(60)
        finally:
            q.stop()
    assert sorted((r.i, r.admitted) for r in spark.table("limited").collect()) == [(0, True), (1, True), (2, False)]


def test_sources(spark, tmp_path):
    root = tmp_path / "ro" / "plante"
    root.mkdir(parents=True)
    (root / "a.md").write_bytes("﻿unu\r\ndoi".encode())
    (root / "B.MD").write_bytes("ș".encode("cp1250", "ignore") + "ţ".encode("cp1250"))
    (root / "c.txt").write_text("nu")
    got = {r.relative_path: r for r in files.scan_markdown(spark, {"ro": f"file://{tmp_path}/ro"}).collect()}
    assert set(got) == {"ro/plante/a.md", "ro/plante/B.MD"}
    a = got["ro/plante/a.md"]
    assert (a.text, a.encoding, a.line_count, a.category_id) == ("unu\ndoi", "utf-8-sig", 2, "plante")
    assert files.decode("ab\0c".encode("utf-16"))[0] == "abc" and files.decode(None) == (None, None)
    files.write_report(spark.createDataFrame([(1, "x")], "n int, s string"), f"{tmp_path}/r")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/r").count() == 1
