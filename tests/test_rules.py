"""Units of text and the ordered polarity rules."""

from pyspark.sql import functions as F

from quillspark.operators import rules
from quillspark.operators.units import text_units, units

TEXT = "# A\n\nPrimul rând\nal doilea.\n\n## B\n\nSe evită:\n- unu\n  și mai mult\n- doi\n\n| x | y |\n|---|:-:|\n| 1 | 2 |\n\nFinal."


def test_units():
    got = [(u.kind, u.text, u.headings, u.intro, u.header) for u in units(TEXT)]
    assert got == [
        ("paragraph", "Primul rând\nal doilea.", ("A",), "", ()), ("paragraph", "Se evită:", ("A", "B"), "", ()), ("list", "- unu\n  și mai mult", ("A", "B"), "Se evită:", ()),
        ("list", "- doi", ("A", "B"), "Se evită:", ()), ("row", "| 1 | 2 |", ("A", "B"), "", ("x", "y")), ("paragraph", "Final.", ("A", "B"), "", ()),
    ]
    assert all(TEXT[u.begin : u.end] == u.text for u in units(TEXT)) and units("") == [] == units("\n \n") and len(units("x\n" * 50_000)) == 1


def test_text_units(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (1, TEXT)], "doc_id long, text string").withColumn("unit", F.lit(9))
    assert text_units(df, "doc_id", "text").count() == 12


def test_pairs_stay_within_their_unit(spark):
    text = "Teiul ajută.\n\nDurere de cap și teiul ajută în durere."
    p, c = [(0, 5, None), (32, 37, "plante")], [(14, 27), (14, 20), (47, 53)]
    df = spark.createDataFrame([(1, text, p, c), (2, None, p, c), (3, text, None, c), (4, text, p, [])], "identity long, text string, products array<struct<begin:int,finish:int,category:string>>, conditions array<struct<begin:int,finish:int>>")
    got = [(r.identity, r.unit, r.p0, r.c0, r.code) for r in rules.classify_units(df).collect()]
    assert sorted(got) == sorted([(1, 2, 18, 0, "adjacent_cue"), (1, 2, 18, 0, "longer_condition_name"), (1, 2, 18, 33, "adjacent_cue")])


def test_recipes_and_lists():
    def code(text, product, condition, **kw):
        span = lambda x: (text.index(x), text.index(x) + len(x))
        d = rules.decide(rules.Candidate(text, "", span(product), span(condition), products=tuple(map(span, kw.pop("products", (product,)))), **kw))
        return d and (d.label, d.code)

    assert code("Tuse: 2 linguri de tei, 1 lingură de soc; se bea călduț.", "tei", "Tuse", products=("tei", "soc")) == ("positive", "recipe_intake")
    assert code("Teiul calmează durere, tuse, febră.", "Teiul", "febră") == ("positive", "common_list")
    assert code("Suplimentele sunt contraindicate în gută; fierul e unul.", "fierul", "gută", category="suplimente")[0] == "caution"
    assert code("Teiul ajută copii cu tuse: febră, gripă.", "Teiul", "gripă") == ("positive", "adjacent_cue")
    assert rules.primary_heading(["Tuse", "Observații"]) == "Tuse" and rules.primary_heading([]) == ""


def test_combination_answers_and_cache(spark):
    d = spark.createDataFrame([(1, "positive", "a"), (1, "unclear", "b"), (2, "positive", "a"), (2, "caution", "c"), (3, "unclear", "b"), (3, None, None), (4, "caution", "c"), (4, "caution", "d")], "k int, label string, code string")
    assert {tuple(r) for r in rules.combine(d, ["k"]).collect()} == {(1, "positive", "a"), (2, "mixed", "combined"), (3, "unclear", "b"), (4, "caution", "combined")}
    good = '{"prohibited": %s, "recommended": %s, "quote_begin": 0, "quote_end": %d}'
    rows = [(1, good % ("true", "true", 3), True), (2, good % ("true", "false", 3), True), (3, good % ("true", "false", 3), False), (4, good % ("true", "false", 99), True), (5, '{"prohibited": true}', True), (6, "no", True), (7, None, True), (8, good % ("false", "false", 3), None)]
    got = {r.k: (r.label, r.quote_end) for r in rules.accepted_answers(spark.createDataFrame([(k, a, "text", v) for k, a, v in rows], "k int, a string, unit string, ok boolean"), "a", "unit", "ok").collect()}
    assert got == {1: ("positive", 3), 2: ("caution", 3), **{k: ("unclear", None) for k in range(3, 9)}}
    held = spark.createDataFrame([(1, "positive", 0, 3), (2, "positive", None, None), (3, "unclear", 0, 1), (4, "odd", 0, 1), (9, "positive", 0, 1), (5, "caution", 0, 40)], "k int, label string, quote_begin int, quote_end int")
    texts = spark.createDataFrame([(k, "text") for k in range(1, 6)], "k int, unit string")
    assert {tuple(r) for r in rules.stale_decisions(held, texts, "k", "unit").collect()} == {(2, "quote"), (3, "quote_of_unclear"), (4, "label"), (9, "no_unit"), (5, "quote")}
