import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.formula import Formula, FormulaError, product_formula, search_formula
from quillspark.operators import lexical, ranking, search

SCHEMA = "chunk_id long, language string, category_id string, heading string, text string, char_count int, embedding array<float>, primary_medical_conditions array<string>, secondary_medical_conditions array<string>, source_relative_path string, score double"


def vec(c):
    return [c, math.sqrt(1 - c * c), 0.0]


def corpus(spark, rows):
    return spark.createDataFrame([(i, "ro", "a", h, t, n, e, p, s, "x", 0.0) for i, h, t, n, e, p, s in rows], SCHEMA)


ROWS = [
    (1, "H", "alfa beta gama", 10, vec(0.9), ["X"], [], ),
    (2, None, "alfa delta", 20, vec(0.5), [], ["X"]),
    (3, " ", "delta", 30, vec(0.5), None, None),
    (4, "H", None, 5, [0.0, 0.0, 0.0], [], []),
    (5, "H", "", None, None, ["Y"], ["X"]),
    (6, "H", "beta", 7, vec(0.1), [], []),
]


@pytest.mark.parametrize("code", ["ABC", "AB", "AC", "BC", "A", "B", "C"])
def test_score_is_the_formula(spark, code):
    df = corpus(spark, ROWS)
    s = search.Signals.parse(code)
    got = {r.chunk_id: r for r in search.hybrid_search(df, "ro", ["X"], ["alfa", "beta"], [1.0, 0.0, 0.0], s).collect()}
    f = search_formula()
    for r in got.values():
        assert r.score == pytest.approx(f.value(P1=r.p1, P2=r.p2, L=r.lexical, V=r.semantic, K=10)) and r.score > 0
        assert 0 < r.relevance <= 100 + 1e-9
    if code == "C":
        assert set(got) == {1} and got[1].semantic == 1  # the median of .9 .5 .5 .1 is .5 and the gate is strict
    if code == "A":
        assert set(got) == {1, 2, 5}


def test_scope_and_budget(spark):
    df = corpus(spark, ROWS)
    assert search.hybrid_search(df, "ro", ["X"], categories=[]).count() == 0
    assert search.hybrid_search(df, "en", ["X"]).count() == 0
    hits = search.hybrid_search(df, "ro", ["X"], signals=search.Signals.parse("A"), budget=10 + 1 + 12)
    assert [r.chunk_id for r in hits.collect()] == [1]  # 2 is next and does not fit, so 5 is cut off too
    assert search.hybrid_search(df.limit(0), "ro", ["X"], ["alfa"], [1.0, 0.0, 0.0]).count() == 0


def test_without_conditions_the_signal_is_dropped():
    s = search.Signals()
    assert s.effective([]) == search.Signals(False, True, True)
    assert search.Signals.parse("A").effective([]) == search.Signals.parse("A")
    assert s.best() == 8 and search.Signals.parse("BC").best() == 2
    for bad in ("", "D", " "):
        with pytest.raises(ValueError):
            search.Signals.parse(bad)


def test_formula_language(spark):
    for bad in ("", "x+1", "P1**2", "__import__('os')", "1" * 201, "+".join(["L1"] * 60), "1/L1", "L1/(L2-1)", "L1 if L2 else 3", "True"):
        with pytest.raises(FormulaError):
            product_formula(bad)
    with pytest.raises(FormulaError):
        search_formula("P1-2")
    f = Formula("-(a+2)*3/b", ("a", "b"))
    row = spark.createDataFrame([(1, 2), (1, 0)], "a int, b int").select(f.column({"a": F.col("a"), "b": F.col("b")}).alias("v")).collect()
    assert row[0].v == f.value(a=1, b=2) == -4.5 and row[1].v is None


def test_bm25_against_brute_force(spark):
    docs = ["alfa beta alfa", "beta", None, "gama alfa delta beta beta", ""]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    got = {r.id: r.bm25 for r in lexical.bm25(df, "id", "text", ["alfa", "beta", "alfa"]).collect()}
    words = [(d or "").split() for d in docs]
    avg = sum(map(len, words)) / len(docs)
    want = {}
    for i, w in enumerate(words):
        s = 0.0
        for t in ("alfa", "beta"):
            n = sum(t in x for x in words)
            tf = w.count(t)
            s += math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        if s:
            want[i] = s
    assert got == pytest.approx(want)


def test_phrases(spark):
    df = spark.createDataFrame([(1, "unu doi trei"), (2, "unu x trei"), (3, "unu x y trei"), (4, None), (5, "trei unu")], "id int, text string")
    ok = lambda slop: {r.id for r in df.where(lexical.holds_phrase(T.words("text"), ["unu", "trei"], slop)).collect()}
    assert ok(0) == set() and ok(1) == {1, 2} and ok(2) == {1, 2, 3}


def test_distributed_rank_and_sum_equal_the_window(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 7), i % 5) for i in range(500)], "id long, s double, n int")
    order = [F.desc("s"), F.asc("id")]
    plain = ranking.running_sum(ranking.global_rank(df, [F.desc("s")], "r"), order, "n", "sum")
    want = sorted(map(tuple, plain.collect()))
    monkeypatch.setattr(ranking, "ONE_TASK_ROWS", 10)
    spread = ranking.running_sum(ranking.global_rank(df, [F.desc("s")], "r"), order, "n", "sum")
    assert sorted(map(tuple, spread.select(*plain.columns).collect())) == want


def test_windows_and_priority(spark):
    df = spark.createDataFrame([(1, "x" * 1400), (2, "x" * 1401), (3, ""), (4, None), (5, "y" * 5000)], "id long, text string")
    got = {}
    for r in search.embedding_windows(df, "id", "text").collect():
        got.setdefault(r.id, []).append((r.window, len(r.text)))
    assert sorted(got) == [1, 2, 5] and got[1] == [(0, 1400)] and sorted(got[2]) == [(0, 1400), (1, 241)]
    assert sorted(got[5])[-1] == (4, 5000 - 4 * 1160)
    hits = spark.createDataFrame([(1, 3.0, 0), (2, 2.0, 1), (3, 1.0, 1)], "chunk_id long, score double, p1 int")
    assert {r.chunk_id for r in search.priority_violations(hits).collect()} == {2, 3}
    assert search.expressions("a b, B  a,,a b") == ["a b", "B  a"]


def test_fold_word(spark):
    df = spark.createDataFrame([("gripei",), ("gripa",), ("anemii",), ("ul",), ("copilului",), ("oul",)], "w string")
    assert [r.f for r in df.select(T.fold_word(F.col("w")).alias("f")).collect()] == ["grip", "grip", "anemi", "ul", "copil", "oul"]
