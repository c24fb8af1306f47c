"""The whole cleaning order and its number invariant; stored postings."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import clean as C
from quillspark.operators import lexical as L

DOCS = [
    (1, "# Ghid de plante bune\n\nISBN 973-1\nVezi [pagina 12](http://x.ro/77) și www.y.ro/5 sau a1@b2.ro.\n" + "Ghid de plante bune 3\n" * 6 + "Ghid de plante bune 5 mg\n" * 6 + "Tel. 0745 123 456.\n\n\n\nSfârșit 9."),
    (2, None), (3, ""), (4, "---\nsource_path: x\npages: 40\n---\nText 1,5 și 2."), (5, "Pagina\n### Pagina 3\n\nx 4"), (4, "Repetat 8."),
]


def test_steps_in_order():
    text, removed = C.clean_document(DOCS[0][1])
    rules = [r for r, _ in removed]
    assert {r: rules.count(r) for r in set(rules)} == {"link": 1, "url": 1, "email": 1, "phone": 1, "label": 1, "empty_line": 1, "credit": 1, "header": 5}
    assert "pagina 12" in text and "77" not in text and text.count("Ghid de plante bune 3") == 1 and text.count("5 mg") == 6 and text.endswith("\n\nSfârșit 9.")


def test_numbers_are_accounted_for(spark):
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(DOCS)], "doc_id long, text string").withColumn("number", F.lit(1))
    cleaned = C.clean_documents(df, "doc_id", "text")
    assert C.unaccounted_numbers(df, cleaned, "doc_id", "text").count() == 0
    silent = cleaned.withColumn("removed", F.filter("removed", lambda r: r["rule"] != "url"))
    assert {(r.id, r.number, r.missing) for r in C.unaccounted_numbers(df, silent, "doc_id", "text").collect()} == {(0, "5", 1)}


@pytest.mark.parametrize("run,labelled,verdict", [("0745 123 456", False, "phone"), ("12.000.000", True, "thousands"), ("9789731234567", False, "isbn"), ("12.03.2004 55", True, "date"), ("111 111 111", True, "repeated_digit"), ("123 456 789", False, "unlabelled"), ("123 456", True, "length"), ("1234567 8/2004", True, "reference_of_a_year")])
def test_phone_verdicts(run, labelled, verdict):
    assert C.phone_verdict(run, labelled, "", "") == verdict
    assert C.phone_verdict(run, labelled, "", " mg") in ("unit_after", verdict)


def test_stored_postings_give_the_same_scores(spark, tmp_path):
    rows = [(k, " ".join(["ceai", "de", "tei", "și", "soc"][: 1 + k % 5] * (1 + k % 3))) for k in range(60)] + [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "chunk_id long, text string").withColumn("id", F.lit(0))
    L.store_postings(df, "chunk_id", "text", f"{tmp_path}/p")
    for terms in (["tei"], ["tei", "soc", "tei", "lipsă"], ["lipsă"]):
        want = {r.id: round(r.bm25, 9) for r in L.bm25(df, "chunk_id", "text", terms).collect()}
        assert {r.id: round(r.bm25, 9) for r in L.stored_bm25(spark, f"{tmp_path}/p", terms).collect()} == want and (want or terms == ["lipsă"])
