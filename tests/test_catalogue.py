"""Catalogue, publication and session operators on small cases."""

import datetime as dt
import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import catalogue as K
from quillspark.operators import publication as P
from quillspark.operators import ranking, resolve, search, sync
from quillspark.streaming import state


def test_forms():
    for word, form in (("steaua", "stelei"), ("coada", "cozii"), ("pana", "penei"), ("iarba", "ierbii"), ("floarea", "florii"), ("musetel", "musetelului"), ("ghimbirul", "ghimbirului")):
        assert form in K.romanian_forms(word) and word in K.romanian_forms(word), word
    assert K.english_forms("fox") == {"fox", "foxes"} and K.english_forms("berry") == {"berry", "berries"} and K.english_forms("at") == {"at"}


def test_mentions_and_owners(spark):
    names = [(1, "Coada-vulpii", "ro"), (2, "Coada-vulpii", "ro"), (1, "Alopecurus pratensis", "la"), (3, "Vulpe", "ro"), (4, "Coada", "ro"), (5, None, "ro"), (6, "?", "en"), (7, "Fox's-tail", "en")]
    forms = K.inflected_names(spark.createDataFrame(names, "id long, name string, language string"), "id", "name", "language")
    texts = [(1, "Ceai de coada-vulpii (Alopecurus pratensis)."), (2, "Cozii vulpii, coada lupului."), (3, None), (4, ""), (5, "fox's tails"), (1, "Ceai de coada-vulpii (Alopecurus pratensis).")]
    df = spark.createDataFrame(texts, "chunk_id long, text string").withColumn("words", F.lit(1))
    found = K.mentions(df, forms.withColumnRenamed("id", "entry"), "chunk_id", "text", "entry")
    got = {(r.id, r.position, r.words, r.entry, r.literal) for r in found.collect()}
    assert got == {(1, 2, 2, 1, True), (1, 2, 2, 2, True), (1, 4, 2, 1, True), (2, 0, 2, 1, False), (2, 0, 2, 2, False), (2, 2, 1, 4, True), (5, 0, 3, 7, False)}
    assert {(r.id, r.position, r.entry) for r in K.preferred_owners(found, "entry").collect()} == {(1, 2, 1), (2, 0, None)}


def test_lookup_and_orders(spark):
    values = spark.createDataFrame([("Mușețel",), ("musetel",), ("coada",), ("mustel",), ("zzzz",), (None,), ("",), ("pana",)], "v string")
    got = {r.value: (r.name_id, r.how) for r in K.lookup(values, [(1, "musetel"), (2, "coada vulpii"), (3, "pana ursului"), (4, "pana lupului"), (0, "musetel")], "v").collect()}
    assert got["Mușețel"] == (0, "exact") and got["coada"] == (2, "prefix") and got["mustel"] == (0, "typo") and got["zzzz"] == (None, "none") == got[""] and got["pana"][1] == "none"
    df = spark.createDataFrame([(1, "a 10"), (2, "A 9"), (3, "ă 9b"), (4, None)], "id int, n string")
    assert [r.id for r in df.orderBy(K.natural_key(F.col("n"))).collect()][1:] == [2, 3, 1]


def test_close_names_are_those_of_all_pairs():
    rng = random.Random(4)
    names = ["".join(rng.choices("abcde ", k=rng.randint(1, 12))) for _ in range(150)]
    index = resolve.CloseNames(names)
    for _ in range(80):
        q = "".join(rng.choices("abcdex", k=rng.randint(0, 12)))
        assert [x for x, _ in index.close(q, 3, 0.7)] == difflib.get_close_matches(q, sorted(set(names)), 3, 0.7)
    with pytest.raises(ValueError):
        resolve.bounded_names(range(resolve.MOST_NAMES + 1))


def test_cache_packing_and_completeness(spark):
    stored = spark.createDataFrame([(1, "unknown"), (2, "kept"), (3, "unknown"), (None, "x")], "k int, v string")
    new = spark.createDataFrame([(1, "better"), (2, "other"), (4, "first"), (4, "second"), (None, "y"), (5, None)], "k int, v string")
    assert {tuple(r) for r in P.merge_cache(stored, new, "k", "v").collect()} == {(1, "better", "upgraded"), (2, "kept", "stored"), (3, "unknown", "stored"), (4, "first", "inserted")}
    rng = random.Random(2)
    rows = [(k, rng.choice("ab"), rng.choice([0, 3, 9, 25]), rng.choice([10, 9000, 30_000])) for k in range(200)] + [(900, "c", None, None)]
    packed = P.pack_requests(spark.createDataFrame(rows, "id int, bucket string, relations int, size int"), "bucket", ["id"], "relations", "size").collect()
    want = {}
    for b in "abc":
        n = [0, 0, 0, 0]
        for k, _, r, s in sorted(x for x in rows if x[1] == b):
            need = (r or 0, 1, s or 0)
            if n[2] and (n[1] + need[0] > 20 or n[2] + 1 > 6 or n[3] + need[2] > 24_000):
                n = [n[0] + 1, 0, 0, 0]
            n = [n[0], *(x + y for x, y in zip(n[1:], need))]
            want[k] = n[0]
    assert {r.id: r.batch for r in packed} == want
    work = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c")], "i int, c string")
    done = spark.createDataFrame([(1, "a"), (3, "c"), (3, "c"), (4, "d")], "i int, c string")
    assert {tuple(r) for r in P.incomplete(work, done, ["i", "c"]).collect()} == {(2, "b", "missing"), (3, "c", "repeated"), (4, "d", "unexpected")}


def test_grouped_mentions(spark):
    found = spark.createDataFrame([(1, 12, 15, "x"), (1, 12, 15, "x"), (1, 10, 11, "y"), (1, 18, 25, "z"), (2, 0, 1, "x")], "fragment int, begin int, finish int, entry string")
    units = spark.createDataFrame([(7, 1, 10, 20), (8, 1, 20, 30)], "unit int, fragment int, unit_begin int, unit_end int")
    got = P.grouped_mentions(found, units, "unit", "fragment").collect()
    assert [(r.unit, [tuple(m) for m in r.mentions], r.repeated) for r in got] == [(7, [(0, 1, "y"), (2, 5, "x")], 1)]


def test_checked_publication_and_snapshots(spark, tmp_path):
    target = sync.VersionedTarget(spark, f"file://{tmp_path}/t")
    good, bad = spark.createDataFrame([(1, 2)], "k int, n int"), spark.createDataFrame([(1, -2)], "k int, n int")
    check = lambda df: df.where("n < 0")
    one = P.publish_checked(target, good, None, check)
    with pytest.raises(ValueError):
        P.publish_checked(target, bad, one, check)
    assert target.version() == one
    with P.snapshot(target) as read:
        P.publish_checked(target, good.unionByName(good), one, check)
        assert read().count() == 1 and target.current().count() == 2
    scores = spark.createDataFrame([("a", "t", 1, 2, 1), ("b", "t", 0, 2, 1), ("c", "t", 0, -1, 1), ("d", "t", 0, 1, 5)], "entity string, topic string, l1 int, l2 int, l3 int")
    titles = spark.createDataFrame([(1, "a", "t"), (2, "b", "t")], "f int, entity string, topic string")
    rank = spark.createDataFrame([(e, 1) for e in "abcd"], "entity string, eligible int")
    assert {tuple(r) for r in P.score_problems(scores, titles, rank, "f", "entity", "topic").collect()} == {("b", "t", "title"), ("c", "t", "negative"), ("d", "t", "ranking")}


def test_sessions_end_by_age(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, k, t0 + dt.timedelta(minutes=50 * k)) for k in range(8)] + [(2, 0, t0), (2, 1, t0 + dt.timedelta(hours=1)), (2, 2, None)]
    got = state.limited_sessions(spark.createDataFrame(rows, "user int, id int, ts timestamp"), "user", "ts", "id").collect()
    assert {(r.user, r.session, r.events) for r in got} == {(1, 1, 5), (1, 2, 3), (2, 1, 1), (2, 2, 1)}
    e = spark.createDataFrame(rows, "user int, id int, ts timestamp")
    assert state.joined_events(e.where("id = 2"), e.where("id < 2"), "user", "ts", "1 HOUR").count() == 1


def test_ranks_are_the_same_in_one_task_and_in_many(spark, monkeypatch):
    rng = random.Random(1)
    pool = spark.createDataFrame([(k, float(rng.randint(0, 40)) if k % 9 else None) for k in range(300)], "chunk_id long, cosine double")
    hits = spark.createDataFrame([(k, float(rng.randint(0, 9)), rng.randint(0, 1)) for k in range(60)], "chunk_id long, score double, p1 int")
    want = {tuple(r) for r in search.cosine_ranks(pool).collect()}, {tuple(r) for r in search.priority_violations(hits).collect()}
    values = sorted(r.cosine for r in pool.collect() if r.cosine is not None)
    middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
    assert {c for c, v, s in want[0] if s != float("inf")} == {c for c, v, _ in want[0] if v > middle}
    monkeypatch.setattr(ranking, "ONE_TASK_ROWS", 10)
    assert ({tuple(r) for r in search.cosine_ranks(pool).collect()}, {tuple(r) for r in search.priority_violations(hits).collect()}) == want
