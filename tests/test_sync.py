import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.operators import sync

DOCS = "doc_id long, relative_path string, sha256 string, text string, extra string"
CHUNKS = "chunk_id long, source_relative_path string, source_sha256 string, text string, sha256 string"
LOG = "attempt_id long, relative_path string, sha256 string, started_at timestamp, outcome string, text string"
T0 = dt.datetime(2025, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


def pending(spark, docs, chunks, log):
    d = spark.createDataFrame(docs, DOCS)
    return {(r.doc_id, r.reason) for r in sync.pending_reasons(d, spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(log, LOG)).collect()}


def test_reasons(spark):
    docs = [(k, f"p{k}", f"{k}{k}", "text", "x") for k in range(1, 8)] + [(8, "p8", None, "t", "x"), (9, "p9", "99", "  ", "x"), (10, "p10", "aa", None, "x")]
    chunks = [(1, "p1", "SHA256: 11 ".lower(), "", ""), (2, "p2", "22", "", ""), (3, "p3", "33", "", ""), (4, "p4", "44", "", ""), (5, "p4", "4f", "", ""), (6, "p5", None, "", ""), (7, "p8", "88", "", ""), (8, None, "11", "", "")]
    log = [(k, f"p{k}", f"{k}{k}" if k < 10 else "AA", at(0), "published", "") for k in (1, 2, 4, 5, 6, 7, 9, 10)]
    log += [(20, "p2", "22", at(5), None, ""), (21, "p7", "77", at(5), "failed", ""), (22, "p7", "77", at(6), "published", ""), (22, "p7", "77", at(6), "published", ""), (23, "p1", "0f", at(9), "failed", "")]
    assert pending(spark, docs, chunks, log) == {(2, "not_published"), (3, "not_published"), (4, "stale_chunks"), (5, "stale_chunks"), (6, "no_chunks"), (7, "no_chunks"), (8, "no_digest")}


def test_empty_and_repeated(spark):
    assert pending(spark, [], [], []) == set()
    assert pending(spark, [(1, "p", "aa", "t", "x")] * 3, [], []) == {(1, "not_published")}
    assert pending(spark, [(1, None, "aa", "t", "x")], [(1, None, "aa", "", "")], [(1, None, "aa", at(0), "published", "")]) == {(1, "not_published")}


def test_incremental_run_survives_failures(spark, tmp_path):
    schema = "k string, v string, body string"
    one = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y"), ("b", "1", "y"), (None, "1", "z"), ("c", None, "n")], schema)
    target = sync.VersionedTarget(spark, f"file://{tmp_path}/t")
    double = lambda df: df.withColumn("body", F.concat("body", "body"))
    first = sync.incremental_run(one, target, double, "k", "v")
    assert first["taken"] == 3
    assert sync.incremental_run(one, target, double, "k", "v") == {"taken": 0, "removed": 0, "version": first["version"]}
    two = spark.createDataFrame([("a", "2", "q"), ("b", "1", "y"), ("d", "1", "w")], schema)

    def broken(df):
        return df.withColumn("body", F.when(F.col("k") == "d", F.raise_error(F.lit("lost"))).otherwise(F.col("body")))

    with pytest.raises(Exception):
        sync.incremental_run(two, target, broken, "k", "v")
    assert target.version() == first["version"]
    again = sync.incremental_run(two, target, double, "k", "v")
    assert (again["taken"], again["removed"]) == (2, 2)
    rows = sorted((r.k, r.v, r.body) for r in target.current(spark.createDataFrame([], schema).schema).collect())
    assert rows == [("a", "2", "qq"), ("b", "1", "yy"), ("d", "1", "ww")]
    assert target.publish(two, again["version"]) == again["version"] + 1
    with pytest.raises(RuntimeError):
        target.publish(two, again["version"])


def test_runs_write_what_changed_and_can_be_compacted(spark, tmp_path):
    schema = "k string, v string, body string"
    keep = lambda df: df
    target = sync.VersionedTarget(spark, f"file://{tmp_path}/t")
    rows = lambda t: sorted((r.k, r.v, r.body) for r in t.collect())
    make = lambda *x: spark.createDataFrame(list(x), schema)
    assert sync.incremental_run(make(), target, keep, "k", "v") == {"taken": 0, "removed": 0, "version": 1}
    sync.incremental_run(make(("a", "1", "x"), ("b", "1", "y"), ("c", None, "n")), target, keep, "k", "v")
    two = make(("a", "2", "q"), ("b", "1", "y"), ("b", "1", "z"), ("d", "1", "w"))
    done = sync.incremental_run(two, target, keep, "k", "v")
    assert done == {"taken": 2, "removed": 2, "version": 3}
    assert rows(target.current(only=3)) == [("a", "2", "q"), ("d", "1", "w")] and rows(target.current()) == [("a", "2", "q"), ("b", "1", "y"), ("d", "1", "w")]
    assert rows(target.current(version=2)) == [("a", "1", "x"), ("b", "1", "y"), ("c", None, "n")]
    # back to an earlier version of a row, then one of two versions of a key
    assert sync.incremental_run(make(("a", "1", "x"), ("d", "1", "w"), ("d", "2", "v")), target, keep, "k", "v")["taken"] == 2
    sync.incremental_run(make(("a", "1", "x"), ("d", "1", "w")), target, keep, "k", "v")
    assert rows(target.current()) == [("a", "1", "x"), ("d", "1", "w")]
    before = rows(target.current())
    target.compact()
    assert rows(target.current()) == before and len(target.manifest()["segments"]) == 1
    assert target.vacuum(keep=1, older_than_s=-10) > 3 and rows(target.current()) == before
    assert sync.incremental_run(make(("a", "1", "x"), ("d", "1", "w")), target, keep, "k", "v")["taken"] == 0


def test_of_two_runs_from_one_version_one_publishes(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    target = sync.VersionedTarget(spark, f"file://{tmp_path}/t")
    df = spark.createDataFrame([("a", "1")], "k string, v string")
    target.publish(df, None)

    def one(_):
        try:
            return target.publish(df, 1)
        except RuntimeError:
            return None

    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(one, range(4)), key=str) == [2, None, None, None]
    assert target.version() == 2 and len(target.manifest()["segments"]) == 2


def test_a_local_folder_is_refused_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from quillspark import shared

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://x:7077", getConf=lambda: {}))
    with pytest.raises(ValueError):
        shared.scratch_dir(fake)
