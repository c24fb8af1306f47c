"""The general training-data query p1 with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import sync
from quillspark.shared import scratch_dir, table


def p1_pending(spark: SparkSession, d: str) -> DataFrame:
    return sync.pending_reasons(table(spark, d, "documents"), table(spark, d, "chunks"), table(spark, d, "sync_log"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sync.pending_documents(table(spark, d, "documents"), table(spark, d, "chunks"), table(spark, d, "sync_log")).select("doc_id").distinct()


def p1_synced(spark: SparkSession, d: str) -> DataFrame:
    """The documents that a run takes up over a target that holds what sync_log and chunks say it does: rows that went
    through ``incremental_run``, read from the version it published."""
    source = table(spark, d, "documents").withColumn("version", sync.digest("sha256"))
    state = sync.target_state(table(spark, d, "chunks"), table(spark, d, "sync_log"))
    on = (source["relative_path"] == state["path"]) & (source["version"] == state["version"]) & (state["filled"] | sync.is_blank("text"))

    def measure(rows: DataFrame) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        return rows.select("doc_id", "relative_path", "version", F.length(text).alias("characters"), F.size(F.split(text, "\n")).alias("lines"))

    target = sync.VersionedTarget(spark, f"{scratch_dir(spark)}/target-{uuid.uuid4().hex}")
    first = target.publish(measure(source.join(state, on, "left_semi")), None, key=("relative_path", "version"))
    done = sync.incremental_run(source, target, measure, "relative_path", "version")
    return target.current(only=done["version"]).select("doc_id", "characters", "lines") if done["version"] != first else target.current().limit(0).select("doc_id", "characters", "lines")


def queries():
    return {"p1_pending": p1_pending, "p1_found": p1_found, "p1_synced": p1_synced}


_HEX = "regexp_replace(regexp_replace(lower({0}), '^\\s*(sha-?256\\s*[:=]|0x)', ''), '[^0-9a-f]', '', 'g')"
_P1 = f"""
WITH d AS (SELECT doc_id, relative_path, sha256, {_HEX.format('sha256')} AS v,
                  text IS NOT NULL AND regexp_matches(text, '[^\\s\\p{{Z}}\\p{{Cf}}]') AS has_text FROM documents),
c AS (SELECT source_relative_path AS p, min(coalesce({_HEX.format('source_sha256')}, '')) AS lo, max(coalesce({_HEX.format('source_sha256')}, '')) AS hi
      FROM chunks WHERE source_relative_path IS NOT NULL GROUP BY 1),
s AS (SELECT p, v, outcome FROM (SELECT relative_path AS p, {_HEX.format('sha256')} AS v, outcome,
        row_number() OVER (PARTITION BY relative_path, {_HEX.format('sha256')} ORDER BY started_at DESC NULLS LAST, attempt_id DESC NULLS LAST, outcome = 'published' DESC NULLS LAST) AS n
      FROM sync_log WHERE relative_path IS NOT NULL AND sha256 IS NOT NULL) WHERE n = 1),
r AS (SELECT d.*, CASE WHEN d.v IS NULL THEN 'no_digest' WHEN s.outcome IS DISTINCT FROM 'published' THEN 'not_published'
        WHEN c.p IS NOT NULL AND (c.lo <> d.v OR c.hi <> d.v) THEN 'stale_chunks' WHEN d.has_text AND c.p IS NULL THEN 'no_chunks' END AS reason
      FROM d LEFT JOIN c ON d.relative_path = c.p LEFT JOIN s ON d.relative_path = s.p AND d.v = s.v)
"""


def oracle_sql():
    return {
        "p1_pending": _P1 + "SELECT DISTINCT doc_id, relative_path, sha256, reason FROM r WHERE reason IS NOT NULL",
        "p1_found": _P1 + "SELECT DISTINCT doc_id FROM r WHERE reason IS NOT NULL",
        "p1_synced": _P1 + """SELECT DISTINCT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS characters, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INTEGER) AS lines
FROM r JOIN documents USING (doc_id) WHERE reason IS NOT NULL""",
    }
