"""Incremental synchronisation: which documents are new or changed, and the atomic publication of a target version.

The target is the state: every target row carries its source key and the version (digest) it was made from, so no
separate bookkeeping can disagree with the data. Timestamps of the source are never used to decide.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.shared import materialize


def digest(col: Column | str) -> Column:
    """The hex digits of a SHA-256 digest however written (upper case, blanks, a leading ``sha256:`` or ``0x``)."""
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    return F.regexp_replace(F.regexp_replace(c, r"^\s*(sha-?256\s*[:=]|0x)", ""), "[^0-9a-f]", "")


def is_blank(col: Column | str) -> Column:
    """Null, empty or only white space (Unicode spaces and invisible characters included)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | ~c.rlike(r"[^\s\p{Z}\p{Cf}]")


def fragment_versions(chunks: DataFrame) -> DataFrame:
    """``(path, lo, hi)``: the least and greatest digest of the fragments of each path, a null one as the empty text."""
    own = chunks.where(F.col("source_relative_path").isNotNull()).select(F.col("source_relative_path").alias("path"), F.coalesce(digest("source_sha256"), F.lit("")).alias("v"))
    return own.groupBy("path").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def newest_attempts(sync_log: DataFrame) -> DataFrame:
    """``(path, version, ok)``: whether the newest attempt at each version of each path published it. Attempts of equal
    ``started_at`` rank by ``attempt_id``; attempts without a time come first."""
    own = sync_log.where(F.col("relative_path").isNotNull() & F.col("sha256").isNotNull())
    newest = F.max(F.struct("started_at", "attempt_id", (F.coalesce(F.col("outcome"), F.lit("")) == "published").alias("ok")))
    return own.groupBy(F.col("relative_path").alias("path"), digest("sha256").alias("version")).agg(newest["ok"].alias("ok"))


def target_state(chunks: DataFrame, sync_log: DataFrame) -> DataFrame:
    """``(path, version, filled)``: the versions that the target holds whole: the newest attempt published them, and no
    fragment of the path carries another digest. ``filled`` tells whether the path has fragments. Both sides are reduced
    to a row per path (and version) map-side, so a path with a third of all fragments meets no other row of its key."""
    held = newest_attempts(sync_log).where("ok").join(fragment_versions(chunks), "path", "left")
    return held.where("lo IS NULL OR (lo = version AND hi = version)").select("path", "version", F.col("lo").isNotNull().alias("filled"))


def missing(source: DataFrame, state: DataFrame, on: Column) -> DataFrame:
    """The rows of ``source`` for which the target's ``state`` has no row: the anti-join that decides what a run takes up."""
    return source.join(state, on, "left_anti")


def pending_documents(documents: DataFrame, chunks: DataFrame, sync_log: DataFrame) -> DataFrame:
    """The documents the next run must take up: those whose path and digest the target does not hold (``target_state``),
    or holds without a fragment although the text is not blank. A null digest or path is never held. Empty ``chunks`` or
    ``sync_log`` make every document pending or every one with a text; empty ``documents`` give no rows; repeated rows
    stay repeated."""
    s = target_state(chunks, sync_log)
    held = (documents["relative_path"] == s["path"]) & (digest(documents["sha256"]) == s["version"]) & (s["filled"] | is_blank(documents["text"]))
    return missing(documents, s, held)


def pending_reasons(documents: DataFrame, chunks: DataFrame, sync_log: DataFrame) -> DataFrame:
    """``(doc_id, relative_path, sha256, reason)`` of the pending documents, each once: ``no_digest``, ``not_published``
    (the newest attempt at this version did not, or there is none), ``stale_chunks`` (a fragment of the path carries
    another digest, a null one included) or ``no_chunks``, the first that holds."""
    d = pending_documents(documents, chunks, sync_log).select("doc_id", "relative_path", "sha256", digest("sha256").alias("_v"))
    c = fragment_versions(chunks)
    s = newest_attempts(sync_log).select(F.col("path").alias("_p"), "version", "ok")
    joined = d.join(c, d["relative_path"] == c["path"], "left").join(s, (d["relative_path"] == s["_p"]) & (d["_v"] == s["version"]), "left")
    reason = (
        F.when(F.col("_v").isNull(), "no_digest")
        .when(~F.coalesce(F.col("ok"), F.lit(False)), "not_published")
        .when(F.col("lo").isNotNull(), "stale_chunks")
        .otherwise("no_chunks")
    )
    return joined.select("doc_id", "relative_path", "sha256", reason.alias("reason")).distinct()


class VersionedTarget:
    """A target table of numbered versions.

    A version is a file ``log/<n>.json`` that names segments: folders of rows, each with the keys and versions that it takes out of
    the segments before. A run writes a segment of what changed and then creates the file of the next number, which
    fails if that exists: so of two runs that began from one version one publishes and the other is refused, and a run
    that breaks off leaves nothing that a reader sees. On file systems with atomic renames the file is written aside and
    renamed without overwriting (linked, on local ones); on object stores it is created on condition that it is new."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._uri = jvm.java.net.URI(self.root)
        self._fs = jvm.org.apache.hadoop.fs.FileSystem.get(self._uri, spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """Names in a folder with the times of their last change."""
        p = self._path(folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def version(self) -> int | None:
        """The number of the newest version, None before the first."""
        return max((int(n[:-5]) for n, _ in self._names("log") if n.endswith(".json") and n[:-5].isdigit()), default=None)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version is None:
            return {"segments": []}
        stream = self._fs.open(self._path(f"log/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _create(self, version: int, content: dict) -> None:
        name, data = f"log/{version:012d}.json", json.dumps(content).encode()
        self._fs.mkdirs(self._path("log"))
        scheme = self._fs.getUri().getScheme()
        try:
            if scheme == "file":
                base = self._path("").toUri().getPath()
                aside = f"{base}/log/.{uuid.uuid4().hex}"
                with open(aside, "wb") as f:
                    f.write(data)
                try:
                    os.link(aside, f"{base}/{name}")
                finally:
                    os.unlink(aside)
                return
            aside = self._path(f"log/.{uuid.uuid4().hex}") if scheme in ("hdfs", "viewfs", "webhdfs") else self._path(name)
            out = self._fs.create(aside, False)
            out.write(bytearray(data))
            out.close()
            if scheme in ("hdfs", "viewfs", "webhdfs"):
                jvm = self.spark._jvm
                keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._uri, self.spark._jsc.hadoopConfiguration()).rename(aside, self._path(name), keep)
        except Exception as e:
            if self._fs.exists(self._path(name)):
                raise RuntimeError("another run published in between") from e
            raise

    def publish(self, rows: DataFrame, based_on: int | None, gone: DataFrame | None = None, key: tuple[str, str] | None = None, whole: bool = False) -> int:
        """Write ``rows`` as a segment that takes the keys and versions ``gone (k, v)`` out of those before (all of them if
        ``whole``), and make it visible as the version after ``based_on``; RuntimeError if another run did so first. ``key``
        names the columns of key and version, if rows are to be taken out."""
        before = {"segments": []} if whole or based_on is None else self.manifest(based_on)
        number = (based_on or 0) + 1
        segment = {"n": number, "rows": f"data/{uuid.uuid4().hex}", "gone": None}
        rows.write.parquet(f"{self.root}/{segment['rows']}")
        if gone is not None and before["segments"]:
            segment["gone"] = f"data/{uuid.uuid4().hex}"
            gone.select("k", "v").distinct().write.parquet(f"{self.root}/{segment['gone']}")
        try:
            self._create(number, {"version": number, "key": key or before.get("key"), "schema": json.loads(rows.schema.json()), "segments": [*before["segments"], segment]})
        except RuntimeError:
            for name in (segment["rows"], segment["gone"]):
                if name:
                    self._fs.delete(self._path(name), True)
            raise
        return number

    def current(self, schema: StructType | None = None, version: int | None = None, only: int | None = None) -> DataFrame:
        """The rows of a version, the newest one unless told; of the segment ``only`` if that is given. ``schema`` is that of
        a target without a version."""
        m = self.manifest(version)
        if not m["segments"]:
            return self.spark.createDataFrame([], schema)
        form = StructType.fromJson(m["schema"])
        rows = taken = None
        for s in m["segments"]:
            if only is None or s["n"] == only:
                part = self.spark.read.schema(form).parquet(f"{self.root}/{s['rows']}").withColumn("_n", F.lit(s["n"]))
                rows = part if rows is None else rows.unionByName(part)
            if s["gone"]:
                part = self.spark.read.parquet(f"{self.root}/{s['gone']}").select(F.col("k").alias("_k"), F.col("v").alias("_v"), F.lit(s["n"]).alias("_gone"))
                taken = part if taken is None else taken.unionByName(part)
        if taken is not None:
            key, version_col = m["key"]
            last = taken.groupBy("_k", "_v").agg(F.max("_gone").alias("_gone"))
            same = (rows[key] == last["_k"]) & (F.coalesce(rows[version_col], F.lit("")) == last["_v"])
            rows = rows.join(last, same & (last["_gone"] > rows["_n"]), "left_anti")
        return rows.drop("_n")

    def compact(self) -> int | None:
        """Publish the rows of the newest version as one segment, so that reading needs no anti-join."""
        based_on = self.version()
        return None if based_on is None else self.publish(self.current(), based_on, key=self.manifest(based_on).get("key"), whole=True)

    def vacuum(self, keep: int = 2, older_than_s: float = 24 * 3600) -> int:
        """Remove the versions before the newest ``keep``, and the folders that none of these names and that have not been
        written to for ``older_than_s`` seconds, such as those of runs that broke off. Gives how many folders went."""
        import time

        newest = self.version() or 0
        kept = [n for n in range(max(1, newest - keep + 1), newest + 1)]
        used = {x for n in kept for s in self.manifest(n)["segments"] for x in (s["rows"], s["gone"]) if x}
        for name, _ in self._names("log"):
            if name.endswith(".json") and int(name[:-5]) < (kept[0] if kept else 0):
                self._fs.delete(self._path(f"log/{name}"), False)
        removed = 0
        for name, changed in self._names("data"):
            if f"data/{name}" not in used and changed < (time.time() - older_than_s) * 1000:
                removed += bool(self._fs.delete(self._path(f"data/{name}"), True))
        return removed


def incremental_run(source: DataFrame, target: VersionedTarget, transform: Callable[[DataFrame], DataFrame], key: str, version: str) -> dict:
    """One incremental run: transform exactly the source rows whose (key, version) the target lacks, take out the target
    rows whose key left the source or changed, and publish both as one version.

    ``transform`` must keep ``key`` and ``version``. Rows with a null key are not taken up; a null version counts as
    a version of its own that always differs from a digest. Of source rows with one key and version one is taken, always
    the same. A second run over an unchanged source takes up nothing and publishes nothing. Only keys and versions are
    read of the whole source and target; what is transformed and written is the change."""
    based_on = target.version()
    v = lambda name: F.coalesce(F.col(name), F.lit("")).alias("v")
    live = source.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), v(version)).distinct()
    if based_on is None:
        changed, gone, removed = materialize(live, "changed"), None, 0
    else:
        state = target.current().select(F.col(key).alias("k"), v(version)).distinct()
        changed = materialize(live.join(state, ["k", "v"], "left_anti"), "changed")
        gone = materialize(state.join(live, ["k", "v"], "left_anti"), "gone")
        removed = gone.count()
    taken = changed.count()
    if not taken and not removed and based_on is not None:
        return {"taken": 0, "removed": 0, "version": based_on}
    todo = source.join(changed, (source[key] == changed["k"]) & (F.coalesce(source[version], F.lit("")) == changed["v"]), "left_semi")
    hashed = F.xxhash64(*(F.to_json(F.struct(F.col(f.name))) for f in source.schema.fields))
    once = F.row_number().over(W.partitionBy(key, version).orderBy(hashed))
    rows = transform(todo.withColumn("_once", once).where("_once = 1").drop("_once"))
    return {"taken": taken, "removed": removed, "version": target.publish(rows, based_on, gone, (key, version))}
