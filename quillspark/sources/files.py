"""Sources of documents and catalogues, and sinks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Encodings tried in order when a corpus is indexed, and when it is cleaned.
INDEX_ENCODINGS = ("utf-8-sig", "utf-8", "utf-16", "cp1250", "cp1252")
CLEAN_ENCODINGS = ("utf-8-sig", "utf-8", "cp1250", "cp1252")


def decode(content: bytes | None, encodings: Sequence[str] = INDEX_ENCODINGS) -> tuple[str | None, str | None]:
    """Text and the encoding that read it; undecodable bytes are replaced at last. UTF-16 only with a byte order mark or
    an even length. Null characters go, line breaks become LF, letters are composed."""
    if content is None:
        return None, None
    text = used = None
    marked = content[:2] in (b"\xff\xfe", b"\xfe\xff")
    for name in (["utf-16"] if marked else []) + [e for e in encodings if e != "utf-16" or (not marked and len(content) % 2 == 0)]:
        try:
            text, used = content.decode(name), name
            break
        except UnicodeDecodeError:
            continue
    if text is None:
        text, used = content.decode("utf-8", "replace"), "utf-8 (replaced)"
    text = text.replace("\0", "").replace("\r\n", "\n").replace("\r", "\n")
    return unicodedata.normalize("NFC", text), used


def scan_markdown(spark: SparkSession, roots: dict[str, str], encodings: Sequence[str] = INDEX_ENCODINGS) -> DataFrame:
    """``(language, relative_path, size_bytes, modified_utc, sha256, encoding, line_count, char_count, category_id, text)``
    of the ``*.md`` files (any case) under the root of each language. Roots may not be empty or lie in one another."""
    plain = [r.rstrip("/") for r in roots.values()]
    if not roots or not all(plain) or any(a != b and b.startswith(a + "/") for a in plain for b in plain) or len(set(plain)) < len(plain):
        raise ValueError("roots must be given, not empty and not within one another")
    out = None
    for language, root in roots.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)
        part = files.select(F.lit(language).alias("language"), F.regexp_replace("path", r"^[a-z]+:/*", "/").alias("path"), F.lit("/" + root.split(":", 1)[-1].strip("/") + "/").alias("root"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_utc"), "content")
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("relative_path", F.concat("language", F.lit("/"), F.expr("substring(path, length(root) + 1)"))).withColumn("sha256", F.sha2("content", 256)).drop("path", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [decode(c, encodings) for c in b.column("content").to_pylist()]
            kept = [b.column(n) for n in ("language", "relative_path", "size_bytes", "modified_utc", "sha256")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([d[1] for d in done], pa.string()), pa.array([d[0] for d in done], pa.string())], names=["language", "relative_path", "size_bytes", "modified_utc", "sha256", "encoding", "text"])

    read = out.select("language", "relative_path", "size_bytes", "modified_utc", "sha256", "content").mapInArrow(run, "language string, relative_path string, size_bytes bigint, modified_utc timestamp, sha256 string, encoding string, text string")
    folder = F.regexp_replace(F.regexp_replace("relative_path", r"^[^/]+/", ""), r"/?[^/]*$", "")
    return read.select("*", F.size(F.split("text", "\n")).alias("line_count"), F.length("text").alias("char_count"), folder.alias("category_id"))


def read_catalog(spark: SparkSession, path: str, schema: StructType, required: Sequence[str]) -> DataFrame:
    """A JSONL catalogue; a line that is not JSON of the schema, or lacks a required non-blank value, is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for c in required:
        rows = rows.withColumn(c, F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is missing or blank"))))
    return rows


def write_report(df: DataFrame, path: str) -> None:
    """Rows as tab-separated text with a header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_parquet_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_bulk(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """A bulk write: each task streams its rows into files of at most ``rows_per_file`` rows; nothing is buffered beyond
    the writer's row group."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).parquet(path)


def scan_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, fetch: int = 2000, **options: str) -> DataFrame:
    """A table of a database in ``parts`` ranges of ``column``, each read by one task through a cursor that holds ``fetch``
    rows; rows outside ``lower`` and ``upper`` go with the first and last part."""
    if parts < 1 or lower >= upper:
        raise ValueError("a scan needs at least one part and a lower bound under the upper")
    named = {"url": url, "dbtable": table, "partitionColumn": column, "lowerBound": lower, "upperBound": upper, "numPartitions": parts, "fetchsize": fetch, **options}
    return spark.read.format("jdbc").options(**named).load()


def encode(text: str | None, encoding: str | None) -> tuple[bytes | None, str | None]:
    """The bytes of a text in the encoding it was read in, or in UTF-8 if that is unknown or lacks a character."""
    if text is None:
        return None, None
    for name in (encoding, "utf-8"):
        try:
            if name:
                return text.encode(name), name
        except (UnicodeEncodeError, LookupError):
            continue
    raise AssertionError


def encoded_documents(df: DataFrame) -> DataFrame:
    """``(relative_path, encoding, content)`` of ``(relative_path, encoding, text)`` rows, as ``encode`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [encode(t, e) for e, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[1] for d in done], pa.string()), pa.array([d[0] for d in done], pa.binary())], names=["relative_path", "encoding", "content"])

    return df.select("relative_path", "encoding", "text").mapInArrow(run, "relative_path string, encoding string, content binary")


def write_documents(encoded: DataFrame, root: str) -> int:
    """Write the rows of ``encoded_documents`` as files under ``root``, a folder that all executors share, and give their
    number. Never in place: ``root`` must not exist. Each file is written aside and renamed, so that a task that is run
    again leaves no half file. Rows without content or with a path out of the folder are left out."""
    import os

    folder = root.removeprefix("file://")
    os.makedirs(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = 0
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                target = os.path.normpath(os.path.join(folder, path or ""))
                if content is None or not path or not target.startswith(os.path.join(folder, "")):
                    continue
                os.makedirs(os.path.dirname(target), exist_ok=True)
                aside = f"{target}.{os.getpid()}.part"
                with open(aside, "wb") as f:
                    f.write(content)
                os.replace(aside, target)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return encoded.select("relative_path", "content").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
