"""What is shown or quoted of texts: highlights, quotations, segments, accents; identities of evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

QUOTE, SEGMENT = 1000, 1500
# What a translation must not touch.
_MASKED = re.compile(r"```.*?```|`[^`\n]+`|!?\[[^\]\n]*\]\([^()\n]+\)|https?://\S+", re.S)
_STRONG = re.compile(r"\n[ \t]*\n\s*|[.!?…][\"'”’)\]]*\s+")


def highlight_ranges(text: str, words: Sequence[str]) -> list[tuple[int, int]]:
    """Places of whole words in the text with its white space collapsed, neighbours that only white space parts joined;
    case and accents don't matter."""
    flat = " ".join(text.split())
    table = str.maketrans(T.ACCENTED, T.FOLDED)
    wanted = {w.lower().translate(table) for w in words}
    out: list[tuple[int, int]] = []
    for m in re.finditer(r"[^\W_]+", flat):
        if m[0].lower().translate(table) in wanted:
            if out and not flat[out[-1][1] : m.start()].strip():
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
    return out


def quote_spans(text: str, most: int = QUOTE) -> list[tuple[int, int]]:
    """Windows that cover the text, each up to ``most`` characters, cut at the last end of a sentence or paragraph, else
    at the last blank, else at the limit."""
    out, start = [], 0
    while len(text) - start > most:
        ends = [m.end() for m in _STRONG.finditer(text, start, start + most)]
        cut = ends[-1] if ends else text.rfind(" ", start + 1, start + most) + 1 or start + most
        out.append((start, cut))
        start = cut
    if start < len(text):
        out.append((start, len(text)))
    return out


def segments(text: str, most: int = SEGMENT) -> list[tuple[str, bool]]:
    """``(part, translate)``: the text in parts that join to it; code and links are parts that stay, the others are at
    most ``most`` characters."""
    out, last = [], 0
    for m in [*_MASKED.finditer(text), None]:
        end = m.start() if m else len(text)
        out += [(text[last:end][a:b], True) for a, b in quote_spans(text[last:end], most)]
        if m:
            out.append((m[0], False))
            last = m.end()
    return out


def per_row(df: DataFrame, id_col: str, text_col: str, fn, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """``(id, n, <fields>)``: the tuples ``fn(text)`` gives, numbered from 1; null texts give none."""
    kind = df.schema[id_col].dataType.simpleString()
    types = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for n, r in enumerate(fn(t), 1)]
            cols = list(zip(*rows)) if rows else [()] * (2 + len(fields))
            kinds = (b.schema.field(0).type, pa.int32(), *(types[k] for _, k in fields))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "n", *(f for f, _ in fields)])

    return df.select(id_col, text_col).mapInArrow(run, ", ".join([f"id {kind}", "n int", *(f"{f} {k}" for f, k in fields)]))


def display_forms(texts: DataFrame, text_col: str) -> DataFrame:
    """``(plain, shown)``: words whose accented spelling in the corpus is the only one with accents."""
    w = texts.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    marked = w.where(T.plain("w") != F.col("w")).select(T.plain("w").alias("plain"), "w")
    return marked.groupBy("plain").agg(F.countDistinct("w").alias("forms"), F.min("w").alias("shown")).where("forms = 1").select("plain", "shown")


def preferred_alias(mentions: DataFrame) -> DataFrame:
    """``(text, name, entity)`` of ``(text, name, entity, role)``: where a name may mean several entities, those for
    which it is a main name (role 0) push out those for which it is an alias."""
    best = mentions.groupBy("text", "name").agg(F.min("role").alias("_best"))
    return mentions.join(best, ["text", "name"]).where("role = _best").select("text", "name", "entity").distinct()


def identity(*columns: str) -> Column:
    """Identity of a piece of evidence: the hash of its canonical JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def size_threshold(sizes: DataFrame, size: str, is_section: str, least: int = 5, gap: float = 1.0) -> DataFrame:
    """``(threshold)``: half way between the medians of section and part sizes, if there are ``least`` of both and the
    medians are ``gap`` apart; else null. One row."""
    s = sizes.agg(F.count_if(F.col(is_section)).alias("a"), F.count_if(~F.col(is_section)).alias("b"), F.median(F.when(F.col(is_section), F.col(size))).alias("x"), F.median(F.when(~F.col(is_section), F.col(size))).alias("y"))
    return s.select(F.when((F.col("a") >= least) & (F.col("b") >= least) & (F.col("x") - F.col("y") >= gap), (F.col("x") + F.col("y")) / 2).alias("threshold"))
