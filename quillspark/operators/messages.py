"""Messages, reports and requests: parsing, validation, merging."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as t

from quillspark.functions import text as T

# Kinds of safety messages from the most severe on, limits of their texts.
KINDS = ("contraindication", "interaction", "warning")
LONGEST, MOST_WORDS = 240, 40
# Sections of a report.
SECTIONS = ("summary", "recommendations", "nutrition", "warnings", "sources")
# Words that name a group of products.
GROUPS = {"plante": ("plante", "plantele", "plants", "herbs"), "uleiuri": ("uleiuri", "uleiurile", "oils", "uleiuri esentiale"), "suplimente": ("suplimente", "suplimentele", "supplements")}
DEFAULT_COUNT, MOST_COUNT = 100, 10_000
# What a label of a recommendation ends at (a colon or spaced dash, a word of use or a quantity, a bracket
# that opens with a quantity) and how long it may be in each case.
QUANTITY = r"(?:½|¼|\d+(?:[.,]\d+)?)\s*(?:linguri?țe?|linguri?|ml|g|capsule?|picături?)\b"
USES = r"(?:pentru\b|pulbere\b|administrat\b|preparat\b|se\s+(?:ține|bea|ia|consumă|prepară)\b)"
COUNT_WORDS = "o un una două doua trei patru cinci a an one two three"
LABELS = (
    r"^(.+?)(?::\s*|\s+[–—-]\s+)(.+)$",
    rf"(?i)^(.{{2,160}}?)\s+((?:{USES}|{QUANTITY}).*)$",
    rf"(?i)^([^():]{{2,120}}?)\s+(\((?:½|¼|\d|(?:{COUNT_WORDS.replace(' ', '|')})\s).*)$",
)
# Words of a request for a top, in the order they may come.
POLITE = ("te rog", "va rog")
WISHES = ("da mi", "arata mi", "vreau", "doresc", "as vrea")
TOPS = ("top", "topul", "best", "primele", *(f"{are}cele mai {what}" for are in ("", "care sunt ") for what in ("utile", "recomandate", "bune", "folosite")))
SUBJECTS = "pentru contra impotriva for against nu"
NO_CATEGORY = ("din catalog", "in general", "te rog")

ANSWER = t.StructType([t.StructField("status", t.StringType()), t.StructField("messages", t.ArrayType(t.StructType([t.StructField("type", t.StringType()), t.StructField("text", t.StringType())])))])


def split_label(c: Column) -> tuple[Column, Column]:
    """Label and description of a recommendation: before a colon or spaced dash; else before a verb of use or a
    quantity; else before a bracket that opens with a quantity; else no label."""
    x = F.trim(F.regexp_replace(c, r"\s+", " "))
    part = lambda group, otherwise: F.coalesce(*(F.when(x.rlike(p), F.trim(F.regexp_extract(x, p, group))) for p in LABELS), otherwise)
    return part(1, F.lit("")), part(2, x)


def valid_answers(df: DataFrame, json_col: str) -> DataFrame:
    """``df`` with ``valid_messages`` (array of type, text) and ``problem``: answers must have a known status and known
    kinds; texts one line of Latin script within the limits and without a list marker. A broken answer is dropped
    (``problem`` says why), a broken message only itself."""
    parsed = df.withColumn("_a", F.from_json(json_col, ANSWER, {"mode": "PERMISSIVE"}))
    problem = F.when(F.col("_a").isNull() | F.col("_a.status").isNull(), "not_an_answer").when(~F.col("_a.status").isin("complete", "uncertain"), "unknown_status")

    def good(m: Column) -> Column:
        text = m["text"]
        return m["type"].isin(*KINDS) & text.isNotNull() & (F.trim(text) != "") & (F.length(text) <= LONGEST) & (F.size(F.split(F.trim(text), r"\s+")) <= MOST_WORDS) & ~text.rlike(r"[\r\n]") & ~text.rlike(r"^\s*(?:[-*•]|\d+[.)])\s") & ~text.rlike(r"[\p{L}&&[^\p{IsLatin}]]")

    kept = F.when(problem.isNull(), F.filter(F.coalesce("_a.messages", F.array().cast(ANSWER["messages"].dataType)), good)).otherwise(F.array().cast(ANSWER["messages"].dataType))
    return parsed.withColumn("problem", problem).withColumn("valid_messages", kept).drop("_a")


def unknown_citations(items: DataFrame, evidence: DataFrame, report: str, cited: str) -> DataFrame:
    """``(report, id)`` of the cited evidence ids that the report's evidence lacks."""
    return items.select(report, F.explode(cited).alias("id")).distinct().join(evidence.select(report, "id"), [report, "id"], "left_anti")




def merge_messages(df: DataFrame, product: str) -> DataFrame:
    """``(product, rank, position, type, ro, en, kept)`` of ``(product, rank, position, type, ro, en)``: in the order of
    sources a message repeats an earlier one if either text is the same but for case, accents and punctuation. The
    earlier one stays, but within one source the more severe type replaces it. Sequential, since "either" is not
    transitive."""
    kind = df.schema[product].dataType.simpleString()
    own = df.select(product, "rank", "position", "type", "ro", "en")
    placed = own.repartition(product).sortWithinPartitions(product, "rank", "position")
    severity = {k: n for n, k in enumerate(KINDS)}

    def norm(s: str | None) -> str:
        return re.sub(r"[^0-9a-z]+", " ", (s or "").lower().translate(str.maketrans(T.ACCENTED, T.FOLDED))).strip()

    def flush(rows: list[list]) -> list[list]:
        kept: list[list] = []
        by_text: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for r in rows:
            texts = norm(r[4]), norm(r[5])
            found = [d[x] for d, x in zip(by_text, texts) if x in d]
            r[6] = True
            if not found:
                kept.append(r)
                at = len(kept) - 1
            elif kept[at := min(found)][1] == r[1] and severity.get(r[3], 9) < severity.get(kept[at][3], 9):
                kept[at][6] = False
                for d, x in zip(by_text, map(norm, kept[at][4:6])):
                    if d.get(x) == at:
                        del d[x]
                kept[at] = r
            else:
                r[6] = False
                continue
            for d, x in zip(by_text, texts):
                d[x] = min(at, d.get(x, at))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        schema = None

        def out(done):
            cols = list(zip(*done)) if done else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=pa.schema(schema))

        for b in batches:
            schema = [*b.schema, pa.field("kept", pa.bool_())]
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if rows and rows[-1][0] != r[0]:
                    yield out(flush(rows))
                    rows = []
                rows.append([*r, True])
        if rows:
            yield out(flush(rows))

    return placed.mapInArrow(run, f"`{product}` {kind}, rank int, position int, type string, ro string, en string, kept boolean")


def group_winners(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """The winner of each group: best source, then most severe type, then earliest."""
    severity = F.lit(len(KINDS))
    for n, k in reversed(list(enumerate(KINDS))):
        severity = F.when(F.col("type") == k, n).otherwise(severity)
    best = F.min_by(F.struct("rank", "position", "type", "ro", "en"), F.struct("rank", severity, "position"))
    return df.groupBy(*group).agg(best.alias("w")).select(*group, "w.*")


def merge_reports(items: DataFrame, report: str) -> DataFrame:
    """``(report, section, text, position, evidence)`` of ``(report, section, position, text, evidence array)``: equal
    texts of a section are one item at the first place, with the evidence of all in order, each once.
    Evidence is reduced to distinct ids before it is gathered, so copies of a text add nothing to hold."""
    keys = [report, "section", "text"]
    one = items.select(*keys, "position", F.posexplode_outer("evidence").alias("at", "id"))
    first = one.groupBy(*keys, "id").agg(F.min(F.struct("position", "at")).alias("first"))
    whole = first.groupBy(*keys).agg(F.min("first.position").alias("position"), F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("first", "id")))).alias("e"))
    return whole.select(*keys, "position", F.transform("e", lambda x: x["id"]).alias("evidence"))


@dataclass(frozen=True)
class TopRequest:
    count: int | None
    category: str | None
    clarify: str | None = None


def _after(words: list[str], phrases: Sequence[str]) -> list[str] | None:
    """The words after the longest of ``phrases`` they begin with, None if they begin with none."""
    fits = [p.split() for p in phrases if words[: len(p.split())] == p.split()]
    return words[max(map(len, fits)) :] if fits else None


def parse_top(message: str) -> TopRequest | None:
    """A request for the first products of a group: "top 10 plante". None if it is none or names a subject; what is
    unclear is said in ``clarify``."""
    table = str.maketrans(T.ACCENTED, T.FOLDED)
    words = re.findall(r"[+-]?\d+(?:[.,]\d+)?|[^\W_]+", message.lower().translate(table))
    if re.search(r'["«»„”\n;@]', message) or set(words) & set(SUBJECTS.split()):
        return None
    for phrases in (POLITE, WISHES):
        rest = _after(words, phrases)
        words = words if rest is None else rest
    rest = _after(words, TOPS)
    if rest is None:
        return None
    number = rest[0] if rest and re.fullmatch(r"[+-]?\d+", rest[0]) else None
    count = int(number) if number else DEFAULT_COUNT
    what = " ".join(rest[1:] if number else rest).removeprefix("de ")
    for phrase in NO_CATEGORY:
        what = re.sub(rf"\b{phrase}\b", "", what).strip()
    found = {g for g, names in GROUPS.items() if any(re.search(rf"\b{n}\b", what) for n in names)}
    good = 1 <= count <= MOST_COUNT
    clarify = "category" if len(found) > 1 or (what and not found) else None if good else "count"
    return TopRequest(count if good else None, next(iter(found)) if len(found) == 1 else None, clarify)


def clock(seconds: Column) -> Column:
    """hh:mm:ss."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def latest_requests(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in ``order``: deliveries repeated are taken once."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
