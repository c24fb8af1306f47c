"""One consistent form for text that looks the same in different characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.shared import materialize

# Letters of other scripts drawn like a Latin letter.
LATIN_LIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "ο": "o", "ν": "v", "ϳ": "j", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
_TO_LATIN = str.maketrans(LATIN_LIKE)
# the other way: a Latin letter in a word of another script
_TO_CYRILLIC = str.maketrans({v: k for k, v in LATIN_LIKE.items() if "\u0400" <= k <= "\u052f"})
_TO_GREEK = str.maketrans({v: k for k, v in LATIN_LIKE.items() if "\u0370" <= k <= "\u03ff"})
_CEDILLA = dict(zip("şţŞŢµ", "șțȘȚμ"))

#: A text without any of these characters is its own consistent form, so it never leaves the JVM. Listed are the
#: characters that are safe: ASCII, Latin letters with the marks of Romanian and of western languages, usual signs.
PLAIN = r"^[\x00-\x7FÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-ŝŠšŤ-žȘ-ț§«°±·»×÷\u2010-\u2014\u2018-\u201e\u2022\u2026\u20ac]*$"

_INVISIBLE = re.compile(
    "\u00ad(?![ \t]*\n)|[\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb\U000e0000-\U000e0fff]"
)
_WIDE = re.compile("[\ufb00-\ufb06\uff01-\uffee\u3000ĿŀŉĲĳſ]")
_SPACE = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_OLD = re.compile("[şţŞŢµ]")
_FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f]")
_TOKEN = re.compile(r"[^\W_]+")
_COMPOUND = re.compile("[^\\W_]+(?:['’‘`´\u2010-][^\\W_]+)*")


def fold(text: str) -> str:
    """The form of ``text`` as far as single characters decide: full-width forms and ligatures as plain letters,
    composed accents, comma below instead of cedilla, plain blanks, no invisible characters. Superscripts, fractions,
    quotation marks, case, accents and digits look different and stay. A soft hyphen at a line end is visible there
    and stays. Idempotent."""
    if text.isascii():
        return text
    text = _INVISIBLE.sub("", text)
    text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    return _SPACE.sub(" ", _OLD.sub(lambda m: _CEDILLA[m[0]], unicodedata.normalize("NFC", text)))


def _script(ch: str) -> str:
    return "greek" if "\u0370" <= ch <= "\u03ff" else "cyrillic" if "\u0400" <= ch <= "\u052f" else "latin"


def _latin(token: str) -> str:
    """Letter by letter, with the accents a letter carries: a Cyrillic a with a breve becomes a Latin one."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", token).translate(_TO_LATIN))


def _scripts(token: str) -> dict[str, int]:
    counts: dict[str, int] = {}
    for ch in token:
        if ch.isalpha():
            counts[_script(ch)] = counts.get(_script(ch), 0) + 1
    return counts


def _dominant(token: str) -> str | None:
    """The script of most letters; among equally frequent ones Latin."""
    counts = _scripts(token)
    return max(counts, key=lambda s: (counts[s], s == "latin")) if counts else None


def _all(token: str, script: str) -> bool:
    return all(_script(c) == script for c in token if c.isalpha())


def repair_candidate(token: str) -> str | None:
    """The token in its dominant script, or None where that changes nothing or can't be done letter by letter. Only
    tokens that mix scripts are repaired: a word wholly of one script is a word of that script, whatever it looks like.
    Words joined by an apostrophe or hyphen are one token; each of them is repaired by itself, so a Greek letter before
    a name stays beside a repaired name."""
    if len(_scripts(token)) < 2:
        return None
    whole = _dominant(token)

    def word(m: re.Match) -> str:
        w = m[0]
        main = _dominant(w) if len(_scripts(w)) > 1 else whole
        latin = _latin(w)
        if _all(latin, "latin"):
            return latin if main == "latin" or len(_scripts(w)) > 1 else w
        out = w.translate(_TO_CYRILLIC if main == "cyrillic" else _TO_GREEK)
        return out if main != "latin" and _all(out, main) else w

    out = _TOKEN.sub(word, token)
    return out if out != token else None


def candidates(text: str) -> Iterator[tuple[int, int, str, str]]:
    """``(begin, end, token, repair)`` in a text. A single letter, digits beside it or not, has no script to be dominant
    within it: between words of Latin letters it is offered in Latin, elsewhere it stays."""
    if not _FOREIGN.search(text):
        return
    found = list(_COMPOUND.finditer(text))
    for k, m in enumerate(found):
        token = m[0]
        if not _FOREIGN.search(token):
            continue
        out = repair_candidate(token)
        if out is None and sum(map(str.isalpha, token)) == 1:
            near = [_dominant(found[j][0]) for j in (k - 1, k + 1) if 0 <= j < len(found)]
            out = _latin(token) if near and all(s == "latin" for s in near) and _all(_latin(token), "latin") else None
        if out is not None and out != token:
            yield m.start(), m.end(), token, out


def changed_parts(token: str, repair: str) -> list[tuple[str, str]]:
    """The words of a token that its repair changes, in lower case: ``(before, after)``."""
    return [(a.lower(), b.lower()) for a, b in zip(_TOKEN.findall(token), _TOKEN.findall(repair)) if a != b]


def apply_repairs(text: str, repairs: dict[str, str]) -> str:
    out, at = [], 0
    for begin, end, token, repair in candidates(text):
        if repairs.get(token) == repair:
            out += [text[at:begin], repair]
            at = end
    return "".join([*out, text[at:]])


def _vocabulary(df: DataFrame, cols: list[str], wanted: DataFrame) -> DataFrame:
    """``(word, n)``: how often each of the ``wanted`` words occurs in the corpus in lower case. Words are counted
    map-side before they are shuffled."""
    text = F.concat_ws("\n", *cols)
    words = df.select(F.explode(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.join(wanted, "word", "left_semi")


def consistent_forms(df: DataFrame, id_col: str = "chunk_id", cols: tuple[str, ...] = ("heading", "text"), least_seen: int = 1) -> DataFrame:
    """``(id_col, <col>, <col>_form ...)``: each row's fields as stored and in their consistent form.

    First single characters are folded (``fold``). Then, in words that mix scripts, letters are replaced by their
    look-alikes of the word's dominant script, only if the result is a word of the corpus that occurs ``least_seen`` times
    and at least as often as the mixed one, so that names and symbols that rightly mix scripts stay. Null fields stay
    null, empty ones empty; repeated rows are kept; an empty table gives an empty result.

    Rows of plain characters never leave the JVM. The vocabulary is matched with the proposals by a join, so neither
    is ever held by one process; the accepted repairs return to the rows through a join on the row's id.
    """
    plain = F.lit(True)
    for c in cols:
        plain = plain & (F.col(c).isNull() | F.col(c).rlike(PLAIN))
    own = df.select(id_col, *cols)
    kind = df.schema[id_col].dataType.simpleString()
    forms = [f"{c}_form" for c in cols]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folded = [[None if t is None else fold(t) for t in b.column(1 + k).to_pylist()] for k in range(len(cols))]
            mixed = [sorted({(m, r) for t in row if t for _, _, m, r in candidates(t)}) for row in zip(*folded)]
            parts = [[{"token": a, "repair": r, "own": own, "word": word} for a, r in row for own, word in changed_parts(a, r)] for row in mixed]
            pairs = pa.array(parts, pa.list_(pa.struct([(n, pa.string()) for n in ("token", "repair", "own", "word")])))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(f, pa.string()) for f in folded), pairs], names=["id", *cols, *forms, "pairs"])

    strings = ", ".join(f"`{c}` string" for c in (*cols, *forms))
    odd = materialize(own.where(~plain).mapInArrow(first, f"id {kind}, {strings}, pairs array<struct<token:string,repair:string,own:string,word:string>>"), "lookalike")
    proposals = materialize(odd.select(F.explode("pairs").alias("p")).select("p.*").distinct(), "proposals")
    seen = materialize(_vocabulary(df, list(cols), proposals.select(F.explode(F.array("word", "own")).alias("word")).distinct()), "vocabulary")
    own_n = seen.select(F.col("word").alias("own"), F.col("n").alias("own_n"))
    judged = proposals.join(seen, "word", "left").join(own_n, "own", "left")
    fine = (F.coalesce("n", F.lit(0)) >= least_seen) & (F.coalesce("n", F.lit(0)) >= F.coalesce("own_n", F.lit(0)))
    accepted = judged.groupBy("token", "repair").agg(F.bool_and(fine).alias("fine")).where("fine").select("token", "repair")
    uses = odd.select("id", F.explode("pairs").alias("p")).select("id", "p.token", "p.repair").distinct()
    repairs = uses.join(accepted, ["token", "repair"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", "repair"))).alias("repairs"))
    joined = odd.drop("pairs").join(repairs, "id", "left")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(cols)
        for b in batches:
            out = [b.column(1 + n + k).to_pylist() for k in range(n)]
            for row, pairs in enumerate(b.column(1 + 2 * n).to_pylist()):
                if pairs:
                    to = dict(pairs)
                    for c in out:
                        if c[row]:
                            c[row] = apply_repairs(c[row], to)
            yield pa.RecordBatch.from_arrays([*b.columns[: 1 + n], *(pa.array(c, pa.string()) for c in out)], names=["id", *cols, *forms])

    fixed = joined.where(F.col("repairs").isNotNull()).mapInArrow(second, f"id {kind}, {strings}")
    rest = joined.where(F.col("repairs").isNull()).drop("repairs")
    same = own.where(plain).select(F.col(id_col).alias("id"), *cols, *(F.col(c).alias(f) for c, f in zip(cols, forms)))
    return same.unionByName(rest).unionByName(fixed).withColumnRenamed("id", id_col)


def same_look(forms: DataFrame, id_col: str = "chunk_id", cols: tuple[str, ...] = ("heading", "text")) -> DataFrame:
    """``(id_col, look, stored)`` of the rows whose consistent form occurs in more than one spelling: ``look`` is the
    class of rows that look the same, ``stored`` the class of rows stored alike. Rows of equal ``look`` and unequal
    ``stored`` are the links; copies stay one class and are not expanded. A null field equals only a null field."""
    def digest(names):
        return F.md5(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))

    keyed = forms.select(F.col(id_col), digest([f"{c}_form" for c in cols]).alias("look"), digest(list(cols)).alias("stored"))
    keyed = materialize(keyed, "looks")
    several = keyed.groupBy("look").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo != hi").select("look")
    return keyed.join(several, "look", "left_semi").distinct()


def same_look_pairs(classes: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """The links of ``same_look`` as pairs, the smaller id first. Pairs of rows stored alike are no links."""
    c = materialize(classes, "look-classes")
    a = c.select("look", F.col(id_col).alias(f"{id_col}_a"), F.col("stored").alias("sa"))
    b = c.select("look", F.col(id_col).alias(f"{id_col}_b"), F.col("stored").alias("sb"))
    return a.join(b, "look").where(f"`{id_col}_a` < `{id_col}_b` AND sa != sb").select(f"{id_col}_a", f"{id_col}_b").distinct()
