"""Text normalisation as JVM expressions, each with the SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with accents and the plain letters they fold to, pairwise.
ACCENTED = "ăâîșşțţáàäãåéèêëíìïóòôöõúùûüýÿñçšžõ"
FOLDED = "aaissttaaaaaeeeeiiiooooouuuuyyncszo"

# Romanian endings folded away, the longest first, with what stays.
ENDINGS = (("ului", ""), ("ilor", ""), ("elor", ""), ("ile", ""), ("ele", ""), ("ei", ""), ("ii", "i"), ("ul", ""), ("a", ""), ("e", ""), ("i", ""))

# Words that say nothing about the subject of a question.
GENERIC_WORDS = ("about", "ceva", "cum", "despre", "este", "pentru", "spune", "tell", "tot", "what", "which")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain(c: Column | str) -> Column:
    """Lower case without accents, letter by letter (composed letters only)."""
    return F.translate(F.lower(_col(c)), ACCENTED, FOLDED)


def plain_sql(e: str) -> str:
    return f"translate(lower({e}), '{ACCENTED}', '{FOLDED}')"


def words(c: Column | str) -> Column:
    """Runs of letters and digits of the plain text, in order; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(plain(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def words_sql(e: str) -> str:
    return f"regexp_extract_all(coalesce({plain_sql(e)}, ''), '[\\p{{L}}\\p{{N}}]+')"


def normalized(c: Column | str) -> Column:
    """The words joined by single blanks: names that differ in case, accents and punctuation only become equal."""
    return F.array_join(words(c), " ")


def normalized_sql(e: str) -> str:
    return f"array_to_string({words_sql(e)}, ' ')"


def fold_word(c: Column) -> Column:
    """The word without the first ending of ``ENDINGS`` that leaves three letters; words under four letters stay."""
    out = c
    for end, to in reversed(ENDINGS):
        out = F.when(c.endswith(end) & (F.length(c) - len(end) >= 3), F.concat(F.substring(c, F.lit(1), F.length(c) - len(end)), F.lit(to))).otherwise(out)
    return F.when(F.length(c) < 4, c).otherwise(out)


def fold_word_sql(e: str) -> str:
    cases = " ".join(f"WHEN {e} LIKE '%{end}' AND length({e}) - {len(end)} >= 3 THEN left({e}, length({e}) - {len(end)}) || '{to}'" for end, to in ENDINGS)
    return f"CASE WHEN length({e}) < 4 THEN {e} {cases} ELSE {e} END"


def meaningful(c: Column) -> Column:
    """Words of four letters or more that are not generic."""
    return F.filter(c, lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_WORDS))


def query_words(c: Column | str, most: int = 32) -> Column:
    """The first ``most`` words without the generic ones, or all of these if nothing else is left."""
    own = F.slice(words(c), 1, most)
    kept = F.filter(own, lambda w: ~w.isin(*GENERIC_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(own)


def query_words_sql(e: str, most: int = 32) -> str:
    generic = ", ".join(f"'{w}'" for w in GENERIC_WORDS)
    own = f"list_slice({words_sql(e)}, 1, {most})"
    kept = f"list_filter({own}, lambda w: NOT list_contains([{generic}], w))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {own} END"


def collapse_blank(c: Column | str) -> Column:
    """Runs of blanks and tabs as one blank, three or more line breaks as two, no blanks at line ends."""
    t = F.regexp_replace(_col(c), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")


def collapse_blank_sql(e: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({e}, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
