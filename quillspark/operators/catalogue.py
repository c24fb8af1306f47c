"""The catalogue of products: inflected names, mentions, owners of ambiguous names, lookup, orders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.evidence import phrase_mentions
from quillspark.operators.resolve import CloseNames, bounded_names

# Endings of the forms of a noun by the ending of its dictionary form, and the vowels that change before
# them. The dictionary form loses its ending first.
ROMANIAN = (
    ("eaua", ("eaua", "ea", "ele", "elei", "elele", "elelor")),
    ("ea", ("ea", "e", "ii", "i", "ile", "ilor")),
    ("a", ("a", "e", "ei", "i", "ii", "ele", "elor", "ile", "ilor")),
    ("e", ("e", "ea", "i", "ii", "ile", "ilor")),
    ("ul", ("ul", "", "ului", "i", "ii", "ilor", "uri", "urile", "urilor")),
    ("", ("", "ul", "ului", "i", "ii", "ilor", "uri", "urile", "urilor")),
)
VOWELS = (("oa", "o"), ("ea", "e"), ("ia", "ie"), ("a", "e"))
#: Ratios tried one after the other when a name is looked up and nothing is nearer.
CUTOFFS = (0.90, 0.83, 0.76)


def romanian_forms(word: str) -> set[str]:
    """Forms of a plain Romanian noun: with and without article, genitive and plural, with and without the change of its
    last vowel. A superset: forms that do not exist are met by no text."""
    if len(word) < 4:
        return {word}
    end, endings = next((e, f) for e, f in ROMANIAN if word.endswith(e))
    body = word[: len(word) - len(end)]
    bodies = {body}
    for vowel, to in VOWELS:
        head, found, tail = body.rpartition(vowel)
        if found and not set(tail) & set("aeiou"):
            bodies.add(head + to + tail)
            break
    bodies |= {b[:-1] + "z" for b in bodies if b.endswith("d")}
    return {word, *(b + e for b in bodies for e in endings if len(b) > 1)}


def english_forms(word: str) -> set[str]:
    """A plain English noun and its plural."""
    if len(word) < 3:
        return {word}
    if word.endswith("y") and word[-2] not in "aeiou":
        return {word, word[:-1] + "ies"}
    return {word, word + ("es" if word.endswith(("s", "x", "ch", "sh")) else "s")}


def inflected_names(names: DataFrame, id_col: str, name_col: str, language_col: str) -> DataFrame:
    """``(id_col, form, literal)``: each name as words and the forms of its head: the first word of a Romanian name, the
    last of an English one. Other languages give the name itself. Null and wordless names give nothing."""
    kind = names.schema[id_col].dataType.simpleString()
    own = names.select(id_col, T.words(name_col).alias("w"), F.coalesce(language_col, F.lit("")).alias("language")).where(F.size("w") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, ws, language in zip(*(c.to_pylist() for c in b.columns)):
                head = {"ro": romanian_forms(ws[0]), "en": english_forms(ws[-1])}.get(language, set())
                forms = {" ".join([h, *ws[1:]] if language == "ro" else [*ws[:-1], h]) for h in head} | {" ".join(ws)}
                rows += [(i, f, f == " ".join(ws)) for f in sorted(forms)]
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.string(), pa.bool_()))], names=[id_col, "form", "literal"])

    return own.mapInArrow(run, f"`{id_col}` {kind}, form string, literal boolean").groupBy(id_col, "form").agg(F.bool_or("literal").alias("literal"))


def mentions(texts: DataFrame, forms: DataFrame, id_col: str, text_col: str, name_id: str) -> DataFrame:
    """``(id, position, words, name_id, literal)`` of the names in texts by any of their ``forms`` (of ``inflected_names``):
    the longest name at each place, none inside a longer one, and a name as it stands in the catalogue before one that only
    an inflection gives. Several entries of one name stay several rows. Windows are per text."""
    keyed = forms.select(F.xxhash64("form").alias("_form"), "form", F.size(F.split("form", " ")).alias("words"), name_id, "literal")
    places = phrase_mentions(texts, keyed.select("_form", "form").distinct(), id_col, text_col, "_form", "form")
    met = places.join(keyed, "_form").select("id", "position", "words", name_id, "literal")
    here = W.partitionBy("id", "position")
    best = met.withColumn("_long", F.max("words").over(here)).where("words = _long").withColumn("_literal", F.max("literal").over(here)).where("literal = _literal").drop("_long", "_literal")
    before = W.partitionBy("id").orderBy("position").rangeBetween(W.unboundedPreceding, -1)
    covered = F.max(F.col("position") + F.col("words")).over(before) >= F.col("position") + F.col("words")
    return best.withColumn("_covered", F.coalesce(covered, F.lit(False))).where("NOT _covered").drop("_covered").distinct()


def preferred_owners(found: DataFrame, name_id: str) -> DataFrame:
    """``(id, position, name_id)`` of the names that several entries share: the entry that the same text names alone
    nearest by, as a botanical name in brackets or a heading does; null where none is named, or two equally near."""
    count = F.count("*").over(W.partitionBy("id", "position"))
    own = found.withColumn("_n", count)
    shared = own.where("_n > 1").select("id", "position", name_id)
    alone = own.where("_n = 1").select("id", F.col("position").alias("_at"), name_id)
    near = shared.join(alone, ["id", name_id], "left").groupBy("id", "position", name_id).agg(F.min(F.abs(F.col("_at") - F.col("position"))).alias("_d"))
    best = near.groupBy("id", "position").agg(F.min("_d").alias("_best"))
    tied = near.join(best, ["id", "position"]).where("_d = _best").groupBy("id", "position").agg(F.count("*").alias("_n"), F.min(name_id).alias(name_id))
    return best.select("id", "position").join(tied.where("_n = 1").select("id", "position", name_id), ["id", "position"], "left")


def lookup(values: DataFrame, names: Sequence[tuple[int, str]], value_col: str) -> DataFrame:
    """``(value, name_id, how, ratio)`` of each distinct value: the entry whose name it is (``exact``), the only one whose
    name begins with it (``prefix``), or the most similar one at the first of ``CUTOFFS`` that any reaches (``typo``); of
    several the smallest id. ``none`` with nulls otherwise. Null values give no rows. The names go to every task; their
    number is checked."""
    shared = values.sparkSession.sparkContext.broadcast(bounded_names(names))
    own = values.where(F.col(value_col).isNotNull()).select(F.col(value_col).alias("value"), T.normalized(value_col).alias("key")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        for i, n in shared.value:
            ids[n] = min(i, ids.get(n, i))
        index = CloseNames(list(ids))
        for b in batches:
            out = []
            for key in b.column(1).to_pylist():
                begins = {ids[n] for n in index.names if n.startswith(key + " ")} if key and key not in ids else set()
                if key in ids:
                    out.append((ids[key], "exact", 1.0))
                elif len(begins) == 1:
                    out.append((begins.pop(), "prefix", None))
                else:
                    close = index.close(key, 1, CUTOFFS[-1])
                    out.append((ids[close[0][0]], "typo", close[0][1]) if close else (None, "none", None))
            cols = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64())))], names=["value", "name_id", "how", "ratio"])

    return own.mapInArrow(run, "value string, name_id bigint, how string, ratio double")


def natural_key(c: Column) -> Column:
    """A key that orders names without case and accents, and numbers in them by value: digits padded to twelve."""
    return F.array_join(F.transform(F.regexp_extract_all(T.normalized(c), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)), lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 12, "0")).otherwise(p)), "")


def sibling_order(df: DataFrame, parent: str, name: str, key: str) -> DataFrame:
    """``df`` with ``position``: the place among the rows of one parent by name without case, then by ``key``."""
    return df.withColumn("position", F.row_number().over(W.partitionBy(parent).orderBy(F.lower(name).asc_nulls_last(), key)))


def alias_maps(aliases: DataFrame, key: str, kind: str, name: str) -> DataFrame:
    """``(key, names map<kind, sorted array of names>)``."""
    per = aliases.where(F.col(kind).isNotNull()).groupBy(key, kind).agg(F.sort_array(F.collect_set(name)).alias("_names"))
    return per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "_names")))).alias("names"))
