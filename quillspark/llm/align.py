"""Sentence alignment of documents that exist in two languages."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.lookalike import fold
from quillspark.shared import materialize

#: Rounds in which the translation tables are learned, each from the alignment of the round before, at most; they end when
#: the number of translations and their sum change by no more than this share.
ROUNDS, SETTLED = 4, 1e-3
#: Translations kept of a word, and the least association of one.
TRANSLATIONS, LEAST_ASSOCIATION = 6, 0.12
#: Rows of the tables that go to every task; larger tables are joined by word, with the same result.
MOST_SHARED = 300_000
#: Least score of a pair, and least share of a neighbour's content that the other sentence must cover to be merged.
LEAST_SCORE, LEAST_COVERED = 0.48, 0.6
#: Sentences of either side in a cell, the unit in which those of a document meet: most documents are one cell, a large
#: one has as many as its sides need, with the same result.
CELL = 256
#: Before anything is learned: places that a sentence's partner may be off the even spread of both sides.
BAND = 3
#: Pairs of sentences that teach words: least score, and least share of either one's alignment.
LEAST_TEACHING, LEAST_SHARE = 0.3, 0.2

_STOP = re.compile(r"[.!?](?=\s|\Z)")
_WORD = re.compile(r"[^\W_]+")


def split_sentences(text: str) -> list[tuple[int, str]]:
    """``(number, sentence)``, counted from 1: a sentence ends at ``.``, ``!`` or ``?`` before white space or the end
    of the text; what follows the last one counts as one if it is not blank."""
    out, start = [], 0
    for m in _STOP.finditer(text):
        out.append(text[start : m.end()].strip())
        start = m.end()
    if text[start:].strip():
        out.append(text[start:].strip())
    return list(enumerate(out, 1))


def content(sentence: str) -> list[str]:
    """Distinct words of a sentence without case and accents, in order; words broken at a line end are joined."""
    t = re.sub("(?<=[^\\W\\d_])[-\u00ad\u2010\u00ac][ \t]*\n\\s*(?=[^\\W\\d_])", "", sentence)
    if not t.isascii():
        t = unicodedata.normalize("NFKD", fold(t)).encode("ascii", "ignore").decode()
    return list(dict.fromkeys(w for w in _WORD.findall(t.lower()) if len(w) > 1 or w.isdigit()))


def counterpart_key(path: Column | str, languages: tuple[str, str] = ("ro", "en")) -> Column:
    """What the paths of a document and its counterpart share: the path without marks of language, case, accents, kind
    of separator and extension."""
    marks = "|".join(languages)
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    p = F.translate(p, "ăâîșşțţáàäéèêëíïóòöúüñç", "aaissttaaaeeeeiiooouunc")
    p = F.regexp_replace(p, r"\p{M}+", "")
    p = F.regexp_replace(p, rf"^(?:{marks})/|\.[a-z0-9]+$", "")
    p = F.regexp_replace(p, r"[\s_\-.]+", "-")
    return F.regexp_replace(p, rf"(?:-(?:{marks}))+$|(?<=/)(?:{marks})-", "")


def paired_sentences(chunks: DataFrame, languages: tuple[str, str], id_col: str, path_col: str, lang_col: str, text_col: str, line_col: str | None) -> DataFrame:
    """``(doc, side, id, line, number, words)`` of the documents that have chunks in both languages; ``doc`` numbers the
    documents, ``side`` is 0 for the first language."""
    line = F.col(line_col).cast("long") if line_col else F.lit(None).cast("long")
    own = chunks.where(F.col(lang_col).isin(*languages) & F.col(path_col).isNotNull() & F.col(text_col).isNotNull())
    side = F.when(F.col(lang_col) == languages[0], 0).otherwise(1)
    own = own.select(counterpart_key(path_col, languages).alias("key"), side.alias("side"), F.col(id_col).alias("id"), line.alias("line"), F.col(text_col).alias("text"))
    both = own.groupBy("key").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a != b").select("key")
    both = materialize(both.withColumn("doc", F.monotonically_increasing_id()), "documents")  # written, so that numbers stay
    kind = chunks.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, side, i, line, n, content(s)) for d, side, i, line, t in zip(*(c.to_pylist() for c in b.columns)) for n, s in split_sentences(t)]
            cols = list(zip(*rows)) if rows else [()] * 6
            types = (pa.int64(), pa.int32(), b.schema.field(2).type, pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc", "side", "id", "line", "number", "words"])

    return own.join(both, "key").select("doc", "side", "id", "line", "text").mapInArrow(run, f"doc bigint, side int, id {kind}, line bigint, number bigint, words array<string>")


def said(words: str) -> Column:
    """Sentences of the same words are one; within a document their 64-bit digest tells them apart."""
    return F.xxhash64(F.array_join(words, " "))


def placed_sentences(sentences: DataFrame) -> DataFrame:
    """``(doc, side, said, words, place, total, other)``: the distinct sentences of each side, numbered in the order of the
    document, with the number of those of its own and of the other side. Places are ranks within range partitions plus the
    sizes of those before, so no document is in one task."""
    spoken = sentences.where(F.size("words") > 0).withColumn("said", said("words"))
    first = spoken.groupBy("doc", "side", "said").agg(F.min(F.struct(F.coalesce("line", F.lit(1 << 40)).alias("line"), "id", "number")).alias("at"), F.first("words").alias("words"))
    ranged = materialize(first.repartitionByRange("doc", "side", "at").withColumn("part", F.spark_partition_id()), "ranged")
    whole = W.partitionBy("doc", "side")
    sizes = ranged.groupBy("doc", "side", "part").agg(F.count("*").alias("n"))
    total = F.sum("n").over(whole)
    sizes = sizes.select("doc", "side", "part", total.cast("int").alias("total"), (F.sum("n").over(W.partitionBy("doc")) - total).cast("int").alias("other"), (F.sum("n").over(whole.orderBy("part")) - F.col("n")).cast("int").alias("before"))
    place = F.row_number().over(W.partitionBy("doc", "side", "part").orderBy("at")) - 1 + F.col("before")
    return materialize(ranged.join(sizes, ["doc", "side", "part"]).select("doc", "side", "said", "words", place.cast("int").alias("place"), "total", "other"), "sentences")


def weighted(placed: DataFrame, side: int, known: DataFrame | None, total: float) -> DataFrame:
    """``(doc, place, at, other, digits, all, ws array<struct<w, x, digit, long>>)`` of one side: the words of each sentence
    as 64-bit digests with weights ``x`` that sum up to ``all``; ``at`` is the place as a share of the document, ``digits``
    the weight of the numbers. Rare words weigh more; before anything is known numbers weigh most."""
    own = placed.where(F.col("side") == side)
    words = own.select("doc", "place", "total", "other", F.explode("words").alias("word"))
    digit = F.col("word").rlike("^[0-9]+$")
    words = words.select("doc", "place", "total", "other", F.xxhash64("word").alias("w"), digit.alias("digit"), (digit | (F.length("word") > 3)).alias("long"))
    if known is None:
        weight = F.when(F.col("digit"), 1.0).otherwise(0.2)
    else:
        words = words.join(known, "w", "left")
        told = F.log(1 + total / (1 + F.coalesce("n", F.lit(0.0))))
        weight = F.when(F.col("digit") | F.col("translated"), told).otherwise(0.5 * math.log(1 + total / 2) if total else 1.0)
    words = words.withColumn("x", weight.cast("float"))
    per = words.groupBy("doc", "place").agg(F.first("total").alias("total"), F.first("other").alias("other"), F.sum("x").alias("all"), F.coalesce(F.sum(F.when(F.col("digit"), F.col("x"))), F.lit(0.0)).alias("digits"), F.collect_list(F.struct("w", "x", "digit", "long")).alias("ws"))
    return per.select("doc", "place", (F.col("place") / F.col("total")).cast("float").alias("at"), "other", F.col("digits").cast("float").alias("digits"), F.col("all").cast("float").alias("all"), "ws")


def in_cells(sentences: DataFrame) -> DataFrame:
    """``sentences``, or rows of them, of both sides, in each cell ``(doc, ia, ib)`` where they meet others, all rows of a
    cell in one task. The number of tasks is stated, since what comes of a cell is many times its sentences."""
    block = lambda n: (n / CELL).cast("int")
    own, cell = block(F.col("place")), F.col("cell")
    rows = sentences.withColumn("cell", F.explode(F.sequence(F.lit(0), block(F.greatest(F.col("other"), F.lit(1)) - 1))))
    rows = rows.withColumns({"ia": F.when(F.col("side") == 0, own).otherwise(cell), "ib": F.when(F.col("side") == 0, cell).otherwise(own)}).drop("cell")
    return rows.repartition(int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc", "ia", "ib")


def entries(sentences: DataFrame, words: DataFrame | None) -> DataFrame:
    """What each sentence enters into the inverted file: ``near`` and ``w`` say under what, ``x`` is what the word weighs in
    the sentence, null if that only has a translation of it, ``raw`` the same of numbers before weights are shares, ``t``
    how much the word counts in the bag that the sentence becomes. Equal tokens (numbers, names) translate each other;
    ``words`` holds ``(side, w, tos)``. Without it sentences also enter the places around their own (``near``)."""
    e, zero = F.col("e"), F.lit(0.0).cast("float")
    entry = lambda near, w, x, raw, t: F.struct(near.alias("near"), w.cast("long").alias("w"), x.cast("float").alias("x"), raw.cast("float").alias("raw"), t.cast("float").alias("t"))
    own = lambda e: entry(F.lit(False), e["w"], e["x"] / F.col("all"), F.when(e["digit"], e["x"]).otherwise(0.0), F.when(e["long"], 1.0).otherwise(0.5))
    if words is None:
        even = F.round(F.col("at") * F.col("other")).cast("int")
        around = F.when(F.col("side") == 0, F.sequence(even - BAND, even + BAND)).otherwise(F.array("place"))
        found = sentences.withColumn("e", F.explode(F.concat(F.transform("ws", own), F.transform(around, lambda p: entry(F.lit(True), p, zero, zero, zero)))))
    else:
        found = sentences.withColumn("e", F.explode("ws")).withColumn("w", e["w"]).join(words, ["side", "w"], "left")
        to = F.transform("tos", lambda x: entry(F.lit(False), x["to"], F.lit(None), zero, x["t"]))
        found = found.withColumn("e", F.explode(F.when(F.col("tos").isNull(), F.array(own(e))).otherwise(F.concat(F.array(own(e)), to))))
    return found.select(*(c for c in sentences.columns if c not in ("ws", "all")), "e.*")


def scored_pairs(a: DataFrame, b: DataFrame, table: DataFrame | None) -> DataFrame:
    """``(doc, pa, pb, ca, cb, score)``: how much of each sentence of ``a`` a sentence of ``b`` covers, the other way, and
    their score, for all pairs that share a translation. Both directions go through one inverted file: a word has the
    sentences of either side that hold it or have it in their bag, the bag of each sentence meets those of the other side
    that hold the word, and what it weighs in these is added up. Sentences, not pairs or words, go to the task of their
    cell, where all this is done."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    if table is None:
        rows = entries(in_cells(both), None)
    else:
        way = lambda side, w, to: table.select(F.lit(side).alias("side"), F.col(w).alias("w"), F.struct(F.col(to).alias("to"), "t").alias("to"))
        words = way(0, "wa", "wb").unionByName(way(1, "wb", "wa")).groupBy("side", "w").agg(F.collect_list("to").alias("tos"))
        rows = entries(in_cells(both), F.broadcast(words)) if table.count() <= MOST_SHARED else in_cells(entries(both, words))
    # of several words that give one, the best counts
    rows = rows.groupBy("doc", "ia", "ib", "near", "w", "side", "place").agg(*(F.max(c).alias(c) for c in ("x", "raw", "t")), *(F.first(c).alias(c) for c in ("at", "digits")))
    holds = F.struct(F.col("place").alias("p"), "x", "raw", "t", "at", "digits")
    file = rows.groupBy("doc", "ia", "ib", "near", "w").agg(*(F.collect_list(F.when(F.col("side") == side, holds)).alias(c) for side, c in ((0, "a"), (1, "b"))))
    met = file.where((F.size("a") > 0) & (F.size("b") > 0)).withColumn("a", F.explode("a")).withColumn("b", F.explode("b")).where("a.x IS NOT NULL OR b.x IS NOT NULL")
    part = lambda c, t: F.coalesce(F.col(c) * F.col(t), F.lit(0.0)).alias(c[2:] + c[0])
    met = met.select("doc", "ia", "ib", F.col("a.p").alias("pa"), F.col("b.p").alias("pb"), part("a.x", "b.t"), part("b.x", "a.t"), part("a.raw", "b.t"), *(F.col(f"{c}.{k}").alias(k + c) for c in "ab" for k in ("at", "digits")))
    pairs = met.groupBy("doc", "ia", "ib", "pa", "pb").agg(F.sum("xa").alias("ca"), F.sum("xb").alias("cb"), F.sum("rawa").alias("shared"), *(F.first(f"{k}{c}").alias(n + c) for c in "ab" for k, n in (("at", "at"), ("digits", "d"))))
    apart = F.col("ata") - F.col("atb")
    bonus = 0.03 * F.exp(-F.pow(apart / 0.1, 2)) if table is not None else F.exp(-F.pow(apart / 0.08, 2))
    # sentences made alike whose numbers differ, the rare ones above all, say different things
    least = F.least("da", "db")
    trust = F.when((least > 0) & (F.col("shared") < 0.4 * least), 0.3).otherwise(1.0)
    return pairs.select("doc", "pa", "pb", (F.col("ca") * trust).alias("ca"), (F.col("cb") * trust).alias("cb"), (trust * (F.sqrt(F.col("ca") * F.col("cb")) + bonus)).alias("score"))


def learn(pairs: DataFrame, a: DataFrame, b: DataFrame, power: int) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """``(table, known a, known b, total)`` from the alignment that ``pairs`` gives: each side spreads one count over what it
    is most like. ``table`` holds ``wa, wb, t``: of each word its best translations by association c / sqrt(na nb), from
    either side, weighted relative to the best of either word and less for weak ones; ``known`` holds ``w, n,
    translated``."""
    s = F.pow(F.col("score"), power)
    share = F.sqrt(s / F.sum(s).over(W.partitionBy("doc", "pa")) * s / F.sum(s).over(W.partitionBy("doc", "pb")))
    soft = pairs.where(F.col("score") >= (LEAST_TEACHING if power > 2 else 0.05)).select("doc", "pa", "pb", share.alias("soft")).where(F.col("soft") >= LEAST_SHARE)
    bare = lambda c: F.transform("ws", lambda e: F.struct(e["w"].alias("w"), e["digit"].alias("digit"))).alias(c)
    wa = a.select("doc", F.col("place").alias("pa"), bare("wa"))
    wb = b.select("doc", F.col("place").alias("pb"), bare("wb"))
    taught = materialize(soft.join(wa, ["doc", "pa"]).join(wb, ["doc", "pb"]).select("soft", "wa", "wb"), "taught")
    total = taught.agg(F.sum("soft")).first()[0] or 0.0
    word = lambda c: taught.select("soft", F.explode(c).alias("e")).groupBy(F.col("e.w").alias("w")).agg(F.sum("soft").alias("n"))
    na, nb = materialize(word("wa"), "words-a"), materialize(word("wb"), "words-b")
    # numbers translate only themselves
    counts = taught.select("soft", F.explode("wa").alias("a"), "wb").where(~F.col("a.digit")).select("soft", F.col("a.w").alias("wa"), F.explode("wb").alias("b")).where(~F.col("b.digit"))
    counts = counts.groupBy("wa", F.col("b.w").alias("wb")).agg(F.sum("soft").alias("c")).where("c > 0.3")
    linked = counts.join(na.withColumnsRenamed({"w": "wa", "n": "na"}), "wa").join(nb.withColumnsRenamed({"w": "wb", "n": "nb"}), "wb")
    linked = linked.select("wa", "wb", (F.col("c") / F.sqrt(F.col("na") * F.col("nb") + 0.5)).alias("s")).where(F.col("s") >= LEAST_ASSOCIATION)
    of_a, of_b = W.partitionBy("wa"), W.partitionBy("wb")
    ranked = linked.withColumn("ra", F.row_number().over(of_a.orderBy(F.desc("s"), "wb"))).withColumn("rb", F.row_number().over(of_b.orderBy(F.desc("s"), "wa"))).where((F.col("ra") <= TRANSLATIONS) & (F.col("rb") <= 2 * TRANSLATIONS))
    best = F.greatest(F.col("s") / F.max("s").over(of_a), F.col("s") / F.max("s").over(of_b))
    table = materialize(ranked.select("wa", "wb", (best * F.least(F.lit(1.0), 0.4 + F.col("s"))).cast("float").alias("t")), "translations")
    known = lambda n, c: n.join(table.select(F.col(c).alias("w")).distinct().withColumn("translated", F.lit(True)), "w", "left").select("w", "n", F.coalesce("translated", F.lit(False)).alias("translated"))
    return table, known(na, "wa"), known(nb, "wb"), float(total)


def grown(choices: DataFrame, at: str, partner: str, core: DataFrame) -> DataFrame:
    """``choices`` of one side that belong to a merge: runs of neighbouring sentences with one partner, of which one stands
    and the others are covered by it. A run is as long as it is, so a sentence may merge any number."""
    marked = choices.join(core.select("doc", "pa", "pb").withColumn("stands", F.lit(True)), ["doc", "pa", "pb"], "left")
    fit = marked.where(F.col("stands") | (F.col("c" + at[1]) >= LEAST_COVERED))
    run = F.col(at) - F.row_number().over(W.partitionBy("doc", partner).orderBy(at))
    kept = F.max(F.coalesce("stands", F.lit(False))).over(W.partitionBy("doc", partner, "run"))
    return fit.withColumn("run", run).withColumn("kept", kept).where("kept").select("doc", "pa", "pb", "score")


def align_sentences(chunks: DataFrame, languages: tuple[str, str] = ("ro", "en"), id_col: str = "chunk_id", path_col: str = "source_relative_path", lang_col: str = "language", text_col: str = "text", line_col: str | None = "line_start", rounds: int = ROUNDS) -> DataFrame:
    """``(id_col_a, sentence_a, id_col_b, sentence_b, score)``: sentences of documents and their counterparts that say
    the same thing, ``a`` in the first language.

    Counterparts are found by path (``counterpart_key``). Translation tables are learned from all pairs of documents in
    ``rounds`` passes, fewer if they settle before: at first from sentences at like places and with like numbers, then from
    the alignment of the pass before. Each sentence then finds its best partner in both directions (ties go to the earlier one); pairs that
    choose each other stand, and neighbours of a standing sentence join its partner where they choose it and it covers
    them, so merged and split sentences give several pairs. Sentences without a partner give none; order is only a slight
    preference.

    A sentence that stands in several chunks of its document (copies, older versions) counts once in the alignment and
    gives a pair for each place. Rows with a null path, text or language, and documents without a counterpart, give
    nothing; with no pair of documents the result is empty. Everything is joined by document and sentence or by cell of a
    document, so a document that holds a third of all rows is spread over many tasks.
    """
    sentences = materialize(paired_sentences(chunks, languages, id_col, path_col, lang_col, text_col, line_col), "paired")
    placed = placed_sentences(sentences)
    table, known_a, known_b, total = None, None, None, 0.0
    before = None
    for k in range(rounds):
        a, b = (materialize(weighted(placed, side, known, total), "side") for side, known in ((0, known_a), (1, known_b)))
        table, known_a, known_b, total = learn(scored_pairs(a, b, table), a, b, 8 if k else 2)
        now = table.agg(F.count("*").alias("n"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("t")).first()
        if k > 1 and abs(now.n - before.n) <= SETTLED * before.n and abs(now.t - before.t) <= SETTLED * before.t:
            break
        before = now
    a, b = (materialize(weighted(placed, side, known, total), "side") for side, known in ((0, known_a), (1, known_b)))
    pairs = materialize(scored_pairs(a, b, table).where("score >= 0.1 OR ca >= 0.5 OR cb >= 0.5"), "pairs")
    best = F.max_by(F.struct("pa", "pb", "score", "ca", "cb"), F.struct("score", -F.col("pa"), -F.col("pb")))
    fa = materialize(pairs.groupBy("doc", F.col("pa").alias("from")).agg(best.alias("x")).select("doc", "x.*"), "choices-a")
    fb = materialize(pairs.groupBy("doc", F.col("pb").alias("from")).agg(best.alias("x")).select("doc", "x.*"), "choices-b")
    core = materialize(fa.join(fb.select("doc", "pa", "pb"), ["doc", "pa", "pb"]).where(F.col("score") >= LEAST_SCORE).select("doc", "pa", "pb", "score"), "core")
    links = core.unionByName(grown(fa, "pa", "pb", core)).unionByName(grown(fb, "pb", "pa", core)).groupBy("doc", "pa", "pb").agg(F.max("score").alias("score"))
    at = sentences.where(F.size("words") > 0).select("doc", "side", said("words").alias("said"), "id", "number").join(placed.select("doc", "side", "said", "place"), ["doc", "side", "said"])
    sa = at.where("side = 0").select("doc", F.col("place").alias("pa"), F.col("id").alias(f"{id_col}_a"), F.col("number").alias("sentence_a"))
    sb = at.where("side = 1").select("doc", F.col("place").alias("pb"), F.col("id").alias(f"{id_col}_b"), F.col("number").alias("sentence_b"))
    return links.join(sa, ["doc", "pa"]).join(sb, ["doc", "pb"]).select(f"{id_col}_a", "sentence_a", f"{id_col}_b", "sentence_b", "score").distinct()
