"""Subject areas of documents by mined class-association rules."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.lookalike import LATIN_LIKE
from quillspark.shared import bounded_sample, materialize

#: Labelled documents the rules are mined from at most, picked by the hash of their id.
TRAINING_DOCS = 6000
#: One of so many of these documents is held out: no rule is mined from it, and what evidence is worth is measured on it.
HELD_OUT = 5
#: Words of a sentence that take part in mining: those that tell most about the class.
MINED_WORDS = 6
LEAST_SHARE = 1 / 6
LEAST_WORDS = 20

_SENTENCE = re.compile(r"[.!?][\"')\]]*\s+|\n\s*\n\s*|\n(?=[ \t]*(?:[-*+>|]|\d+[.)]\s))")
_WORD = re.compile(r"[0-9a-z]+")  # of lower-case ASCII
_HEADING = re.compile(r"^[ \t]{0,3}#{1,6}(?:[ \t].*|)$", re.M)
_BROKEN = re.compile("(?<=[^\\W\\d_])[-\u00ad\u2010\u00ac]\n[ \t]*(?=[^\\W\\d_])")
_FOREIGN = re.compile("[\u0370-\u052f]")
_LATIN = str.maketrans(LATIN_LIKE)


def body(text: str) -> str:
    """The text without its Markdown titles and headings."""
    return _HEADING.sub("", text)


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence of a body, without case and accents; list items, table rows and paragraphs end
    sentences too. Words broken at a line end are joined; letters that no accent or look-alike leads to ASCII are left out."""
    text = _BROKEN.sub("", text)
    if not text.isascii():
        if _FOREIGN.search(text):
            text = text.translate(_LATIN)
        text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return [ws for s in _SENTENCE.split(text.lower()) if (ws := _WORD.findall(s))]


def _training(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(doc, held_out, classes, words)`` for each sentence of the labelled sample; the classes are all that any annotator gave
    the document, each once. Annotators err now and then: the confidence of the rules allows for that."""
    per_doc = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(F.collect_set(F.col(label_col).cast("long")).alias("classes"))
    sample = bounded_sample(per_doc, "doc", TRAINING_DOCS)
    own = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(sample, "doc").dropDuplicates(["doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, classes, words = [], [], []
            for d, t, c in zip(*(b.column(n).to_pylist() for n in ("doc", "text", "classes"))):
                for ws in sentences(body(t)):
                    docs.append(d)
                    classes.append(c)
                    words.append(ws)
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field("doc").type), pa.array(classes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.string()))], names=["doc", "classes", "words"])

    kind = documents.schema[id_col].dataType.simpleString()
    rows = own.select("doc", "text", "classes").mapInArrow(run, f"doc {kind}, classes array<bigint>, words array<string>")
    return rows.withColumn("held_out", F.pmod(F.xxhash64("doc", F.lit("held out")), F.lit(HELD_OUT)) == 0)


def mine_rules(rows: DataFrame, confidence: float = 0.5) -> list[tuple[tuple[str, ...], int, float]]:
    """``(words, class, evidence)``: class-association rules mined by parallel FP-growth over the sentences of a
    bounded labelled sample (``classes, words`` of ``rows``), redundant ones pruned. The bound of the sample bounds the
    word sets; none that is frequent is left out.

    A transaction is the most telling words of a sentence with the classes of its document. A frequent word set gives
    a rule for the class that its confidence lifts most over the class's base rate, if the confidence reaches
    ``confidence`` of what the class can reach; a rule is redundant if a subset of its words gives the same class with
    about the same confidence. ``evidence`` is the logarithm of the odds against the base rate, from counts smoothed
    by the base rate (so rare sets weigh little).
    """
    from pyspark.ml.fpm import FPGrowth

    rows = materialize(rows.select("classes", F.array_distinct(F.filter("words", lambda w: w.rlike("^[a-z]{2,}$"))).alias("words")).where(F.size("words") > 1), "mined")
    n = rows.count()
    if not n:
        return []
    base = {r.c: r["count"] / n for r in rows.select(F.explode("classes").alias("c")).groupBy("c").count().collect()}
    least = max(3, round(2e-4 * n))
    # of each word, how often it occurs and with which class: by that, the words that tell something
    counts = rows.select(F.explode("words").alias("w"), "classes").groupBy("w").agg(F.count("*").alias("n"), F.array(*(F.count(F.when(F.array_contains("classes", c), 1)) for c in sorted(base))).alias("by")).where(F.col("n") >= least)
    order = sorted(base)
    telling = {}
    for r in counts.collect():  # words of a bounded sample
        lift = max(((k + 2 * base[c]) / (r.n + 2)) / base[c] for c, k in zip(order, r.by))
        if lift >= 1.3:
            telling[r.w] = lift
    if not telling:
        return []
    shared = rows.sparkSession.sparkContext.broadcast(telling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = []
            for c, ws in zip(b.column("classes").to_pylist(), b.column("words").to_pylist()):
                best = sorted((w for w in ws if w in shared.value), key=lambda w: (-shared.value[w], w))[:MINED_WORDS]
                if best:
                    items.append([*best, *(f"#{x}" for x in c)])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], names=["items"])

    baskets = materialize(rows.select("classes", "words").mapInArrow(run, "items array<string>"), "baskets")
    total = max(1, baskets.count())
    sets = FPGrowth(itemsCol="items", minSupport=least / total, numPartitions=baskets.sparkSession.sparkContext.defaultParallelism).fit(baskets).freqItemsets
    split = sets.select(F.filter("items", lambda x: ~x.startswith("#")).alias("w"), F.filter("items", lambda x: x.startswith("#")).alias("c"), "freq")
    split = split.where((F.size("c") <= 1) & F.size("w").between(1, 3)).select(F.array_sort("w").alias("w"), F.element_at(F.concat("c", F.array(F.lit(""))), 1).alias("c"), "freq")
    support: dict[tuple, dict[str, int]] = defaultdict(dict)
    for r in split.collect():
        support[tuple(r.w)][r.c] = r.freq
    rules: dict[tuple, tuple[int, float, float]] = {}
    # what a class can reach: its labels miss some documents, so even its own words stay under 1
    for words in sorted(support, key=len):
        by = support[words]
        if "" not in by:
            continue
        best = max(((k + 2 * base[int(c[1:])]) / (by[""] + 2), int(c[1:])) for c, k in by.items() if c) if len(by) > 1 else None
        if not best:
            continue
        conf, c = best
        if conf < confidence or conf <= base[c]:
            continue
        subsets = [words[:i] + words[i + 1 :] for i in range(len(words))] if len(words) > 1 else []
        subsets += [(w,) for w in words] if len(words) > 2 else []
        if any(s in rules and rules[s][0] == c and rules[s][1] >= conf - 0.05 for s in subsets):
            continue
        rules[words] = (c, conf, math.log(conf / (1 - min(conf, 0.995))) - math.log(base[c] / (1 - min(base[c], 0.995))))
    kept = sorted(rules.items(), key=lambda kv: (-kv[1][2], kv[0]))
    return [(words, c, evidence) for words, (c, _, evidence) in kept]


class Scorer:
    """Matches rules against sentences. Sentences with the same rule words get the same answer, so answers are kept; those
    kept longest make room, which changes no answer."""

    def __init__(self, rules: list[tuple[tuple[str, ...], int, float]], margin: float = 0.0):
        self.margin = margin
        self.single: dict[str, tuple[int, float]] = {}
        self.several: dict[str, list] = defaultdict(list)
        for words, c, e in rules:
            if len(words) == 1:
                self.single[words[0]] = (c, e)
            else:
                self.several[words[0]].append((frozenset(words), c, e))
        self.words = {w for words, _, _ in rules for w in words}
        self.memo: dict[frozenset, tuple[int | None, float]] = {}

    def best(self, words: list[str]) -> tuple[int | None, float]:
        """The class with the most evidence, and how much more it has than the second or, with no second, than none."""
        key = self.words.intersection(words)
        if not key:
            return None, 0.0
        key = frozenset(key)
        if key in self.memo:
            return self.memo[key]
        score: Counter = Counter()
        for w in sorted(key):
            if w in self.single:
                c, e = self.single[w]
                score[c] += e
            for need, c, e in self.several.get(w, ()):
                if need <= key:
                    score[c] += e
        top = sorted(score.items(), key=lambda kv: (-kv[1], kv[0]))
        out = (top[0][0], top[0][1] - max(0.0, top[1][1] if len(top) > 1 else 0.0)) if top and top[0][1] > 0 else (None, 0.0)
        if len(self.memo) >= 200_000:
            self.memo.clear()
        self.memo[key] = out
        return out

    def sentence(self, words: list[str]) -> int | None:
        """The class of the sentence, None if there is none or the evidence is not enough."""
        c, more = self.best(words)
        return c if more > self.margin else None

    def shares(self, text: str | None) -> tuple[int, dict[int, float]]:
        """Number of body words, and of each class the share of them in its sentences."""
        if not text or not text.strip():
            return 0, {}
        by: Counter = Counter()
        total = 0
        for ws in sentences(body(text)):
            total += len(ws)
            c = self.sentence(ws)
            if c is not None:
                by[c] += len(ws)
        return total, {c: k / total for c, k in by.items()}


def calibrate(held_out: DataFrame, rules: list[tuple[tuple[str, ...], int, float]]) -> tuple[float, float]:
    """``(slope, offset)`` of the chance that the best class of a sentence is one its document is labelled with, as the
    logistic function of how much more evidence it has than the second: measured on the held-out documents, so evidence
    is worth what it proves to be. ``(1, 0)`` if there is nothing to measure."""
    shared = held_out.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            rows = []
            for classes, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c, more = scorer.best(words)
                if c is not None:
                    rows.append((round(more, 1), c in classes))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.bool_())], names=["more", "right"])

    seen = held_out.select("classes", "words").mapInArrow(run, "more double, right boolean").groupBy("more").agg(F.count("*").alias("n"), F.count_if("right").alias("k"))
    bins = sorted((r.more, r.n, r.k) for r in seen.collect())  # tenths of evidence, whatever the number of sentences
    if not bins:
        return 1.0, 0.0
    x, n, k = (np.array(c, float) for c in zip(*bins))
    w = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):  # Newton steps with a weak pull to (1, 0)
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (k - n * p) - (w - [1.0, 0.0])
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + np.eye(2), grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def trained(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list, float]:
    """The rules, and the margin of evidence from which on the best class of a sentence is more likely right than not."""
    rows = materialize(_training(documents, labels, id_col, text_col, label_col), "sentences")
    rules = mine_rules(rows.where(~F.col("held_out")))
    slope, offset = calibrate(rows.where("held_out"), rules)
    return rules, max(0.0, -offset / slope) if slope > 0 else 0.0


def subject_shares(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "subject_id") -> DataFrame:
    """``(id_col, label_col, share, body_words)``: of each document, the share of its body's words in sentences of each
    area. Titles and headings are left aside; sentences that no rule decides, or whose evidence held-out documents show to
    be more often wrong than right, count for no area but as words. Null, blank and heading-only texts give no rows; with
    no labels there are no rules and no rows. Repeated rows give repeated rows. Documents are read in one pass without a
    shuffle; the rules are bounded by the bounded sample of labelled documents they are mined from."""
    rules, margin = trained(documents, labels, id_col, text_col, label_col)
    kind = documents.schema[id_col].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast((rules, margin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, by = scorer.shares(t)
                out += [(d, c, s, n) for c, s in sorted(by.items())]
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.int64(), pa.float64(), pa.int32()))], names=[id_col, label_col, "share", "body_words"])

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{label_col}` bigint, share double, body_words int")


def held_out_quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "subject_id") -> dict[str, float]:
    """How the areas found agree with the labels of the documents that no rule was mined from: share of the labelled areas
    that are found, and of the found areas that are labelled."""
    per_doc = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(F.collect_set(F.col(label_col).cast("long")).alias("classes"))
    kept = bounded_sample(per_doc, "doc", TRAINING_DOCS).where(F.pmod(F.xxhash64("doc", F.lit("held out")), F.lit(HELD_OUT)) == 0)
    given = kept.select("doc", F.explode("classes").alias("c"))
    found = subject_areas(subject_shares(documents, labels, id_col, text_col, label_col)).select(F.col(id_col).alias("doc"), F.col(label_col).alias("c")).distinct().join(kept.select("doc"), "doc", "left_semi")
    both = given.join(found, ["doc", "c"]).count()
    return {"documents": kept.count(), "found_of_labelled": both / max(1, given.count()), "labelled_of_found": both / max(1, found.count())}


def subject_areas(shares: DataFrame, least_share: float = LEAST_SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``subject_shares`` whose area takes up at least ``least_share`` of a body of ``least_words``."""
    return shares.where((F.col("share") >= least_share) & (F.col("body_words") >= least_words))
