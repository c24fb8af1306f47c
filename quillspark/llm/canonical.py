"""Free-entered values mapped to the entries of a reference list."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.lookalike import LATIN_LIKE, fold
from quillspark.shared import materialize

#: Names that go to every task at once; a longer list is taken block by block and the best block wins, by the same order.
BLOCK_NAMES = 200_000
#: A word of the values that no name has says nothing if leaving it out leaves the exact names of so many entries.
LEAST_ENTRIES = 3
#: A word that may misspell one of a name is one of its own if it is at least this share as frequent.
MISSPELT_SHARE = 0.05
#: A word that this share of the names have, always between two others, may be left out if no two entries differ by it.
OPTIONAL_SHARE = 0.005
#: Total distance of all words of a value within which it may still name an entry.
MOST_TOTAL = 4.0

_LATIN = str.maketrans(LATIN_LIKE)
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower case without accents, one script, plain characters; apostrophes with a genitive s are dropped."""
    t = unicodedata.normalize("NFKD", fold(text).translate(_LATIN)).casefold()
    t = "".join(c for c in t if not unicodedata.combining(c))
    return re.sub(r"['’‘`´](?=s\b)|(?<=s)['’‘`´]", "", t)


def tokens(text: str) -> list[str]:
    return _WORD.findall(plain(text))


def stem(word: str) -> str:
    """A light stem shared by the inflected forms of a Romanian or English noun."""
    if len(word) > 4:
        for end in ("ului", "ilor", "elor", "ul"):
            if word.endswith(end) and len(word) - len(end) >= 3:
                word = word[: -len(end)]
                break
    if word.endswith("s") and len(word) > 3 and not word.endswith("ss"):
        word = word[:-1]
    bare = word.rstrip("aeiu")
    word = bare if len(bare) >= 3 else word
    return word[:-3] + "el" if word.endswith("eal") else word


_LAST_VOWEL = re.compile(r"(?:oa|ea|ia|a)(?=[^aeiou]*$)")
_SHIFT = {"oa": "o", "ea": "e", "ia": "ie", "a": "e"}


def _bodies(lemma: str) -> set[str]:
    """What Romanian feminine endings are put to: the noun without its ending, with and without the change of its last
    vowel and of a final d."""
    body = lemma.rstrip("aeu") or lemma
    out = {body, _LAST_VOWEL.sub(lambda m: _SHIFT[m[0]], body)}
    return out | {x[:-1] + "z" for x in out if x.endswith("d")}


def forms(word: str) -> set[str]:
    """Forms of a list word that users may type: nominative, definite, genitive, plural; a superset does no harm."""
    out = {word}
    if len(word) > 3:
        if word.endswith(("a", "e")):
            out |= {x + e for x in _bodies(word) for e in ("a", "e", "ea", "ei", "i", "ii", "elor", "ilor", "ile", "uri")}
        if word.endswith("eaua"):
            out |= {word[:-3] + e for e in ("a", "le", "lei", "lele", "lelor")}
        if word.endswith("ea"):
            out |= {word[:-1], word[:-1] + "i"}
        if word.endswith("eala"):
            out |= {word[:-4] + "eli", word[:-4] + "elii"}
        if word.endswith("ul"):
            out |= {word + "ui", word[:-2], word[:-1]}
        if word.endswith("ie"):
            out |= {word[:-1] + "a", word[:-1] + "i", word[:-1] + "ei"}
        if not word.endswith(("a", "e", "l")):
            out |= {word + "ul", word + "ului", word + "s"}
    return {f for f in out if len(f) > 1}


def squeezed(word: str) -> str:
    """The word with runs of one letter as one: a key held too long is no edit."""
    return "".join(c for k, c in enumerate(word) if not k or c != word[k - 1])


def deletes(word: str, depth: int) -> set[str]:
    """The word with up to ``depth`` characters left out."""
    out = level = {word}
    for _ in range(depth):
        level = {w[:k] + w[k + 1 :] for w in level for k in range(len(w))}
        out = out | level
    return out


def allowed(length: int) -> int:
    """Edits allowed in a word of ``length`` characters; as many are looked up."""
    return 0 if length < 3 else 1 if length < 6 else 2


_NEIGHBOURS = {a: set(b) for a, b in zip("qwertyuiopasdfghjklzxcvbnm", "wa qes wrd etf ryg tuh yij uok ipl ol qsz awdx sefx drgc fthv gyjb hukn jilm kop asx zsdc xdfv cfgb vghn bhjm njk".split())}


def distance(a: str, b: str, most: float) -> float:
    """Damerau-Levenshtein distance with weights: a swap of neighbours, a doubled letter or a vowel for a vowel costs
    0.8, a neighbouring key 0.9, any other edit 1. ``inf`` beyond ``most``."""
    if abs(len(a) - len(b)) > most + 1:
        return float("inf")
    before: list[float] = []
    row = [float(j) for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        now = [float(i)] + [0.0] * len(b)
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            change = 0.0 if x == y else 0.8 if x in "aeiou" and y in "aeiou" else 0.9 if y in _NEIGHBOURS.get(x, ()) else 1.0
            drop = 0.8 if i > 1 and x == a[i - 2] else 1.0
            add = 0.8 if j > 1 and y == b[j - 2] else 1.0
            best = min(row[j - 1] + change, row[j] + drop, now[j - 1] + add)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, before[j - 2] + 0.8)
            now[j] = best
        if min(now) > most + 1:
            return float("inf")
        before, row = row, now
    return row[-1]


def _lacking(ts: list[str], word: str) -> tuple[str, str]:
    """The bag of the words of a name, and what is left of it without ``word``."""
    return " ".join(sorted(ts)), " ".join(sorted(t for t in ts if t != word))


def optional_words(names: list[tuple[int, list[str]]]) -> frozenset[str]:
    """Words that only join others: many names have them, always between two words, and no two entries differ by one
    alone. A value may lack them or have others."""
    count = Counter(w for _, ts in names for w in set(ts))
    edges = {w for _, ts in names if ts for w in (ts[0], ts[-1])}
    out = set()
    for w in (w for w, n in count.items() if w not in edges and n >= max(LEAST_ENTRIES, OPTIONAL_SHARE * len(names))):
        groups: dict[str, tuple[set, set]] = defaultdict(lambda: (set(), set()))
        for ref, ts in names:
            before, after = _lacking(ts, w)
            groups[after][0].add(before)
            groups[after][1].add(ref)
        if "" not in groups and all(len(bags) == 1 or len(refs) == 1 for bags, refs in groups.values()):
            out.add(w)
    return frozenset(out)


def _optional_of(names: DataFrame) -> frozenset[str]:
    """``optional_words`` of a list of any length. At most 1 / ``OPTIONAL_SHARE`` words a word of a name come back."""

    def run(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for ref, name in zip(*(c.to_pylist() for c in b.columns)):
                ts = tokens(name)
                if wanted is None:
                    rows += [(w, ref, "edge" if w in (ts[0], ts[-1]) else "", "") for w in set(ts)]
                elif ts:
                    rows += [(w, ref, *_lacking(ts, w)) for w in wanted]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["word", "ref", "before", "after"])

    schema = "word string, ref bigint, before string, after string"
    own = names.select("ref_id", "name")
    n = own.count()
    frequent = own.mapInArrow(lambda it: run(it, None), schema).groupBy("word").agg(F.count("*").alias("n"), F.max("before").alias("edge")).where((F.col("edge") == "") & (F.col("n") >= max(LEAST_ENTRIES, OPTIONAL_SHARE * n)))
    wanted = sorted(r.word for r in frequent.collect())
    if not wanted:
        return frozenset()
    groups = own.mapInArrow(lambda it: run(it, wanted), schema).groupBy("word", "after").agg(F.countDistinct("before").alias("bags"), F.countDistinct("ref").alias("refs"))
    bad = groups.where("after = '' OR bags > 1 AND refs > 1").select("word").distinct()
    return frozenset(wanted) - {r.word for r in bad.collect()}


class Dictionary:
    """A symmetric-delete dictionary of the words of a list of names.

    Every form of every list word is filed, as it is and squeezed, under all strings that leaving out letters gives, as many as edits
    are allowed; a typed word finds the forms within its bound by leaving out letters itself, without comparing it to the
    list. Names are bags of stems, so the order of words doesn't matter; ``optional`` words of names and ``fillers`` of
    values say nothing about which entry is meant."""

    def __init__(self, names: list[tuple[int, str, float]], fillers: frozenset[str] = frozenset(), optional: frozenset[str] | None = None):
        split = [(ref, tokens(name), frequency) for ref, name, frequency in names]
        self.optional = optional_words([(r, ts) for r, ts, _ in split if ts]) if optional is None else optional
        bags: dict[tuple, list] = defaultdict(list)
        squashed: dict[str, list] = defaultdict(list)
        self.form_stems: dict[str, set[str]] = defaultdict(set)
        for ref, ts, frequency in split:
            core = [t for t in ts if t not in self.optional] or ts
            if not core:
                continue
            bags[tuple(sorted(stem(t) for t in core))].append((-frequency, ref))
            for order in {tuple(core), tuple(reversed(core))}:
                squashed["".join(order)].append((-frequency, ref))
            for t in core:
                for f in forms(t):
                    self.form_stems[f].add(stem(t))
        self.stems = {s for v in self.form_stems.values() for s in v}
        self.bags = {k: min(v) for k, v in bags.items()}
        self.squashed = {k: min(v) for k, v in squashed.items()}
        # each bag under its rarest stem: a value that lacks it can't name the entry
        count: Counter = Counter(s for k in self.bags for s in set(k))
        self.by_rarest: dict[str, list[tuple]] = defaultdict(list)
        for k in self.bags:
            self.by_rarest[min(set(k), key=lambda s: (count[s], s))].append(k)
        self.fillers = frozenset(f for f in fillers | self.optional if f not in self.form_stems)
        self.words: dict[str, list[str]] = defaultdict(list)
        for f in [*self.form_stems, *(f for f in self.fillers if len(f) > 4)]:
            for q in {f, squeezed(f)}:
                for k in deletes(q, allowed(len(q))):
                    self.words[k].append(f)
        self.longest = max(map(len, self.squashed), default=0)  # what is longer by more than two letters is no name
        self.whole: dict[str, list[str]] = defaultdict(list)
        for name in self.squashed:
            for k in deletes(name, 2):
                self.whole[k].append(name)
        self.memo: dict[str, dict] = {}

    def exact(self, token: str) -> set[str]:
        return self.form_stems.get(token) or ({s} if len(s := stem(token)) >= 4 and s in self.stems else set())

    def word(self, token: str) -> dict[str | None, float]:
        """The stems of the list words a typed word may mean with their distances, None for saying nothing."""
        if token in self.memo:
            return self.memo[token]
        out: dict[str | None, float]
        if token in self.form_stems:
            out = dict.fromkeys(self.form_stems[token], 0.0)
        elif token in self.fillers:
            out = {None: 0.0}
        else:
            out = dict.fromkeys(self.exact(token), 0.0)
            short = squeezed(token)
            near = {f for q in {token, short} for k in deletes(q, allowed(len(q))) for f in self.words.get(k, ())}
            for f in near:
                g = squeezed(f)
                held = 0.4 * abs(len(token) - len(short) - len(f) + len(g))
                ways = [(token, f, 0.0), (short, g, held)]
                d = min((x + more for q, w, more in ways if (x := distance(q, w, m := allowed(len(q)))) <= min(m, allowed(len(w)) + 0.5)), default=None)
                if d is not None:
                    for s in self.form_stems.get(f) or (None,):
                        out[s] = min(d, out.get(s, 99.0))
        self.memo[token] = out
        return out

    def _assign(self, bag: tuple, options: list[dict]) -> tuple[int, float]:
        """``(words left over, distance)`` of the best way to read the words of a value as the words of a bag, each used
        once, and the others as saying nothing; words that mean no list word are left over. ``inf`` if there is none."""
        states: dict[tuple, tuple[int, float]] = {bag: (0, 0.0)}
        for o in options:
            after: dict[tuple, tuple[int, float]] = {}
            for left, (over, d) in states.items():
                ways = [(left, over, d + o[None])] if None in o else []
                if not o:
                    ways = [(left, over + 1, d)]
                for s in set(left):
                    if s in o:
                        k = left.index(s)
                        ways.append((left[:k] + left[k + 1 :], over, d + o[s]))
                for to, n, x in ways:
                    if x <= MOST_TOTAL and (n, x) < after.get(to, (1 << 30, 0.0)):
                        after[to] = (n, x)
            states = after
            if not states:
                break
        return states.get((), (1 << 30, float("inf")))

    def lookup(self, value: str | None) -> tuple[int, int, float, float]:
        """``(tier, ref, distance, frequency)`` of the entry that ``value`` names, ref 0 if none. Tier 0: all its words
        are words of the name or say nothing; 1: the letters of the whole value are those of a name; 2: it holds all words
        of a name exactly, and the others mean no word of the list. Within a tier the nearest wins, then the more frequent,
        then the smaller id."""
        none = (9, 0, float("inf"), 0.0)
        ts = tokens(value) if value else []
        if not ts:
            return none
        options = [self.word(t) for t in ts]
        stems = {s for o in options for s in o if s is not None}
        best = none
        for bag in {bag for s in stems for bag in self.by_rarest.get(s, ())}:
            if not stems.issuperset(bag):
                continue
            over, d = self._assign(bag, options)
            if d == float("inf") or over and (d > 0 or len("".join(bag)) < 5):
                continue
            minus, ref = self.bags[bag]
            best = min(best, (2 if over else 0, ref, d, -minus), key=_order)
        if best[0] == 0:
            return best
        joined = "".join(t for t in ts if t not in self.fillers)
        if len(joined) >= 6:
            most = 1 if len(joined) < 9 else 2
            near = {f for k in deletes(joined, 2) for f in self.whole.get(k, ())} if len(joined) <= self.longest + 2 else set()
            for f in near:
                if (d := distance(joined, f, most)) <= most:
                    minus, ref = self.squashed[f]
                    best = min(best, (1, ref, d, -minus), key=_order)
        return best


def _order(x: tuple[int, int, float, float]) -> tuple:
    tier, ref, d, frequency = x
    return tier, d, -frequency, ref


#: Dictionaries of this worker process, by the key sent with their names; the tasks of a stage share them.
_BUILT: dict[str, Dictionary] = {}


def _dictionary(key: str, names, fillers, optional) -> Dictionary:
    if key not in _BUILT:
        if len(_BUILT) >= 2:
            _BUILT.clear()
        _BUILT[key] = Dictionary(names, fillers, optional)
    return _BUILT[key]


def map_values(values: DataFrame, names: DataFrame, value_col: str = "value") -> DataFrame:
    """``(value, ref_id, distance)``: the entry of ``names`` that each distinct non-blank value means, or 0 with a null
    distance where it names none.

    ``names`` holds ``ref_id, name, frequency``, several rows for an entry with several names; of entries equally near
    the more frequent wins, then the smaller id; a null frequency is the number of values that are the name itself.
    Values are compared without case, accents, punctuation, word order and inflection, and within a bounded weighted
    Damerau-Levenshtein distance per word. Words around a name are learned from the values: a word that no name has says
    nothing if the values are names of several entries without it; other words may stand beside a name that is spelled
    right. Null and blank values give no rows; an empty list leaves every value unmatched.

    Distinct values are found map-side first, so a value typed a million times is looked up once, and spread over all
    tasks however few bytes they are. The list goes to the tasks in blocks of bounded size; all blocks judge words alike,
    so the best block gives what one block would."""
    spark = values.sparkSession
    clean = names.where(F.col("name").isNotNull() & F.col("ref_id").isNotNull()).select(F.col("ref_id").cast("long"), "name", F.col("frequency").cast("double").alias("frequency"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = values.where(F.col(value_col).rlike(r"[^\s\p{Z}\p{Cf}]")).groupBy(F.col(value_col).alias("value")).agg(F.count("*").alias("n"))
    counted = materialize(counted.repartition(tasks, "value"), "values")
    used = counted.groupBy(F.lower(F.trim("value")).alias("_k")).agg(F.sum("n").alias("_used"))
    clean = clean.withColumn("_k", F.lower(F.trim("name"))).join(used, "_k", "left").select("ref_id", "name", F.coalesce("frequency", "_used", F.lit(0)).cast("double").alias("frequency"))
    clean = materialize(clean.groupBy("ref_id", "name").agg(F.max("frequency").alias("frequency")), "names")
    blocks = max(1, -(-clean.count() // BLOCK_NAMES))
    distinct = counted.select("value")
    optional = _optional_of(clean)
    lists: dict[int, list] = {}

    def fetch(k: int) -> list[tuple[int, str, float]]:
        if k not in lists:
            lists.clear()
            rows = clean.where(F.pmod(F.xxhash64("ref_id"), F.lit(blocks)) == k).orderBy("ref_id", "name").collect()
            lists[k] = [(r.ref_id, r.name, r.frequency) for r in rows]
        return lists[k]

    def around(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
        """``(value, exact, rest, refs, stems, near)``: the words of a value that names have and those that none has, the
        entries that the former name, the stems of the former, and of the latter what stems each may misspell."""
        for b in batches:
            dictionary = _dictionary(*shared.value)
            out: list[tuple] = []
            for v in b.column(0).to_pylist():
                ts = list(dict.fromkeys(t for t in tokens(v) if t not in dictionary.optional))
                exact = {t: o for t in ts if (o := dictionary.exact(t))}
                rest = [t for t in ts if t not in exact]
                stems = {s for o in exact.values() for s in o}
                bags = {bag for s in stems for bag in dictionary.by_rarest.get(s, ())} if rest else ()
                refs = [dictionary.bags[bag][1] for bag in bags if stems.issuperset(bag) and dictionary._assign(bag, [dict.fromkeys(o, 0.0) for o in exact.values()])[1] == 0]
                near = [{"word": t, "near": s} for t in rest for s in dictionary.word(t) if s is not None] if refs else []
                out.append((v, list(exact), rest, refs, sorted(stems), near))
            cols = list(zip(*out)) or [()] * 6
            strings = pa.list_(pa.string())
            types = (pa.string(), strings, strings, pa.list_(pa.int64()), strings, pa.list_(pa.struct([("word", pa.string()), ("near", pa.string())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["value", "exact", "rest", "refs", "stems", "near"])

    def search(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dictionary = _dictionary(*shared.value)
            found = list(zip(*map(dictionary.lookup, b.column(0).to_pylist()))) or [()] * 4
            words = [sorted(set(tokens(v))) for v in b.column(0).to_pylist()]
            means = [[t for t in ts if dictionary.word(t)] for ts in words]
            over = [[t for t in ts if not dictionary.word(t)] if tier == 2 else [] for ts, tier in zip(words, found[0])]
            types = (pa.int32(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(found, types)), pa.array(means, pa.list_(pa.string())), pa.array(over, pa.list_(pa.string()))], names=["value", "tier", "ref_id", "distance", "frequency", "means", "over"])

    def over_blocks(run, schema: str, fillers: frozenset[str]) -> DataFrame:
        out = None
        for k in range(blocks):
            shared = spark.sparkContext.broadcast((uuid.uuid4().hex, fetch(k), fillers, optional))
            part = distinct.mapInArrow(lambda it, shared=shared: run(it, shared), schema)
            out = part if out is None else out.unionByName(part)
        return out

    def agreed(rows: DataFrame, mine: str, others: str) -> DataFrame:
        """The rows whose words ``mine``, unknown to their block, no other block knows."""
        if blocks == 1:
            return rows
        known = rows.groupBy("value").agg(F.array_distinct(F.flatten(F.collect_list(others))).alias("_known"))
        return rows.join(known, "value").where((F.size(mine) == 0) | ~F.arrays_overlap(mine, "_known")).drop("_known")

    schema = "value string, exact array<string>, rest array<string>, refs array<bigint>, stems array<string>, near array<struct<word:string,near:string>>"
    seen = materialize(over_blocks(around, schema, frozenset()), "words-around")
    named = agreed(seen, "rest", "exact").where(F.size("refs") > 0)
    beside = named.select("value", F.explode("rest").alias("word"), "refs").select("value", "word", F.explode("refs").alias("ref")).groupBy("word").agg(F.countDistinct("ref").alias("entries"), F.countDistinct("value").alias("n"))
    used = seen.select("value", F.explode("stems").alias("near")).distinct().groupBy("near").agg(F.count("*").alias("used"))
    near = seen.select(F.explode("near").alias("x")).select("x.*").distinct().join(used, "near").groupBy("word").agg(F.max("used").alias("used"))
    # a word near one of a name is a misspelling of it unless it is about as frequent
    says_nothing = beside.join(near, "word", "left").where((F.col("entries") >= LEAST_ENTRIES) & (F.col("n") >= MISSPELT_SHARE * F.coalesce("used", F.lit(0))))
    fillers = frozenset(r.word for r in says_nothing.select("word").collect())  # words beside many names: few
    out = over_blocks(search, "value string, tier int, ref_id bigint, distance double, frequency double, means array<string>, over array<string>", fillers)
    if blocks > 1:
        out = materialize(out, "found")
        whole = out.withColumn("over", F.when(F.col("tier") == 2, F.col("over")).otherwise(F.array().cast("array<string>")))
        best = F.min_by(F.struct("ref_id", "distance"), F.struct("tier", "distance", -F.col("frequency"), "ref_id"))
        out = agreed(whole, "over", "means").groupBy("value").agg(best.alias("r")).select("value", "r.*")
        out = distinct.join(out, "value", "left").select("value", F.coalesce("ref_id", F.lit(0)).cast("long").alias("ref_id"), "distance")
    return out.select("value", "ref_id", F.when(F.col("ref_id") != 0, F.col("distance")).alias("distance"))


def herb_names(herbs: DataFrame, aliases: DataFrame) -> DataFrame:
    """All names of the products: Romanian, English, Latin and the aliases, weighted by ranking."""
    own = herbs.select(F.col("id").alias("ref_id"), F.explode(F.array("ro", "en", "latin")).alias("name"), F.col("ranking").alias("frequency"))
    more = aliases.join(herbs.select(F.col("id"), F.col("ranking").alias("frequency")), F.col("herb_id") == F.col("id")).select(F.col("herb_id").alias("ref_id"), "name", "frequency")
    return own.unionByName(more)


def condition_names(conditions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """All names of the conditions; how often each is used is counted in the values (``map_values``)."""
    unknown = F.lit(None).cast("double").alias("frequency")
    own = conditions.select(F.col("id").alias("ref_id"), F.explode(F.array("name", "en")).alias("name"), unknown)
    return own.unionByName(synonyms.select(F.col("condition_id").alias("ref_id"), F.col("synonym").alias("name"), unknown))


def map_messages(messages: DataFrame, lists: dict[str, DataFrame], id_col: str = "message_id") -> DataFrame:
    """``(id_col, field, value, ref_id, distance)`` of each non-blank value of the fields named in ``lists``."""
    out = None
    for field, names in lists.items():
        own = messages.select(F.col(id_col), F.col(field).alias("value")).where(F.col("value").rlike(r"[^\s\p{Z}\p{Cf}]")).distinct()
        part = own.join(map_values(own, names), "value").select(id_col, F.lit(field).alias("field"), "value", "ref_id", "distance")
        out = part if out is None else out.unionByName(part)
    return out
