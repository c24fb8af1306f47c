"""Passages of held-out items inside corpus documents."""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13  # words of the smallest passage of a longer item that counts
SHINGLE = 5
SIMILARITY = 0.8
#: Hamming distance within which every fingerprint is found. Texts of similarity s have bits that differ with a chance of
#: arccos(2 s / (1 + s)) / pi: 9.7 of 64 at 0.8, so that 15 or fewer differ in 98 % of such pairs.
RADIUS = 15
#: Blocks of the 64 bits. Of fingerprints within ``RADIUS`` one block at least differs in ``RADIUS // BLOCKS`` bits or fewer.
BLOCKS = 8
#: Items of one pass over the documents, and characters of them; they go to every task.
BLOCK_ITEMS, BLOCK_CHARS = 8192, 8_000_000

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"[\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")


def words(text: str) -> list[str]:
    """Runs of letters and digits without case and accents."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        return _WORD.findall(_MARKS.sub("", text.casefold()))
    return _WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(ids: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit value for each run of ``size`` word ids."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    base = _mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + base[k : k + n]
    return _mix(h)


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0, dtype=np.int64)))


class Bits:
    """SimHash of windows of a text, from the values and weights of its shingles; ``used`` marks the shingles that the
    windows asked for consist of, so that nothing is summed up for the others."""

    def __init__(self, sh: np.ndarray, weight: np.ndarray, used: np.ndarray | None = None):
        self.place = None
        if used is not None:
            self.place, sh, weight = _running(used), sh[used], weight[used]
        bits = np.unpackbits(sh.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
        bits *= 2
        bits -= 1
        bits *= weight[:, None].astype(np.int32)
        self.total = np.zeros((len(sh) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=self.total[1:])

    def windows(self, at: np.ndarray, words: int) -> np.ndarray:
        """Fingerprints of the windows of ``words`` words that begin at ``at``."""
        begin = at if self.place is None else self.place[at]
        return np.packbits(self.total[begin + words - SHINGLE + 1] > self.total[begin], axis=1).view(np.uint64).ravel()


class HammingIndex:
    """Fingerprints in one sorted list per block of bits. Looking up each block with up to ``RADIUS // BLOCKS`` of its bits
    turned finds all fingerprints within ``RADIUS``."""

    width = 64 // BLOCKS

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.tables = []
        for k in range(BLOCKS):
            part = self._block(marks, k)
            order = np.argsort(part, kind="stable")
            self.tables.append((part[order], order))
        turns = range(RADIUS // BLOCKS + 1)
        self.turned = np.array([sum(1 << b for b in bits) for n in turns for bits in combinations(range(self.width), n)], np.uint64)

    def _block(self, marks: np.ndarray, k: int) -> np.ndarray:
        return (marks >> np.uint64(self.width * k)) & np.uint64((1 << self.width) - 1)

    def near(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position in ``marks``, position in the index) within ``RADIUS``."""
        found = []
        for lo in range(0, len(marks), 512):
            some = marks[lo : lo + 512]
            for k, (part, order) in enumerate(self.tables):
                key = (self._block(some, k)[:, None] ^ self.turned[None]).ravel()
                first, last = np.searchsorted(part, key, "left"), np.searchsorted(part, key, "right")
                n = last - first
                a = np.repeat(np.repeat(np.arange(len(some)), len(self.turned)), n)
                b = order[np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
                close = np.bitwise_count(some[a] ^ self.marks[b]) <= RADIUS
                found.append((a[close] + lo) * len(self.marks) + b[close])
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pairs // max(len(self.marks), 1), pairs % max(len(self.marks), 1)


class ItemIndex:
    """The windows of a block of items: of each item one of its own size, and of longer ones all of ``WINDOW`` words, by
    size. Items of fewer words than a shingle are kept as they are, to be found exactly."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [(i, ws) for i, t in items if t and (ws := words(t))]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in texts for w in ws}), 1)}
        self.ids = [i for i, _ in texts]
        self.coded = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in texts]
        counts = Counter(int(s) for ids in self.coded for s in set(shingles(ids).tolist()))
        self.shingle_keys = np.array(sorted(counts), np.uint64)
        # rarer shingles weigh more, in whole numbers so that sums are exact
        self.shingle_weight = np.array([1 + round(2 * math.log1p(len(texts) / counts[int(k)])) for k in self.shingle_keys], np.int64)
        rows = []
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for n, ids in enumerate(self.coded):
            if len(ids) < SHINGLE:
                self.short[len(ids)][int(shingles(ids, len(ids))[0])].append(n)
                continue
            sh = shingles(ids)
            bits = Bits(sh, self.weights(sh)[0])
            for size in {len(ids), min(WINDOW, len(ids))}:
                at = np.arange(len(ids) - size + 1)
                rows.append((np.full(len(at), size), np.full(len(at), n), at, bits.windows(at, size)))
        none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
        self.size, self.owner, self.begin, self.marks = (np.concatenate(c) for c in zip(*rows)) if rows else none
        self.sizes = np.unique(self.size).tolist()
        self.near = HammingIndex(self.marks).near
        # of each size the shingles of the items that have windows of it
        self.keys = {size: np.unique(np.concatenate([shingles(self.coded[n]) for n in np.unique(self.owner[self.size == size])])) for size in self.sizes}

    def weights(self, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights of shingles, 1 for those that no item has, and whether an item has them."""
        if not len(self.shingle_keys):
            return np.ones(len(sh), np.int64), np.zeros(len(sh), bool)
        at = np.minimum(np.searchsorted(self.shingle_keys, sh), len(self.shingle_keys) - 1)
        known = self.shingle_keys[at] == sh
        return np.where(known, self.shingle_weight[at], 1), known

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """Weighted Jaccard similarity of the shingles of two windows of word ids."""
        x, y = np.unique(shingles(a)), np.unique(shingles(b))
        both = np.concatenate((np.intersect1d(x, y, assume_unique=True), np.empty(0, np.uint64)))
        w = lambda s: int(self.weights(s)[0].sum())
        return w(both) / (w(x) + w(y) - w(both)) if len(x) and len(y) else 0.0

    def code(self, text: str) -> list[int]:
        """Word ids of a text; words that no item has get ids of their own beyond the vocabulary."""
        get, beyond = self.vocabulary.get, len(self.vocabulary) + 1
        return [get(w) or beyond + crc32(w.encode()) for w in words(text)]


#: Words matched at once; bounds the memory of a task whatever the batch.
CHUNK_WORDS = 250_000


def passages(index: ItemIndex, texts: list[str | None]) -> list[tuple[int, int, float, int, int]]:
    """``(position of the text, item, similarity, run, windows)`` of the items of which a text holds a passage: the
    best similarity of a window pair, the longest run of equal words, and how many windows of the text are equal to one
    of the item, or near where none is equal."""
    found: dict[tuple[int, int], list] = {}
    longest = max([*index.sizes, *index.short], default=0)
    parts: list[tuple[int, list[int]]] = []
    held = 0
    for n, text in enumerate(texts):
        ids = index.code(text) if text else []
        if not ids:
            continue
        for at in range(0, max(1, len(ids) - longest + 1), CHUNK_WORDS):  # parts overlap by the longest window
            part = ids[at : at + CHUNK_WORDS + longest - 1]
            parts.append((n, part))
            held += len(part)
            if held >= CHUNK_WORDS:
                _match(index, parts, found)
                parts, held = [], 0
    if parts:
        _match(index, parts, found)
    return [(n, index.ids[i], s, run, len(at)) for (n, i), (s, run, at) in found.items()]


def _match(index: ItemIndex, parts: list[tuple[int, list[int]]], found: dict) -> None:
    ids = np.array([i for _, p in parts for i in p], np.int64)
    owner = np.repeat(np.arange(len(parts)), [len(p) for _, p in parts])
    for size, keys in index.short.items():
        values = shingles(ids, size)
        at = np.flatnonzero(np.isin(values, np.array(sorted(keys), np.uint64)))
        for k in at[owner[at] == owner[at + size - 1]].tolist():
            for i in keys[int(values[k])]:
                best = found.setdefault((parts[owner[k]][0], i), [1.0, size, set()])
                best[2].add((owner[k], k))
    sh = shingles(ids)
    if not len(sh):
        return
    weight, known = index.weights(sh)
    if not known.any():
        return
    total, known = _running(weight), np.flatnonzero(known)
    begins: list[np.ndarray] = []
    used = np.zeros(len(sh) + 1, np.int64)
    for size in index.sizes:
        span = size - SHINGLE + 1
        # the shingles that two windows share weigh at most what those of items in one do: less can't reach SIMILARITY
        theirs = known[np.isin(sh[known], index.keys[size])]
        of_items = np.zeros(len(sh), np.int64)
        of_items[theirs] = weight[theirs]
        held = _running(of_items)
        at = np.flatnonzero(held[span:] - held[:-span] >= SIMILARITY * (total[span:] - total[:-span])) if len(sh) >= span else np.empty(0, np.int64)
        at = at[owner[at] == owner[at + size - 1]]  # windows over the end of a part are none of the text
        begins.append(at)
        np.add.at(used, at, 1)
        np.add.at(used, at + span, -1)
    if not any(map(len, begins)):
        return
    bits = Bits(sh, weight, np.cumsum(used)[:-1] > 0)
    at = np.concatenate(begins)
    sizes = np.repeat(index.sizes, [len(x) for x in begins])
    marks, back = np.unique(np.concatenate([bits.windows(x, size) for x, size in zip(begins, index.sizes)]), return_inverse=True)
    a, wins = index.near(marks)
    members = np.argsort(back, kind="stable")
    first = np.searchsorted(back[members], np.arange(len(marks) + 1))
    n = first[a + 1] - first[a]
    which = members[np.repeat(first[a] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
    wins = np.repeat(wins, n)
    fit = sizes[which] == index.size[wins]
    places, wins = at[which[fit]], wins[fit]
    starts = np.concatenate(([0], np.cumsum([len(c) for c in index.coded])))[:-1]
    items = np.concatenate(index.coded)
    item_sh = np.concatenate([shingles(items), np.zeros(SHINGLE, np.uint64)])
    inside = starts[index.owner[wins]] + index.begin[wins]
    # equal windows have equal shingles: compared as running sums of their values, then word by word
    same = np.zeros(len(places), bool)
    for size in index.sizes:
        pick = np.flatnonzero(index.size[wins] == size)
        pick = pick[(sh[places[pick]] == item_sh[inside[pick]]) & (sh[places[pick] + size - SHINGLE] == item_sh[inside[pick] + size - SHINGLE])]
        for lo in range(0, len(pick), 8192):
            p = pick[lo : lo + 8192]
            k = np.arange(size)
            same[p] = (ids[places[p][:, None] + k] == items[inside[p][:, None] + k]).all(1)
    runs: dict[tuple[int, int, int], int] = {}
    for equal in (True, False):
        pick = same == equal
        for k, q in zip(places[pick].tolist(), wins[pick].tolist()):
            i, x, size = int(index.owner[q]), int(index.begin[q]), int(index.size[q])
            part = int(owner[k])
            key = (parts[part][0], i)
            best = found.get(key)
            if not equal and best and best[0] == 1.0:
                continue  # nothing nearer to be found
            theirs = index.coded[i]
            s = 1.0 if equal else index.similarity(ids[k : k + size], theirs[x : x + size])
            if s < SIMILARITY:
                continue
            if not best or s == 1.0 > best[0]:
                best = found[key] = [s, best[1] if best else 0, set()]
            best[0] = max(best[0], s)
            best[2].add((part, k))
            if not equal:
                run = _longest(ids[k : k + size], theirs[x : x + size])
            elif (run := runs.get((part, i, k - x))) is None:  # windows of one run lie on one diagonal
                run = runs[part, i, k - x] = _longest_on(ids, owner, k, theirs, x)
            best[1] = max(best[1], run)


def _longest_on(ids: np.ndarray, owner: np.ndarray, a: int, item: np.ndarray, b: int) -> int:
    """The longest run of equal words where an item lies so along a text that word ``b`` of it meets word ``a``."""
    left = min(a, b)
    n = min(len(ids) - a, len(item) - b) + left
    mine = slice(a - left, a - left + n)
    return _longest(np.where(owner[mine] == owner[a], ids[mine], -1), item[b - left : b - left + n])


def _longest(x: np.ndarray, y: np.ndarray) -> int:
    best = now = 0
    for same in (x == y).tolist():
        now = now + 1 if same else 0
        best = max(best, now)
    return best


#: Indexes of this worker process, by the key sent with their items; the tasks of a stage share them.
_BUILT: dict[str, ItemIndex] = {}


def _index(key: str, items: list[tuple[int, str]]) -> ItemIndex:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ItemIndex(items)
    return _BUILT[key]


def leaked_passages(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id_col, item_col, similarity, longest_run, windows)``: every document that holds a passage of an item.

    Each item gives a window of its own size and, if it has more than 13 words, all windows of 13 words, the smallest
    passage that counts, since a part of an item is not like the whole. Documents are cut into windows of the same sizes;
    each has a SimHash of its weighted five-word shingles. Windows whose fingerprints differ in at most ``RADIUS`` bits are
    candidates, found without a miss through ``BLOCKS`` blocks of bits; the exact weighted similarity of their shingles,
    ``SIMILARITY`` at least, decides. ``longest_run`` is the longest run of equal consecutive words; 13 or more mean a
    verbatim passage. Items of one to four words are found exactly.

    The items are the bounded side: they go to the tasks, which index them, in blocks of at most ``BLOCK_ITEMS`` items and
    about ``BLOCK_CHARS`` characters; documents are read once for each block and never shuffled. Null and empty texts hold
    no passage, null and empty items and those without a word are in none; repeated rows and equal items are reported each
    once per (document, item). Empty tables give no rows.
    """
    spark = documents.sparkSession
    own = items.where(F.col(item_text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).distinct()
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("c")).first()
    blocks = max(1, math.ceil(size.n / (BLOCK_ITEMS // 2)), math.ceil(size.c / (BLOCK_CHARS // 2))) if size.n > BLOCK_ITEMS or size.c > BLOCK_CHARS else 1
    kind, item_kind = (f.schema[c].dataType.simpleString() for f, c in ((documents, id_col), (items, item_col)))
    docs = documents.where(F.length(text_col) > 0).select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    out = None
    for k in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, sorted((r.i, r.t) for r in rows)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(*shared.value)
            for b in batches:
                keys = b.column(0).to_pylist()
                found = [(keys[n], *p) for n, *p in passages(index, b.column(1).to_pylist())]
                cols = list(zip(*found)) if found else [()] * 5
                types = [b.schema.field(0).type, None, pa.float64(), pa.int32(), pa.int32()]
                item_type = pa.int64() if item_kind in ("bigint", "long") else pa.int32() if item_kind == "int" else pa.string()
                types[1] = item_type
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["d", "i", "similarity", "longest_run", "windows"])

        part = docs.mapInArrow(run, f"d {kind}, i {item_kind}, similarity double, longest_run int, windows int")
        out = part if out is None else out.unionByName(part)
    return (
        out.groupBy("d", "i").agg(F.max("similarity").alias("similarity"), F.max("longest_run").alias("longest_run"), F.max("windows").alias("windows"))
        .withColumnsRenamed({"d": id_col, "i": item_col})
    )
