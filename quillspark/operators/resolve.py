"""Questions resolved to conditions, and close matches of names."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.operators.fragment import Phrases

#: Ratios from which a spelling is a typo of a name, or close to one; conditions of one expression at most.
TYPO, CLOSE, MOST = 0.9, 0.84, 2


@dataclass(frozen=True)
class Resolved:
    text: str
    conditions: tuple[str, ...]
    whole: bool
    rest: str


#: Names that go to every task at most.
MOST_NAMES = 200_000


class CloseNames:
    """Names similar to a text by ratio of matching blocks. Letters that two strings share, however placed, and their lengths
    bound the ratio; only names that these admit are compared."""

    def __init__(self, names: Sequence[str]):
        self.names = sorted(set(names))
        self.letters = {c: k for k, c in enumerate(sorted({c for x in self.names for c in x}))}
        self.counts = np.zeros((len(self.names), len(self.letters) + 1), np.int16)
        for k, x in enumerate(self.names):
            self.counts[k] = self._count(x)
        self.sizes = np.array([len(x) for x in self.names])

    def _count(self, text: str) -> np.ndarray:
        out = np.zeros(len(self.letters) + 1, np.int16)
        for c, n in Counter(text).items():
            if c in self.letters:
                out[self.letters[c]] = n
        return out

    def close(self, text: str, n: int, ratio: float) -> list[tuple[str, float]]:
        """Up to ``n`` names with their ratios, the most similar first, of equal ones the later in the alphabet."""
        if not self.names or not text:
            return []
        common = np.minimum(self.counts, self._count(text)).sum(1)
        near = np.flatnonzero(2 * common >= (ratio - 1e-9) * (self.sizes + len(text)))
        match = difflib.SequenceMatcher(None, "", text)  # keeps what it knows of the second
        found = []
        for k in near.tolist():
            match.set_seq1(self.names[k])
            if (r := match.ratio()) >= ratio:
                found.append((r, self.names[k]))
        return [(x, r) for r, x in sorted(found, reverse=True)[:n]]


def bounded_names(names: Sequence) -> list:
    if len(names) > MOST_NAMES:
        raise ValueError(f"{len(names)} names are too many to be sent to every task")
    return list(names)


class Resolver:
    """Resolves the expressions of a question: the whole is a name, or nearly one; names stand in it, the longest
    first; or it is close to a name."""

    def __init__(self, terms: Sequence[tuple[str, str]]):
        self.plain = Phrases.of(terms, inflected=False)
        self.names: dict[str, list[str]] = {}
        for key, names in self.plain.names.items():
            self.names.setdefault(" ".join(key), list(names))
        self.near = CloseNames(list(self.names))

    def close(self, key: str, ratio: float, n: int = 1) -> list[str]:
        return [x for x, _ in self.near.close(key, n, ratio)]

    def expression(self, text: str) -> Resolved:
        words = self.plain.words(text)
        key = " ".join(words)
        if not key:
            return Resolved(text, (), False, "")
        if key in self.names:
            return Resolved(text, tuple(self.names[key][:MOST]), True, "")
        if typo := self.close(key, TYPO):
            return Resolved(text, tuple(self.names[typo[0]][:MOST]), True, "")
        inside = self._contained(words)
        if inside:
            found = list(dict.fromkeys(n for _, _, k in inside for n in self.names[k]))[:MOST]
            taken = {i for a, b, _ in inside for i in range(a, b)}
            return Resolved(text, tuple(found), False, " ".join(w for i, w in enumerate(words) if i not in taken))
        if near := self.close(key, CLOSE):
            return Resolved(text, tuple(self.names[near[0]][:MOST]), False, "")
        return Resolved(text, (), False, key)

    def _contained(self, words: tuple[str, ...]) -> list[tuple[int, int, str]]:
        """Places of names, longer ones before shorter where they overlap, in text order."""
        spans = [(a, b) for a in range(len(words)) for b in range(a + 1, len(words) + 1) if " ".join(words[a:b]) in self.names]
        spans.sort(key=lambda s: (-len(" ".join(words[s[0] : s[1]])), s[0]))
        chosen: list[tuple[int, int]] = []
        for a, b in spans:
            if all(b <= x or a >= y for x, y in chosen):
                chosen.append((a, b))
        return [(a, b, " ".join(words[a:b])) for a, b in sorted(chosen)]

    def question(self, text: str) -> list[Resolved]:
        return [self.expression(part.strip()) for part in text.split(",") if part.strip()]


def resolve_questions(df: DataFrame, terms: Sequence[tuple[str, str]], id_col: str, text_col: str) -> DataFrame:
    """``(id, expression, conditions, whole, rest)`` of each expression of each question. Null questions give none."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(bounded_names(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolver = Resolver(shared.value)
        memo: dict[str, list[Resolved]] = {}
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    if t not in memo:
                        if len(memo) > 50_000:
                            memo.clear()
                        memo[t] = resolver.question(t)
                    rows += [(i, r.text, list(r.conditions), r.whole, r.rest) for r in memo[t]]
            cols = list(zip(*rows)) if rows else [()] * 5
            types = (b.schema.field(0).type, pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "expression", "conditions", "whole", "rest"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, expression string, conditions array<string>, whole boolean, rest string")


def close_names(df: DataFrame, names: Sequence[str], id_col: str, text_col: str, n: int = 3, ratio: float = CLOSE) -> DataFrame:
    """``(id, position, name, ratio)``: the ``n`` most similar of a bounded list of names, by matching blocks."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(bounded_names([str(x) for x in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {x.casefold(): x for x in shared.value}
        index = CloseNames(list(own))
        memo: dict[str, list] = {}
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                key = t.casefold().strip()
                if key not in memo:
                    if len(memo) > 50_000:
                        memo.clear()
                    memo[key] = [(p, own[f], r) for p, (f, r) in enumerate(index.close(key, n, ratio), 1)]
                rows += [(i, *m) for m in memo[key]]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.int32(), pa.string(), pa.float64()))], names=["id", "position", "name", "ratio"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, position int, name string, ratio double")
