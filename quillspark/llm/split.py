"""Splitting texts over a size limit at natural boundaries, with overlaps."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from the strongest to the weakest; a cut falls after the match.
BOUNDARIES = (
    re.compile(r"\n[ \t]*\n\s*"),  # between paragraphs
    re.compile(r"\n"),  # between lines
    re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+"),  # between sentences
    re.compile(r"(?<=[,;:])\s+"),  # between clauses
    re.compile(r"\s+"),  # between words
)


def _cuts(text: str) -> list[list[int]]:
    """For each strength the positions after its boundaries, ascending."""
    return [[m.end() for m in p.finditer(text) if 0 < m.end() < len(text)] for p in BOUNDARIES]


def _nearest(cuts: list[int], mid: int, lo: int, hi: int) -> int | None:
    """The cut in [lo, hi] nearest to ``mid``; of two equally near ones the earlier."""
    k = bisect.bisect_left(cuts, mid)
    near = [c for c in cuts[max(0, k - 1) : k + 1] if lo <= c <= hi]
    return min(near, key=lambda c: (abs(c - mid), c)) if near else None


def bisect_text(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int, int]]:
    """``(begin, end, core)`` of the pieces of ``text``: piece = text[begin:end], at most ``limit`` characters, of
    which text[begin:core] repeats at most ``overlap`` characters of the piece before.

    Recursive bisection: a span still longer than ``limit - overlap`` is cut at the strongest boundary within the
    middle half of the span, the nearest to the midpoint; where that part holds no white space, at the midpoint
    itself, but never inside a base character and its combining marks if that can be avoided. The first core may use
    the whole limit only as part of the recursion, so all cores are at most ``limit - overlap``. The overlap begins
    at the strongest boundary inside its window, or at the word nearest to its full length.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    if len(text) <= limit:
        return [(0, len(text), 0)]
    room = limit - overlap
    levels = _cuts(text)
    spans: list[tuple[int, int]] = []
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= room:
            spans.append((a, b))
            continue
        mid, quarter = (a + b) // 2, max(1, (b - a) // 4)
        cut = next((c for cuts in levels if (c := _nearest(cuts, mid, a + quarter, b - quarter)) is not None), None)
        if cut is None:
            import unicodedata

            cut = mid
            while cut > a + quarter and (unicodedata.combining(text[cut]) or text[cut] in "\u200d\ufe0f"):
                cut -= 1
        todo += [(cut, b), (a, cut)]
    pieces = []
    for k, (a, b) in enumerate(spans):
        begin = a
        if k and overlap:
            lo = max(a - overlap, spans[k - 1][0])
            begin = next((cuts[i] for cuts in levels[:3] if (i := bisect.bisect_left(cuts, lo)) < len(cuts) and cuts[i] < a and cuts[i] <= a - overlap // 4), None)
            if begin is None:
                i = bisect.bisect_left(levels[4], lo)
                begin = levels[4][i] if i < len(levels[4]) and levels[4][i] < a else lo
        pieces.append((begin, b, a))
    return pieces


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", line_col: str | None = "line_start", limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Pieces of the rows whose text has more than ``limit`` code points:
    ``(id_col, piece, text, char_count, overlap_chars, line_start, line_end)``.

    The stored counts are not consulted. Every character is in some piece and cutting off each piece's
    ``overlap_chars`` and joining gives the text back. Lines are 1-based; where the row's first line is null, or
    ``line_col`` is None, they are null. A piece that ends with line breaks ends on the line of its last other
    character. Null texts and texts within the limit give no rows; repeated rows are split each. One pass, no
    shuffle; the length filter runs before any text reaches Python.
    """
    line = F.col(line_col).cast("long") if line_col else F.lit(None).cast("long")
    big = df.where(F.length(text_col) > limit).select(F.col(id_col), F.col(text_col), line.alias("line"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, text, first in zip(*(c.to_pylist() for c in b.columns)):
                breaks = [m.start() for m in re.finditer("\n", text)]
                for k, (begin, end, core) in enumerate(bisect_text(text, limit, overlap), 1):
                    piece = text[begin:end]
                    last = begin + max(len(piece.rstrip("\r\n")) - 1, 0)
                    at = (lambda pos: None if first is None else first + bisect.bisect_left(breaks, pos))
                    out.append((key, k, piece, len(piece), core - begin, at(begin), at(last)))
            cols = list(zip(*out)) if out else [()] * 7
            types = [b.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "piece", "text", "char_count", "overlap_chars", "line_start", "line_end"])

    schema = f"key {kind}, piece int, text string, char_count int, overlap_chars int, line_start bigint, line_end bigint"
    return big.mapInArrow(run, schema).withColumnRenamed("key", id_col)
