"""Units of text that are judged as a whole: paragraphs, list items and table rows, with what stands above them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_HEADING = re.compile(r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_ROW = re.compile(r"^\s*\|.*\|\s*$")
_RULE = re.compile(r"^\s*\|(?:\s*:?-+:?\s*\|)+\s*$")


@dataclass(frozen=True)
class Unit:
    """``text`` is text[begin:end] of the document. ``intro`` is the paragraph that ends with a colon above a list,
    ``header`` the cells of the table's header, ``headings`` the open headings from the outermost on."""

    begin: int
    end: int
    kind: str
    text: str
    headings: tuple[str, ...] = ()
    intro: str = ""
    header: tuple[str, ...] = ()


def cells(row: str) -> list[str]:
    return [c.strip() for c in row.strip().strip("|").split("|")]


def units(text: str) -> list[Unit]:
    """The units of a text in order. Lines of a paragraph are one unit; so are the indented lines that go on after a list
    item. A table's first row is its header if a rule line follows, and no unit."""
    out: list[Unit] = []
    open_: list[tuple[int, str]] = []
    intro, header, held = "", (), None  # held: (begin, end, kind) of the unit that may go on
    lines, at = text.split("\n"), 0

    def close() -> None:
        nonlocal held, intro
        if held:
            begin, end, kind = held
            body = text[begin:end]
            if kind == "paragraph":
                intro = body if body.rstrip().endswith(":") else ""
            out.append(Unit(begin, end, kind, body, tuple(t for _, t in open_), intro if kind == "list" else "", header if kind == "row" else ()))
            held = None

    for k, line in enumerate(lines):
        end = at + len(line)
        if m := _HEADING.match(line):
            close()
            intro, header = "", ()
            while open_ and open_[-1][0] >= len(m[1]):
                open_.pop()
            open_.append((len(m[1]), m[2]))
        elif not line.strip():
            close()
        elif _RULE.match(line):
            pass
        elif _ROW.match(line):
            close()
            if k + 1 < len(lines) and _RULE.match(lines[k + 1]):
                header = tuple(cells(line))
            else:
                held = (at, end, "row")
                close()
        elif _ITEM.match(line):
            close()
            held = (at, end, "list")
        elif held and (held[2] == "paragraph" or line[:1].isspace()):
            held = (held[0], end, held[2])
        else:
            close()
            header = ()
            held = (at, end, "paragraph")
        at = end + 1
    close()
    return out


def text_units(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, unit, kind, begin, finish, headings, intro)`` of each text; null and blank texts give none. One pass."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, u.kind, u.begin, u.end, list(u.headings), u.intro) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for n, u in enumerate(units(t), 1)]
            cols = list(zip(*rows)) if rows else [()] * 7
            types = (b.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "unit", "kind", "begin", "finish", "headings", "intro"])

    return texts.select(id_col, text_col).mapInArrow(run, f"id {kind}, unit int, kind string, begin int, finish int, headings array<string>, intro string")
