"""Encoding of a whole corpus with a public byte-level BPE tokenizer, and decoding back to bytes."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts longer than this many characters are cut at safe boundaries before they are encoded.
SEGMENT_CHARS = 1 << 16


def vocabulary_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a rank file of the installed ``public_tokenizers`` package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_encoding(rank_file: str, pattern: str | None = None):
    import tiktoken

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


# A blank between two characters that are not blank always begins a new piece of the pre-splitting pattern, so the
# encodings on both sides can be joined without changing an id.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str, limit: int = SEGMENT_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters that begin at safe boundaries; a run without such a boundary
    stays whole, however long."""
    start = 0
    while len(text) - start > limit:
        m = _SAFE.search(text, start + limit)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode_text(encoding, text: str | None) -> list[int]:
    """Ids of a text without special tokens; null and empty texts give the empty list. Strings that spell a special
    token are ordinary text."""
    if not text:
        return []
    if len(text) <= SEGMENT_CHARS:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for part in segments(text):
        ids.extend(encoding.encode_ordinary(part))
    return ids


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(id_col, ids array<int>)`` for every row, null and empty texts included (both give ``[]``).

    One pass without a shuffle; only the two columns are read. Repeated rows are kept as they are, an empty table
    gives an empty result, other columns are ignored. The rank file must exist at the same path on every executor.
    """
    file = rank_file or vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(file, pattern)
        for b in batches:
            ids = [encode_text(encoding, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", rank_file: str | None = None) -> DataFrame:
    """``(id_col, content binary)``: the raw bytes of each id list. Bytes, not text, since a list cut anywhere may end
    inside a character. A null list gives null, an empty one no bytes; an unknown id is an error."""
    file = rank_file or vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(file)
        for b in batches:
            out = [None if ids is None else encoding.decode_bytes(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "content"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, content binary")
