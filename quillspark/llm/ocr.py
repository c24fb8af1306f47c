"""Repair of text from scanned pages: running headers, page numbers, broken words and misread characters."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.lookalike import fold
from quillspark.shared import materialize

#: A line that many distinct texts have is the running header of a book if at least this share of its occurrences stand at
#: a page edge: beside a page number or in the middle of a sentence. A share, so it holds at every size of the corpus.
LEAST_REPEATS, EDGE_SHARE = 3, 0.3
#: A misread word is this many times rarer than the word it is read back as, which occurs so often at least.
RARER, LEAST_KNOWN = 8, 4
#: Marks (repairs of words, compounds, keys of headers) that go to every task; with more of them each row gets its own
#: by a join, with the same result.
MOST_SHARED = 400_000

# What scanning reads (first) and what stood there (second).
CONFUSIONS = (
    ("c", "e"), ("l", "i"), ("f", "t"), ("f", "ț"), ("1", "l"), ("1", "i"), ("ii", "u"), ("5", "s"), ("5", "ș"), ("§", "ș"), ("0", "o"), ("à", "ă"), ("rn", "m"), ("cl", "d"), ("9", "g"), ("b", "h"),
    ("6", "b"), ("8", "b"), ("vv", "w"), ("á", "ă"), ("ã", "ă"),
)
# a section sign among letters is a misread letter
_WORD = re.compile(r"(?:[^\W_]|§)+")
_COMPOUND = re.compile("(?<![\\w-])[^\\W\\d_]+[-\u2010][^\\W\\d_]+(?![\\w-])")
_HYPHENS = "-\u00ad\u2010\u00ac"
# looked for from the hyphen, not from the word before it, so that long runs of letters cost no more than short ones
_BREAK = re.compile("(?<=[^\\W\\d_])([-\u00ad\u2010\u00ac])[ \t]*\n\\s*(?=([^\\W\\d_]))")
_MARKUP = re.compile(r"^\s*(?:[-*+•>|#]|\d+[.)]\s|```|~~~)")
_END = re.compile(r"[.!?…:;][\"'”’)\]*_]*$")
_ROMAN = re.compile(r"^(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
_NUMBER = r"(?:\d{1,4}(?:\s*/\s*\d{1,4})?|\d(?:\s\d){1,3})"
_PAGE = re.compile(rf"^[\[(~–—\-|·•*\s]*(?:(?:p|pp|pag|pg)\.\s*|(?:pagina|page)\s+)?{_NUMBER}(?:\s+(?:din|of)\s+\d{{1,4}})?[\])~–—\-|·•*\s]*$", re.I)
_BESIDE = re.compile(r"^(?:(?P<n1>\d{1,4})\s*[·|•–—~]?\s+(?P<t1>[^\W\d_].*)|(?P<t2>.*[^\W_])\s*(?:\s[·|•–—~]\s*|\s+)(?P<n2>\d{1,4}))$")
_HEADING_PAGE = (
    re.compile(r"^(?P<t>.*[^\s.·|])\s*(?:\.{3,}|…|\s[·|•~–—])\s*(?:p\.\s*|pag(?:ina|e)?\.?\s*)?\d{1,4}\s*$"),
    re.compile(r"^\s*(?:p\.\s*|pag(?:ina|e)?\.?\s*)?\d{1,4}\s*[·|•~–—]\s*(?P<t>\S.*)$"),
    re.compile(r"^\s*\[\d{1,4}\]\s+(?P<t>\S.*)$"),
    re.compile(r"^(?P<t>.*\S)\s+(?:\[\d{1,4}\]|~ ?\d{1,4} ?~)\s*$"),
)


def line_key(line: str) -> str:
    """Key under which repeats of a header meet although scanning misread some letters: letters and digits without
    accents, each group of letters that are taken for one another as one."""
    t = unicodedata.normalize("NFKD", fold(line)).casefold()
    t = "".join(c for c in t if not unicodedata.combining(c))
    t = " ".join(_WORD.findall(t.replace("§", "s")))
    for a, b in (("rn", "m"), ("cl", "d"), ("ii", "u")):
        t = t.replace(a, b)
    return t.translate(_KEY)


_KEY = str.maketrans({"e": "c", "0": "o", "1": "i", "l": "i", "5": "s", "9": "g", "b": "h", "f": "t"})


def _titlelike(title: str) -> bool:
    """All capitals, or every longer word with a capital."""
    ws = [w for w in re.findall(r"[^\W\d_]{2,}", title)]
    if len(ws) < 2 or len(title) > 70:
        return False
    upper = sum(w.isupper() for w in ws)
    if upper >= 0.8 * len(ws) and sum(map(len, ws)) >= 8:
        return True
    return len(ws) >= 3 and all(w[0].isupper() for w in ws)


def header_candidates(text: str) -> list[tuple[int, int, str, str, bool]]:
    """``(first line, last line, title, kind, edge)`` of the lines that may be running headers by their place: short, no
    markup, no end of a sentence, beginning with a capital or a number, and not the beginning of the prose that goes on
    below. ``kind`` is ``pair`` for two lines tried as one, since headers wrap in narrow columns, else ``line``; ``edge``
    tells whether the place shows a page edge: a page number beside or next to it, or a sentence that it interrupts.
    Whether a candidate is a header is for the corpus to tell."""
    lines = text.split("\n")
    page = [bool(_PAGE.match(s.strip()) and s.strip()) for s in lines]
    out = []
    for k, raw in enumerate(lines):
        s = raw.strip()
        if not s or page[k] or len(s) > 70 or _MARKUP.match(raw):
            continue
        for last in (k, k + 1):
            if last > k and (last >= len(lines) or not lines[last].strip() or _MARKUP.match(lines[last]) or page[last]):
                continue
            whole = s if last == k else f"{s} {lines[last].strip()}"
            if len(whole) > 80 or _END.search(whole) or whole[-1] in _HYPHENS + ",":
                continue
            m = _BESIDE.match(whole)
            title = (m["t1"] or m["t2"]) if m else whole
            if not title or not title[0].isupper() or sum(c.isalpha() for c in title) < 4:
                continue
            up, down = k - 1, last + 1
            while up >= 0 and page[up]:
                up -= 1
            while down < len(lines) and page[down]:
                down += 1
            blank_above = up >= 0 and not lines[up].strip()
            blank_below = down < len(lines) and not lines[down].strip()
            before = next((lines[j].strip() for j in range(up, -1, -1) if lines[j].strip() and not page[j]), "")
            follows = lines[down].strip() if down < len(lines) else ""
            plainly = _titlelike(title) and (last == k or _titlelike(s))
            if not plainly and not blank_below and (follows[:1].islower() or follows[:1].isdigit()) and (not before or blank_above or _END.search(before)):
                continue  # a line of the prose that goes on
            if not plainly and (len(_WORD.findall(title)) > 9 or "," in title or any(c.isdigit() for c in title)):
                continue
            if title.isupper() and any(0 <= j < len(lines) and len(lines[j].strip()) > 8 and lines[j].strip().isupper() for j in (k - 1, last + 1)):
                continue  # a passage in capitals
            numbered = m is not None or any(page[j] for j in range(up + 1, k)) or any(page[j] for j in range(last + 1, down))
            broken = bool(before) and not _END.search(before) and next((lines[j].strip() for j in range(down, len(lines)) if lines[j].strip() and not page[j]), "")[:1].islower()
            out.append((k, last, title, "line" if last == k else "pair", numbered or broken))
    return out


def title_mark(path: str | None, key: str) -> str:
    return f"t:{path}\0{key}"


def line_marks(text: str, path: str | None) -> set[str]:
    """The marks that tell whether a line of the text is a header: of a book, or the title of its own document."""
    out = set()
    for _, _, title, _, _ in header_candidates(text):
        key = line_key(title)
        out |= {"l:" + key, title_mark(path, key)}
    return out


def _breaks(text: str) -> list[tuple[re.Match, int, int]]:
    """The places where a word is broken, with the begin of its first part and the end of its second."""
    out = []
    for m in _BREAK.finditer(text):
        a, b = m.start(), m.end()
        while a and (text[a - 1].isalnum() or text[a - 1] == "§"):
            a -= 1
        while b < len(text) and (text[b].isalnum() or text[b] == "§"):
            b += 1
        out.append((m, a, b))
    return out


def _parts(text: str, m: re.Match, a: int, b: int) -> tuple[str, str]:
    return fold(text[a : m.start()]).lower(), fold(text[m.end() : b]).lower()


def _undecided(m: re.Match) -> bool:
    """Whether the hyphen may be a compound's own: not so the marks that only break words, and before a capital it always
    is."""
    return m[1] in "-\u2010" and m[2].islower()


#: One key for all words that scanning may take for one another: letters that are confused become one letter, and a
#: letter read as two becomes these two. Undoing any number of confusions leaves the key as it is.
_SAME_FROM, _SAME_TO = "ețt1l5șs§0àáã9b68", "cffiissssoăăăghhh"
_APART = (("u", "ii"), ("m", "rn"), ("d", "ci"), ("w", "vv"))


def confusion_key(word: Column) -> Column:
    out = F.translate(word, _SAME_FROM, _SAME_TO)
    for one, two in _APART:
        out = F.replace(out, F.lit(one), F.lit(two))
    return out


def undone(read: str, stood: str, most: int) -> int | None:
    """The least number of confusions, ``most`` at most, that make ``read`` of ``stood``; None if none do."""
    best = {(0, 0): 0}
    for i in range(len(read) + 1):
        for j in range(max(0, i - 2 * most), min(len(stood), i + 2 * most) + 1):
            n = best.get((i, j))
            if n is None:
                continue
            if i < len(read) and j < len(stood) and read[i] == stood[j]:
                best[i + 1, j + 1] = min(n, best.get((i + 1, j + 1), n))
            if n < most:
                for a, b in CONFUSIONS:
                    if read.startswith(a, i) and stood.startswith(b, j):
                        to = (i + len(a), j + len(b))
                        best[to] = min(n + 1, best.get(to, n + 1))
    return best.get((len(read), len(stood)))


def distinct_texts(df: DataFrame, id_col: str, cols: tuple[str, str]) -> DataFrame:
    """``df`` with one row of each group of rows whose fields are equal, the smallest id. Only digests are shuffled; the
    digests that occur more than once go to the tasks if they are few, else they are joined."""
    digest = F.xxhash64(*(F.coalesce(F.col(c), F.lit("\0")) for c in cols))
    several = df.groupBy(digest.alias("_digest")).agg(F.min(id_col).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_digest", "_first")
    several = materialize(several, "copies")
    several = F.broadcast(several) if several.count() <= MOST_SHARED else several
    return df.withColumn("_digest", digest).join(several, "_digest", "left").where(F.col("_first").isNull() | (F.col("_first") == F.col(id_col))).drop("_digest", "_first")


def document_titles(documents: DataFrame, path_col: str = "relative_path", text_col: str = "text") -> DataFrame:
    """``(path, title)``: the first Markdown heading of each document."""
    own = documents.select(F.col(path_col).alias("path"), F.regexp_extract(text_col, r"(?m)^#{1,6}[ \t]+(\S.*?)[ \t#]*$", 1).alias("title"))
    return own.where("path IS NOT NULL AND title != ''")


def corpus_marks(df: DataFrame, cols: tuple[str, str] = ("heading", "text"), id_col: str = "chunk_id", path_col: str | None = None, titles: DataFrame | None = None) -> DataFrame:
    """``(mark, value)`` learned from all rows: ``w:<word>`` with the word to read instead; ``k:<left>-<right>`` for
    compounds that keep the hyphen at which they are broken; ``l:<key>`` for the running headers of books and
    ``t:<path> <key>`` for those that give the title of their own document.

    Copies count once. Word and line counts are combined within each batch before they are shuffled. ``titles`` holds
    ``path, title``."""
    heading, text = cols
    path = F.col(path_col) if path_col else F.lit(None).cast("string")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: Counter = Counter()
            lines: Counter = Counter()
            edges: Counter = Counter()
            for h, t, p in zip(*(c.to_pylist() for c in b.columns)):
                for x in (h, t):
                    if not x:
                        continue
                    if "\n" in x and (broken := _breaks(x)):
                        rest, at = [], 0
                        for m, a, b_ in broken:
                            left, right = _parts(x, m, a, b_)
                            words[f"j:{left}{right}"] += 1
                            if _undecided(m):
                                words[f"b:{left}-{right}"] += 1
                            rest.append(x[at:a])
                            at = max(at, b_)
                        x = "\n".join([*rest, x[at:]])
                    low = fold(x).lower()
                    words.update(_WORD.findall(low))
                    if "-" in low or "\u2010" in low:
                        words.update("c:" + c.replace("\u2010", "-") for c in _COMPOUND.findall(low))
                if t and "\n" in t:
                    for _, _, title, kind, edge in header_candidates(t):
                        key = line_key(title)
                        if p is not None:
                            lines[title_mark(p, key)] += 1
                        if kind == "line":
                            lines["l:" + key] += 1
                            edges["l:" + key] += edge
            names = [w if w[1:2] == ":" else "w:" + w for w in words] + list(lines)
            n = [*words.values(), *lines.values()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array([0] * len(words) + [edges[k] for k in lines], pa.int64())], names=["mark", "n", "edge"])

    once = distinct_texts(df.select(id_col, heading, text, path.alias("_path")), id_col, cols).select(heading, text, "_path")
    counts = materialize(once.mapInArrow(count, "mark string, n bigint, edge bigint").groupBy("mark").agg(F.sum("n").alias("n"), F.sum("edge").alias("edge")), "counts")
    of = lambda kind: counts.where(F.col("mark").startswith(kind)).select(F.expr("substring(mark, 3)").alias("word"), "n")

    # misread words: the more frequent words with the same key
    words = of("w:").unionByName(of("j:")).groupBy("word").agg(F.sum("n").alias("n")).withColumn("key", confusion_key(F.col("word")))
    known = words.where((F.col("n") >= LEAST_KNOWN) & ~F.col("word").rlike("[0-9§]")).select("key", F.col("word").alias("candidate"), F.col("n").alias("known"))
    # a word that half of all words of its kind are can't be RARER times rarer than another
    top = words.agg(F.max("n")).first()[0] or 0
    rare = words.where((F.col("n") * RARER <= top) & (F.length("word") > 1) & ~F.col("word").rlike("^[0-9]+$"))
    fits = rare.join(known, "key").where((F.col("known") >= RARER * F.col("n")) & ((F.length("word") > 3) | (F.col("known") >= 10 * RARER * F.col("n"))))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            ok = [undone(w, c, 3 if any(x.isdigit() for x in w) or len(w) > 7 else 2) is not None for w, c in pairs]
            yield b.filter(pa.array(ok, pa.bool_()))

    fits = fits.select("word", "candidate", "known").mapInArrow(verify, "word string, candidate string, known bigint")
    repairs = fits.groupBy("word").agg(F.max_by("candidate", F.struct("known", "candidate")).alias("value")).select(F.concat(F.lit("w:"), "word").alias("mark"), "value")

    # broken words: the vocabulary decides between the joined word and the compound
    left, right = F.split_part("word", F.lit("-"), F.lit(1)), F.split_part("word", F.lit("-"), F.lit(2))
    readings = {"joined": F.concat(F.lit("w:"), left, right), "compound": F.concat(F.lit("c:"), "word"), "left": F.concat(F.lit("w:"), left), "right": F.concat(F.lit("w:"), right)}
    asked = of("b:").select("word", F.explode(F.create_map(*(x for k, v in readings.items() for x in (F.lit(k), v)))).alias("role", "mark"))
    seen = asked.join(counts.select("mark", "n"), "mark").groupBy("word").agg(*(F.coalesce(F.max(F.when(F.col("role") == k, F.col("n"))), F.lit(0)).alias(k) for k in readings))
    keeps = seen.where((F.col("compound") > F.col("joined")) | ((F.col("joined") + F.col("compound") == 0) & (F.least("left", "right") >= LEAST_KNOWN)))
    keeps = keeps.select(F.concat(F.lit("k:"), "word").alias("mark"), F.lit("").alias("value"))

    books = counts.where(F.col("mark").startswith("l:") & (F.col("n") >= LEAST_REPEATS) & (F.col("edge") >= EDGE_SHARE * F.col("n"))).select("mark", F.lit("").alias("value"))
    marks = repairs.unionByName(keeps).unionByName(books)
    if titles is not None and path_col:
        lines = counts.where(F.col("mark").startswith("t:")).select("mark", F.expr("substring_index(substring(mark, 3), '\\0', 1)").alias("path"))

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = [m == title_mark(p, line_key(t)) for m, p, t in zip(*(c.to_pylist() for c in b.columns))]
                yield b.filter(pa.array(ok, pa.bool_())).select(["mark"])

        named = titles.where(F.col("path").isNotNull() & F.col("title").isNotNull()).select("path", "title")
        headers = lines.join(named, "path").select("mark", "path", "title").mapInArrow(own, "mark string").distinct()
        marks = marks.unionByName(headers.withColumn("value", F.lit("")))
    return materialize(marks, "marks")


def lookup(marks: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Marks as the repair looks them up: words by themselves, the others by their marks."""
    return {m[2:] if m.startswith("w:") else m: v for m, v in marks}


def _reread_words(text: str, marks: dict[str, str]) -> tuple[str, bool]:
    if marks.keys().isdisjoint(_WORD.findall(text.lower())):
        return text, False

    def sub(m: re.Match) -> str:
        to = marks.get(m[0].lower())
        if not to:
            return m[0]
        return to.upper() if m[0].isupper() and len(m[0]) > 1 else to[0].upper() + to[1:] if m[0][0].isupper() else to

    return _WORD.sub(sub, text), True


def strip_pages(text: str, marks: dict[str, str], path: str | None = None) -> tuple[str, set[str]]:
    """The text without running headers and page numbers, and which of the two it had."""
    defects: set[str] = set()
    lines: list[str | None] = list(text.split("\n"))
    if len(lines) > 1:
        headers = {}
        for first, last, title, _, _ in header_candidates(text):
            key = line_key(title)
            if "l:" + key in marks or title_mark(path, key) in marks:
                headers[first] = max(headers.get(first, (last, title)), (last, title))
        for first, (last, title) in headers.items():
            if lines[first] is None:
                continue
            defects.add("running_header")
            if " ".join(s.strip() for s in lines[first : last + 1] if s) != title:
                defects.add("page_number")
            for k in range(first, last + 1):
                lines[k] = None
        for k, s in enumerate(lines):
            t = s.strip() if s else ""
            if t and (_PAGE.match(t) and any(c.isdigit() for c in t) or _ROMAN.match(t)) and not _MARKUP.match(s):
                defects.add("page_number")
                lines[k] = None
        if None in lines:
            kept: list[str] = []
            dropped = False
            for k, s in enumerate(lines):
                if s is None:
                    dropped = True
                    continue
                if dropped and not s.strip() and (not kept or not kept[-1].strip() or not _END.search(kept[-1].strip())):
                    continue  # the blank lines around a header that broke a sentence
                if s.strip():
                    if dropped and kept and not kept[-1].strip() and s.strip()[:1].islower():
                        while kept and not kept[-1].strip():
                            kept.pop()
                    dropped = False
                kept.append(s)
            while kept and not kept[-1].strip():
                kept.pop()
            text = "\n".join(kept)

    return text, defects


def mend_words(text: str, marks: dict[str, str]) -> tuple[str, set[str]]:
    """The text with words broken at line ends joined, misread words read again and wrapped lines joined, and which
    defects it had. Lists, tables and quotes stay as they are."""
    defects: set[str] = set()
    if "\n" in text:
        keep = set() if not _BREAK.search(text) else {m.start() for m, a, b in _breaks(text) if _undecided(m) and "k:{}-{}".format(*_parts(text, m, a, b)) in marks}

        def join(m: re.Match) -> str:
            if m.start() in keep or m[1] == "-" and not m[2].islower():
                return m[1]
            defects.add("hyphenation")
            return ""

        text = _BREAK.sub(join, text)
    text, misread = _reread_words(text, marks)
    if misread:
        defects.add("characters")
    if "\n" in text:
        out: list[str] = []
        for s in text.split("\n"):
            if out and s.strip() and out[-1].strip() and not _MARKUP.match(s) and not _MARKUP.match(out[-1]):
                out[-1] = f"{out[-1].rstrip()} {s.strip()}"
            else:
                out.append(s)
        text = "\n".join(out)
    return text, defects


def repair_heading(heading: str, marks: dict[str, str]) -> tuple[str, set[str]]:
    defects: set[str] = set()
    if "\n" in heading:
        heading, pages = strip_pages(heading, {})
        heading, defects = mend_words(heading, marks)
        defects |= pages
    for p in _HEADING_PAGE if len(heading) < 500 else ():
        if m := p.match(heading):
            heading = m["t"].strip()
            defects.add("page_number")
    heading, misread = _reread_words(heading, marks)
    if misread:
        defects.add("characters")
    return heading, defects


def repair_scans(df: DataFrame, id_col: str = "chunk_id", cols: tuple[str, str] = ("heading", "text"), path_col: str | None = None, titles: DataFrame | None = None) -> DataFrame:
    """``(id_col, heading, text, defects array<struct<field, defect>>)`` of every row, repaired.

    What a header, a misread word or a compound is comes from counts over all distinct texts (``corpus_marks``). A line
    between others is a running header if many texts repeat it at page edges, or if it is the title of its own document
    (``titles`` holds ``path, title``; without it only repeats count). The marks go to the tasks if there are at most
    ``MOST_SHARED`` of them; if more, each row gets those that concern it by two joins: the marks of its lines, then
    those of the words that are left without headers, which is what the other way looks up. Null fields stay null, empty
    ones empty; repeated rows are kept; an empty table gives an empty result.
    """
    marks = corpus_marks(df, cols, id_col, path_col, titles)
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    h_col, t_col = cols
    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    own = df.select(F.col(id_col).alias("id"), F.col(h_col).alias("heading"), F.col(t_col).alias("text"), path.alias("path"))
    found = pa.list_(pa.struct([("field", pa.string()), ("defect", pa.string())]))
    as_found = lambda ds, field: [{"field": field, "defect": x} for x in sorted(ds)]

    def finish(out: DataFrame) -> DataFrame:
        return out.withColumnsRenamed({"id": id_col, "heading": h_col, "text": t_col})

    types = f"id {kind}, heading string, text string, defects array<struct<field:string,defect:string>>"
    if marks.count() <= MOST_SHARED:
        shared = spark.sparkContext.broadcast(lookup((r.mark, r.value) for r in marks.collect()))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hs, ts, ds = [], [], []
                for h, t, p in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                    dh, dt = set(), set()
                    if h:
                        h, dh = repair_heading(h, shared.value)
                    if t:
                        t, pages = strip_pages(t, shared.value, p)
                        t, dt = mend_words(t, shared.value)
                        dt |= pages
                    hs.append(h)
                    ts.append(t)
                    ds.append(as_found(dh, h_col) + as_found(dt, t_col))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hs, pa.string()), pa.array(ts, pa.string()), pa.array(ds, found)], names=["id", "heading", "text", "defects"])

        return finish(own.mapInArrow(whole, types))

    def named(rows: DataFrame, name) -> DataFrame:
        """The rows with a map of the marks that ``name`` says concern them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                uses = [(k, m) for k, *x in zip(*(c.to_pylist() for c in b.columns)) for m in name(*x)]
                yield pa.RecordBatch.from_arrays([pa.array([u[0] for u in uses], b.schema.field(0).type), pa.array([u[1] for u in uses], pa.string())], names=["id", "mark"])

        uses = rows.select("id", "heading", "text", "path").mapInArrow(run, f"id {kind}, mark string").distinct().join(marks, "mark")
        return rows.join(uses.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("mark", "value"))).alias("marks")), "id", "left")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(t, set()) if not t else strip_pages(t, lookup(m or ()), p) for t, p, m in zip(*(b.column(n).to_pylist() for n in ("text", "path", "marks")))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("heading"), pa.array([g[0] for g in got], pa.string()), b.column("path"), pa.array([sorted(g[1]) for g in got], pa.list_(pa.string()))], names=["id", "heading", "text", "path", "pages"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ts, ds = [], [], []
            for h, t, pages, m in zip(*(b.column(n).to_pylist() for n in ("heading", "text", "pages", "marks"))):
                m = lookup(m or ())
                h, dh = repair_heading(h, m) if h else (h, set())
                t, dt = mend_words(t, m) if t else (t, set())
                hs.append(h)
                ts.append(t)
                ds.append(as_found(dh, h_col) + as_found(dt | set(pages), t_col))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(hs, pa.string()), pa.array(ts, pa.string()), pa.array(ds, found)], names=["id", "heading", "text", "defects"])

    lines = named(own, lambda h, t, p: line_marks(t, p) if t and "\n" in t else ())
    stripped = materialize(lines.mapInArrow(first, f"id {kind}, heading string, text string, path string, pages array<string>"), "stripped")
    return finish(named(stripped, word_marks).mapInArrow(second, types))


def word_marks(heading: str | None, text: str | None, path: str | None = None) -> set[str]:
    """The marks that may concern the words of a row without headers: whole words, broken ones, and what joining those
    and reading headings without their page numbers gives."""
    out: set[str] = set()
    if heading and "\n" in heading:
        heading = strip_pages(heading, {})[0]
    for x in (heading, text):
        if not x:
            continue
        for m, a, b in _breaks(x):
            left, right = _parts(x, m, a, b)
            out |= {f"k:{left}-{right}", f"w:{left}{right}"}
        for y in (x, _BREAK.sub("", x), _BREAK.sub(lambda m: m[1], x)):
            out |= {"w:" + w for w in _WORD.findall(y.lower())}
    return out


def defects(repaired: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """``(id_col, field, defect)`` of the rows of ``repair_scans``, each once."""
    return repaired.select(id_col, F.explode("defects").alias("d")).select(id_col, "d.field", "d.defect").distinct()
