"""Ordered, named rules that decide the polarity of a (product, condition) candidate within a unit of text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.units import units as split_units


@dataclass(frozen=True)
class Candidate:
    """A unit of text with the places of a product and a condition in it (half-open, in characters)."""

    unit: str
    heading: str
    product: tuple[int, int]
    condition: tuple[int, int]
    kind: str = "paragraph"
    intro: str = ""
    header: tuple[str, ...] = ()
    products: tuple[tuple[int, int], ...] = ()  # of the whole unit
    longer: tuple[int, int] | None = None  # a longer condition name around the condition
    category: str = ""  # of the product


@dataclass(frozen=True)
class Decision:
    label: str
    code: str
    quote: tuple[int, int] | None = None


# Cue words of the rule set, Romanian and English.
POSITIVE = r"(?:ajut[ăa]|alin[ăa]|calmeaz[ăa]|recomand\w*|se aplic[ăa]|se iau|eficient\w*|helps?|soothes?|calms?|recommended|one applies|take)"
CAUTION = r"(?:evit[ăa]\w*|interzi[cs]\w*|contraindica\w*|nu se (?:combin[ăa]|administreaz[ăa]|recomand[ăa])|se opre[șs]te|avoid\w*|forbid\w*|contraindicated|not (?:combined|recommended)|stop)"
LIMIT = r"(?:except\w*|cu excep[țt]ia|numai dac[ăa]|unless|only if|mai mult de|more than)"
SOURCE = r"(?:bibliograf\w*|et al\.|isbn|\bvol\.\s*\d|\bpp?\.\s*\d)"
NON_USE = r"(?:habitat|cre[șs]te (?:în|pe|prin)|con[țt]ine|grows|contains|altitudin\w*|petale|stamine|petals|stamens)"
NEGATION = r"\b(?:nu|niciodat[ăa]|not|never)\b"
QUANTITY = r"(?:½|¼|\d+(?:[.,]\d+)?)\s*(?:(?:mg|g|ml|linguri?[țt]e?|linguri?|capsule?|pic[ăa]turi|c[ăa]ni|teaspoons?|drops|capsules?|cups?)\b)"
INTAKE = r"\b(?:se iau|se ia|se bea|se beau|se administreaz[ăa]|take|drink|is taken|are taken)\b"
INDICATED = r"(?:indica[țt]ii|recomand\w*|utiliz[ăa]ri|uses|indications|recommended)"
WARNED = r"(?:contraindica\w*|aten[țt]ion\w*|precau[țt]\w*|interdic[țt]ii|warnings?|cautions?|avoid)"
NEUTRAL = r"^\s*(?:general\w*|note|observa[țt]ii|altele|detalii|remarks|notes|details|other)\b"
GROUPED = {"suplimente": r"\b(?:suplimente\w*|vitamine\w*|minerale\w*|aminoaciz\w*|supplements?|vitamins?|minerals?|amino acids?)\b", "uleiuri": r"\b(?:uleiuri\w*|oils?)\b", "plante": r"\b(?:plante\w*|herbs?|plants?)\b"}
CONSULT = r"(?:consulta[țt]i|sfatul medicului|supraveghere\w* medical[ăa]|consult (?:a|your) (?:doctor|physician)|medical supervision)"
POPULATION = r"\b(?:copii|sarcin\w*|al[ăa]pt\w*|v[âa]rstnici|children|pregnan\w*|elderly)\b"
INSTRUCTION_WORDS = frozenset("""a al ale cu de din după dupa în in înainte inainte la mai o ori pe pentru se zi zile zilnic masă mese dimineața seara și si după iau ia bea beau administrează administreaza
nu niciodată take drink taken is are of the for in and a after before times daily day days per meal meals morning evening with water apă apa not never""".split())
#: Units over so many characters are judged by cues next to the names only.
LONG_UNIT = 600
_SENTENCE = re.compile(r"[^.!?…]*[.!?…]?\s*")


@lru_cache(maxsize=64)
def _sentences(unit: str) -> tuple[list[int], list[int]]:
    """Where the sentences begin and end."""
    spans = [m.span() for m in _SENTENCE.finditer(unit) if m[0]]
    return [a for a, _ in spans], [b for _, b in spans]


def _sentence(c: Candidate) -> tuple[int, int]:
    """The sentence of the condition."""
    begins, ends = _sentences(c.unit)
    k = bisect_right(begins, c.condition[0]) - 1
    return (begins[k], ends[k]) if k >= 0 and c.condition[0] < ends[k] else (0, len(c.unit))


# the pairs of a unit ask the same of the same text
@lru_cache(maxsize=4096)
def _in(pattern: str, text: str) -> re.Match | None:
    return re.search(pattern, text, re.I)


def _unresolved_place(c: Candidate) -> Decision | None:
    ok = 0 <= c.product[0] < c.product[1] <= len(c.unit) and 0 <= c.condition[0] < c.condition[1] <= len(c.unit)
    return None if ok else Decision("unclear", "place_outside_unit")


def _shared_mention(c: Candidate) -> Decision | None:
    shared = c.product[0] < c.condition[1] and c.condition[0] < c.product[1]
    return Decision("unclear", "shared_mention") if shared else None


def _source_only(c: Candidate) -> Decision | None:
    return Decision("unclear", "source_reference") if _in(SOURCE, c.unit) else None


def _whole_prohibition(c: Candidate) -> Decision | None:
    a, b = _sentence(c)
    s = c.unit[a:b]
    return Decision("caution", "explicit_prohibition", (a, b)) if _in(CAUTION, s) and a <= c.product[0] < b and not _in(LIMIT, s) and not _in(POSITIVE, s) else None


def _description(c: Candidate) -> Decision | None:
    a, b = _sentence(c)
    s = c.unit[a:b]
    return Decision("unclear", "description") if _in(NON_USE, s) and not _in(POSITIVE, s) and not _in(CAUTION, s) else None


def _warning_heading(c: Candidate) -> Decision | None:
    warned = _in(r"contraindica|aten[țt]ion|precau[țt]|warning|caution", c.heading)
    return Decision("caution", "warning_section", _sentence(c)) if warned else None


def _list_scope(c: Candidate) -> Decision | None:
    head, _, rest = c.unit.partition(":")
    if not rest or c.product[0] < len(head):
        return None
    pos, neg = bool(_in(POSITIVE, head)), bool(_in(CAUTION, head))
    return Decision("caution" if neg else "positive", "list_introduction", (0, len(head))) if pos != neg else None


def _near_cue(c: Candidate) -> Decision | None:
    a, b = _sentence(c)
    if not a <= c.product[0] < b or _in(LIMIT, c.unit[a:b]):
        return None
    lo, hi = min(c.product[0], c.condition[0]), max(c.product[1], c.condition[1])
    near = c.unit[max(a, lo - 60) : min(b, hi + 60)]
    pos, neg = bool(_in(POSITIVE, near)), bool(_in(CAUTION, near))
    if pos and neg:
        return Decision("mixed", "adjacent_cues", (a, b))
    return Decision("positive" if pos else "caution", "adjacent_cue", (a, b)) if pos or neg else None


def _compound_condition(c: Candidate) -> Decision | None:
    inside = c.longer and c.longer[0] <= c.condition[0] and c.condition[1] <= c.longer[1] and c.longer != c.condition
    return Decision("unclear", "longer_condition_name") if inside else None


def primary_heading(headings: Sequence[str]) -> str:
    """The innermost heading that says something: neutral ones are passed on the way up."""
    return next((h for h in reversed(headings) if not re.search(NEUTRAL, h, re.I)), "")


def _cell(unit: str, place: int) -> int:
    """The number of the table cell that holds a place."""
    return unit[:place].count("|") - 1 if unit.lstrip().startswith("|") else unit[:place].count("|")


def _dose_row(c: Candidate) -> Decision | None:
    dosed = any(_in(r"\b(?:doz[ăae]\w*|dos(?:e|age))", h) for h in c.header) and (_in(INDICATED, c.heading) or any(_in(INDICATED, h) for h in c.header))
    fine = c.kind == "row" and dosed and _in(QUANTITY, c.unit) and not _in(CAUTION, c.unit) and not _in(LIMIT, c.unit)
    return Decision("positive", "recommended_dose", (0, len(c.unit))) if fine else None


def _column(c: Candidate) -> Decision | None:
    k = _cell(c.unit, c.condition[0])
    if c.kind != "row" or not 0 <= k < len(c.header):
        return None
    good, bad = bool(_in(INDICATED, c.header[k])), bool(_in(WARNED, c.header[k]))
    good = good and not bad  # "contraindications" holds "indications"
    return Decision("caution" if bad else "positive", "table_column", (0, len(c.unit))) if good != bad else None


def _instruction(c: Candidate) -> Decision | None:
    a, b = _sentence(c)
    if not a <= c.product[0] < b or not _in(INTAKE, c.unit[a:b]) or _in(LIMIT, c.unit[a:b]):
        return None
    (p, q), (r, t) = sorted((c.product, c.condition))
    rest = re.sub(QUANTITY, " ", f"{c.unit[a:p]} {c.unit[q:r]} {c.unit[t:b]}", flags=re.I)
    if not set(re.findall(r"[^\W\d_]+", rest.lower())) <= INSTRUCTION_WORDS:
        return None  # something is said that is not understood
    return Decision("caution" if _in(NEGATION, rest) else "positive", "administration", (a, b))


def _recipe(c: Candidate) -> Decision | None:
    last = max((e for _, e in c.products or (c.product,)), default=0)
    intake = re.compile(INTAKE, re.I).search(c.unit, last)
    told = intake and len(c.products) > 1 and _in(QUANTITY, c.unit[:last]) and not _in(CAUTION, c.unit) and not _in(NEGATION, c.unit)
    return Decision("positive", "recipe_intake", intake.span()) if told else None


def _common_list(c: Candidate) -> Decision | None:
    a, b = _sentence(c)
    s = c.unit[a:b]
    cues = [(m.start() + a, label) for label, p in (("positive", POSITIVE), ("caution", CAUTION)) for m in re.finditer(p, s, re.I)]
    listed = a <= c.product[0] < b and len(cues) == 1 and c.product[1] <= cues[0][0] < c.condition[0]
    between = c.unit[cues[0][0] : c.condition[0]] if listed else ""
    if not listed or _in(LIMIT, s) or _in(NEGATION, s) or not re.search(r"[,:]", c.unit[cues[0][0] : b]) or re.search(r"[;()]", between):
        return None
    return Decision(cues[0][1], "common_list", (a, b))


def _class_restriction(c: Candidate) -> Decision | None:
    a, b = _sentence(c)
    s = c.unit[a:b]
    bound = c.category in GROUPED and _in(GROUPED[c.category], s) and _in(CAUTION, s) and not _in(LIMIT, s)
    return Decision("caution", "class_restriction", (a, b)) if bound else None


def _consultation(c: Candidate) -> Decision | None:
    a, b = _sentence(c)
    s = c.unit[a:b]
    return Decision("caution", "consultation", (a, b)) if _in(CONSULT, s) and a <= c.product[0] < b else None


def _avoidance_list(c: Candidate) -> Decision | None:
    told = c.kind == "list" and _in(r"\b(?:evita[țt]i|nu (?:lua[țt]i|folosi[țt]i)|avoid|do not (?:take|use))\b", c.intro) and not _in(LIMIT, c.intro)
    return Decision("caution", "avoidance_list", (0, len(c.unit))) if told else None


def _introduced(c: Candidate) -> Decision | None:
    if c.kind != "list" or not c.intro:
        return None
    pos, neg = bool(_in(POSITIVE, c.intro)), bool(_in(CAUTION, c.intro))
    return Decision("caution" if neg else "positive", "list_scope", (0, len(c.unit))) if pos != neg and not _in(LIMIT, c.intro) else None


def _open(rule: Callable[[Candidate], Decision | None]) -> Callable[[Candidate], Decision | None]:
    """A rule for units that can be understood as a whole: not long, without an exception or a restricted population."""

    def gated(c: Candidate) -> Decision | None:
        closed = len(c.unit) > LONG_UNIT or _in(LIMIT, c.unit) or _in(POPULATION, c.unit)
        return None if closed else rule(c)

    gated.__name__ = rule.__name__
    return gated


#: The order decides: the first rule that answers wins; no answer leaves the candidate to the cache or a model.
RULES: tuple[Callable[[Candidate], Decision | None], ...] = (
    _unresolved_place, _shared_mention, _compound_condition, _source_only, _whole_prohibition, _avoidance_list, _class_restriction, _consultation, _open(_dose_row), _description, _warning_heading,
    _open(_column), _list_scope, _open(_introduced), _open(_instruction), _open(_recipe), _open(_common_list), _near_cue,
)


def decide(c: Candidate) -> Decision | None:
    return next((d for rule in RULES if (d := rule(c)) is not None), None)


def classify(candidates: DataFrame) -> DataFrame:
    """``(identity, label, code, quote_begin, quote_end)`` of ``(identity, unit, heading, p0, p1, c0, c1)`` rows; label
    null where no rule answers. Quotes are offsets within the unit. Null units are unclear."""
    kind = candidates.schema["identity"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, unit, heading, p0, p1, c0, c1 in zip(*(b.column(n).to_pylist() for n in ("identity", "unit", "heading", "p0", "p1", "c0", "c1"))):
                d = Decision("unclear", "no_text") if unit is None or None in (p0, p1, c0, c1) else decide(Candidate(unit, heading or "", (p0, p1), (c0, c1)))
                q = d.quote if d and d.quote else (None, None)
                rows.append((i, d.label if d else None, d.code if d else None, *q))
            cols = list(zip(*rows)) if rows else [()] * 5
            types = (b.schema.field(b.schema.get_field_index("identity")).type, pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["identity", "label", "code", "quote_begin", "quote_end"])

    own = candidates.select("identity", "unit", "heading", *(candidates[c].cast("int") for c in ("p0", "p1", "c0", "c1")))
    return own.mapInArrow(run, f"identity {kind}, label string, code string, quote_begin int, quote_end int")


#: Rows of a batch of pairs; a unit with many pairs gives several batches.
PAIR_ROWS = 10_000


def classify_pairs(units: DataFrame) -> DataFrame:
    """``(identity, p0, p1, c0, c1, label, code, quote_begin, quote_end)`` of every product with every condition of the
    ``(identity, unit, heading, products array<string>, conditions array<struct<begin, finish>>)`` rows. Products are the
    names in the order of the text, each from the end of the one before; the places of the pairs are offsets."""
    kind = units.schema["identity"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = (b.schema.field(0).type, *[pa.int32()] * 4, pa.string(), pa.string(), pa.int32(), pa.int32())
            names = ["identity", "p0", "p1", "c0", "c1", "label", "code", "quote_begin", "quote_end"]
            rows = []
            for i, unit, heading, products, conditions in zip(*(c.to_pylist() for c in b.columns)):
                end = 0
                for name in products or ():
                    begin = unit.index(name, end)
                    end = begin + len(name)
                    for c in conditions or ():
                        d = decide(Candidate(unit, heading or "", (begin, end), (c["begin"], c["finish"])))
                        rows.append((i, begin, end, c["begin"], c["finish"], d.label if d else None, d.code if d else None, *((d.quote if d else None) or (None, None))))
                        if len(rows) == PAIR_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows = []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 9, types)], names=names)

    own = units.select("identity", "unit", "heading", "products", "conditions")
    return own.mapInArrow(run, f"identity {kind}, p0 int, p1 int, c0 int, c1 int, label string, code string, quote_begin int, quote_end int")


def classify_units(texts: DataFrame) -> DataFrame:
    """``(identity, unit, p0, p1, c0, c1, label, code, quote_begin, quote_end)`` of every product with every condition of one
    unit (``units``) of the ``(identity, text, products, conditions)`` rows; both are arrays of struct<begin, finish> in
    characters of the text, those of products with a ``category``. Places and quotes are offsets within the unit; a
    condition inside a longer one is judged as such. Null texts give no rows."""
    kind = texts.schema["identity"].dataType.simpleString()
    names = ["identity", "unit", "p0", "p1", "c0", "c1", "label", "code", "quote_begin", "quote_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = (b.schema.field(0).type, *[pa.int32()] * 5, pa.string(), pa.string(), pa.int32(), pa.int32())
            rows = []
            for i, text, products, conditions in zip(*(c.to_pylist() for c in b.columns)):
                for n, u in enumerate(split_units(text) if text and products and conditions else (), 1):
                    inside = lambda xs: [(x["begin"] - u.begin, x["finish"] - u.begin, x) for x in xs if u.begin <= x["begin"] and x["finish"] <= u.end]  # noqa: B023, E731
                    ps, cs = inside(products), inside(conditions)
                    for p0, p1, p in ps:
                        for c0, c1, _ in cs:
                            longer = next(((x, y) for x, y, _ in cs if x <= c0 and c1 <= y and (x, y) != (c0, c1)), None)
                            d = decide(Candidate(u.text, primary_heading(u.headings), (p0, p1), (c0, c1), u.kind, u.intro, u.header, tuple((x, y) for x, y, _ in ps), longer, p["category"] or ""))
                            rows.append((i, n, p0, p1, c0, c1, d.label if d else None, d.code if d else None, *((d.quote if d else None) or (None, None))))
                            if len(rows) == PAIR_ROWS:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                                rows = []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=names)

    own = texts.select("identity", "text", "products", "conditions")
    return own.mapInArrow(run, f"identity {kind}, unit int, p0 int, p1 int, c0 int, c1 int, label string, code string, quote_begin int, quote_end int")


def combine(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, label, code)``: one decision for each group. Equal labels keep theirs; positive with caution is mixed; unclear
    counts only where nothing else is said. The code is that of the one rule that decided, else ``combined``."""
    told = F.col("label").isNotNull()
    has = lambda x: F.coalesce(F.bool_or(F.col("label") == x), F.lit(False))
    per = decisions.where(told).groupBy(*keys).agg(*(has(x).alias(f"_{x}") for x in ("positive", "caution", "mixed")), F.collect_set(F.when(F.col("label") != "unclear", F.col("code"))).alias("_codes"), F.min("code").alias("_first"))
    label = F.when(F.col("_mixed") | (F.col("_positive") & F.col("_caution")), "mixed").when(F.col("_positive"), "positive").when(F.col("_caution"), "caution").otherwise("unclear")
    code = F.when(F.size("_codes") == 1, F.element_at("_codes", 1)).when(F.size("_codes") > 1, "combined").otherwise(F.col("_first"))
    return per.select(*keys, label.alias("label"), code.alias("code"))


#: Keys that an answer of a model must have, no more and no fewer.
ANSWER_KEYS = ("prohibited", "recommended", "quote_begin", "quote_end")


def accepted_answers(answers: DataFrame, json_col: str, unit_col: str, verified_col: str) -> DataFrame:
    """``answers`` with ``label``, ``quote_begin`` and ``quote_end``: an answer counts if it has exactly ``ANSWER_KEYS``, its
    quote lies inside the unit and the local scope verifies; a recommendation beats a prohibition. Everything else is
    unclear, without a quote."""
    a = answers.withColumn("_k", F.array_sort(F.coalesce(F.json_object_keys(json_col), F.array().cast("array<string>"))))
    a = a.withColumn("_a", F.from_json(json_col, "prohibited boolean, recommended boolean, quote_begin int, quote_end int"))
    inside = (F.col("_a.quote_begin") >= 0) & (F.col("_a.quote_begin") < F.col("_a.quote_end")) & (F.col("_a.quote_end") <= F.length(unit_col))
    good = F.coalesce((F.col("_k") == F.array(*map(F.lit, sorted(ANSWER_KEYS)))) & inside & F.col(verified_col), F.lit(False))
    label = F.when(good & F.col("_a.recommended"), "positive").when(good & F.col("_a.prohibited"), "caution").otherwise("unclear")
    quote = lambda c: F.when(label != "unclear", F.col(f"_a.{c}")).alias(c)
    return a.select(*answers.columns, label.alias("label"), quote("quote_begin"), quote("quote_end"))


def stale_decisions(decisions: DataFrame, units: DataFrame, key: str, unit_col: str) -> DataFrame:
    """``(key, problem)`` of cached decisions that no longer hold: no unit, an unknown label, a quote that is missing or lies
    outside the unit, or one that an unclear decision should not have."""
    both = decisions.join(units.select(key, F.length(unit_col).alias("_n"), F.lit(True).alias("_is")), key, "left")
    quoted = F.col("quote_begin").isNotNull() & F.col("quote_end").isNotNull()
    inside = (F.col("quote_begin") >= 0) & (F.col("quote_begin") < F.col("quote_end")) & (F.col("quote_end") <= F.coalesce("_n", F.lit(0)))
    problem = (
        F.when(F.col("_is").isNull(), "no_unit").when(~F.coalesce(F.col("label").isin("positive", "caution", "mixed", "unclear"), F.lit(False)), "label")
        .when((F.col("label") == "unclear") & quoted, "quote_of_unclear").when((F.col("label") != "unclear") & ~(quoted & inside), "quote")
    )
    return both.select(key, problem.alias("problem")).where(F.col("problem").isNotNull())
