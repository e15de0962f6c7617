"""Problem 6: personal data in free text, found and replaced by typed placeholders.

Generators with high recall propose spans, which may overlap; boosted trees score them by their format and by the words
around them; calibrated thresholds select. No text is labelled, so the trees are fitted by co-training on the spans of all pages: the
trees that judge the format of a span learn from labels that its context gives, and the trees that judge the context learn
from spans whose format is beyond doubt, so that no tree sees in its features what its labels were made of. Which words
announce which kind is counted over all pages, and what the trees are fitted on are counts of equal feature rows, which Spark adds up. Names are labelled by the register of entities and by
e-mail addresses made of them, as positive or unknown.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketeer.llm.boosting import Boosted, fit_counts
from docketeer.llm.name_links import LEGAL_FORMS, TITLES, fold, given_names, short_forms, trade_words
from docketeer.runtime import cut, map_arrow

#: Candidates after or before a word from which on the word's record counts as known.
KNOWN_CUE = 5
KINDS = ("email", "phone", "id_number", "address", "person_name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[NAME]"}

# How the kinds are written.
_AT, _DOT = r"\s?(?:\(at\)|\[at\]|<at>|\{at\})\s?", r"\s?(?:\(dot\)|\[dot\]|<dot>|\{dot\})\s?"
EMAIL = re.compile(rf"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*(?:@|{_AT})[\w-]+(?:(?:\.|{_DOT})[\w-]+)*(?:\.|{_DOT})[A-Za-z]{{2,}}(?![\w-])|(?<![\w.+-])[\w+-]*@[\w-]+", re.I)
NUMBER = re.compile(r"(?<![\w/.$€£,@#(-])(?:\+\d{1,3}|\((?=\d{2,4}\))|(?=\d))\d[\d ().-]{4,20}\d(?:,? ?(?:ext\.?|x) ?\d{1,5})?(?![\w/-]|[.,]\d)|(?<=\()\d[\d .-]{4,20}\d(?=\))|(?<![\w.])\+\d{1,3}[ .-]?[\d(][\d ().-]{4,20}\d(?:,? ?(?:ext\.?|x) ?\d{1,5})?(?![\w/-])")
LETTERED = re.compile(r"(?<![\w-])(?:[A-Z]{1,3}\d[\d-]{4,16}\d|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z])(?![\w-])")
STREETS = "Street|Lane|Road|Avenue|Ave|Drive|Court|Blvd|Boulevard|Row|Terrace|Way|Close|Square|Place|Crescent"
ADDRESS = re.compile(
    rf"(?<![\w,.-])(?:(?:Flat|Apt|Apartment|Unit|Suite|Room) \w{{1,5}}, )?\d{{1,5}}[A-Za-z]? [A-ZÀ-Þ][\w'’-]+ (?:(?:{STREETS})\b\.?|[A-ZÀ-Þ][\w'’-]+)(?:, (?:Flat|Apt|Apartment|Unit|Suite) \w{{1,5}})?(?:, [A-ZÀ-Þ][\w'’-]+(?: (?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[\dA-Z]? ?\d[A-Z]{{2}})\b)?)?"
    r"|(?<![\w.])P\.? ?O\.? ?Box \d{1,6}(?:, [A-ZÀ-Þ][\w'’-]+(?: (?:\d{5}|[A-Z]{1,2}\d[\dA-Z]? ?\d[A-Z]{2})\b)?)?"
)
STREET_WORD = re.compile(rf"\b(?:{STREETS})\b")
CAPITAL = re.compile("[A-ZÀ-ÖØ-Þ](?:[\\w\u0300-\u036f]|['’-](?=\\w))*")
BLANKS = " \u00a0"
#: Number formats that leave no doubt, as published: international or bracketed area code and extension; US and UK national numbers; ISO dates.
SURE_PHONE = re.compile(r"\+\d|\(\d{2,4}\)|.*(?:ext\.?|x) ?\d+$")
SURE_ID = re.compile(r"\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]")
SURE_DATE = re.compile(r"(?:19|20)\d{2}[-.](?:0\d|1[0-2])[-.][0-3]\d")
POSTCODE = re.compile(r" (?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[\dA-Z]? ?\d[A-Z]{2})$")


@dataclass
class Lexicon:
    """Words learned from the register's names, and the number formats seen in a telling context."""

    given: frozenset = frozenset()
    trade: frozenset = frozenset()
    places: frozenset = frozenset()
    formats: frozenset = frozenset()
    _seen: dict = field(default_factory=dict, compare=False, repr=False)

    def is_given(self, word: str) -> bool:
        known = self._seen.get(word)
        if known is None:
            if len(self._seen) > 300_000:
                self._seen.clear()
            known = self._seen[word] = fold(word) in self.given
        return known


@dataclass(frozen=True)
class Span:
    """A proposed span: what it looks like, and the words before (nearest first) and after it; ``sure`` is 1 or 0 where the format leaves no doubt."""

    start: int
    end: int
    kind: str
    form: tuple
    around: tuple[str, str, str, str]
    sure: int | None = None


def number_format(value: str) -> str:
    return re.sub(r"\d+", lambda m: str(len(m[0])), re.sub(r"(?:ext\.?|x) ?\d+$", "x", value))


def _number_form(value: str) -> tuple:
    groups = [len(g) for g in re.findall(r"\d+", re.sub(r",? ?(?:ext\.?|x) ?\d+$", "", value))]
    seps = {c for c in re.sub(r"[\d+()]|ext\.?", "", value) if c in " .-"}
    letters = len(re.match(r"[A-Z]*", value)[0])
    g = (groups + [0, 0, 0, 0])[:4]
    return (sum(groups), len(groups), *g, int(" " in seps), int("." in seps), int("-" in seps), int(value[0] == "+"), int("(" in value), letters, int(value[-1].isalpha()), int("ext" in value or "x" in value), int(SURE_DATE.fullmatch(value) is not None))


def _around(text: str, s: int, e: int) -> tuple[str, str, str, str]:
    """The two words before, nearest first, the word after, and the marks that touch the span."""
    before = text[max(0, s - 40) : s].split()[-2:]
    after = text[e : e + 24].split()[:1]
    near = [w.strip("(,;:<\"“”").lower() for w in reversed(before)]
    follow = after[0].strip(",;:>\"“”.").lower() if after else ""
    return (near + ["", ""])[0] if near else "", (near + ["", ""])[1], follow, (text[s - 1] if s else "") + (text[e] if e < len(text) else "")


def candidates(text: str, lex: Lexicon) -> Iterator[Span]:
    """Spans proposed in a text."""
    if "@" in text or "at)" in text or "at]" in text or "at>" in text or "(AT)" in text:
        for m in EMAIL.finditer(text):
            value = m[0]
            local, _, host = re.sub(_AT, "@", value, flags=re.I).partition("@")
            dots = host.count(".") + len(re.findall(_DOT, host, re.I))
            form = (int("@" in value), min(len(local), 3), min(dots, 3), len(re.search(r"[A-Za-z]*$", value)[0]), int(any(c.isdigit() for c in local)), int("_" in value or "." in local))
            yield Span(m.start(), m.end(), "email", form, _around(text, m.start(), m.end()), int(bool(local) and dots > 0) if "@" in value and (dots == 0 or "." in host) else None)
    for pattern in (NUMBER, LETTERED):
        for m in pattern.finditer(text):
            value, start, end = m[0], m.start(), m.end()
            form = _number_form(value)
            if not 6 <= form[0] <= 15 or form[1] > 5 or (form[6] and form[7]):
                continue
            # cut off at the edge of an excerpt: only formats known to be whole
            if (start == 0 or end == len(text)) and lex.formats and number_format(value) not in lex.formats:
                continue
            around = _around(text, start, end)
            sure = "phone" if SURE_PHONE.match(value) and form[9] + form[10] + form[13] else "id_number" if SURE_ID.fullmatch(value) else "date" if form[14] else None
            for kind in ("phone", "id_number"):
                yield Span(start, end, kind, form, around, None if sure is None else int(sure == kind))
    for m in ADDRESS.finditer(text):
        value = m[0]
        street = STREET_WORD.search(value)
        if street and value.endswith(".") and street.end() == len(value) - 1 and street[0] not in ("Ave", "Blvd"):
            value = value[:-1]
        kind = 1 if street else 2 if "Box" in value else 0
        form = (kind, value.count(","), int(value[-1].isdigit()), int(value[0] in "FAURS"), min(len(re.match(r"\d*", value)[0]), 5), int(value.isupper()))
        sure = 1 if kind and POSTCODE.search(value) else 0 if not kind and not POSTCODE.search(value) else None
        yield Span(m.start(), m.start() + len(value), "address", form, _around(text, m.start(), m.start() + len(value)), sure)
    yield from _names(text, lex)


def _names(text: str, lex: Lexicon) -> Iterator[Span]:
    found = [(m.start(), m.end(), m[0]) for m in CAPITAL.finditer(text)]
    given, n = lex.is_given, len(found)
    for i, (s, e, t) in enumerate(found):
        if s and (text[s - 1].isalnum() or text[s - 1] in "'’_@./"):
            continue
        if len(t) > 1 and given(t):
            j, end = i + 1, e
            while j < n and found[j][0] - end == 1 and text[end] in BLANKS and len(found[j][2]) == 1 and text[found[j][1] : found[j][1] + 2] == ". ":
                end, j = found[j][1] + 1, j + 1
            if j < n and found[j][0] - end == 1 and text[end] in BLANKS and len(found[j][2]) > 1:
                yield _name(text, lex, found, i, j, 0 if j == i + 1 else 1)
            if i and text[found[i - 1][1] : s] == ", " and len(found[i - 1][2]) > 2:
                last = i
                if i + 1 < n and found[i + 1][0] - e == 1 and len(found[i + 1][2]) == 1 and text[found[i + 1][1] : found[i + 1][1] + 1] == "." and not (i + 2 < n and found[i + 2][0] - found[i + 1][1] == 2):
                    last = i + 1
                yield _name(text, lex, found, i - 1, last, 2)
        elif len(t) == 1 and text[e : e + 1] == ".":
            j, end = i + 1, e + 1
            while j < n and found[j][0] - end in (0, 1) and len(found[j][2]) == 1 and text[found[j][1] : found[j][1] + 1] == ".":
                end, j = found[j][1] + 1, j + 1
            before = i and found[i - 1][1] + 1 == s and given(found[i - 1][2])
            if not before and j < n and found[j][0] - end == 1 and text[end] in BLANKS and len(found[j][2]) > 2:
                yield _name(text, lex, found, i, j, 3)


def _name(text: str, lex: Lexicon, found: list, i: int, j: int, shape: int) -> Span:
    s, e = found[i][0], found[j][1]
    if shape == 2 and len(found[j][2]) == 1:
        e += 1
    surname = found[i][2] if shape == 2 else found[j][2]
    folded = fold(surname)
    before, follow = 0, 0
    w = v = ""
    if i and s - found[i - 1][1] == 1 and text[s - 1] in BLANKS:
        w = fold(found[i - 1][2])
        before = 1 if w in TITLES else 2 if w in lex.trade or w in LEGAL_FORMS else 3
    if j + 1 < len(found) and found[j + 1][0] - e == 1 and text[e] in BLANKS:
        v = fold(found[j + 1][2])
        follow = 1 if v in lex.trade or v in LEGAL_FORMS else 2 if v in lex.places else 3
    given = found[j if shape == 2 else i][2]
    cases = 0 if surname.isupper() == (given.isupper() and len(given) > 1) else 1 if shape != 3 else int(surname.isupper())
    form = (shape, before, follow, int(folded in lex.trade or folded in LEGAL_FORMS), int(folded in lex.places), int(lex.is_given(surname)), min(len(surname), 3), cases)
    return Span(s, e, "person_name", form, (w, "", v, ""))


def _places(entities: DataFrame, least: int = 3) -> frozenset:
    """Words that follow ``least`` or more different first words in names of places."""
    words = entities.where("entity_type = 'Location' and canonical_name is not null").select(F.split(F.lower("canonical_name"), r"\s+").alias("w")).where("size(w) > 1")
    pairs = words.select(F.col("w")[0].alias("a"), F.explode(F.slice("w", F.lit(2), F.size("w"))).alias("b")).distinct()
    return frozenset(fold(r["b"]) for r in pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") >= least).toLocalIterator())


class Cues:
    """How often candidates beside a word were good ones, in steps from 0 (never) to 5 (over 3 of 10), -1 where the word isn't known."""

    STEPS = (0.0, 0.01, 0.03, 0.1, 0.3)

    def __init__(self, known: dict[tuple[int, str], int]):
        self.known = known

    def of(self, around: Sequence[str]) -> tuple:
        return tuple(self.known.get((place, w), -1) for place, w in enumerate(around))


#: How often a feature row (format, cues) was met with label 0 and with 1: among the rows to fit on and among those held out.
Counts = tuple[dict[tuple, list[int]], dict[tuple, list[int]]]


class Judge:
    """Two sets of trees for one kind; the margins of both to their calibrated thresholds are added."""

    def __init__(self, form: Boosted, context: Boosted, cues: Cues):
        self.form, self.context, self.cues = form, context, cues

    def margin(self, x: Span, cut_off: bool) -> float:
        return self.of_cues(x.form, None if cut_off else self.cues.of(x.around))

    def of_cues(self, form: tuple, c: tuple | None) -> float:
        out = _margin(self.form, form)
        # what a word or two say weighs less than a format seen over the whole corpus
        return out + max(-3.0, min(3.0, _margin(self.context, c))) if c is not None and max(c[:3]) >= 0 else out


def _logit(p: float) -> float:
    return max(-4.0, min(4.0, math.log(max(p, 1e-9) / max(1 - p, 1e-9))))


def _margin(model: Boosted, row: tuple) -> float:
    return _logit(model.score(row)) - _logit(model.threshold)


def _regroup(counts: Counts, change: Callable[[tuple, list[int]], tuple[tuple, list[int]] | None]) -> Counts:
    """The counts after each row and its two numbers were changed, equal rows added up."""
    out: Counts = ({}, {})
    for part, changed in zip(counts, out, strict=True):
        for row, n in part.items():
            new = change(row, n)
            if new:
                m = changed.setdefault(new[0], [0, 0])
                m[0], m[1] = m[0] + new[1][0], m[1] + new[1][1]
    return out


def co_train(counts: Counts, cues: Cues) -> Judge:
    """Context trees from the sure formats, then format trees from what these say of each span's surroundings.

    The sure spans are positives, all others unknown: a telling context has sure ones among its spans, a wrong one has none. So a context is
    accepted from a fifth of what those of sure spans reach.
    """
    contexts = _regroup(counts, lambda row, n: (row[1], n))
    context = fit_counts(*contexts)
    reached = [(context.score(c), n[1]) for part in contexts for c, n in part.items()]
    sure = sum(n for _, n in reached)
    context.threshold = sum(p * n for p, n in reached) / sure / 5 if sure else 0.5

    def told(row: tuple, n: list[int]) -> tuple[tuple, list[int]] | None:
        if max(row[1][:3]) < 0:
            return None
        return row[0], [0, sum(n)] if context.accepts(row[1]) else [sum(n), 0]

    return Judge(fit_counts(*_regroup(counts, told)), context, cues)


def from_register(counts: Counts, cues: Cues) -> Judge:
    """Positives and unknowns: trees on format and context together learn how likely a span is to be registered. Half of what registered
    ones of its shape reach is the threshold, as a name is missing in the register by chance and a span that is no name never is there."""
    rows = _regroup(counts, lambda row, n: (row[0] + row[1], n))
    model = fit_counts(*rows)
    reached: dict[int, list[float]] = {}
    for part in rows:
        for row, n in part.items():
            if n[1]:
                total = reached.setdefault(row[0], [0.0, 0])
                total[0], total[1] = total[0] + n[1] * model.score(row), total[1] + n[1]
    every = sum(n for _, n in reached.values())
    return Whole(model, cues, {shape: p / n / 2 for shape, (p, n) in reached.items()}, sum(p for p, _ in reached.values()) / every / 2 if every else 0.5)


class Whole(Judge):
    def __init__(self, model: Boosted, cues: Cues, thresholds: dict[int, float], otherwise: float):
        self.model, self.cues, self.thresholds, self.otherwise = model, cues, thresholds, otherwise

    def margin(self, x: Span, cut_off: bool) -> float:
        return self.of_cues(x.form, self.cues.of(x.around))

    def of_cues(self, form: tuple, c: tuple) -> float:
        return _logit(self.model.score(form + c)) - _logit(self.thresholds.get(form[0], self.otherwise))


class Redactor:
    def __init__(self, lex: Lexicon, judges: dict[str, Judge]):
        self.lex, self.judges = lex, judges
        self._seen: dict = {}

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """The selected spans, none overlapping: where two compete the more certain wins, then the longer."""
        if not text:
            return []
        chosen = []
        for x in candidates(text, self.lex):
            cut_off = x.start == 0 or x.end == len(text)
            key = (x.kind, x.form, x.around, cut_off)
            m = self._seen.get(key)
            if m is None:
                if len(self._seen) > 200_000:
                    self._seen.clear()
                m = self._seen[key] = self.judges[x.kind].margin(x, cut_off)
            if m >= 0:
                chosen.append((-round(m, 1), x.start - x.end, x.start, x.end, x.kind))
        if len(chosen) < 2:
            return [(s, e, kind) for _, _, s, e, kind in chosen]
        out: list[tuple[int, int, str]] = []
        rank = {"email": 0, "address": 1}
        for _, _, s, e, kind in sorted(chosen, key=lambda c: (rank.get(c[4], 2), *c)):
            if all(e <= a or s >= b for a, b, _ in out):
                out.append((s, e, kind))
        return sorted(out)

    def redact(self, text: str | None) -> str | None:
        """The text with each span replaced by its placeholder, otherwise unchanged; null stays null."""
        if not text:
            return text
        out, at = [], 0
        for s, e, kind in self.spans(text):
            out += [text[at:s], PLACEHOLDERS[kind]]
            at = e
        return "".join(out) + text[at:]


def _proposed(pages: DataFrame, lex: Lexicon) -> DataFrame:
    """The spans proposed in all pages (id, final_text), those of a page delivered twice once: where each stands, its format, the words around it,
    the format of a number, a name as the register writes it, and whether an e-mail address in the same text is made of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(candidates(text, lex))
                addresses = " ".join(fold(text[x.start : x.end]) for x in found if x.kind == "email")
                for x in found:
                    value = text[x.start : x.end]
                    number = name = None
                    addressed = False
                    if x.kind == "person_name":
                        name = _straight(value)
                        if addresses:
                            surname = fold(value.split(", ")[0].split()[-1])
                            addressed = len(surname) > 3 and surname in addresses
                    elif x.kind in ("phone", "id_number"):
                        number = number_format(value)
                    out.append((page, x.start, x.kind, x.form, x.around, x.sure == 1 or addressed, number, name))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)], schema=kinds)

    kinds = pa.schema([("page", pa.int64()), ("start", pa.int32()), ("kind", pa.string()), ("form", pa.list_(pa.int16())), ("around", pa.list_(pa.string())), ("good", pa.bool_()), ("number", pa.string()), ("name", pa.string())])
    texts = pages.where("final_text is not null").select(F.xxhash64("id", "final_text"), "final_text")
    return map_arrow(texts, run, "page bigint, start int, kind string, form array<smallint>, around array<string>, good boolean, number string, name string").distinct()


def _learned_cues(spans: DataFrame) -> dict[str, Cues]:
    """For each kind the words met often enough beside its spans, counted over all of them."""
    words = spans.select("kind", "good", F.posexplode("around").alias("place", "word")).where("word <> ''")
    words = words.groupBy("kind", "place", "word").agg(F.count("*").alias("n"), F.count_if("good").alias("good")).where(F.col("n") >= KNOWN_CUE)
    step = sum((F.col("good") / F.col("n") > s).cast("int") for s in Cues.STEPS)
    known: dict[str, dict] = {k: {} for k in KINDS}
    for kind, place, word, at in words.select("kind", "place", "word", step).toLocalIterator():
        known[kind][place, word] = at
    return {k: Cues(c) for k, c in known.items()}


def _feature_rows(spans: DataFrame, cues: dict[str, Cues]) -> list[tuple]:
    """(kind, form, cues, number, held, good, n): how often each feature row is met, added up within each task first. Every third page is held out.
    Formats and cues are small numbers, so the different rows are bounded by their values and not by the pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*zip(*seen, strict=True), seen.values()], kinds, strict=True)], schema=kinds)

        seen: Counter = Counter()
        for batch in batches:
            for held, kind, form, around, good, number in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                seen[kind, tuple(form), cues[kind].of(around), number, held, good] += 1
            if len(seen) > 300_000:
                yield out(seen)
                seen = Counter()
        if seen:
            yield out(seen)

    kinds = pa.schema([("kind", pa.string()), ("form", pa.list_(pa.int16())), ("cues", pa.list_(pa.int16())), ("number", pa.string()), ("held", pa.bool_()), ("good", pa.bool_()), ("n", pa.int64())])
    rows = map_arrow(spans.select((F.pmod("page", F.lit(3)) == 2).alias("held"), "kind", "form", "around", "good", "number"), run, "kind string, form array<smallint>, cues array<smallint>, number string, held boolean, good boolean, n bigint")
    summed = rows.groupBy("kind", "form", "cues", "number", "held", "good").agg(F.sum("n").alias("n"))
    return sorted((r[0], tuple(r[1]), tuple(r[2]), r[3] or "", r[4], r[5], r[6]) for r in summed.toLocalIterator())


def train(pages: DataFrame, entities: DataFrame, extracted: DataFrame, mentions: DataFrame) -> Redactor:
    """Learn the words from all entities and fit the trees on the spans of all pages (id, final_text).

    Without pages or entities, candidates of that kind are taken by format alone.
    """
    persons = entities.where("entity_type = 'Person'").select(F.col("canonical_name").alias("name"))
    counts = given_names(persons)
    given = frozenset(g for g in set(counts) | set(short_forms(entities, extracted, mentions, counts)) if len(g) > 1)
    trade = frozenset(trade_words(entities.where("entity_type = 'Organization'").select(F.col("canonical_name").alias("name"))))
    lex = Lexicon(given, trade, _places(entities))
    # the texts are searched once for all that is learned
    proposed = cut(_proposed(pages, lex))
    # a name is known from the register, or by an e-mail address in the same text that is made of it
    names = proposed.where("kind = 'person_name'").join(_registered(entities), "name", "left").withColumn("good", F.col("good") | F.col("registered").isNotNull())
    spans = proposed.where("kind <> 'person_name'").unionByName(names.drop("registered")).drop("name")
    cues = _learned_cues(spans)
    by_kind: dict[str, Counts] = {k: ({}, {}) for k in KINDS}
    numbers: Counter = Counter()
    for kind, form, c, number, held, good, n in _feature_rows(spans, cues):
        by_kind[kind][held].setdefault((form, c), [0, 0])[good] += n
        if number:
            numbers[kind, form, c, number] += n
    judges = {k: (from_register if k == "person_name" else co_train)(by_kind[k], cues[k]) for k in KINDS}
    formats: Counter = Counter()
    for (kind, form, c, number), n in numbers.items():
        if judges[kind].of_cues(form, c) >= 0:
            formats[number] += n
    lex.formats = frozenset(f for f, n in formats.items() if n >= 2)
    return Redactor(lex, judges)


def _registered(entities: DataFrame) -> DataFrame:
    """(name, registered): the names of registered persons, in full and with initials."""
    known = entities.where("entity_type = 'Person' and canonical_name is not null").select(F.col("canonical_name").alias("name"))
    w = F.split("name", r"\s+")
    short = known.where(F.size(w) == 2).select(F.concat(F.substring(w[0], 1, 1), F.lit(". "), w[1]).alias("name"))
    return known.unionByName(short).distinct().withColumn("registered", F.lit(True))


def _straight(value: str) -> str:
    """A name in the register's order and case, without middle initials."""
    surname, comma, given = value.partition(", ")
    words = (given.split()[:1] + [surname]) if comma else [w for w in value.split() if not (len(w) == 2 and w[1] == ".") or w == value.split()[0]]
    return " ".join(w.title() if w.isupper() and len(w) > 2 else w for w in words)


def find_spans(texts: DataFrame, redactor: Redactor) -> DataFrame:
    """(table_name, record_id, kind, value) of texts (table_name, record_id, text); a map without shuffle but for dropping repeated rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for name, record, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for s, e, kind in redactor.spans(text):
                    for col, v in zip(out, (name, record, kind, text[s:e]), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["table_name", "record_id", "kind", "value"])

    rows = texts.where("text is not null").select("table_name", "record_id", "text")
    return map_arrow(rows, run, "table_name string, record_id string, kind string, value string").distinct()


def redact_texts(texts: DataFrame, redactor: Redactor) -> DataFrame:
    """(table_name, record_id, text) with placeholders; null texts stay null, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = pa.array([redactor.redact(t) for t in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), clean], names=["table_name", "record_id", "text"])

    return map_arrow(texts.select("table_name", "record_id", "text"), run, "table_name string, record_id string, text string")
