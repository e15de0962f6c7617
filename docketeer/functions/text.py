"""Text functions as Column expressions; Python only where a rule walks along the text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from docketeer.functions import lists


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize(c: Column, keep: str = "") -> Column:
    """Lower case, only a-z, digits, blanks and ``: / . -`` (and ``keep``), single blanks; '' for null."""
    out = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\r\n\t]+", " ")
    return squeeze(F.regexp_replace(out, rf"[^a-z0-9\s:/.{keep}\-]", ""))


def normalize_claim(c: Column) -> Column:
    return normalize(c, "_,")


def token_set(c: Column) -> Column:
    """Distinct tokens of the normalised text without stopwords."""
    return F.array_except(F.array_distinct(F.split(normalize(c), " ")), F.array(*[F.lit(w) for w in ["", *lists.STOPWORDS]]))


def jaccard(a: Column, b: Column) -> Column:
    """0 where either set is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def significant_tokens(c: Column) -> Column:
    """Letter runs of a name of more than two letters, without the words that names share."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1)
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)), F.array(*[F.lit(w) for w in lists.DEDUP_STOPWORDS]))


def initials(c: Column) -> Column:
    """First letters of the words that begin with a capital."""
    return F.array_join(F.transform(F.filter(F.split(c, r"\s+"), lambda w: w.rlike(r"^\p{Lu}")), lambda w: F.substring(w, 1, 1)), "")


def initials_match(short: Column, full: Column) -> Column:
    return (F.length(short) <= 4) & short.rlike(r"\p{L}") & (F.upper(short) == short) & (initials(full) == short)


def _any_suffix(c: Column, suffixes: list[str]) -> Column:
    return c.rlike("(?:" + "|".join(re.escape(s) for s in suffixes) + ")$")


def extractor_noise(name: Column, kind: Column) -> Column:
    """True for extracted names that are no entities: markup, dates, articles, labels, and persons that aren't named like one."""
    n = F.trim(F.coalesce(name, F.lit("")))
    low, tokens = F.lower(n), F.split(F.regexp_replace(n, r"\s+", " "), " ")
    folded = F.transform(tokens, lambda t: F.lower(t))
    person = (F.size(tokens) > 3) | F.arrays_overlap(folded, F.array(*[F.lit(t) for t in lists.NON_NAME_TOKENS])) | F.rtrim(folded[0], F.lit(".")).isin(lists.ROLE_PREFIXES)
    noise = (
        (n == "") | n.contains("--") | n.contains("→") | n.contains("|->") | n.contains("\n") | F.coalesce(kind == "Date", F.lit(False)) | (F.size(tokens) > 6)
        | folded[0].isin(lists.LEADING_WORDS) | ~n.rlike(r"^\p{L}") | low.isin(lists.BLOCKED_NAMES) | _any_suffix(low, lists.NOISE_SUFFIXES)
        | low.rlike("|".join(lists.NOISE_KEYWORDS)) | (F.coalesce(kind == "Person", F.lit(False)) & person)
    )
    return F.coalesce(noise, F.lit(True))


def canonical_noise(name: Column, kind: Column, junk: list[str] | None = None) -> Column:
    """The canonicaliser's own rule: as above without label and keyword lists and role prefixes, with the caller's ``junk`` names."""
    n = F.trim(F.coalesce(name, F.lit("")))
    low, tokens = F.lower(n), F.split(F.regexp_replace(n, r"\s+", " "), " ")
    folded = F.transform(tokens, lambda t: F.lower(t))
    person = (F.size(tokens) > 3) | F.arrays_overlap(folded, F.array(*[F.lit(t) for t in lists.NON_NAME_TOKENS]))
    return (
        (n == "") | n.contains("--") | n.contains("→") | F.coalesce(kind == "Date", F.lit(False)) | low.isin([j.lower() for j in junk or []]) | _any_suffix(low, lists.CANON_NOISE_SUFFIXES)
        | (F.size(tokens) > 6) | ~n.rlike(r"^\p{L}") | folded[0].isin(lists.CANON_LEADING_WORDS) | (F.coalesce(kind == "Person", F.lit(False)) & person)
    )


def _count(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(f"({pattern})"), 1))


def ocr_junk(text: Column, mode: str = "foia") -> Column:
    """True for text that is no prose. Mode ``foia``: redaction codes, number lines, form markers; mode ``case``: only plain garbage."""
    t = F.trim(F.coalesce(text, F.lit("")))
    nt = normalize_claim(t)
    alpha, digits = _count(t, r"\p{L}"), _count(t, r"\p{Nd}")
    digit_heavy = (alpha > 0) & (digits > alpha * 1.5)
    if mode == "foia":
        lines = F.filter(F.transform(F.split(t, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
        numeric = F.size(F.filter(F.slice(lines, 1, 40), lambda x: x.rlike(r"^[\d\s\-~.,]+$")))
        markers = sum((F.when(nt.contains(m), 1).otherwise(0) for m in lists.BOILERPLATE_MARKERS), F.lit(0))
        return (F.length(t) < 20) | (_count(t, r"(?i)\bb[367][a-zA-Z0-9]?\b") >= 12) | (numeric >= 8) | (markers >= 2) | digit_heavy
    codes = sum((_count(nt, code) for code in ("b3", "b6", "b7")), F.lit(0))
    return (F.length(t) < 20) | (F.size(F.split(nt, " ")) < 6) | t.rlike(r"^[\d\s\-~.,]+$") | (codes >= 8) | digit_heavy


def ocr_garbage(text: Column) -> Column:
    """True where over 35 % of the tokens are redaction codes or numbers, or fewer than five are words of four letters or more."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    codes = F.size(F.filter(tokens, lambda t: F.regexp_replace(F.lower(t), r"^[,;\-]+|[,;\-]+$", "").isin(lists.REDACTION_CODES)))
    digits = F.size(F.filter(tokens, lambda t: t.rlike(r"^\d+$")))
    words = F.size(F.filter(tokens, lambda t: t.rlike(r"^\p{L}{4,}$")))
    return (F.size(tokens) == 0) | ((codes + digits) / F.size(tokens) > 0.35) | (words < 5)


def strip_relation_markup(text: Column) -> Column:
    """Without the lines that hold both ``--`` and ``>``."""
    return F.array_join(F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: ~(x.contains("--") & x.contains(">"))), "\n")


def clean_claim_text(text: Column, mode: str = "foia") -> Column:
    """The lines that hold prose, joined; at most 500 characters (``case``: 700), as the rule has it."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    if mode == "foia":
        lines = F.filter(lines, lambda x: ~normalize_claim(x).rlike("|".join(lists.SKIP_LINES)))
    lines = F.filter(lines, lambda x: ~x.rlike(r"^[\d\s\-~.,]+$") & (F.length(normalize_claim(x)) > 2))
    return F.substring(squeeze(F.array_join(lines, " ")), 1, 700 if mode == "case" else 500)


def sentences(text: Column) -> Column:
    """Cut after ``. ! ?`` and blanks, and at line breaks; blank ones leave."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def event_type(predicate: Column, claim_type: Column) -> Column:
    p = normalize(predicate)
    out = None
    for family, words in lists.EVENT_FAMILIES.items():
        cond = p.rlike("|".join(words))
        out = F.when(cond, family) if out is None else out.when(cond, family)
    return out.when(claim_type.isin("allegation", "denial", "observation"), claim_type).otherwise("statement")


def event_key(*parts: Column, cut: int | None = None) -> Column:
    """Normalised parts joined by a bar; the third is cut to ``cut`` characters if given."""
    out = [F.substring(normalize_claim(p), 1, cut) if cut and i == 2 else normalize_claim(p) for i, p in enumerate(parts)]
    return F.concat_ws("|", *out)


def location(text: Column, gazetteer: list[str] | None = None) -> Column:
    """``City, ST`` first, else the first name of the caller's gazetteer, else ''."""
    first = F.regexp_extract(text, r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s*[A-Z]{2})\b", 1)
    if not gazetteer:
        return first
    return F.when(first != "", first).otherwise(F.regexp_extract(text, r"(?i)\b(" + "|".join(map(re.escape, gazetteer)) + r")\b", 1))


def fixed_chunks(text: Column, size: int = 800, overlap: int = 120) -> Column:
    """array<struct<start,chunk>> of windows of ``size`` characters, each ``overlap`` back; null and '' give none."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(text, i + 1, F.lit(size)).alias("chunk")))).otherwise(F.array())


def sanitize_tag(tag: Column) -> Column:
    return F.substring(F.regexp_replace(tag, r"[^\w\-]", "_"), 1, 64)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def like_snippet(text: Column, query: str) -> Column:
    """100 characters to both sides of the first hit, escaped, hits marked; without a hit the first 200 characters."""
    at = F.locate(query.lower(), F.lower(text))
    around = F.substring(text, F.greatest(at - 100, F.lit(1)), F.lit(200 + len(query)))
    marked = F.regexp_replace(html_escape(around), "(?i)(" + re.escape(query) + ")", "<mark>$1</mark>")
    return F.when(at > 0, marked).otherwise(html_escape(F.substring(text, 1, 200)))


def unique_aliases(aliases: Column, more: Column, canonical: Column) -> Column:
    """Both lists in order, each alias once, without the canonical name."""
    empty = F.array().cast("array<string>")
    return F.array_remove(F.array_distinct(F.concat(F.coalesce(aliases, empty), F.coalesce(more, empty))), canonical)


def parse_aliases(c: Column) -> Column:
    """Aliases kept as JSON text: a list, or a plain string that is one alias; null gives none."""
    return F.when(c.isNull() | (F.trim(c) == ""), F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(c, "array<string>"), F.array(c)))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio; 0 where either side is empty. Callers prune pairs before."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def ratio_possible(a: Column, b: Column, least: float) -> Column:
    """An upper bound of the ratio from the lengths alone: 2 min / (la + lb)."""
    return 2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))


@F.pandas_udf(StringType())
def title_case(s: pd.Series) -> pd.Series:
    """Letter runs with a capital first: ``o'neil`` becomes ``O'Neil``, unlike initcap."""
    return s.str.title()


def normalize_entity(raw: Column, kind: Column) -> Column:
    """The stable form of an extracted name, by type."""
    text = squeeze(raw)
    person = title_case(F.regexp_replace(text, r"(?i),?\s+(?:Jr\.?|Sr\.?|II|III|IV|Esq\.?)$", ""))
    return F.when(kind.isin("Aircraft", "Airport"), F.upper(text)).when(kind == "Phone", F.regexp_replace(text, r"[^\d+]", "")).when(kind == "Email", F.lower(text)).when(kind == "Person", person).otherwise(text)


_PASSAGE = ArrayType(StructType([StructField("char_start", IntegerType()), StructField("char_end", IntegerType()), StructField("passage", StringType())]))


@F.pandas_udf(_PASSAGE)
def passages(texts: pd.Series) -> pd.Series:
    """Paragraphs with their places; longer ones than 1,400 characters are packed word by word."""

    def cut(text: str | None) -> list[tuple[int, int, str]]:
        out, at = [], 0
        for part in re.split(r"\n\s*\n", text or ""):
            start = (text or "").find(part, at)
            at = start + len(part)
            body = part.strip()
            if not body:
                continue
            if len(body) <= 1400:
                out.append((start, start + len(part), body))
                continue
            piece: list[str] = []
            size, begin = 0, start
            for word in body.split():
                if piece and size + len(word) + 1 > 1400:
                    joined = " ".join(piece)
                    out.append((begin, begin + len(joined), joined))
                    begin += len(joined) + 1
                    piece, size = [], 0
                piece.append(word)
                size += len(word) + 1
            if piece:
                joined = " ".join(piece)
                out.append((begin, begin + len(joined), joined))
        return out

    return texts.map(cut)


@F.pandas_udf(ArrayType(StringType()))
def sentence_chunks(texts: pd.Series) -> pd.Series:
    """Windows of 512 characters, 64 back; a window ends after its last full stop if that lies beyond its half."""

    def cut(text: str | None) -> list[str]:
        out, at, text = [], 0, text or ""
        while at < len(text):
            end = min(at + 512, len(text))
            stop = text.rfind(". ", at, end) if end < len(text) else -1
            end = stop + 1 if stop > at + 256 else end
            if text[at:end].strip():
                out.append(text[at:end].strip())
            if end >= len(text):
                break
            at = max(end - 64, at + 1)
        return out

    return texts.map(cut)


_VOWELS = "aeiou"


def _is_consonant(w: str, i: int) -> bool:
    return not (w[i] in _VOWELS or (w[i] == "y" and i > 0 and _is_consonant(w, i - 1)))


def _measure(w: str) -> int:
    shape = "".join("c" if _is_consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", shape))


def _ends_cvc(w: str) -> bool:
    return len(w) > 2 and _is_consonant(w, len(w) - 1) and not _is_consonant(w, len(w) - 2) and _is_consonant(w, len(w) - 3) and w[-1] not in "wxy"


# The suffix tables of Porter's published algorithm.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def porter_stem(w: str) -> str:
    """Porter's 1980 stemmer for words of lower-case letters."""
    if len(w) <= 2:
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            stem = w[: -len(end)]
            if w.endswith(end) and any(not _is_consonant(stem, i) for i in range(len(stem))):
                if stem.endswith(("at", "bl", "iz")):
                    stem += "e"
                elif len(stem) > 1 and stem[-1] == stem[-2] and _is_consonant(stem, len(stem) - 1) and stem[-1] not in "lsz":
                    stem = stem[:-1]
                elif _measure(stem) == 1 and _ends_cvc(stem):
                    stem += "e"
                w = stem
                break
    if w.endswith("y") and any(not _is_consonant(w, i) for i in range(len(w) - 1)):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for rule in sorted(table, key=lambda r: -len(r.split(":")[0])):
            end, new = rule.split(":")
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted([*_STEP4, "sion", "tion"], key=lambda e: -len(e)):
        if w.endswith(end):
            stem = w[: -len(end)] if end not in ("sion", "tion") else w[:-3]
            if _measure(stem) > 1:
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_cvc(stem)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(ArrayType(StringType()))
def stems(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Porter stems of a text's letter and digit runs, in order; each spelling is stemmed once for a task."""
    known: dict[str, str] = {}
    run = re.compile(r"[a-z0-9]+")

    def of(text: str | None) -> list[str]:
        out = []
        for w in run.findall((text or "").lower()):
            if w not in known:
                known[w] = porter_stem(w) if w.isalpha() else w
            out.append(known[w])
        return out

    for batch in texts:
        yield batch.map(of)
