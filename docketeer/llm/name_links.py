"""Problem 2: variant spellings of one person's or organisation's name.

Suffix blocking: every token that tells a name (surname, given name, an organisation's own token) is indexed by its suffixes,
read from either end, from half of its length on, so that a token with one slip keeps one of them whole. A suffix is refined by
another field a variant must agree in (the initial of the given name, one of the other words). Suffixes that are overly common even so are discarded for keys
that are refined by all fields (all ways to leave letters out of the token, the given name, the other words), which lose no
pair that the comparison would accept. Pairs that share a key are compared by longest common subsequence.

Given names, their short forms and the words organisations share are learned from the tables; none is listed here.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketeer.runtime import cut, lookup_side, map_arrow

#: An indexed suffix has half of its token's letters, at most this many.
SUFFIX = 5
#: Names in a block beyond which its suffix counts as overly common.
COMMON = 3_000
#: Names in which a word must occur to be learned.
LEAST = 3

#: Fixed values.
TITLES = frozenset(["mr", "mrs", "ms", "miss", "dr", "hon", "atty", "prof", "sir", "judge", "agent", "officer", "counsel"])
NAME_ENDINGS = frozenset(["jr", "sr", "ii", "iii", "iv", "esq"])
LEGAL_FORMS = frozenset(["inc", "incorporated", "ltd", "limited", "llc", "llp", "lp", "corp", "corporation", "co", "company", "plc", "the", "and"])
_LETTERS = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d"})


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower().translate(_LETTERS)) if not unicodedata.combining(c))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one big-integer step for each character of ``b``."""
    if a == b:
        return len(a)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def lcs_ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def near(a: str, b: str) -> float:
    """The LCS ratio if the words differ by no more than one slip (two in long ones), else 0."""
    if a == b:
        return 1.0
    short, long = sorted((len(a), len(b)))
    slips = long - lcs(a, b)
    if short < 4 or slips > (2 if short >= 9 else 1):
        return 0.0
    return lcs_ratio(a, b)


@dataclass(frozen=True)
class Parsed:
    kind: str
    #: Person: (given, surname) in each order that the name may have. Organisation: the telling token, once with each reading.
    readings: tuple[tuple[str, str], ...]
    middle: str = ""
    words: tuple[frozenset, ...] = field(default=())
    acronym: str = ""


class Parser:
    """Reads names with the help of word lists learned from the names themselves."""

    def __init__(self, given: set[str], trade: set[str], short: dict[str, frozenset] | None = None):
        self.given, self.trade, self.short = given, trade, short or {}
        self._sorted = sorted(given)
        self._words: dict[str, frozenset] = {}
        self._full: dict[str, frozenset] = {}

    def full_given(self, t: str) -> frozenset:
        """The given names that ``t`` may stand for: itself, those it shortens, those that begin with it."""
        if t not in self._full:
            known = self.short.get(t, frozenset())
            if t in self.given:
                known = known | {t}
            elif len(t) > 1:
                known = known | set(self._sorted[bisect_left(self._sorted, t) : bisect_left(self._sorted, t + "\uffff")])
            self._full[t] = frozenset(known)
        return self._full[t]

    def trade_words(self, t: str) -> frozenset:
        """The common words of organisations' names that ``t`` is, abbreviates or misspells."""
        if t not in self._words:
            out = {t} if t in self.trade else {w for w in self.trade if w[0] == t[0] and len(t) < len(w) - 1 and (len(t) <= 5 or len(t) < len(w) - 2) and lcs(t, w) == len(t)}
            self._words[t] = frozenset(out or {w for w in self.trade if len(t) > 3 and near(t, w)})
        return self._words[t]

    def parse(self, name: str, kind: str | None) -> Parsed | None:
        raw = re.sub(r"(?<=[a-zß-öø-ÿ])(?=[A-Z])", " ", name) if " " in name else name
        text = fold(raw)
        tokens = [t for t in re.sub(r"[^\w\s,&]", "", text).replace("_", " ").split() if t != "&"]
        bare = [t.strip(",").replace(",", "") for t in tokens]
        org = kind == "Organization" or kind != "Person" and (any(t in self.trade or t in LEGAL_FORMS for t in bare) or sum(bool(len(t) > 2 and self.trade_words(t)) for t in bare) > 1)
        if kind != "Person" and re.fullmatch(r"[A-Z]{2,5}", name):
            return Parsed("O", (), acronym=name.lower())
        return self._org(bare) if org else self._person(tokens, bare)

    def _org(self, bare: list[str]) -> Parsed | None:
        core = [t for i, t in enumerate(bare) if t and t not in LEGAL_FORMS and not (i and len(t) > 6 and any(near(t, w) for w in ("incorporated", "corporation", "company", "limited")))]
        if not core:
            return None
        known = [self.trade_words(t) for t in core]
        own = [i for i, k in enumerate(known) if not k] or [0]
        # one token tells the organisation; more unknown ones are read as part of it
        telling = "".join(core[i] for i in own)
        words = tuple(k for i, k in enumerate(known) if i not in own)
        return Parsed("O", (("", telling),), words=words, acronym="".join(t[0] for t in core) if own == [0] and len(core) > 1 else "")

    def _person(self, tokens: list[str], bare: list[str]) -> Parsed | None:
        comma = next((i for i, t in enumerate(tokens) if t.endswith(",")), None)
        if comma is not None and any(t in NAME_ENDINGS for t in bare[comma + 1 :]) and not [t for t in bare[comma + 1 :] if t and t not in NAME_ENDINGS]:
            comma = None
        parts = [(i, t) for i, t in enumerate(bare) if t and t not in TITLES and t not in NAME_ENDINGS]
        if comma is not None:
            parts = [p for p in parts if p[0] > comma] + [p for p in parts if p[0] <= comma]
        words = [t for _, t in parts]
        long = [t for t in words if len(t) > 1]
        if not 1 <= len(long) <= 3 or len(words) < 2:
            return None
        if len(long) == 1:
            initial = next(t for t in words if len(t) == 1)
            return Parsed("P", ((initial, long[0]),))
        middle = next((t for t in words[1:] if len(t) == 1), "") if len(words[0]) > 1 else ""
        given, surname = long[0], "".join(long[1:])
        if comma is not None or given in self.given or given in self.short:
            return Parsed("P", ((given, surname),), middle)
        return Parsed("P", ((given, surname), (surname, given)), middle)


def pieces(t: str) -> set[str]:
    """A token's indexed suffixes ('<') and, read backwards, beginnings ('>'): of tokens that differ by one slip, one such piece is the same in both.

    Tokens in which two slips are allowed have pieces of a third of their length as well, the middle one ('=') at each place to which slips before it can move it.
    """
    n = len(t)
    out = {f"{end}{t[-h:] if end == '<' else t[:h]}" for h in {max(1, min(SUFFIX, k)) for k in ((n - 1) // 2, n // 2)} for end in "<>"}
    if n >= 9:
        for h in {min(SUFFIX, k) for k in ((n - 2) // 3, (n - 1) // 3, n // 3)}:
            out |= {f"<{t[-h:]}", f">{t[:h]}"} | {f"={t[i : i + h]}" for i in range(h - 1, n - 2 * h + 2)}
    return out


#: Which side of a pair a key is for: the known names', the others', or either.
BOTH, KNOWN, OTHER = "b", "k", "o"


def block_keys(p: Parser, n: Parsed) -> list[tuple[str, str]]:
    """(key, side): suffixes of the telling tokens from either end, refined by the initial of the given name or by a word that organisations share; of given names, refined by the surname."""
    if n.kind == "O":
        shared = {w for ws in n.words for w in ws} or {""}
        out = [(f"o{piece} {w}", BOTH) for _, t in n.readings for piece in pieces(t) for w in shared]
        if n.acronym:
            # an acronym meets names in full, and names in full don't meet by it
            out += [(f"oa{n.acronym}", KNOWN), (f"oA{n.acronym}", OTHER)] if n.readings else [(f"oA{n.acronym}", KNOWN), (f"oa{n.acronym}", OTHER)]
        return out
    out = []
    for g, s in n.readings:
        full = p.full_given(g)
        for i in {g[0]} | {f[0] for f in full}:
            out += [(f"p{piece[0]}{i}{piece[1:]}", BOTH) for piece in pieces(s)]
        if len(g) > 1:
            out += [(f"pg{piece} {s[:3]}", BOTH) for f in full | {g} for piece in pieces(f) if piece[0] == "<"]
    return list(dict.fromkeys(out))


def left_out(t: str, slips: int) -> set[str]:
    """The token with up to ``slips`` letters left out: two tokens with no more slips between them share one."""
    return {"".join(t[i] for i in range(len(t)) if i not in gone) for k in range(slips + 1) for gone in combinations(range(len(t)), k)}


def refined_keys(p: Parser, n: Parsed, key: str) -> list[tuple[str, str]]:
    """(key, side) that take an overly common key's place: refined by all that the comparison asks for, so that no pair it accepts is lost."""
    if key[:2] in ("oa", "oA"):
        return [(key, OTHER if (key[1] == "A") == bool(n.readings) else KNOWN)]
    if n.kind == "O":
        return [(f"{key}|{v}", BOTH) for _, t in n.readings for v in left_out(t, 2 if len(t) >= 9 else 1)]
    out = []
    for g, s in n.readings:
        sides = [("1", KNOWN), ("1", OTHER), ("2", OTHER)] if len(g) == 1 else [("2", KNOWN), ("1", OTHER)]
        given = {v for f in p.full_given(g) | {g} for v in left_out(f, 2 if len(f) >= 9 else 1)} if len(g) > 1 else set()
        for v in left_out(s, 2 if len(s) >= 9 else 1):
            # names with an initial only meet all others; these meet by their given names
            out += [(f"{key}|{v}|{x}", side) for x, side in sides] + [(f"{key}|{v}|{x}=", BOTH) for x in given]
    return list(dict.fromkeys(out))


def same(p: Parser, a: Parsed, b: Parsed) -> float:
    """Likeness from 0 (no link) to 1."""
    if a.kind != b.kind:
        return 0.0
    if a.kind == "O":
        if not a.readings or not b.readings:
            return 0.0
        telling = near(a.readings[0][1], b.readings[0][1])
        short, long = sorted((a.words, b.words), key=len)
        if not telling or (not short and long):
            return 0.0
        left = list(long)
        for w in short:
            hit = next((x for x in left if x & w), None)
            if hit is None:
                return 0.0
            left.remove(hit)
        return telling if len(short) == len(long) else telling * 0.95
    if a.middle and b.middle and a.middle != b.middle:
        return 0.0
    best = 0.0
    for g1, s1 in a.readings:
        for g2, s2 in b.readings:
            sur = near(s1, s2)
            if not sur:
                continue
            f1, f2 = p.full_given(g1), p.full_given(g2)
            if len(g1) == 1 or len(g2) == 1:
                i1, i2 = {g1[0]} | {f[0] for f in f1}, {g2[0]} | {f[0] for f in f2}
                given = 0.9 if i1 & i2 and (sur == 1 or len(s1) > 5) else 0.0
            elif g1 == g2 or f1 & f2:
                given = 1.0
            elif f1 and f2:
                given = 0.0
            else:
                given = max([near(g1, g2)] + [near(g1, f) for f in f2] + [near(f, g2) for f in f1])
            if given and sur + given > 1.6:
                best = max(best, (sur + given) / 2)
    return best


def _words_in(name: str) -> Column:
    """A name's words in plain lower-case letters; commas and full stops leave, accents stay until they are folded."""
    return F.filter(F.split(F.regexp_replace(F.lower(name), r"[^\p{L}\p{M}\p{N}\s]", ""), r"\s+"), lambda w: w != "")


def _without_variants(counts: dict[str, int], shortened, ratio: int = 5) -> dict[str, int]:
    """Words that are no slip in, and not ``shortened`` from, another word ``ratio`` times as frequent."""
    near_by: dict[str, list[str]] = {}
    for w in counts:
        for v in left_out(w, 1):
            near_by.setdefault(v, []).append(w)
    starts: dict[str, list[str]] = {}
    for w in counts:
        starts.setdefault(w[0], []).append(w)
    out = {}
    for w, n in counts.items():
        if not any(counts[x] >= ratio * n and near(w, x) for v in left_out(w, 1) for x in near_by[v]) and not any(counts[x] >= ratio * n and shortened(w, x) for x in starts[w[0]]):
            out[w] = n
    return out


def given_names(persons: DataFrame) -> dict[str, int]:
    """Given names, with their counts, of ``persons`` (name): words that begin LEAST names or more with different ends, and oftener begin names than end them.

    The rule knows no share of the table, so unrelated names change nothing. A name has one given name, and given names are few against names.
    """
    plain = persons.where("name is not null and name not like '%,%'").select(F.filter(_words_in("name"), lambda w: ~w.isin(sorted(TITLES | NAME_ENDINGS))).alias("w")).where("size(w) > 1")
    ends = plain.select(F.col("w")[0].alias("a"), F.element_at("w", -1).alias("b")).where("length(a) > 1 and length(b) > 1").distinct()
    first, last = ends.groupBy(F.col("a").alias("w")).agg(F.count("*").alias("n")), ends.groupBy(F.col("b").alias("w")).agg(F.count("*").alias("m"))
    kept = first.where(F.col("n") >= LEAST).join(last, "w", "left").where("n >= 2 * coalesce(m, 0)")
    counts: dict[str, int] = {}
    for r in kept.select("w", "n").toLocalIterator():
        counts[fold(r["w"])] = counts.get(fold(r["w"]), 0) + r["n"]
    return _without_variants(counts, lambda w, x: len(w) < len(x) and x.startswith(w))


def trade_words(organisations: DataFrame) -> set[str]:
    """Words that follow LEAST or more different first words in names of ``organisations`` (name)."""
    words = organisations.where("name is not null").select(F.filter(_words_in("name"), lambda w: ~w.isin(sorted(LEGAL_FORMS))).alias("w")).where("size(w) > 1")
    pairs = words.select(F.col("w")[0].alias("a"), F.explode(F.slice("w", F.lit(2), F.size("w"))).alias("b")).distinct()
    counts: dict[str, int] = {}
    for r in pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).toLocalIterator():
        w = re.sub(r"[^\w]", "", fold(r["b"]))
        if w:
            counts[w] = counts.get(w, 0) + r["n"]
    return set(_without_variants(counts, lambda w, x: len(w) < len(x) - 1 and lcs(w, x) == len(w))) - LEGAL_FORMS


def short_forms(entities: DataFrame, extracted: DataFrame, mentions: DataFrame | None, given: dict[str, int], least: int = 2, share: float = 0.2) -> dict[str, frozenset]:
    """Short form -> given names it stands for: it stands with the same surname as they do, as an alias, in a document that mentions that
    person, or where no other given name has that surname, for ``least`` surnames or more and in ``share`` of its such cases. Slips and
    beginnings of a given name aren't learned."""

    def ends(df: DataFrame, name: str, *keep: str) -> DataFrame:
        words = F.filter(_words_in(name), lambda w: (F.length(w) > 1) & ~w.isin(sorted(TITLES | NAME_ENDINGS)))
        turned = F.when(F.col(name).contains(","), F.array_append(F.slice(words, 2, 9), words[0])).otherwise(words)
        return df.where(f"{name} is not null").select(*keep, turned.alias("w")).where("size(w) = 2").select(*keep, F.col("w")[0].alias("g"), F.col("w")[1].alias("s")).distinct()

    persons = entities.where("entity_type = 'Person'")
    known = ends(persons, "canonical_name", "id")
    # a surname that many share has several given names, so this join has one row for each record
    only = known.select("s", "g").distinct().groupBy("s").agg(F.min("g").alias("g"), F.count("*").alias("n")).where("n = 1").select("s", "g")
    others = ends(extracted.where("entity_type = 'Person'"), "raw_name").toDF("short", "s")
    parts = [others.join(only, "s").select("short", "g", "s")]
    if "aliases" in entities.columns:
        alias = ends(persons.select("id", F.explode("aliases").alias("alias")), "alias", "id").toDF("id", "short", "s")
        parts.append(alias.join(known, ["id", "s"]).select("short", "g", "s"))
    if mentions is not None:
        records = ends(extracted.where("entity_type = 'Person' and document_id is not null"), "raw_name", "document_id").toDF("document_id", "short", "s")
        there = mentions.select("document_id", F.col("entity_id").alias("id")).distinct().join(known, "id").select("document_id", "g", "s")
        parts.append(records.join(there, ["document_id", "s"]).select("short", "g", "s"))
    seen = parts[0]
    for p in parts[1:]:
        seen = seen.unionByName(p)
    counts = cut(seen.where("short <> g").distinct().groupBy("short", "g").agg(F.count("*").alias("n")))
    total = counts.groupBy("short").agg(F.sum("n").alias("all"))
    # few: pairs of given names, whatever the number of persons
    out: dict[str, set] = {}
    for r in counts.where(F.col("n") >= least).join(total, "short").where(F.col("n") >= share * F.col("all")).toLocalIterator():
        a, b = fold(r["short"]), fold(r["g"])
        if given.get(b, 0) > given.get(a, 0) and not near(a, b) and not b.startswith(a):
            out.setdefault(a, set()).add(b)
    return {a: frozenset(bs) for a, bs in out.items()}


def link_names(entities: DataFrame, extracted: DataFrame, mentions: DataFrame | None = None, nicknames: dict[str, frozenset] | None = None, common: int = COMMON) -> DataFrame:
    """(id_a, id_b, score), id_a < id_b: records of one person or organisation whose names aren't equal character for character.

    Both in ``entities`` (id, entity_type, canonical_name), or one in ``extracted`` (id, entity_type, raw_name, document_id). Names are compared
    once for each distinct spelling, then spread to their records. An acronym is linked to the organisation with these initials that is mentioned in
    the record's document (``mentions``: entity_id, document_id), or to the only one there is. ``nicknames`` (short form -> given names) takes
    the place of the short forms learned from the tables. ``common`` decides when keys are refined and never changes the pairs. Null, blank and
    non-name values, other types and empty tables give no rows; repeated rows count once.
    """
    spark = entities.sparkSession
    ents = entities.where(F.col("entity_type").isin("Person", "Organization")).select("id", F.col("entity_type").alias("kind"), F.col("canonical_name").alias("name")).distinct()
    counts, trade = given_names(ents.where("kind = 'Person'")), trade_words(ents.where("kind = 'Organization'"))
    short, given = short_forms(entities, extracted, mentions, counts) if nicknames is None else nicknames, set(counts)
    kinds = F.when(F.col("entity_type").isin("Person", "Organization"), F.col("entity_type")).when(F.col("entity_type").isin("Location", "Aircraft"), F.lit("-")).otherwise(F.lit("?"))
    xtrs = extracted.select("id", kinds.alias("kind"), F.col("raw_name").alias("name"), "document_id").where("kind <> '-'").distinct()
    named = "name is not null and trim(name) <> ''"
    spellings = ents.where(named).select("kind", "name").distinct().withColumn("known", F.lit(True)).unionByName(xtrs.where(named).select("kind", "name").distinct().withColumn("known", F.lit(False)))
    spellings = spellings.groupBy("kind", "name").agg(F.max("known").alias("known"))

    def keyed_by(fields: int, keys_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = Parser(given, trade, short)
            for batch in batches:
                rows = []
                for kind, name, known, *key in zip(*(batch.column(i).to_pylist() for i in range(fields)), strict=True):
                    parsed = p.parse(name, None if kind == "?" else kind)
                    if parsed:
                        rows += [(kind, name, known, k, side) for k, side in keys_of(p, parsed, *key) if known or side != KNOWN]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if i == 2 else pa.string()) for i, c in enumerate(cols)], names=["kind", "name", "known", "key", "side"])

        return run

    # the work is in the names rather than in their bytes: as many tasks as cores, so that AQE doesn't join them into one
    tasks = max(spark.sparkContext.defaultParallelism, spellings.count() // 20_000)
    ddl = "kind string, name string, known boolean, key string, side string"
    keyed = cut(map_arrow(spellings.repartition(tasks), keyed_by(3, block_keys), ddl))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > common).select("key", F.lit(True).alias("common"))
    sized = keyed.join(lookup_side(cut(sizes)), "key", "left")
    refined = sized.where("common").select("kind", "name", "known", "key").distinct()
    refined = map_arrow(refined, keyed_by(4, refined_keys), ddl)
    keyed = sized.where("common is null").select("kind", "name", "known", "key", "side").unionByName(refined)
    known = keyed.where(f"known and side <> '{OTHER}'").select("key", F.col("kind").alias("kind_a"), F.col("name").alias("name_a"))
    other = keyed.where(f"side <> '{KNOWN}'").select("key", F.col("kind").alias("kind_b"), F.col("name").alias("name_b"), F.col("known").alias("known_b"))
    # a pair of known names that meet by a key for both sides comes up from both; one is enough
    met = known.join(other, "key").where("name_a <> name_b")
    swap = (F.col("known_b") & (F.col("kind_b") != "?") & (F.col("name_a") > F.col("name_b")))
    pairs = met.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("kind_a", "kind_b"), ("name_a", "name_b"))], *[F.when(swap, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("kind_a", "kind_b"), ("name_a", "name_b"))]).distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Parser(given, trade, short)
        seen: dict[tuple, Parsed | None] = {}

        def parsed(kind: str, name: str) -> Parsed | None:
            if (kind, name) not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen[kind, name] = p.parse(name, None if kind == "?" else kind)
            return seen[kind, name]

        for batch in batches:
            rows = []
            for ka, na, kb, nb in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                a, b = parsed(ka, na), parsed(kb, nb)
                acronym = a.kind == b.kind == "O" and a.acronym == b.acronym != "" and not (a.readings and b.readings)
                score = same(p, a, b)
                if score or acronym:
                    rows.append((ka, na, kb, nb, score, acronym and not score, (a.readings or b.readings)[0][1][:4] if acronym and (a.readings or b.readings) else ""))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols[:4]] + [pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.string())], names=["kind_a", "name_a", "kind_b", "name_b", "score", "acronym", "telling"])

    linked = cut(map_arrow(pairs, compare, "kind_a string, name_a string, kind_b string, name_b string, score double, acronym boolean, telling string"))
    spelled = linked.where("not acronym")
    a = ents.select(F.col("id").alias("id_1"), F.col("kind").alias("kind_a"), F.col("name").alias("name_a"))
    b_ent = ents.select(F.col("id").alias("id_2"), F.col("kind").alias("kind_b"), F.col("name").alias("name_b"))
    b_xtr = xtrs.select(F.col("id").alias("id_2"), F.col("kind").alias("kind_b"), F.col("name").alias("name_b"))
    found = spelled.join(a, ["kind_a", "name_a"]).join(b_ent.unionByName(b_xtr), ["kind_b", "name_b"]).select("id_1", "id_2", "score")
    found = found.unionByName(_acronyms(spark, linked.where("acronym"), a, b_ent, xtrs, mentions))
    return found.where("id_1 <> id_2").groupBy(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b")).agg(F.max("score").alias("score"))


def _acronyms(spark, linked: DataFrame, a: DataFrame, b_ent: DataFrame, xtrs: DataFrame, mentions: DataFrame | None) -> DataFrame:
    """An acronym fits many organisations as they grow in number; its document decides, else it must be the only one."""
    alone = linked.withColumn("short", F.when(F.length("name_a") < F.length("name_b"), F.col("name_a")).otherwise(F.col("name_b"))).groupBy("short").agg(F.count_distinct("telling").alias("n"))
    alone = alone.where("n = 1").select("short")
    ent_pairs = linked.join(a, ["kind_a", "name_a"]).join(b_ent, ["kind_b", "name_b"]).withColumn("short", F.when(F.length("name_a") < F.length("name_b"), F.col("name_a")).otherwise(F.col("name_b")))
    out = ent_pairs.join(alone, "short", "left_semi").select("id_1", "id_2", F.lit(0.8).alias("score"))
    records = xtrs.select(F.col("id").alias("id_2"), F.col("kind").alias("kind_b"), F.col("name").alias("name_b"), "document_id")
    cases = cut(linked.join(records, ["kind_b", "name_b"]).join(a, ["kind_a", "name_a"]).where("name_b = upper(name_b) and not name_b like '% %'").select("id_1", "id_2", "document_id", F.col("name_b").alias("short")))
    if mentions is not None:
        there = mentions.select(F.col("entity_id").alias("id_1"), "document_id").join(lookup_side(cases.select("document_id").distinct()), "document_id", "left_semi").distinct()
        told = cut(cases.join(there, ["id_1", "document_id"]).select("id_1", "id_2", "short").distinct())
        # other rows of the organisation that the document names have its link as well, if no other organisation competes
        rest = cases.join(told.select("id_2").distinct(), "id_2", "left_anti")
        out = out.unionByName(told.select("id_1", "id_2", F.lit(0.9).alias("score")))
        mine = cases.join(told.select("id_2").distinct(), "id_2", "left_semi").join(alone, "short", "left_semi")
        out = out.unionByName(mine.select("id_1", "id_2", F.lit(0.85).alias("score")))
    else:
        rest = cases
    return out.unionByName(rest.join(alone, "short", "left_semi").select("id_1", "id_2", F.lit(0.7).alias("score")))
