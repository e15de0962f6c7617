"""Extraction of entities, relationships and claims from text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketeer.functions import lists
from docketeer.functions import text as T
from docketeer.runtime import map_arrow, ship

_OUT = "document_id string, page_number int, entity_type string, raw_name string, char_start int, char_end int, context string, confidence double"


def regex_entities(pages: DataFrame, exclude_airports: frozenset[str] = frozenset(), kinds: tuple[str, ...] | None = None, extra: Callable[[str], list[tuple[str, str, int, int, float]]] | None = None) -> DataFrame:
    """Every match of the typed patterns in pages (document_id, page_number, text), with its place and 150 characters around.

    Python's regular expressions give the places; batches go through Arrow. ``extra`` is a caller's extractor (a language model, say) whose
    hits are added. Null texts give none; repeated pages count once.
    """
    rows = pages.where("text is not null").select("document_id", "page_number", "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [(kind, re.compile(p, re.I if fold else 0), conf) for kind, p, fold, conf in lists.PATTERNS if not kinds or kind in kinds]
        for batch in batches:
            out: list[tuple] = []
            for doc, page, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hits = [(kind, m[0].strip(), m.start(), m.end(), conf) for kind, p, conf in patterns for m in p.finditer(text) if m[0].strip() and not (kind == "Airport" and m[0].strip().upper() in exclude_airports)]
                for kind, raw, s, e, conf in hits + (list(extra(text)) if extra else []):
                    out.append((doc, page, kind, raw, s, e, text[max(0, s - 150) : e + 150], conf))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in _OUT.split(", ")])

    return map_arrow(rows, run, _OUT)


def pattern_counts(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, kind, value, n): e-mail addresses, domains, IPv4 shapes, ISO dates and capitalised words by built-ins alone; domains match inside addresses too."""
    shapes = {
        "email": r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})", "domain": r"\b((?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,})\b", "ip": r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b",
        "date": r"\b((?:19|20)\d{2}-\d{2}-\d{2})\b", "word": r"\b([A-Z][A-Za-z0-9_\-]{2,})\b",
    }

    def tagged(kind: str):
        return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))

    hits = F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(p), 1), tagged(k)) for k, p in shapes.items()]))
    return texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.explode(hits).alias("h")).groupBy("key", "h.kind", "h.value").agg(F.count("*").alias("n"))


def upsert_entities(found: DataFrame) -> DataFrame:
    """(entity_type, canonical_name, confidence, aliases): one row for each name and type; the first hit's confidence, all other spellings as aliases."""
    named = found.withColumn("canonical_name", T.normalize_entity(F.col("raw_name"), F.col("entity_type"))).where("canonical_name <> ''")
    out = named.groupBy("entity_type", "canonical_name").agg(F.min_by("confidence", F.struct("document_id", "page_number", "char_start")).alias("confidence"), F.array_sort(F.collect_set("raw_name")).alias("aliases"))
    return out.withColumn("aliases", F.array_remove("aliases", F.col("canonical_name")))


def typed_relationships(pages: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(document_id, a, b, kind, confidence): entities named on the same page are ``mentioned_with`` (.65); the two names around ``v.`` are ``filed_against`` (.72). The best kind of each pair."""
    seen = mentions.select("document_id", "page_number", "entity_id").distinct()
    lists_ = seen.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list("entity_id")).alias("e"))
    pairs = lists_.select("document_id", "e", F.explode(F.sequence(F.lit(1), F.size("e"))).alias("i")).where(F.col("i") < F.size("e"))
    with_ = pairs.select("document_id", F.element_at("e", F.col("i")).alias("a"), F.explode(F.slice("e", F.col("i") + 1, F.size("e"))).alias("b")).distinct()
    with_ = with_.withColumn("kind", F.lit("mentioned_with")).withColumn("confidence", F.lit(0.65))
    sides = pages.where("final_text is not null").select("document_id", F.explode(F.regexp_extract_all("final_text", F.lit(r"(?m)^([A-Z][\w.&' \-]+? v\. [A-Z][\w.&' \-]+?)(?= —|,|$)"), 1)).alias("t")).distinct()
    sides = sides.select("document_id", F.split("t", r" v\. ")[0].alias("x"), F.split("t", r" v\. ")[1].alias("y"))
    byname = entities.groupBy(F.col("canonical_name").alias("x")).agg(F.min("id").alias("a"))
    filed = sides.join(byname, "x").join(byname.toDF("y", "b"), "y").where("a <> b").select("document_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit("filed_against").alias("kind"), F.lit(0.72).alias("confidence"))
    both = with_.unionByName(filed)
    return both.groupBy("document_id", "a", "b").agg(F.max_by("kind", "confidence").alias("kind"), F.max("confidence").alias("confidence"))


def upsert_relationships(typed: DataFrame) -> DataFrame:
    """(a, b, kind, confidence, document_id, weight, doc_count): the best kind of each pair over all documents, of equal ones the last document's."""
    best = typed.groupBy("a", "b").agg(F.max_by(F.struct("kind", "confidence", "document_id"), F.struct("confidence", "document_id")).alias("s"))
    return best.select("a", "b", "s.kind", "s.confidence", "s.document_id", F.lit(1).alias("weight"), F.lit(1).alias("doc_count"))


def merge_found(regex: DataFrame, model: DataFrame) -> DataFrame:
    """Regular expressions' and a model's findings (as regex_entities) in one table: where the model covers a type at all in a document's page, the
    expressions' findings of that type count only where the model found nothing that overlaps; noise leaves both."""
    key = ["document_id", "page_number", "entity_type"]
    hit = model.select(*key, F.col("char_start").alias("s"), F.col("char_end").alias("e"))
    extra = regex.join(hit, key, "left").groupBy(*regex.columns).agg(F.max(F.coalesce((F.col("char_start") < F.col("e")) & (F.col("s") < F.col("char_end")), F.lit(False))).alias("met")).where("not met").drop("met")
    return model.unionByName(extra).where(~T.extractor_noise(F.col("raw_name"), F.col("entity_type")))


def heuristic_claims(pages: DataFrame, mentions: DataFrame, entities: DataFrame, per_page: int = 50) -> DataFrame:
    """(document_id, page_number, sentence_no, claim_text, names): sentences of 30 characters or more that hold two names known from the document.

    Names meet sentences through the page's own mentions, so a page is compared with its entities only.
    """
    text = F.coalesce("final_text", "ocr_text")
    sent = pages.where(text.isNotNull()).select("document_id", "page_number", F.posexplode(F.split(text, r"(?<=[.!?])\s+")).alias("sentence_no", "claim_text")).distinct()
    sent = sent.withColumn("claim_text", F.trim("claim_text")).where(F.length("claim_text") >= 30)
    names = mentions.select("document_id", "page_number", "entity_id").distinct().join(entities.select(F.col("id").alias("entity_id"), F.lower("canonical_name").alias("name")), "entity_id")
    names = names.groupBy("document_id", "page_number").agg(F.collect_set("name").alias("known"))
    hits = sent.join(names, ["document_id", "page_number"]).withColumn("names", F.size(F.filter("known", lambda n: F.contains(F.lower("claim_text"), n)))).where("names >= 2")
    from docketeer.operators.graph import rank_in

    kept = rank_in(hits, ["document_id", "page_number"], ["sentence_no", "claim_text"], per_page)
    return kept.select("document_id", "page_number", "sentence_no", F.substring("claim_text", 1, 500).alias("claim_text"), "names")


def statement_claims(texts: DataFrame, key: str = "id", text: str = "text", most: int = 8) -> DataFrame:
    """(key, passage, no, subject, predicate, object, claim_type, polarity): who stated, denied, met or travelled, by five sentence shapes; at most ``most`` of each
    passage of the text, as the rule has it. Null and empty texts have none."""
    shapes = [
        (r"according to ([A-Z][A-Za-z .'\-]+),\s*(.+?)[.;]", "stated", "statement", "affirmed"), (r"([A-Z][A-Za-z .'\-]+) stated that (.+?)[.;]", "stated", "statement", "affirmed"),
        (r"([A-Z][A-Za-z .'\-]+) denied (.+?)[.;]", "denied", "denial", "denied"), (r"([A-Z][A-Za-z .'\-]+) met with ([A-Z][A-Za-z .'\-]+)", "met_with", "meeting", "affirmed"),
        (r"([A-Z][A-Za-z .'\-]+) traveled to ([A-Z][A-Za-z ,'\-]+)", "traveled_to", "travel", "affirmed"),
    ]

    def hits(pattern: str, predicate: str, kind: str, polarity: str) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("s"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("o"))
        return F.transform(pairs, lambda p: F.struct(p["s"].alias("subject"), F.lit(predicate).alias("predicate"), F.substring(F.trim(p["o"]), 1, 200).alias("object"), F.lit(kind).alias("claim_type"), F.lit(polarity).alias("polarity")))

    every = F.slice(F.flatten(F.array(*[hits(*s) for s in shapes])), 1, most)
    ship(texts.sparkSession)
    cut_up = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(T.passages(F.col(text))).alias("passage", "p")).select("key", "passage", F.col("p.passage").alias(text))
    return cut_up.select("key", "passage", F.posexplode(every).alias("no", "c")).select("key", "passage", "no", "c.*")
