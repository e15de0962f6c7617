"""Readers, summaries and profiles over documents, entities, claims, events and relationships.

Null keys never match. Every ranked list has the id as its last key, so that ties come out alike every time. Empty tables give empty reports.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docketeer.functions import lists
from docketeer.functions import text as T
from docketeer.operators.graph import both_ways, rank_in
from docketeer.runtime import lookup_side


# --- claims and their people -------------------------------------------------------------------------------------


def claim_rows(claims: DataFrame, documents: DataFrame, source_tag: str | None = None) -> DataFrame:
    """Claims with their document's tag; claims of unknown documents stay, unless a tag is asked for."""
    tags = documents.select(F.col("id").alias("document_id"), "source_tag").distinct()
    out = claims.select("id", "document_id", "claim_type", "claim_text").distinct().join(tags, "document_id", "left")
    return out if source_tag is None else out.where(F.col("source_tag") == source_tag)


def dated_claims(claims: DataFrame, entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims with a text, the speaker's name where known, and their document's date (its first ten characters)."""
    docs = documents.select(F.col("id").alias("document_id"), F.to_date(F.substring(F.col("created_at").cast("string"), 1, 10)).alias("day")).distinct()
    who = entities.select(F.col("id").alias("speaker_entity_id"), F.col("canonical_name").alias("speaker"))
    rows = claims.where("claim_text is not null").select("id", "document_id", "speaker_entity_id", "claim_text").distinct()
    return rows.join(docs, "document_id").join(who, "speaker_entity_id", "left").select("id", "document_id", "speaker", "day", "claim_text")


def claims_about(claims: DataFrame, name: str, claim_type: str | None = None, limit: int = 25) -> DataFrame:
    """Narrative claims whose subject or object is ``name``, whatever the case; the most certain first."""
    n = F.lit(name.lower())
    rows = claims.where((F.lower("subject") == n) | (F.lower("object") == n))
    if claim_type is not None:
        rows = rows.where(F.col("claim_type") == claim_type)
    return rows.orderBy(F.desc("extractor_confidence"), F.desc("id")).limit(limit).select("id", "subject", "predicate", "object", "claim_type", "extractor_confidence")


def enriched_claims(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, text): the claim as a sentence for an index, with its speaker in front and its subject behind, where known."""
    who = entities.select("id", "canonical_name")
    rows = claims.where("claim_text is not null").select("id", "speaker_entity_id", "subject_entity_id", "claim_text").distinct()
    rows = rows.join(who.toDF("speaker_entity_id", "speaker"), "speaker_entity_id", "left").join(who.toDF("subject_entity_id", "subject"), "subject_entity_id", "left")
    text = F.concat(F.when(F.col("speaker").isNotNull(), F.concat("speaker", F.lit(" states: "))).otherwise(""), "claim_text", F.when(F.col("subject").isNotNull(), F.concat(F.lit(" [about: "), "subject", F.lit("]"))).otherwise(""))
    return rows.select("id", text.alias("text"))


def claim_parties(pairs: DataFrame, claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs (claim_a, claim_b, reason) with both texts and both speakers, where known."""
    who = entities.select(F.col("id").alias("speaker_entity_id"), F.col("canonical_name").alias("actor"))
    side = claims.select("id", "claim_text", "speaker_entity_id").distinct().join(who, "speaker_entity_id", "left").select("id", "claim_text", "actor")
    return pairs.join(side.toDF("claim_a", "text_a", "actor_a"), "claim_a").join(side.toDF("claim_b", "text_b", "actor_b"), "claim_b").select("claim_a", "claim_b", "reason", "text_a", "actor_a", "text_b", "actor_b")


def claims_by_name(named: DataFrame, entities: DataFrame) -> DataFrame:
    """(claim_id, entity_id): names (claim_id, name) tied to the entity of that name, else to the first whose name holds it; case doesn't count.

    Containing names are met through the first word of the asked name, which they must hold.
    """
    e = entities.where("canonical_name is not null").select(F.col("id").alias("entity_id"), F.lower("canonical_name").alias("full"))
    asked = named.where("name is not null and trim(name) <> ''").select("claim_id", F.lower(F.trim("name")).alias("name")).distinct()
    distinct = asked.select("name").distinct()
    words = e.select("entity_id", "full", F.explode(F.array_distinct(F.split("full", " "))).alias("w"))
    met = distinct.withColumn("w", F.split("name", " ")[0]).join(words, "w").where(F.contains("full", F.col("name")))
    best = met.groupBy("name").agg(F.min_by("entity_id", F.struct((F.col("full") != F.col("name")).alias("x"), "entity_id")).alias("entity_id"))
    return asked.join(best, "name").select("claim_id", "entity_id")


# --- events ------------------------------------------------------------------------------------------------------


def event_claims(event_map: DataFrame, claims: DataFrame, entities: DataFrame) -> DataFrame:
    """The claims of each event with role, text and speaker; keys are compared trimmed and without regard to case."""
    k = F.lower(F.trim("claim_id"))
    rows = event_map.select("event_id", k.alias("claim_id"), "role").distinct()
    c = claims.select(F.lower("id").alias("claim_id"), "claim_text", "speaker_entity_id").distinct()
    who = entities.select(F.col("id").alias("speaker_entity_id"), F.col("canonical_name").alias("speaker"))
    return rows.join(c, "claim_id").join(who, "speaker_entity_id", "left").select("event_id", "claim_id", "role", "claim_text", "speaker")


def role_counts(event_map: DataFrame, role: str) -> DataFrame:
    """(event_id, n): different claims of that role; events without one have 0."""
    return event_map.groupBy("event_id").agg(F.count_distinct(F.when(F.col("role") == role, F.col("claim_id"))).alias("n"))


def without_map(events: DataFrame, event_map: DataFrame) -> DataFrame:
    """Events (event_id) that no claim supports any more."""
    return events.select("event_id").distinct().join(event_map.select("event_id").where("event_id is not null"), "event_id", "left_anti")


def event_relationships(event_map: DataFrame, claims: DataFrame, relationships: DataFrame) -> DataFrame:
    """(event_id, a, b, weight): relationships whose ends are both subjects or speakers of an event's claims."""
    rows = event_map.select("event_id", F.lower(F.trim("claim_id")).alias("claim_id")).distinct()
    c = claims.select(F.lower("id").alias("claim_id"), F.explode(F.array("speaker_entity_id", "subject_entity_id")).alias("e")).where("e is not null").distinct()
    ends = rows.join(c, "claim_id").select("event_id", "e").distinct()
    edges = relationships.where("entity_a_id <> entity_b_id").groupBy(F.least("entity_a_id", "entity_b_id").alias("a"), F.greatest("entity_a_id", "entity_b_id").alias("b")).agg(F.sum("weight").alias("weight"))
    return ends.withColumnRenamed("e", "a").join(edges, "a").join(ends.withColumnRenamed("e", "b"), ["event_id", "b"]).select("event_id", "a", "b", "weight")


def first_dates(dated: DataFrame, group: str) -> DataFrame:
    """(group, id, earliness): of rows (group, id, day), 1 for the first day of the group down to 0 for the last; undated 0, half where none or one day is dated."""
    span = dated.groupBy(group).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    days = F.datediff("last", "first")
    score = F.when(F.col("first").isNull(), 0.5).when(F.col("day").isNull(), 0.0).when(days == 0, 0.5).otherwise(1 - F.datediff("day", "first") / days)
    return dated.join(span, group).select(group, "id", score.alias("earliness"))


def timeline(claims: DataFrame, limit: int = 100) -> DataFrame:
    """Dated narrative claims, the earliest first."""
    return claims.where("normalized_date is not null and trim(normalized_date) <> ''").orderBy("normalized_date", "id").limit(limit).select("id", "normalized_date", "subject", "predicate", "object")


# --- entities ----------------------------------------------------------------------------------------------------


def entity_contexts(mentions: DataFrame, entities: DataFrame, most: int = 5, chars: int = 200) -> DataFrame:
    """(entity_id, text): the name and the first ``most`` contexts of each entity, ``chars`` characters of each."""
    rows = mentions.where("context_text is not null and trim(context_text) <> ''").select("entity_id", "id", F.substring("context_text", 1, chars).alias("c")).distinct()
    first = rank_in(rows, ["entity_id"], ["id"], most)
    joined = first.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "c"))), lambda x: x["c"]), " | ").alias("c"))
    return joined.join(entities.select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id").select("entity_id", F.concat("canonical_name", F.lit(": "), "c").alias("text"))


def first_snippets(mentions: DataFrame, most: int = 3) -> DataFrame:
    """(entity_id, document_id, snippets): up to ``most`` contexts of an entity in each document, in order of the mention's id."""
    rows = mentions.where("context_text is not null").select("entity_id", "document_id", "id", "context_text").distinct()
    first = rank_in(rows, ["entity_id", "document_id"], ["id"], most)
    return first.groupBy("entity_id", "document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "context_text"))), lambda x: x["context_text"]), "\n").alias("snippets"))


def neighbours(edges: DataFrame, names: DataFrame, entity: str) -> DataFrame:
    """(id, canonical_name, weight) of an entity's neighbours, the heaviest first; names: id, canonical_name."""
    near = both_ways(edges).where(F.col("a") == entity).select(F.col("b").alias("id"), "weight")
    return near.join(names.select("id", "canonical_name"), "id").orderBy(F.desc("weight"), "id")


def strongest_relationship(relationships: DataFrame) -> DataFrame:
    """(id, other, weight, relationship_type): the heaviest row of each ordered pair of different entities, seen from both."""
    rows = relationships.where("entity_a_id <> entity_b_id").select(F.col("id").alias("row"), "entity_a_id", "entity_b_id", F.coalesce("weight", F.lit(1)).alias("weight"), "relationship_type")
    both = rows.toDF("row", "id", "other", "weight", "relationship_type").unionByName(rows.toDF("row", "other", "id", "weight", "relationship_type"))
    best = both.groupBy("id", "other").agg(F.max_by(F.struct("weight", "relationship_type"), F.struct("weight", "row")).alias("s"))
    return best.select("id", "other", "s.weight", "s.relationship_type")


def capped_graph(edges: DataFrame, counts: DataFrame, nodes: int) -> DataFrame:
    """Edges between the ``nodes`` most mentioned entities; counts: id, n."""
    top = counts.orderBy(F.desc("n"), "id").limit(nodes).select("id")
    side = lookup_side(top, nodes)
    return edges.join(side.withColumnRenamed("id", "a"), "a", "left_semi").join(side.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b", "weight")


def shared_documents(mentions: DataFrame, a: str, b: str) -> DataFrame:
    """(document_id, pages_a, pages_b): documents that mention both entities, with the pages of each."""
    rows = mentions.where(F.col("entity_id").isin(a, b)).select("document_id", "entity_id", "page_number").distinct()

    def pages(e: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("entity_id") == e, F.col("page_number")))), lambda p: p.cast("string")), ",")

    out = rows.groupBy("document_id").agg(pages(a).alias("pages_a"), pages(b).alias("pages_b"), F.count_distinct("entity_id").alias("n"))
    return out.where("n = 2").drop("n")


def entity_audit(entities: DataFrame) -> DataFrame:
    """(entity_type, n, mentions, unnamed): counts of each type, null as a type of its own."""
    return entities.groupBy("entity_type").agg(F.count("*").alias("n"), F.sum(F.coalesce("mention_count", F.lit(0))).alias("mentions"), F.count_if(F.col("aliases").isNull() | (F.size("aliases") == 0)).alias("without_aliases"))


def add_alias(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Entities after changes (id, alias, remove): removed aliases leave, new ones come once, the canonical name is never one. Changes of unknown ids do nothing."""
    per = changes.where("alias is not null").groupBy("id").agg(F.collect_set(F.when(F.col("remove"), F.col("alias"))).alias("gone"), F.array_sort(F.collect_set(F.when(~F.col("remove"), F.col("alias")))).alias("more"))
    empty = F.array().cast("array<string>")
    out = entities.join(per, "id", "left")
    return out.withColumn("aliases", T.unique_aliases(F.array_except(F.coalesce("aliases", empty), F.coalesce("gone", empty)), F.coalesce("more", empty), F.col("canonical_name"))).drop("gone", "more")


def narrative_summary(claims: DataFrame, mentions: DataFrame, per: int = 8) -> DataFrame:
    """(entity_id, claim_id, mentions, excerpt, rank): up to ``per`` claims in which an entity speaks or is spoken of, 220 characters of each."""
    sides = claims.select("id", "claim_text", F.explode(F.array("speaker_entity_id", "subject_entity_id")).alias("entity_id")).where("entity_id is not null").distinct()
    first = rank_in(sides, ["entity_id"], ["id"], per)
    n = mentions.groupBy("entity_id").agg(F.count("*").alias("mentions"))
    return first.join(n, "entity_id").select("entity_id", F.col("id").alias("claim_id"), "mentions", F.substring("claim_text", 1, 220).alias("excerpt"), "rank")


def usual_value(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n): the most frequent value of each group, of equal ones the first."""
    counts = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("s")).select(group, f"s.{value}", "s.n")


# --- graphs of a case ----------------------------------------------------------------------------------------------


def case_graph(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, kind, value): edges from documents to the case's own values (kind, value), each once."""
    return found.select("key", "kind", "value").distinct().join(wanted.select("kind", "value").distinct(), ["kind", "value"], "left_semi")


def case_ingest(before: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, value): the case's values with those of new documents, each once; null values leave."""
    return before.select("kind", "value").unionByName(new.select("kind", "value")).where("value is not null").distinct()


def case_summary(found: DataFrame, top: int = 15) -> DataFrame:
    """(kind, value, n, rank): the ``top`` values by how often they occur."""
    counts = found.groupBy("kind", "value").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "kind", "value").limit(top)


def case_timeline(found: DataFrame) -> DataFrame:
    """(key, value): the dates of each document, in order."""
    return found.where("kind = 'date'").select("key", "value").distinct().orderBy("value", "key")


# --- search results --------------------------------------------------------------------------------------------------


def clamped_score(rank: Column) -> Column:
    """A rank (lower is better, negative) as a score between 0 and 1."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + rank / 20)), 4)


def result_list(hits: DataFrame, pages: DataFrame, documents: DataFrame, mentions: DataFrame, entities: DataFrame, allowed: DataFrame | None = None, page: int = 1, size: int = 20, names: int = 20) -> DataFrame:
    """One page of a search: hits (id, score) with document, tag, score between 0 and 1 and up to ``names`` entities of the page, and the exact total.

    ``allowed`` (document_id) are the documents that pass the filters, taken before anything is counted. Names are fetched for the
    shown page only. Past the end the page is empty.
    """
    where = pages.select("id", "document_id", "page_number").distinct()
    rows = hits.join(where, "id")
    if allowed is not None:
        rows = rows.join(allowed.select("document_id").distinct(), "document_id", "left_semi")
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.orderBy(F.desc("score"), "id").offset((page - 1) * size).limit(size).join(documents.select(F.col("id").alias("document_id"), "filename", "source_tag"), "document_id", "left")
    named = mentions.join(lookup_side(shown.select("document_id", "page_number").distinct(), size), ["document_id", "page_number"], "left_semi").select("document_id", "page_number", "entity_id").distinct()
    named = named.join(entities.select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id")
    named = named.groupBy("document_id", "page_number").agg(F.array_join(F.slice(F.array_sort(F.collect_set("canonical_name")), 1, names), "; ").alias("names"))
    out = shown.join(named, ["document_id", "page_number"], "left").crossJoin(F.broadcast(total))  # a one-row side
    return out.select("id", "document_id", "page_number", "filename", "source_tag", clamped_score(-F.col("score")).alias("closeness"), "score", F.coalesce("names", F.lit("")).alias("names"), "total")


@F.pandas_udf(StringType())
def _window(texts: pd.Series, words: pd.Series) -> pd.Series:
    def best(text: str | None, asked: str) -> str | None:
        if not text:
            return text
        tokens, wanted = text.split(), set(asked.split())
        hit = [re.sub(r"\W", "", t.lower()) in wanted for t in tokens]
        run = sum(hit[:24])
        top, at = run, 0
        for i in range(24, len(tokens)):
            run += hit[i] - hit[i - 24]
            if run > top:
                top, at = run, i - 23
        return ("…" if at else "") + " ".join(tokens[at : at + 24]) + ("…" if at + 24 < len(tokens) else "")

    return pd.Series([best(t, w) for t, w in zip(texts, words, strict=True)])


def best_window(text: Column, query: str) -> Column:
    """The first run of 24 words with the most of the query's words; null for null, '' for ''."""
    return _window(text, F.lit(" ".join(re.findall(r"\w+", query.lower()))))


def similar_above(found: DataFrame, items: DataFrame, least: float, kind: str | None = None, k: int = 10) -> DataFrame:
    """Neighbours (query_id, id, score, rank) whose item (id, kind) is of ``kind``, from ``least`` on, at most ``k`` of a query. The filter comes after
    the search, so that fewer than ``k`` may be left."""
    rows = found.where(F.col("score") >= least).join(items.select("id", "kind"), "id")
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    return rank_in(rows.drop("rank"), ["query_id"], [F.desc(F.round("score", 9)), "id"], k)


# --- status and sinks ----------------------------------------------------------------------------------------------


def status_counts(**tables: DataFrame) -> DataFrame:
    """(name, n): rows of each table, counted in one plan."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def overview(scored: DataFrame, value: str, least: float) -> DataFrame:
    """(n, high, top_id, top): rows, how many from ``least`` on, and the best; of equal ones the first id. Without rows: 0, 0, null, null."""
    return scored.agg(F.count("*").alias("n"), F.count_if(F.col(value) >= least).alias("high"), F.min_by("id", F.when(F.col(value).isNotNull(), F.struct(-F.col(value), "id"))).alias("top_id"), F.max(value).alias("top"))


def source_reliability(sources: DataFrame, table: dict[str, float], default: float = lists.SOURCE_RELIABILITY_DEFAULT) -> DataFrame:
    """Sources with the reliability of their type by the caller's table; other types and null have the default."""
    score = F.lit(default)
    for kind, value in table.items():
        score = F.when(F.lower(F.trim("source_type")) == kind, value).otherwise(score)
    return sources.withColumn("reliability", score)


def repair_json(text: str | None) -> list[dict]:
    """Objects of a model's answer: fences leave, an open list is closed, trailing commas leave; what still can't be read is searched for whole objects."""
    body = re.sub(r"^```\w*|```$", "", (text or "").strip()).strip()
    start = body.find("[")
    body = body[start:] if start >= 0 else body
    for attempt in (body, body + "]"):
        try:
            found = json.loads(re.sub(r",\s*([\]}])", r"\1", attempt))
            return [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]
        except ValueError:
            continue
    out = []
    for m in re.finditer(r"\{[^{}]*\}", body):
        try:
            out.append(json.loads(re.sub(r",\s*}", "}", m[0])))
        except ValueError:
            continue
    return out


def export_json(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as JSON lines under ``folder``, written by the executors."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def redaction_marks(shapes: DataFrame) -> DataFrame:
    """(document_id, page_number, flag_type, confidence) of filled shapes (document_id, page_number, fill array<double>, width, height): dark in every
    channel, from 30 by 8 points on. A null fill is no mark."""
    dark = F.col("fill").isNotNull() & (F.size("fill") > 0) & F.forall("fill", lambda c: c <= 0.15)
    return shapes.where(dark & (F.col("width") >= 30) & (F.col("height") >= 8)).select("document_id", "page_number", F.lit("black_box").alias("flag_type"), F.lit(0.80).alias("confidence"))


def hidden_words(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, page_number, word, flag_type, confidence): the first word (document_id, page_number, no, word) of more than three letters that the page's text lacks."""
    rows = words.where("length(word) > 3").join(pages.select("document_id", "page_number", "final_text").distinct(), ["document_id", "page_number"])
    lost = rows.where(~F.contains(F.coalesce("final_text", F.lit("")), F.col("word")))
    return lost.groupBy("document_id", "page_number").agg(F.min_by("word", "no").alias("word")).withColumns({"flag_type": F.lit("hidden_text"), "confidence": F.lit(0.75)})
