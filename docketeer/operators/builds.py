"""Whole builds out of the single operators: narratives, intelligence, provenance, dossiers. Each returns tables; the caller writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketeer.functions import dates as D
from docketeer.functions import text as T
from docketeer.functions.vectors import centroid, cosine
from docketeer.operators import extract as X
from docketeer.operators import narrative as N
from docketeer.operators.graph import both_ways, rank_in
from docketeer.runtime import cut

#: Titles before a name, and capitalised pairs that are no names.
TITLED = r"\b(?:Judge|Dr\.?|Mr\.?|Ms\.?|Mrs\.?|Counsel|Agent|Officer) ([A-Z][a-z]+(?: [A-Z][a-z]+)?)\b"
NO_NAMES = ["United States", "New York", "Supreme Court", "District Court", "The Court"]


def actor(text: Column, preferred: list[str] | None = None, blocked: list[str] | None = None) -> Column:
    """Who a text is about: the first of the caller's names in it, else a titled name, else the pair of capitalised words that stands most often (of
    equal ones the first), else null."""
    names = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b"), 1), lambda n: ~n.isin([*NO_NAMES, *(blocked or [])]))
    counted = F.transform(F.array_distinct(names), lambda n: F.struct((-F.size(F.filter(names, lambda m: m == n))).alias("k"), F.array_position(names, n).alias("at"), n.alias("n")))
    titled = F.regexp_extract(text, TITLED, 1)
    out = F.when(titled != "", titled).otherwise(F.array_min(counted)["n"])
    for name in reversed(preferred or []):
        out = F.when(F.contains(text, F.lit(name)), name).otherwise(out)
    return out


def narrative_claims(units: DataFrame) -> DataFrame:
    """(document_id, page_number, source_tag, passage, no, s, p, o, subject, predicate, object, claim_type, polarity, day) of text units
    (document_id, page_number, source_tag, text): what the sentence shapes tell, normalised, with the passage's first readable date."""
    keyed = units.select(F.concat_ws("|", "document_id", "page_number").alias("key"), "document_id", "page_number", "source_tag", "text").distinct()
    found = X.statement_claims(keyed.select("key", "text"), "key")
    rows = found.join(keyed.drop("text"), "key").drop("key")
    return rows.withColumns({"s": T.normalize(F.col("subject")), "p": T.normalize(F.col("predicate")), "o": T.normalize(F.col("object")), "day": D.claim_date(F.col("object"))})


def build_narrative(units: DataFrame, before: dict[str, DataFrame] | None = None, source_tag: str | None = None) -> dict[str, DataFrame]:
    """claims and events of the units; of ``before``, the claims of other tags stay and those of ``source_tag`` are replaced."""
    fresh = narrative_claims(units if source_tag is None else units.where(F.col("source_tag") == source_tag))
    if before is not None and source_tag is not None:
        fresh = before["claims"].where(~F.col("source_tag").eqNullSafe(F.lit(source_tag))).unionByName(fresh)
    claims = cut(fresh)
    key = T.event_key(F.col("subject"), F.col("predicate"), F.col("object"), F.col("day").cast("string"))
    events = claims.groupBy(key.alias("event_key")).agg(F.count("*").alias("claims"), F.count_distinct("document_id").alias("documents"), F.max_by("object", F.struct(F.length("object"), "document_id", "page_number", "passage", "no")).alias("summary"))
    return {"claims": claims, "events": events}


def build_intel(claims: DataFrame, entities: DataFrame, mode: str = "foia", preferred: list[str] | None = None) -> dict[str, DataFrame]:
    """claims (id, document_id, page_number, claim_type, claim_text) without junk, cleaned, with day, place and actor; their canonical events with support;
    links to entities; lineage; and actors at two places on one day."""
    rows = claims.where("claim_text is not null").select("id", "document_id", "page_number", "claim_type", "claim_text").distinct()
    rows = rows.where(~T.ocr_junk(F.col("claim_text"), mode)).withColumn("clean", T.clean_claim_text(F.col("claim_text"), mode)).where("clean <> ''")
    rows = cut(rows.withColumns({"day": D.text_date(F.col("clean")), "place": T.location(F.col("clean")), "actor": actor(F.col("clean"), preferred)}))
    key = T.event_key(F.col("actor"), F.col("claim_type"), F.col("clean"), F.col("day"), F.col("place"), cut=140)
    events = rows.withColumn("event_key", key).groupBy("event_key").agg(F.count_if(F.col("claim_type") != "denial").alias("supports"), F.count_if(F.col("claim_type") == "denial").alias("contradictions"), F.count_distinct("document_id").alias("documents"), F.min("id").alias("first_claim"))
    events = events.withColumn("confidence", F.col("supports") / (F.col("supports") + F.col("contradictions") + 1))
    moves = rows.select("id", "actor", F.expr("try_cast(day as date)").alias("date"), "place")
    return {"claims": rows, "events": events, "links": N.claim_entity_links(claims, entities), "lineage": N.claim_lineage(claims), "anomalies": N.temporal_anomalies(moves)}


def correlated_claims(groups: DataFrame, claims: DataFrame) -> DataFrame:
    """(group_id, claims, documents, across, contradictory, chain) of groups (id, group_id) of claims: in more than one document; with claims of both moods, or
    allegations and denials; in three documents or more."""
    rows = claims.select("id", "document_id", "sentiment", "claim_type").distinct().join(groups, "id")

    def some(c: str, v: str) -> Column:
        return F.coalesce(F.bool_or(F.col(c) == v), F.lit(False))

    out = rows.groupBy("group_id").agg(F.count_distinct("id").alias("claims"), F.count_distinct("document_id").alias("documents"), ((some("sentiment", "positive") & some("sentiment", "negative")) | (some("claim_type", "allegation") & some("claim_type", "denial"))).alias("contradictory"))
    return out.where("claims > 1").select("group_id", "claims", "documents", (F.col("documents") > 1).alias("across"), "contradictory", (F.col("documents") >= 3).alias("chain"))


def dossiers(entities: DataFrame, mentions: DataFrame, edges: DataFrame, claims: DataFrame, top: int = 5) -> DataFrame:
    """(id, canonical_name, entity_type, mentions, documents, degree, strongest, said, told_of): of every entity, with its ``top`` heaviest neighbours by name."""
    seen = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("mentions"), F.count_distinct("document_id").alias("documents"))
    near = both_ways(edges).toDF("id", "other", "weight")
    degree = near.groupBy("id").agg(F.count("*").alias("degree"))
    first = rank_in(near, ["id"], [F.desc("weight"), "other"], top).join(entities.select(F.col("id").alias("other"), F.col("canonical_name").alias("name")), "other")
    strongest = first.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), "; ").alias("strongest"))
    c = claims.select("id", "speaker_entity_id", "subject_entity_id").distinct()
    said, told = (c.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("id")).agg(F.count("*").alias(n)) for k, n in (("speaker_entity_id", "said"), ("subject_entity_id", "told_of")))
    out = entities.select("id", "canonical_name", "entity_type")
    for df in (seen, degree, strongest, said, told):
        out = out.join(df, "id", "left")
    return out.fillna(0, ["mentions", "documents", "degree", "said", "told_of"]).fillna("", ["strongest"])


def community_texts(groups: DataFrame, report: DataFrame, entities: DataFrame, names: int = 3) -> DataFrame:
    """(community, text): a sentence on each community by its size and its first persons and organisations."""
    e = groups.join(entities.select("id", "entity_type", "canonical_name"), "id")

    def first(kind: str) -> Column:
        return F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("entity_type") == kind, F.col("canonical_name")))), 1, names), ", ")

    both = e.groupBy("community").agg(first("Person").alias("people"), first("Organization").alias("organisations")).join(report, "community")
    with_ = F.concat(F.col("size").cast("string"), F.lit(" entities"))
    text = (
        F.when((F.col("people") != "") & (F.col("organisations") != ""), F.concat(with_, F.lit(": "), "people", F.lit(" with "), "organisations"))
        .when(F.col("people") != "", F.concat(with_, F.lit(" around "), "people")).when(F.col("organisations") != "", F.concat(with_, F.lit(" of "), "organisations")).otherwise(with_)
    )
    return both.select("community", text.alias("text"))


def reach(pairs: DataFrame, ids: DataFrame, least: float = 0.65) -> DataFrame:
    """(id, reach): how many others each is similar to, by pairs (a, b, sim)."""
    near = pairs.where(F.col("sim") >= least)
    n = near.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("reach"))
    return ids.select("id").join(n, "id", "left").fillna(0, ["reach"])


def seeds(vectors: DataFrame, clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """(leader, seed, score): of each cluster of two or more the vector (id, vector, day) of the largest .35 earliness + .40 closeness to the centroid + .25 reach,
    each but the first by its largest; of equal ones the first id."""
    member = vectors.join(clusters, "id")
    several = member.groupBy("leader").agg(F.count("*").alias("k"), F.min("day").alias("first"), F.max("day").alias("last")).where("k > 1")
    member = member.join(several, "leader")
    mid = centroid(member, ["leader"], "vector").withColumnRenamed("vector", "mid")
    scored = member.join(mid, "leader").join(reach(pairs, vectors), "id").withColumn("sim", cosine(F.col("vector"), F.col("mid")))
    top = scored.groupBy("leader").agg(F.max("sim").alias("top_sim"), F.max("reach").alias("top_reach"))
    span = F.datediff("last", "first")
    early = F.when(F.col("first").isNull(), 0.5).when(F.col("day").isNull(), 0.0).when(span == 0, 1.0).otherwise(1 - F.datediff("day", "first") / span)
    score = 0.35 * early + 0.40 * F.when(F.col("top_sim") > 0, F.col("sim") / F.col("top_sim")).otherwise(0.0) + 0.25 * F.when(F.col("top_reach") > 0, F.col("reach") / F.col("top_reach")).otherwise(0.0)
    best = scored.join(top, "leader").select("leader", "id", score.alias("score"))
    return best.groupBy("leader").agg(F.min_by("id", F.struct(-F.col("score"), "id")).alias("seed"), F.max("score").alias("score"))


def manipulated(dag: DataFrame, threads: DataFrame, actors: DataFrame) -> DataFrame:
    """(leader): threads with two or more children changed by over .28, a coherence under .75 and two or more actors (id, actor) among them."""
    changed = dag.where("mutation > 0.28").groupBy("leader").agg(F.count("*").alias("n")).where("n >= 2")
    who = dag.select("leader", F.col("child").alias("id")).unionByName(dag.select("leader", F.col("leader").alias("id"))).join(actors.where("actor is not null"), "id").groupBy("leader").agg(F.count_distinct("actor").alias("k")).where("k >= 2")
    return threads.where("coherence < 0.75").join(changed, "leader", "left_semi").join(who, "leader", "left_semi").select("leader")


def same_by_context(pairs: DataFrame, entities: DataFrame, mentions: DataFrame, least: float = 0.72, top: int = 30) -> DataFrame:
    """(a, b, sim): persons and organisations of one type, mentioned twice or more, whose contexts are alike to ``least`` and whose aliases don't overlap; pairs: a, b, sim."""
    often = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 2").select("id")
    empty = F.array().cast("array<string>")
    e = entities.where(F.col("entity_type").isin("Person", "Organization")).join(often, "id", "left_semi").select("id", "entity_type", F.transform(F.array_append(F.coalesce("aliases", empty), F.col("canonical_name")), lambda x: F.lower(x)).alias("names"))
    rows = pairs.where(F.col("sim") >= least).join(e.toDF("a", "kind", "na"), "a").join(e.toDF("b", "kind_b", "nb"), "b").where("kind = kind_b")
    return rows.where(~F.arrays_overlap("na", "nb")).orderBy(F.desc("sim"), "a", "b").limit(top).select("a", "b", "sim")


def semantic_edges(pairs: DataFrame, edges: DataFrame, least: float = 0.7) -> DataFrame:
    """(a, b, weight): ties of weight 1 between entities alike to ``least`` that aren't tied yet, in either direction; pairs: a, b, sim."""
    new = pairs.where((F.col("sim") >= least) & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return new.join(edges.select("a", "b"), ["a", "b"], "left_anti").withColumn("weight", F.lit(1))


def date_timeline(dates: DataFrame, mentions: DataFrame, entities: DataFrame, first: int = 200, names: int = 10) -> DataFrame:
    """(day, documents, names) of dates (document_id, day): the ``first`` days in order, the documents that name each, and the first ``names`` entities mentioned there."""
    days = dates.where("day is not null").select("day", "document_id").distinct()
    top = days.select("day").distinct().orderBy("day").limit(first)
    kept = days.join(F.broadcast(top), "day")  # at most ``first`` rows
    n = kept.groupBy("day").agg(F.count("*").alias("documents"))
    who = mentions.select("document_id", "entity_id").distinct().join(kept, "document_id").select("day", "entity_id").distinct().join(entities.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name")), "entity_id").select("day", "name").distinct()
    some = rank_in(who, ["day"], ["name"], names).groupBy("day").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("names"))
    return n.join(some, "day", "left").fillna("", ["names"])


def named_paths(paths: DataFrame, names: DataFrame) -> DataFrame:
    """Broker paths (path, score) with the vertices' names (id, canonical_name) in place of their ids; unknown ids stay."""
    parts = paths.select("path", "score", F.posexplode(F.split("path", " > ")).alias("at", "id")).join(names.select("id", "canonical_name"), "id", "left")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("canonical_name", "id").alias("n")))), lambda x: x["n"]), " > ")
    return parts.groupBy("path", "score").agg(joined.alias("names"))


def model_claims(texts: DataFrame, ask, key: str = "id", text: str = "text", kinds: tuple[str, ...] = ("allegation", "denial", "observation", "statement")) -> DataFrame:
    """(key, claim_text, claim_type, sentiment) from a caller's language model: ``ask`` gets a text and answers in JSON; unreadable answers and failures
    give none, unknown types are observations, unknown sentiments neutral."""
    from collections.abc import Iterator

    import pandas as pd

    from docketeer.operators.reports import repair_json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch["key"], batch["t"], strict=True):
                try:
                    found = repair_json(ask(t))
                except Exception:  # noqa: BLE001 - a model that fails tells nothing
                    found = []
                for x in found:
                    said = str(x.get("claim_text") or "").strip()
                    if said:
                        out.append((k, said, x.get("claim_type") if x.get("claim_type") in kinds else "observation", x.get("sentiment") if x.get("sentiment") in ("positive", "negative") else "neutral"))
            yield pd.DataFrame(out, columns=["key", "claim_text", "claim_type", "sentiment"])

    kind = texts.schema[key].dataType.simpleString()
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"key {kind}, claim_text string, claim_type string, sentiment string")


def index_texts(texts: DataFrame, embed, key: str = "id", text: str = "text") -> DataFrame:
    """(key, no, chunk, vector): texts in overlapping windows, each with the vector of the caller's encoder, which gets a list of strings and gives a list of
    vectors. Blank windows are skipped."""
    from collections.abc import Iterator

    import pandas as pd

    kind = texts.schema[key].dataType.simpleString()
    chunks = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(T.sentence_chunks(F.col(text))).alias("no", "chunk")).where("trim(chunk) <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["vector"] = [list(map(float, v)) for v in embed(list(batch["chunk"]))] if len(batch) else []
            yield batch

    return chunks.mapInPandas(run, f"key {kind}, no int, chunk string, vector array<double>")


def briefing_sections(documents: DataFrame, entities: DataFrame, relationships: DataFrame, claims: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """What a written briefing has besides the top entities: counts, documents, the 30 heaviest relationships by name, clusters, the first 50 dated claims."""
    from docketeer.operators.graph import components
    from docketeer.operators.reports import status_counts, timeline

    names = entities.select("id", "canonical_name")
    top = edges.orderBy(F.desc("weight"), "a", "b").limit(30)
    named = top.join(names.toDF("a", "name_a"), "a").join(names.toDF("b", "name_b"), "b").select("name_a", "name_b", "weight")
    clusters = components(edges).groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return {
        "counts": status_counts(documents=documents, entities=entities, relationships=relationships, claims=claims), "documents": documents.select("id", "filename", "source_tag", "created_at"),
        "relationships": named, "clusters": clusters, "timeline": timeline(claims, 50),
    }
