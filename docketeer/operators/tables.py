"""Lists and counts over documents, pages, entities and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketeer.functions import text as T
from docketeer.functions.dates import bucket


def page_of(df: DataFrame, order: list[Column], page: int = 1, size: int = 50) -> DataFrame:
    """One page of a sorted list, with ``total`` and ``pages`` of the whole; past the end it is empty."""
    total = df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return df.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))  # a one-row side


def documents_list(documents: DataFrame, source_tag: str | None = None, status: str | None = None) -> DataFrame:
    """Documents with the given tag and status, null meaning any."""
    for c, v in (("source_tag", source_tag), ("status", status)):
        if v is not None:
            documents = documents.where(F.col(c) == v)
    return documents.select("id", "filename", "source_tag", "status", "page_count", "created_at")


def content_duplicates(documents: DataFrame, order: list[str]) -> DataFrame:
    """(doc_id, sha256, first_doc_id, is_duplicate): uploads whose content came before, by ``order``. Null texts are no duplicates.

    The first of each content is found by aggregation, so copies of one text are never gathered.
    """
    hashed = documents.where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), *[o for o in order if o != "doc_id"])
    first = hashed.groupBy("sha256").agg(F.min_by("doc_id", F.struct(*order)).alias("first_doc_id"))
    return hashed.join(first, "sha256").select("doc_id", "sha256", "first_doc_id", (F.col("doc_id") != F.col("first_doc_id")).alias("is_duplicate"))


def page_spans(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity spans of each page; mentions without offsets leave."""
    named = entities.select(F.col("id").alias("entity_id"), "canonical_name", "entity_type")
    spans = mentions.where("char_start is not null").join(named, "entity_id")
    return spans.select("document_id", "page_number", "char_start", "char_end", "entity_id", "entity_type", "canonical_name").distinct()


def entity_counts(entities: DataFrame, mentions: DataFrame, documents: DataFrame, source_tag: str | None = None, min_mentions: int = 1, kind: str | None = None, like: str | None = None) -> DataFrame:
    """Mentions and distinct documents of each entity, counted before the entity filters; only mentions of known documents count."""
    docs = documents.where(F.col("source_tag") == source_tag) if source_tag is not None else documents
    known = mentions.join(docs.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_semi")
    counts = known.groupBy("entity_id").agg(F.count("*").alias("mentions"), F.count_distinct("document_id").alias("documents")).where(F.col("mentions") >= min_mentions)
    if kind is not None:
        entities = entities.where(F.col("entity_type") == kind)
    if like is not None:
        entities = entities.where(F.contains(F.lower("canonical_name"), F.lit(like.lower())))
    return entities.select(F.col("id").alias("entity_id"), "entity_type", "canonical_name").join(counts, "entity_id")


def recount_mentions(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(entity_id, old, new) where the stored mention_count has drifted from the mentions."""
    counts = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("new"))
    out = entities.join(counts, "id", "left").select(F.col("id").alias("entity_id"), F.col("mention_count").cast("bigint").alias("old"), F.coalesce("new", F.lit(0)).alias("new"))
    return out.where(~F.col("old").eqNullSafe(F.col("new")))


def wipe_documents(entities: DataFrame, mentions: DataFrame, gone: DataFrame, **derived: DataFrame) -> dict[str, DataFrame]:
    """All that is left without the documents ``gone`` (document_id): mentions and the ``derived`` tables (with document_id) by anti-join, entities recounted,
    those without any mention removed. Wiping twice, or documents that aren't there, changes nothing more."""
    side = gone.select("document_id").where("document_id is not null").distinct()
    left = mentions.join(side, "document_id", "left_anti")
    counts = left.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("now"))
    kept = entities.join(counts, "id").withColumn("mention_count", F.col("now")).drop("now")
    return {"entities": kept, "mentions": left} | {name: df.join(side, "document_id", "left_anti") for name, df in derived.items()}


def reingest(before: DataFrame, again: DataFrame, key: str = "document_id") -> DataFrame:
    """``before`` with the rows of the documents in ``again`` replaced by these."""
    return before.join(again.select(key).distinct(), key, "left_anti").unionByName(again)


def entity_mentions(mentions: DataFrame, documents: DataFrame, entity_ids: DataFrame) -> DataFrame:
    """Mentions of the asked entities (entity_id) with their documents."""
    docs = documents.select(F.col("id").alias("document_id"), "filename", F.col("created_at").alias("document_date"))
    return mentions.join(entity_ids, "entity_id", "left_semi").join(docs, "document_id").select("id", "entity_id", "document_id", "filename", "page_number", "char_start", "document_date")


def claims_list(claims: DataFrame, entities: DataFrame, documents: DataFrame, **filters) -> DataFrame:
    """Claims with the names they refer to, where they are known. Filters: speaker_entity_id, subject_entity_id, document_id, claim_type, sentiment, min_confidence."""
    least = filters.pop("min_confidence", None)
    for c, v in filters.items():
        claims = claims.where(F.col(c) == v)
    if least is not None:
        claims = claims.where(F.col("confidence") >= least)
    out = claims.select("id", "document_id", "speaker_entity_id", "subject_entity_id", "claim_type", "sentiment", "confidence", "claim_text").distinct()
    for role in ("speaker", "subject"):
        names = entities.select(F.col("id").alias(f"{role}_entity_id"), F.col("canonical_name").alias(role))
        out = out.join(names, f"{role}_entity_id", "left")
    return out.join(documents.select(F.col("id").alias("document_id"), "filename").distinct(), "document_id", "left")


def tag_overview(documents: DataFrame, claims: DataFrame) -> DataFrame:
    """Documents and claims of each non-empty tag."""
    docs = documents.where("source_tag is not null and source_tag <> ''").select(F.col("id").alias("document_id"), "source_tag")
    n_claims = claims.distinct().join(docs, "document_id").groupBy("source_tag").agg(F.count("*").alias("claims"))
    return docs.groupBy("source_tag").agg(F.count("*").alias("documents")).join(n_claims, "source_tag", "left").fillna(0, ["claims"])


def redaction_audit(pages: DataFrame, mentions: DataFrame) -> DataFrame:
    """Of each document with redacted pages: how many, which, and how many entities are mentioned on them."""
    pages = pages.where("has_redactions").select("document_id", "page_number").distinct()
    on = mentions.join(pages, ["document_id", "page_number"], "left_semi").groupBy("document_id").agg(F.count_distinct("entity_id").alias("entities"))
    audit = pages.groupBy("document_id").agg(F.count("*").alias("redacted_pages"), F.array_sort(F.collect_set("page_number")).alias("page_list"))
    return audit.join(on, "document_id", "left").fillna(0, ["entities"]).withColumn("page_list", F.array_join(F.transform("page_list", lambda p: p.cast("string")), ","))


def redaction_report(flags: DataFrame, pages: DataFrame) -> DataFrame:
    """Flags (document_id, page_number, flag_type, y) with the text near them: 120 characters around the place that y of 792 points to, trimmed to 80."""
    near = flags.join(pages.select("document_id", "page_number", "final_text"), ["document_id", "page_number"], "left")
    at = (F.length("final_text") * F.col("y") / 792).cast("int")
    window = F.substring(F.col("final_text"), F.greatest(at - 120, F.lit(1)), F.lit(240))
    return near.select("document_id", "page_number", "flag_type", F.substring(F.trim(window), 1, 80).alias("context"), F.substring("final_text", 1, 300).alias("preview"))


def redaction_candidates(pages: DataFrame, mentions: DataFrame, min_entities: int = 2) -> DataFrame:
    """Redacted pages that mention at least ``min_entities`` entities."""
    marked = pages.where("has_redactions").select("document_id", "page_number", F.substring("final_text", 1, 400).alias("preview")).distinct()
    counts = mentions.groupBy("document_id", "page_number").agg(F.count_distinct("entity_id").alias("entities"))
    return marked.join(counts, ["document_id", "page_number"]).where(F.col("entities") >= min_entities)


def annotations_now(annotations: DataFrame) -> DataFrame:
    """The latest state of each annotation of an append-only table (id, version, is_deleted, ...), deleted ones left out."""
    others = [c for c in annotations.columns if c != "id"]
    last = annotations.groupBy("id").agg(F.max_by(F.struct(*others), "version").alias("s")).select("id", "s.*")
    return last.where("not is_deleted")


def dismissed_pairs(entities: DataFrame) -> DataFrame:
    """(id_a, id_b) of pairs marked as no duplicates in review_notes."""
    marks = entities.select("id", F.explode(F.regexp_extract_all("review_notes", F.lit(r"\[DISMISSED_PAIR:([^\]]+)\]"), 1)).alias("other"))
    return marks.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def timeline_snapshots(mentions: DataFrame, unit: str = "month", top: int = 40, when: str = "created_at") -> DataFrame:
    """Per bucket of time the number of entities and the ``top`` most mentioned. Counts are aggregated before they are ranked."""
    counts = mentions.where(F.col(when).isNotNull()).groupBy(bucket(F.col(when), unit).alias("bucket"), "entity_id").agg(F.count("*").alias("mentions"))
    nodes = counts.groupBy("bucket").agg(F.count("*").alias("nodes"))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("mentions"), "entity_id"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).join(nodes, "bucket").select("bucket", "nodes", "entity_id", "mentions", "rank")


def like_search(pages: DataFrame, query: str) -> DataFrame:
    """Pages that hold ``query``, whatever the case, with a marked snippet."""
    text = F.coalesce("final_text", "ocr_text")
    return pages.where(F.contains(F.lower(text), F.lit(query.lower()))).select("id", "document_id", "page_number", T.like_snippet(text, query).alias("snippet")).distinct()


def search_filters(documents: DataFrame, mentions: DataFrame, entities: DataFrame, tags: list[str] | None = None, redacted: bool | None = None, since=None, until=None, names: list[str] | None = None, match: str = "any") -> DataFrame:
    """(document_id) that pass all filters; ``names`` must be mentioned, any or all of them."""
    docs = documents
    if tags:
        docs = docs.where(F.col("source_tag").isin(tags))
    if redacted is not None:
        docs = docs.where(F.col("has_redactions") == redacted)
    if since is not None:
        docs = docs.where(F.col("created_at") >= F.lit(since))
    if until is not None:
        docs = docs.where(F.col("created_at") <= F.lit(until))
    out = docs.select(F.col("id").alias("document_id")).distinct()
    if names:
        asked = entities.where(F.lower("canonical_name").isin([n.lower() for n in names])).select(F.col("id").alias("entity_id"), F.lower("canonical_name").alias("n"))
        hits = mentions.join(asked, "entity_id").groupBy("document_id").agg(F.count_distinct("n").alias("k")).where(F.col("k") >= (len(set(names)) if match == "all" else 1))
        out = out.join(hits, "document_id", "left_semi")
    return out
