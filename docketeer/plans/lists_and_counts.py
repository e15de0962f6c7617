"""Queries over documents, pages, entities, mentions and claims, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketeer.functions import dates as D
from docketeer.functions import text as T
from docketeer.operators import tables as O
from docketeer.runtime import table
from docketeer.sources import readers as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT id, filename, source_tag, status, page_count, created_at, total, CAST(ceil(total / 50.0) AS BIGINT) AS pages FROM (SELECT *, count(*) OVER () AS total FROM documents WHERE status = 'done') ORDER BY created_at DESC, id LIMIT 50 OFFSET 50")
def documents_page(spark, d):
    return O.page_of(O.documents_list(table(spark, d, "documents"), status="done"), [F.desc("created_at"), F.col("id")], page=2, size=50)


@query("WITH h AS (SELECT doc_id, sha256(text) AS sha256, created_at FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256, first_value(doc_id) OVER w AS first_doc_id, doc_id <> first_value(doc_id) OVER w AS is_duplicate FROM h WINDOW w AS (PARTITION BY sha256 ORDER BY created_at, doc_id)")
def content_duplicates(spark, d):
    return O.content_duplicates(table(spark, d, "documents"), ["created_at", "doc_id"])


@query("SELECT DISTINCT document_id, page_number, char_start, char_end, entity_id, entity_type, canonical_name FROM mentions JOIN entities e ON e.id = entity_id WHERE char_start IS NOT NULL")
def page_spans(spark, d):
    return O.page_spans(table(spark, d, "mentions"), table(spark, d, "entities"))


@query("""SELECT e.id AS entity_id, entity_type, canonical_name, count(*) AS mentions, count(DISTINCT document_id) AS documents FROM mentions m JOIN entities e ON e.id = m.entity_id
WHERE document_id IN (SELECT id FROM documents) GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def entity_counts(spark, d):
    return O.entity_counts(table(spark, d, "entities"), table(spark, d, "mentions"), table(spark, d, "documents"), min_mentions=2)


@query("""SELECT e.id AS entity_id, entity_type, canonical_name, count(*) AS mentions, count(DISTINCT document_id) AS documents FROM mentions m JOIN entities e ON e.id = m.entity_id
WHERE document_id IN (SELECT id FROM documents) AND entity_type = 'Person' AND contains(lower(canonical_name), 'ward') GROUP BY 1, 2, 3""")
def entity_search(spark, d):
    return O.entity_counts(table(spark, d, "entities"), table(spark, d, "mentions"), table(spark, d, "documents"), kind="Person", like="ward")


@query("SELECT id AS entity_id, CAST(mention_count AS BIGINT) AS old, coalesce(n, 0) AS new FROM entities LEFT JOIN (SELECT entity_id, count(*) AS n FROM mentions GROUP BY 1) m ON m.entity_id = id WHERE mention_count IS DISTINCT FROM coalesce(n, 0)")
def mention_recount(spark, d):
    return O.recount_mentions(table(spark, d, "entities"), table(spark, d, "mentions"))


@query("""SELECT m.id, entity_id, m.document_id, d.filename, page_number, char_start, d.created_at AS document_date FROM mentions m JOIN documents d ON d.id = m.document_id
WHERE entity_id IN (SELECT id FROM entities WHERE entity_type = 'Aircraft')""")
def aircraft_mentions(spark, d):
    asked = table(spark, d, "entities").where("entity_type = 'Aircraft'").select(F.col("id").alias("entity_id"))
    return O.entity_mentions(table(spark, d, "mentions"), table(spark, d, "documents"), asked)


@query("""SELECT c.id, c.document_id, speaker_entity_id, subject_entity_id, claim_type, sentiment, c.confidence, claim_text, s.canonical_name AS speaker, o.canonical_name AS subject, filename
FROM (SELECT DISTINCT id, document_id, speaker_entity_id, subject_entity_id, claim_type, sentiment, confidence, claim_text FROM claims WHERE sentiment = 'negative' AND confidence >= 0.6) c
LEFT JOIN entities s ON s.id = speaker_entity_id LEFT JOIN entities o ON o.id = subject_entity_id LEFT JOIN documents d ON d.id = c.document_id""")
def claims_list(spark, d):
    return O.claims_list(table(spark, d, "claims"), table(spark, d, "entities"), table(spark, d, "documents"), sentiment="negative", min_confidence=0.6)


@query("""WITH d AS (SELECT id, source_tag FROM documents WHERE source_tag IS NOT NULL AND source_tag <> '')
SELECT source_tag, count(*) AS documents, coalesce(max(n), 0) AS claims FROM d LEFT JOIN (SELECT source_tag, count(*) AS n FROM (SELECT DISTINCT * FROM claims) c JOIN d ON d.id = c.document_id GROUP BY 1) USING (source_tag) GROUP BY 1""")
def tag_overview(spark, d):
    return O.tag_overview(table(spark, d, "documents"), table(spark, d, "claims"))


@query("SELECT source_tag, count(*) AS documents FROM documents WHERE source_tag IS NOT NULL AND trim(source_tag) <> '' GROUP BY 1")
def exportable_tags(spark, d):
    return S.exportable_tags(table(spark, d, "documents"))


@query("SELECT doc_type, count(*) AS documents, count(DISTINCT source_tag) AS tags, min(created_at) AS first, max(created_at) AS last FROM documents GROUP BY 1")
def dataset_metadata(spark, d):
    return S.dataset_metadata(table(spark, d, "documents"))


@query("""WITH p AS (SELECT DISTINCT document_id, page_number FROM document_pages WHERE has_redactions)
SELECT document_id, redacted_pages, page_list, coalesce(entities, 0) AS entities FROM (SELECT document_id, count(*) AS redacted_pages, string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) AS page_list FROM p GROUP BY 1)
LEFT JOIN (SELECT document_id, count(DISTINCT entity_id) AS entities FROM mentions SEMI JOIN p USING (document_id, page_number) GROUP BY 1) USING (document_id)""")
def redaction_audit(spark, d):
    return O.redaction_audit(table(spark, d, "document_pages"), table(spark, d, "mentions"))


@query("""SELECT document_id, page_number, preview, entities FROM (SELECT DISTINCT document_id, page_number, substr(final_text, 1, 400) AS preview FROM document_pages WHERE has_redactions)
JOIN (SELECT document_id, page_number, count(DISTINCT entity_id) AS entities FROM mentions GROUP BY 1, 2) USING (document_id, page_number) WHERE entities >= 2""")
def redaction_candidates(spark, d):
    return O.redaction_candidates(table(spark, d, "document_pages"), table(spark, d, "mentions"))


@query("""WITH c AS (SELECT strftime(created_at, '%Y-%m') AS bucket, entity_id, count(*) AS mentions FROM mentions WHERE created_at IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY bucket ORDER BY mentions DESC, entity_id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY bucket) AS nodes FROM c) SELECT bucket, nodes, entity_id, mentions, rank FROM r WHERE rank <= 40""")
def timeline_snapshots(spark, d):
    return O.timeline_snapshots(table(spark, d, "mentions"))


@query("SELECT DISTINCT id, document_id, page_number FROM document_pages WHERE contains(lower(coalesce(final_text, ocr_text)), 'data broker')")
def like_search(spark, d):
    return O.like_search(table(spark, d, "document_pages"), "data broker").select("id", "document_id", "page_number")


def like_snippets(spark, d):
    return O.like_search(table(spark, d, "document_pages"), "data broker")


QUERIES["like_snippets"] = like_snippets


@query("""SELECT DISTINCT id AS document_id FROM documents WHERE has_redactions AND created_at >= TIMESTAMP '2018-01-01' AND created_at <= TIMESTAMP '2023-12-31'
AND id IN (SELECT document_id FROM mentions m JOIN entities e ON e.id = entity_id WHERE lower(canonical_name) = 'quillmarsh records oversight company')""")
def filtered_search(spark, d):
    import datetime as dt

    return O.search_filters(table(spark, d, "documents"), table(spark, d, "mentions"), table(spark, d, "entities"), redacted=True, since=dt.datetime(2018, 1, 1), until=dt.datetime(2023, 12, 31), names=["Quillmarsh Records Oversight Company"], match="all")


@query("""SELECT id, raw_name, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(raw_name, '')), '[\\r\\n\\t]+', ' ', 'g'), '[^a-z0-9\\s:/.\\-]', '', 'g'), '\\s+', ' ', 'g')) AS normalized FROM extracted_entities""")
def normalized_names(spark, d):
    return table(spark, d, "extracted_entities").select("id", "raw_name", T.normalize(F.col("raw_name")).alias("normalized"))


@query("""WITH e AS (SELECT id, entity_type, trim(raw_name) AS n, regexp_split_to_array(lower(trim(raw_name)), '\\s+') AS t FROM extracted_entities WHERE raw_name IS NOT NULL)
SELECT id, (n = '' OR contains(n, '--') OR coalesce(entity_type = 'Date', false) OR len(t) > 6 OR t[1] IN ('the','a','an','this','that') OR NOT regexp_matches(n, '^\\p{L}') OR regexp_matches(lower(n), '( date| event| cluster| case| relationships| relationship| ecosystem| dispute| proceeding| network| platform)$')
OR (coalesce(entity_type = 'Person', false) AND (len(t) > 3 OR list_has_any(t, ['district','court','circuit','division','department','bureau','office','commission','coalition','council','committee','tribunal','authority','agency','board','expert','witness','analysis','notice','advisory','regulatory','review','market','exchange','capital','group','panel','motion','argument','production','records','emails','model','report','testimony','form','order','verdict','grid','stack','signal','platform','logic','tech','systems','software','labs','diagnostics'])))) AS noise FROM e""")
def canonical_noise(spark, d):
    x = table(spark, d, "extracted_entities").where("raw_name is not null")
    return x.select("id", T.canonical_noise(F.col("raw_name"), F.col("entity_type")).alias("noise"))


def extractor_noise(spark, d):
    x = table(spark, d, "extracted_entities")
    return x.select("id", T.extractor_noise(F.col("raw_name"), F.col("entity_type")).alias("noise"))


QUERIES["extractor_noise"] = extractor_noise


@query("""WITH t AS (SELECT id, list_filter(regexp_split_to_array(claim_text, '\\s+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT id, claim_text FROM claims WHERE claim_text IS NOT NULL))
SELECT id, (len(w) = 0 OR len(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+') OR regexp_replace(lower(x), '^[,;-]+|[,;-]+$', '', 'g') IN ('b3','b6','b7c','b7d','b7e','b7f','b5','b1','b2','bo','b6e','b6é','b7c-','b6-'))) / len(w) > 0.35 OR len(list_filter(w, lambda x: regexp_full_match(x, '\\p{L}{4,}'))) < 5) AS garbage FROM t""")
def claim_garbage(spark, d):
    c = table(spark, d, "claims").where("claim_text is not null").select("id", "claim_text").distinct()
    return c.select("id", T.ocr_garbage(F.col("claim_text")).alias("garbage"))


def page_junk(spark, d):
    p = table(spark, d, "document_pages").select("id", F.coalesce("final_text", "ocr_text").alias("t")).distinct()
    return p.select("id", T.ocr_junk(F.col("t"), "foia").alias("foia"), T.ocr_junk(F.col("t"), "case").alias("case_mode"))


QUERIES["page_junk"] = page_junk


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 680)) AS start FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(start AS INTEGER) AS start, md5(substr(text, CAST(start AS BIGINT) + 1, 800)) AS chunk_md5 FROM s""")
def fixed_chunks(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(T.fixed_chunks(F.col("text"))).alias("c"))
    return c.select("doc_id", "c.start", F.md5("c.chunk").alias("chunk_md5"))


def passages(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.posexplode(T.passages("text")).alias("no", "p"))
    return c.select("doc_id", "no", "p.char_start", "p.char_end", "p.passage")


QUERIES["passages"] = passages


def sentence_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentence_chunks("text")).alias("no", "chunk"))


QUERIES["sentence_chunks"] = sentence_chunks


@query("""SELECT id, CAST(CASE WHEN regexp_full_match(trim(normalized_date), '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') THEN try_strptime(trim(normalized_date), '%Y-%m-%d')
WHEN regexp_full_match(trim(normalized_date), '[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}') THEN try_strptime(trim(normalized_date), '%Y/%m/%d') WHEN regexp_full_match(trim(normalized_date), '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') THEN try_strptime(trim(normalized_date), '%m/%d/%Y') END AS DATE) AS day FROM narrative_claims""")
def claim_dates(spark, d):
    return table(spark, d, "narrative_claims").select("id", D.timeline_date(F.col("normalized_date")).alias("day"))


def date_mentions(spark, d):
    m = table(spark, d, "documents").select("doc_id", F.explode(D.date_mentions("text")).alias("m"))
    return m.select("doc_id", "m.date", "m.raw", "m.position", "m.context")


QUERIES["date_mentions"] = date_mentions


@query("SELECT id, CASE WHEN regexp_matches(claim_text, '\\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\\b') THEN (CASE WHEN length(split_part(h, '/', 3)) = 2 THEN (CASE WHEN CAST(split_part(h, '/', 3) AS INTEGER) < 40 THEN '20' ELSE '19' END) || split_part(h, '/', 3) ELSE lpad(split_part(h, '/', 3), 4, '0') END) || '-' || lpad(split_part(h, '/', 1), 2, '0') || '-' || lpad(split_part(h, '/', 2), 2, '0') WHEN y <> '' THEN y || '-01-01' END AS day FROM (SELECT DISTINCT id, claim_text, regexp_extract(claim_text, '\\b([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})\\b', 1) AS h, regexp_extract(claim_text, '\\b(19[0-9]{2}|20[0-9]{2})\\b', 1) AS y FROM claims WHERE claim_text IS NOT NULL)")
def claim_text_dates(spark, d):
    c = table(spark, d, "claims").where("claim_text is not null").select("id", "claim_text").distinct()
    return c.select("id", D.text_date(F.col("claim_text")).alias("day"))


@query("SELECT entity_type, canonical_name, mentions, rank FROM (SELECT entity_type, canonical_name, mentions, CAST(row_number() OVER (PARTITION BY entity_type ORDER BY mentions DESC, e.id) AS INTEGER) AS rank FROM entities e JOIN (SELECT entity_id, count(*) AS mentions FROM mentions GROUP BY 1) m ON m.entity_id = e.id) WHERE rank <= 20")
def briefing(spark, d):
    return S.briefing(table(spark, d, "entities"), table(spark, d, "mentions"))


@query("""SELECT document_id, page_number, source_tag, text FROM (SELECT DISTINCT document_id, page_number, coalesce(CASE WHEN trim(ocr_text) <> '' THEN ocr_text END, CASE WHEN trim(final_text) <> '' THEN final_text END) AS text FROM document_pages) p
JOIN (SELECT id, source_tag FROM documents WHERE status = 'done') d ON d.id = p.document_id WHERE length(trim(text)) > 50""")
def text_units(spark, d):
    return S.text_units(table(spark, d, "document_pages"), table(spark, d, "documents"))


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    from docketeer.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", ["event_type"])
