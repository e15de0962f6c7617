"""Queries of search, extraction, claims, narratives and provenance, each with its SQL where one can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketeer.functions.vectors import cosine
from docketeer.operators import extract as X
from docketeer.operators import graph as G
from docketeer.operators import narrative as N
from docketeer.operators import search as S
from docketeer.runtime import cut, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


@query("""WITH p AS (SELECT id, regexp_extract_all(lower(final_text), '[a-z0-9]+') AS w FROM (SELECT DISTINCT id, final_text FROM document_pages WHERE final_text IS NOT NULL)),
c AS (SELECT id, len(w) AS l, len(list_filter(w, lambda x: x = 'cartel')) AS t0, len(list_filter(w, lambda x: x = 'ledger')) AS t1 FROM p), s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c)
SELECT id, round(ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score FROM c, s WHERE t0 > 0 OR t1 > 0""")
def bm25(spark, d):
    return S.bm25(table(spark, d, "document_pages"), "cartel ledger").select("id", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT DISTINCT id, final_text FROM document_pages WHERE final_text IS NOT NULL), w AS (SELECT id, unnest(regexp_extract_all(lower(final_text), '[a-z0-9]+')) AS term FROM p),
k AS (SELECT id, count(*) AS length FROM w GROUP BY 1) SELECT id, term, count(*) AS tf, CAST(any_value(length) AS INTEGER) AS length FROM w JOIN k USING (id) GROUP BY 1, 2""")
def postings(spark, d):
    return S.postings(table(spark, d, "document_pages")).drop("first")


@query("""WITH p AS (SELECT id, ' ' || array_to_string(regexp_extract_all(lower(final_text), '[a-z0-9]+'), '  ') || ' ' AS j FROM (SELECT DISTINCT id, final_text FROM document_pages WHERE final_text IS NOT NULL))
SELECT id, CAST((length(j) - length(replace(j, ' the  cartel  ledger ', ''))) / length(' the  cartel  ledger ') AS INTEGER) AS hits FROM p WHERE contains(j, ' the  cartel  ledger ')""")
def phrase_search(spark, d):
    return S.phrase_search(table(spark, d, "document_pages"), "the cartel ledger", stem=False)


@query()
def stemmed_phrase_search(spark, d):
    return S.phrase_search(table(spark, d, "document_pages"), "inflated invoices", stem=True)


_NEAR = """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM v WHERE id % 100 = 0),
s AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(q.e, v.e) AS c FROM q JOIN v ON q.id <> v.id) """


@query(_NEAR + "SELECT query_id, id, round(c, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 10")
def nearest_vectors(spark, d):
    v = _vectors(spark, d)
    return S.nearest(v, v.where("id % 100 = 0"), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_HYBRID = """WITH p AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)), c AS (SELECT id, len(w) AS l, len(list_filter(w, lambda x: x = 'cartel')) AS t0 FROM p),
st AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (t0 > 0) AS d0 FROM c), kw AS (SELECT id, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * l / m)) AS s FROM c, st WHERE t0 > 0),
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), sem AS (SELECT v.id, list_cosine_similarity(q.e, v.e) AS s FROM v JOIN v q ON q.id = 100 AND v.id <> 100 ORDER BY round(s, 9) DESC, v.id LIMIT 100),
g AS (SELECT DISTINCT least(entity_a_id, entity_b_id) AS a, greatest(entity_a_id, entity_b_id) AS b FROM entity_relationships WHERE entity_a_id <> entity_b_id), dg AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM g UNION ALL SELECT b FROM g) GROUP BY 1),
bo AS (SELECT doc_id AS id, max(d) / (SELECT max(d) FROM dg) AS boost FROM mentions JOIN dg ON dg.id = entity_id JOIN documents ON documents.id = document_id GROUP BY 1),
j AS (SELECT coalesce(sem.id, kw.id) AS id, sem.s / (SELECT max(s) FROM sem) AS s, kw.s / (SELECT max(s) FROM kw) AS k FROM sem FULL JOIN kw ON sem.id = kw.id)
SELECT j.id, round(0.6 * coalesce(s, 0) + 0.3 * coalesce(k, 0) + 0.1 * coalesce(boost, 0), 6) AS score, concat_ws('+', CASE WHEN s IS NOT NULL THEN 'semantic' END, CASE WHEN k IS NOT NULL THEN 'keyword' END, CASE WHEN boost > 0 THEN 'graph' END) AS signals
FROM j LEFT JOIN bo ON bo.id = j.id ORDER BY 0.6 * coalesce(s, 0) + 0.3 * coalesce(k, 0) + 0.1 * coalesce(boost, 0) DESC, j.id LIMIT 50"""


@query(_HYBRID)
def hybrid_search(spark, d):
    """The document whose vector is asked for by id: its nearest vectors, the keyword hits of the documents' texts, and the best connected entity of each."""
    documents, v = table(spark, d, "documents"), _vectors(spark, d)
    semantic = S.nearest(v, v.where("id = 100"), 100).select("id", "score")
    keyword = S.bm25(documents, "cartel", key="doc_id", text="text")
    c = G.degrees(G.edges_of(table(spark, d, "entity_relationships")))
    boost = S.graph_boost(table(spark, d, "mentions"), c).join(documents.select("doc_id", F.col("id").alias("document_id")), "document_id").groupBy(F.col("doc_id").alias("id")).agg(F.max("boost").alias("boost"))
    return S.hybrid(semantic, keyword, boost, k=50).select("id", F.round("score", 6).alias("score"), "signals")


@query()
def regex_entities(spark, d):
    p = table(spark, d, "document_pages").select("document_id", "page_number", F.coalesce("final_text", "ocr_text").alias("text"))
    return X.regex_entities(p).drop("context")


@query("""WITH t AS (SELECT doc_id AS key, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')) AS value, 'email' AS kind FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\\b(?:[A-Za-z0-9\\-]+\\.)+[A-Za-z]{2,}\\b')), 'domain' FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b')), 'ip' FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\\b(?:19|20)\\d{2}-\\d{2}-\\d{2}\\b')), 'date' FROM documents WHERE text IS NOT NULL) SELECT key, kind, value, count(*) AS n FROM t GROUP BY ALL""")
def pattern_counts(spark, d):
    return X.pattern_counts(table(spark, d, "documents"), "doc_id").where("kind <> 'word'")


@query()
def capitalised_words(spark, d):
    return X.pattern_counts(table(spark, d, "documents"), "doc_id").where("kind = 'word'").groupBy("value").agg(F.sum("n").alias("n"))


@query()
def upserted_entities(spark, d):
    p = table(spark, d, "document_pages").select("document_id", "page_number", F.coalesce("final_text", "ocr_text").alias("text"))
    found = X.regex_entities(p, kinds=("Aircraft", "Phone", "Email", "Date"))
    return X.upsert_entities(found).select("entity_type", "canonical_name", "confidence", F.size("aliases").alias("n_aliases"))


@query("""WITH s AS (SELECT DISTINCT document_id, page_number, entity_id FROM mentions), w AS (SELECT DISTINCT x.document_id, x.entity_id AS a, y.entity_id AS b, 'mentioned_with' AS kind, 0.65::DOUBLE AS confidence FROM s x JOIN s y ON x.document_id = y.document_id AND x.page_number = y.page_number AND x.entity_id < y.entity_id),
t AS (SELECT DISTINCT document_id, unnest(regexp_extract_all(final_text, '(?m)^([A-Z][\\w.&'' \\-]+? v\\. [A-Z][\\w.&'' \\-]+?)(?: —|,|$)', 1)) AS t FROM document_pages WHERE final_text IS NOT NULL),
n AS (SELECT canonical_name AS x, min(id) AS i FROM entities GROUP BY 1), f AS (SELECT document_id, least(p.i, q.i) AS a, greatest(p.i, q.i) AS b, 'filed_against' AS kind, 0.72::DOUBLE AS confidence FROM t JOIN n p ON p.x = split_part(t, ' v. ', 1) JOIN n q ON q.x = split_part(t, ' v. ', 2) WHERE p.i <> q.i)
SELECT document_id, a, b, arg_max(kind, confidence) AS kind, max(confidence) AS confidence FROM (SELECT * FROM w UNION ALL SELECT * FROM f) GROUP BY 1, 2, 3""")
def typed_relationships(spark, d):
    return X.typed_relationships(table(spark, d, "document_pages"), table(spark, d, "mentions"), table(spark, d, "entities"))


@query()
def heuristic_claims(spark, d):
    return X.heuristic_claims(table(spark, d, "document_pages"), table(spark, d, "mentions"), table(spark, d, "entities"))


@query()
def statement_claims(spark, d):
    return X.statement_claims(table(spark, d, "documents"), "doc_id")


@query("""WITH c AS (SELECT DISTINCT * FROM claims) SELECT subject_entity_id, claim_type, count(*) AS claims, count(DISTINCT document_id) AS documents, count(DISTINCT speaker_entity_id) AS speakers, substr(arg_min(claim_text, (created_at, id)), 1, 200) AS sample,
coalesce(min(CASE WHEN sentiment IS NULL THEN NULL WHEN sentiment <> 'negative' THEN 1 ELSE 0 END), 1) = 1 AS unchallenged FROM c GROUP BY 1, 2 HAVING count(DISTINCT document_id) >= 2""")
def claim_propagation(spark, d):
    return N.claim_propagation(table(spark, d, "claims"))


@query("""WITH c AS (SELECT DISTINCT id, subject_entity_id, document_id, claim_type, sentiment, created_at FROM claims WHERE subject_entity_id IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY subject_entity_id ORDER BY created_at NULLS FIRST, id) AS k FROM c WHERE claim_type = 'allegation'), n AS (SELECT *, row_number() OVER (PARTITION BY subject_entity_id ORDER BY created_at NULLS FIRST, id) AS k FROM c WHERE claim_type = 'denial'),
p AS (SELECT *, row_number() OVER (PARTITION BY subject_entity_id ORDER BY created_at NULLS FIRST, id) AS k FROM c WHERE sentiment = 'positive'), g AS (SELECT *, row_number() OVER (PARTITION BY subject_entity_id ORDER BY created_at NULLS FIRST, id) AS k FROM c WHERE sentiment = 'negative')
SELECT a.subject_entity_id, a.id AS claim_a, n.id AS claim_b, 'allegation_denial' AS reason FROM a JOIN n USING (subject_entity_id) WHERE a.k <= 3 AND n.k <= 3 AND a.document_id <> n.document_id
UNION ALL SELECT p.subject_entity_id, p.id, g.id, 'sentiment' FROM p JOIN g USING (subject_entity_id) WHERE p.k <= 2 AND g.k <= 2 AND p.document_id <> g.document_id""")
def claim_contradictions(spark, d):
    return N.claim_contradictions(table(spark, d, "claims"))


@query("""SELECT subject_entity_id, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, count(DISTINCT document_id) AS documents FROM (SELECT DISTINCT * FROM claims WHERE confidence >= 0.5 AND subject_entity_id IS NOT NULL) GROUP BY 1
HAVING count(*) FILTER (sentiment = 'positive') > 0 AND count(*) FILTER (sentiment = 'negative') > 0""")
def mixed_sentiment(spark, d):
    return N.mixed_sentiment(table(spark, d, "claims"))


@query()
def narrative_contradictions(spark, d):
    return N.narrative_contradictions(table(spark, d, "narrative_claims"), table(spark, d, "narrative_evidence_spans"))


@query()
def narrative_propagation(spark, d):
    return N.narrative_propagation(table(spark, d, "narrative_claims"), table(spark, d, "narrative_evidence_spans"))


@query()
def claim_lineage(spark, d):
    return N.claim_lineage(table(spark, d, "claims"))


@query("""WITH e AS (SELECT id AS entity_id, entity_type, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(canonical_name, '')), '[\\r\\n\\t]+', ' ', 'g'), '[^a-z0-9\\s:/._,\\-]', '', 'g'), '\\s+', ' ', 'g')) AS n FROM entities WHERE entity_type IN ('Person', 'Organization', 'Location')), c AS (SELECT DISTINCT id AS claim_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(claim_text, '')), '[\\r\\n\\t]+', ' ', 'g'), '[^a-z0-9\\s:/._,\\-]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM claims WHERE claim_text IS NOT NULL)
SELECT DISTINCT claim_id, entity_id, CAST(CASE WHEN entity_type = 'Person' THEN 1.0 ELSE 0.8 END AS DOUBLE) AS score FROM c JOIN e ON length(n) >= 4 AND contains(t, n)""")
def claim_entity_links(spark, d):
    return N.claim_entity_links(table(spark, d, "claims"), table(spark, d, "entities"))


@query("""WITH e AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS actor, CAST(ts AS DATE) AS date, event_type AS place FROM events)
SELECT a.actor, a.date, a.id AS id_a, b.id AS id_b FROM e a JOIN e b ON a.actor = b.actor AND a.date = b.date AND a.id < b.id AND a.place <> b.place""")
def temporal_anomalies(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("actor"), F.to_date("ts").alias("date"), F.col("event_type").alias("place"))
    return N.temporal_anomalies(e)


@query("SELECT event_id, count(*) FILTER (coalesce(role, '') <> 'contradiction') AS supports, count(*) FILTER (role = 'contradiction') AS contradictions, round(count(*) FILTER (coalesce(role, '') <> 'contradiction') / (count(*) FILTER (coalesce(role, '') <> 'contradiction') + count(*) FILTER (role = 'contradiction') + 1), 6) AS confidence FROM narrative_event_claim_map GROUP BY 1")
def event_support(spark, d):
    return N.event_support(table(spark, d, "narrative_event_claim_map")).withColumn("confidence", F.round("confidence", 6))


@query("""WITH c AS (SELECT n.id, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(subject, '')), '[\\r\\n\\t]+', ' ', 'g'), '[^a-z0-9\\s:/._,\\-]', '', 'g'), '\\s+', ' ', 'g')) || '|' || trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(predicate, '')), '[\\r\\n\\t]+', ' ', 'g'), '[^a-z0-9\\s:/._,\\-]', '', 'g'), '\\s+', ' ', 'g')) || '|' || trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(object, '')), '[\\r\\n\\t]+', ' ', 'g'), '[^a-z0-9\\s:/._,\\-]', '', 'g'), '\\s+', ' ', 'g')) || '|' || trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(normalized_date, '')), '[\\r\\n\\t]+', ' ', 'g'), '[^a-z0-9\\s:/._,\\-]', '', 'g'), '\\s+', ' ', 'g')) AS event_key, document_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(predicate, '')), '[\\r\\n\\t]+', ' ', 'g'), '[^a-z0-9\\s:/.\\-]', '', 'g'), '\\s+', ' ', 'g')) AS p, claim_type FROM narrative_claims n LEFT JOIN narrative_evidence_spans s ON s.id = evidence_span_id),
t AS (SELECT *, CASE WHEN regexp_matches(p, 'met|meeting|visited') THEN 'meeting' WHEN regexp_matches(p, 'flew|traveled|flight') THEN 'travel' WHEN regexp_matches(p, 'paid|transferred|wired') THEN 'financial' WHEN regexp_matches(p, 'called|emailed|wrote') THEN 'communication' WHEN claim_type IN ('allegation', 'denial', 'observation') THEN claim_type ELSE 'statement' END AS e FROM c)
SELECT event_key, count(*) AS claims, min(id) AS first_claim, arg_min(e, id) AS event_type, count(DISTINCT document_id) AS documents FROM t GROUP BY 1""")
def canonical_events(spark, d):
    return N.canonical_events(table(spark, d, "narrative_claims"), table(spark, d, "narrative_evidence_spans"))


@query()
def narrative_scores(spark, d):
    claims, evidence = table(spark, d, "narrative_claims"), table(spark, d, "narrative_evidence_spans")
    edges = cut(N.narrative_propagation(claims, evidence).unionByName(N.narrative_contradictions(claims, evidence).select("src", "dst", F.lit("CONTRADICTS").alias("edge_type"), "score")))
    return N.entity_scores(claims, edges).select("entity", F.round("influence", 9).alias("influence"), F.round("witness", 6).alias("witness"), "contradictions")


@query("""WITH l AS (SELECT src_claim_id AS src, dst_claim_id AS dst FROM narrative_claim_lineage WHERE src_claim_id <> dst_claim_id), w AS (SELECT DISTINCT id, speaker_entity_id AS actor FROM claims WHERE speaker_entity_id IS NOT NULL),
o AS (SELECT actor, count(*) AS outgoing FROM l JOIN w ON w.id = src GROUP BY 1), i AS (SELECT actor, count(*) AS incoming FROM l JOIN w ON w.id = dst GROUP BY 1),
b AS (SELECT actor, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) AS incoming FROM o FULL JOIN i USING (actor))
SELECT actor, incoming, outgoing, CASE WHEN outgoing > 2 * incoming AND incoming > 0 AND outgoing >= 3 THEN 'amplifier' WHEN incoming = 0 AND outgoing >= 2 THEN 'originator' WHEN incoming >= 3 AND outgoing = 0 THEN 'suppressor' ELSE 'relay' END AS broker_type FROM b""")
def provenance_brokers(spark, d):
    edges = table(spark, d, "narrative_claim_lineage").select(F.col("src_claim_id").alias("src"), F.col("dst_claim_id").alias("dst")).where("src <> dst")
    return N.brokers(edges, table(spark, d, "claims"))


@query()
def leader_clusters(spark, d):
    return N.leader_clusters(_vectors(spark, d))


@query()
def provenance_threads(spark, d):
    v = _vectors(spark, d)
    return N.threads(v, cut(N.leader_clusters(v, 0.3))).withColumn("coherence", F.round("coherence", 6))


@query()
def provenance_dag(spark, d):
    v = _vectors(spark, d)
    return N.thread_dag(v, cut(N.leader_clusters(v, 0.3)), 0.3).withColumn("mutation", F.round("mutation", 6))


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS sim, a.label AS la, b.label AS lb FROM v a JOIN v b ON a.id < b.id AND a.id % 100 = 0)
SELECT a, b, CASE WHEN la <> lb AND sim > 0.78 THEN 'identity' ELSE 'presence' END AS contradiction_type, round(CASE WHEN la <> lb AND sim > 0.78 THEN sim ELSE 0.8 * sim END, 6) AS severity FROM p WHERE la <> lb AND (sim > 0.68)""")
def provenance_contradictions(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    # the query set: every id divisible by 100 against all rows; its size is checked for broadcast
    from docketeer.runtime import lookup_side

    q = v.where("id % 100 = 0")
    pairs = lookup_side(q.toDF("a", "va", "la")).join(v.toDF("b", "vb", "lb"), F.col("a") < F.col("b")).select("a", "b", cosine(F.col("va"), F.col("vb")).alias("sim"), F.col("la").cast("string").alias("actor_a"), F.col("lb").cast("string").alias("actor_b"), F.col("a").cast("string").alias("doc_a"), F.col("b").cast("string").alias("doc_b"))
    pairs = pairs.withColumns({"date_a": F.lit(None).cast("date"), "date_b": F.lit(None).cast("date"), "negation_differs": F.lit(False)})
    return N.classify_contradictions(pairs).withColumn("severity", F.round("severity", 6))
