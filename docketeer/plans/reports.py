"""Queries of readers, summaries and profiles, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketeer.operators import extract as X
from docketeer.operators import graph as G
from docketeer.operators import narrative as N
from docketeer.operators import reports as P
from docketeer.operators import search as S
from docketeer.operators import tables as O
from docketeer.plans.texts_and_claims import SQL as _TEXTS
from docketeer.runtime import cut, table

QUERIES, SQL = {}, {}
TYPED = _TEXTS["typed_relationships"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_C = "WITH c AS (SELECT DISTINCT * FROM claims)"
_EDGES = "edges AS (SELECT least(entity_a_id, entity_b_id) AS a, greatest(entity_a_id, entity_b_id) AS b, CAST(sum(coalesce(weight, 1)) AS BIGINT) AS weight FROM entity_relationships WHERE entity_a_id IS NOT NULL AND entity_b_id IS NOT NULL AND entity_a_id <> entity_b_id GROUP BY 1, 2), near AS (SELECT a, b, weight FROM edges UNION ALL SELECT b, a, weight FROM edges), deg AS (SELECT a AS id, count(*) AS d FROM near GROUP BY 1)"
#: The entity with the most ties, of equal ones the first.
_TOP = "top AS (SELECT id FROM deg ORDER BY d DESC, id LIMIT 1)"


def _t(spark, d, *names):
    return [table(spark, d, n) for n in names]


def _edges(spark, d):
    return G.edges_of(table(spark, d, "entity_relationships"))


def _hub(spark, d):
    top = G.degrees(_edges(spark, d)).orderBy(F.desc("degree"), "id").first()
    return top["id"] if top else ""


def _patterns(spark, d):
    return X.pattern_counts(table(spark, d, "documents"), "doc_id")


@query("SELECT DISTINCT c.id, c.document_id, claim_type, claim_text, source_tag FROM claims c LEFT JOIN (SELECT DISTINCT id, source_tag FROM documents) d ON d.id = c.document_id")
def claim_rows(spark, d):
    return P.claim_rows(*_t(spark, d, "claims", "documents"))


@query("SELECT c.id, c.document_id, e.canonical_name AS speaker, CAST(d.created_at AS DATE) AS day, claim_text FROM (SELECT DISTINCT id, document_id, speaker_entity_id, claim_text FROM claims WHERE claim_text IS NOT NULL) c JOIN documents d ON d.id = c.document_id LEFT JOIN entities e ON e.id = speaker_entity_id")
def dated_claims(spark, d):
    return P.dated_claims(*_t(spark, d, "claims", "entities", "documents"))


@query("""WITH s AS (SELECT subject FROM narrative_claims WHERE subject IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT id, subject, predicate, object, claim_type, extractor_confidence FROM narrative_claims WHERE lower(subject) = (SELECT lower(subject) FROM s) OR lower(object) = (SELECT lower(subject) FROM s) ORDER BY extractor_confidence DESC NULLS LAST, id DESC LIMIT 25""")
def claims_about(spark, d):
    c = table(spark, d, "narrative_claims")
    top = P.usual_value(c.withColumn("one", F.lit(1)), "one", "subject").first()
    return P.claims_about(c, top["subject"] if top else "")


@query("SELECT c.id, CASE WHEN s.canonical_name IS NOT NULL THEN s.canonical_name || ' states: ' ELSE '' END || claim_text || CASE WHEN o.canonical_name IS NOT NULL THEN ' [about: ' || o.canonical_name || ']' ELSE '' END AS text FROM (SELECT DISTINCT id, speaker_entity_id, subject_entity_id, claim_text FROM claims WHERE claim_text IS NOT NULL) c LEFT JOIN entities s ON s.id = speaker_entity_id LEFT JOIN entities o ON o.id = subject_entity_id")
def enriched_claims(spark, d):
    return P.enriched_claims(*_t(spark, d, "claims", "entities"))


@query("""WITH c AS (SELECT DISTINCT id, subject_entity_id, document_id, claim_type, sentiment, created_at FROM claims WHERE subject_entity_id IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY subject_entity_id ORDER BY created_at NULLS FIRST, id) AS k FROM c WHERE claim_type = 'allegation'), n AS (SELECT *, row_number() OVER (PARTITION BY subject_entity_id ORDER BY created_at NULLS FIRST, id) AS k FROM c WHERE claim_type = 'denial'),
p AS (SELECT *, row_number() OVER (PARTITION BY subject_entity_id ORDER BY created_at NULLS FIRST, id) AS k FROM c WHERE sentiment = 'positive'), g AS (SELECT *, row_number() OVER (PARTITION BY subject_entity_id ORDER BY created_at NULLS FIRST, id) AS k FROM c WHERE sentiment = 'negative'),
q AS (SELECT a.id AS claim_a, n.id AS claim_b, 'allegation_denial' AS reason FROM a JOIN n USING (subject_entity_id) WHERE a.k <= 3 AND n.k <= 3 AND a.document_id <> n.document_id
UNION ALL SELECT p.id, g.id, 'sentiment' FROM p JOIN g USING (subject_entity_id) WHERE p.k <= 2 AND g.k <= 2 AND p.document_id <> g.document_id),
w AS (SELECT DISTINCT c.id, claim_text, canonical_name AS actor FROM claims c LEFT JOIN entities e ON e.id = speaker_entity_id)
SELECT claim_a, claim_b, reason, x.claim_text AS text_a, x.actor AS actor_a, y.claim_text AS text_b, y.actor AS actor_b FROM q JOIN w x ON x.id = claim_a JOIN w y ON y.id = claim_b""")
def contradiction_parties(spark, d):
    claims, entities = _t(spark, d, "claims", "entities")
    return P.claim_parties(N.claim_contradictions(claims).drop("subject_entity_id"), claims, entities)


@query("""WITH n AS (SELECT DISTINCT id AS claim_id, lower(trim(speaker)) AS name FROM narrative_claims WHERE speaker IS NOT NULL AND trim(speaker) <> ''), e AS (SELECT id AS entity_id, lower(canonical_name) AS f FROM entities WHERE canonical_name IS NOT NULL),
b AS (SELECT name, arg_min(entity_id, (f <> name, entity_id)) AS entity_id FROM (SELECT DISTINCT name FROM n) JOIN e ON contains(f, name) AND list_contains(string_split(f, ' '), string_split(name, ' ')[1]) GROUP BY 1) SELECT claim_id, entity_id FROM n JOIN b USING (name)""")
def claims_by_name(spark, d):
    named = table(spark, d, "narrative_claims").select(F.col("id").alias("claim_id"), F.col("speaker").alias("name"))
    return P.claims_by_name(named, table(spark, d, "entities"))


@query("""SELECT m.event_id, m.claim_id, m.role, c.claim_text, e.canonical_name AS speaker FROM (SELECT DISTINCT event_id, lower(trim(claim_id)) AS claim_id, role FROM narrative_event_claim_map) m JOIN (SELECT DISTINCT lower(id) AS claim_id, claim_text, speaker_entity_id FROM claims) c USING (claim_id) LEFT JOIN entities e ON e.id = speaker_entity_id""")
def event_claims(spark, d):
    return P.event_claims(*_t(spark, d, "narrative_event_claim_map", "claims", "entities"))


@query("SELECT event_id, count(DISTINCT CASE WHEN role = 'contradiction' THEN claim_id END) AS n FROM narrative_event_claim_map GROUP BY 1")
def event_contradictions(spark, d):
    return P.role_counts(table(spark, d, "narrative_event_claim_map"), "contradiction")


@query("SELECT DISTINCT event_id FROM narrative_event_claim_map WHERE event_id NOT IN (SELECT event_id FROM narrative_event_claim_map WHERE lower(trim(claim_id)) IN (SELECT lower(id) FROM claims) AND event_id IS NOT NULL)")
def events_without_claims(spark, d):
    m, c = _t(spark, d, "narrative_event_claim_map", "claims")
    good = m.withColumn("k", F.lower(F.trim("claim_id"))).join(c.select(F.lower("id").alias("k")), "k", "left_semi")
    return P.without_map(m, good)


@query("""WITH r AS (SELECT DISTINCT event_id, lower(trim(claim_id)) AS k FROM narrative_event_claim_map), c AS (SELECT lower(id) AS k, unnest([speaker_entity_id, subject_entity_id]) AS e FROM claims), n AS (SELECT DISTINCT event_id, e FROM r JOIN c USING (k) WHERE e IS NOT NULL),
g AS (SELECT least(entity_a_id, entity_b_id) AS a, greatest(entity_a_id, entity_b_id) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM entity_relationships WHERE entity_a_id <> entity_b_id GROUP BY 1, 2)
SELECT x.event_id, a, b, weight FROM n x JOIN g ON x.e = a JOIN n y ON y.e = b AND y.event_id = x.event_id""")
def event_relationships(spark, d):
    return P.event_relationships(*_t(spark, d, "narrative_event_claim_map", "claims", "entity_relationships"))


@query("""WITH t AS (SELECT DISTINCT subject_entity_id, id, CAST(created_at AS DATE) AS day FROM claims WHERE subject_entity_id IS NOT NULL), s AS (SELECT subject_entity_id, min(day) AS f, max(day) AS l FROM t GROUP BY 1)
SELECT subject_entity_id, id, round(CASE WHEN f IS NULL THEN 0.5 WHEN day IS NULL THEN 0 WHEN f = l THEN 0.5 ELSE 1 - (day - f) / (l - f) END, 6) AS earliness FROM t JOIN s USING (subject_entity_id)""")
def earliest_claims(spark, d):
    rows = table(spark, d, "claims").where("subject_entity_id is not null").select("subject_entity_id", "id", F.to_date("created_at").alias("day")).distinct()
    return P.first_dates(rows, "subject_entity_id").withColumn("earliness", F.round("earliness", 6))


@query("SELECT id, normalized_date, subject, predicate, object FROM narrative_claims WHERE normalized_date IS NOT NULL AND trim(normalized_date) <> '' ORDER BY normalized_date, id LIMIT 100")
def claim_timeline(spark, d):
    return P.timeline(table(spark, d, "narrative_claims"))


@query("""WITH m AS (SELECT entity_id, c, row_number() OVER (PARTITION BY entity_id ORDER BY id) AS k FROM (SELECT DISTINCT entity_id, id, substr(context_text, 1, 200) AS c FROM mentions WHERE context_text IS NOT NULL AND trim(context_text) <> ''))
SELECT entity_id, canonical_name || ': ' || t AS text FROM (SELECT entity_id, string_agg(c, ' | ' ORDER BY k) AS t FROM m WHERE k <= 5 GROUP BY 1) JOIN entities ON entities.id = entity_id""")
def entity_contexts(spark, d):
    return P.entity_contexts(*_t(spark, d, "mentions", "entities"))


@query("""WITH m AS (SELECT entity_id, document_id, context_text, row_number() OVER (PARTITION BY entity_id, document_id ORDER BY id) AS k FROM (SELECT DISTINCT entity_id, document_id, id, context_text FROM mentions WHERE context_text IS NOT NULL))
SELECT entity_id, document_id, string_agg(context_text, chr(10) ORDER BY k) AS snippets FROM m WHERE k <= 3 GROUP BY 1, 2""")
def first_snippets(spark, d):
    return P.first_snippets(table(spark, d, "mentions"))


@query(f"WITH {_EDGES}, {_TOP} SELECT b AS id, canonical_name, weight FROM near JOIN entities e ON e.id = b WHERE a = (SELECT id FROM top)")
def hub_neighbours(spark, d):
    return P.neighbours(_edges(spark, d), table(spark, d, "entities"), _hub(spark, d))


@query("""WITH r AS (SELECT id AS row, entity_a_id AS x, entity_b_id AS y, coalesce(weight, 1) AS weight, relationship_type FROM entity_relationships WHERE entity_a_id <> entity_b_id), b AS (SELECT row, x AS id, y AS other, weight, relationship_type FROM r UNION ALL SELECT row, y, x, weight, relationship_type FROM r)
SELECT id, other, weight, relationship_type FROM (SELECT *, row_number() OVER (PARTITION BY id, other ORDER BY weight DESC, row DESC) AS k FROM b) WHERE k = 1""")
def strongest_relationships(spark, d):
    return P.strongest_relationship(table(spark, d, "entity_relationships"))


@query(f"WITH {_EDGES}, t AS (SELECT entity_id AS id FROM mentions WHERE entity_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 150) SELECT a, b, weight FROM edges WHERE a IN (SELECT id FROM t) AND b IN (SELECT id FROM t)")
def capped_graph(spark, d):
    counts = table(spark, d, "mentions").where("entity_id is not null").groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    return P.capped_graph(_edges(spark, d), counts, 150)


@query("""WITH t AS (SELECT entity_id AS e, row_number() OVER (ORDER BY count(*) DESC, entity_id) AS k FROM mentions WHERE entity_id IS NOT NULL GROUP BY 1), m AS (SELECT DISTINCT document_id, k, page_number FROM mentions JOIN t ON e = entity_id WHERE k <= 2)
SELECT document_id, string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) FILTER (k = 1) AS pages_a, string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) FILTER (k = 2) AS pages_b FROM m GROUP BY 1 HAVING count(DISTINCT k) = 2""")
def shared_documents(spark, d):
    m = table(spark, d, "mentions")
    top = [r["entity_id"] for r in m.where("entity_id is not null").groupBy("entity_id").count().orderBy(F.desc("count"), "entity_id").limit(2).collect()] + ["", ""]
    return P.shared_documents(m, top[0], top[1])


@query("SELECT entity_type, count(*) AS n, CAST(sum(coalesce(mention_count, 0)) AS BIGINT) AS mentions, count(*) FILTER (aliases IS NULL OR len(aliases) = 0) AS without_aliases FROM entities GROUP BY 1")
def entity_audit(spark, d):
    return P.entity_audit(table(spark, d, "entities"))


@query("""WITH s AS (SELECT DISTINCT id, claim_text, e FROM (SELECT id, claim_text, unnest([speaker_entity_id, subject_entity_id]) AS e FROM claims) WHERE e IS NOT NULL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY e ORDER BY id) AS INTEGER) AS rank FROM s)
SELECT e AS entity_id, r.id AS claim_id, mentions, substr(claim_text, 1, 220) AS excerpt, rank FROM r JOIN (SELECT entity_id, count(*) AS mentions FROM mentions GROUP BY 1) m ON m.entity_id = e WHERE rank <= 8""")
def narrative_summary(spark, d):
    return P.narrative_summary(*_t(spark, d, "claims", "mentions"))


@query("SELECT subject, predicate, n FROM (SELECT subject, predicate, count(*) AS n, row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, predicate) AS k FROM narrative_claims WHERE subject IS NOT NULL AND predicate IS NOT NULL GROUP BY 1, 2) WHERE k = 1")
def usual_predicates(spark, d):
    return P.usual_value(table(spark, d, "narrative_claims"), "subject", "predicate")


_FOUND = """f AS (SELECT doc_id AS key, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')) AS value, 'email' AS kind FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\\b(?:19|20)\\d{2}-\\d{2}-\\d{2}\\b')), 'date' FROM documents WHERE text IS NOT NULL)"""


@query(f"WITH {_FOUND}, w AS (SELECT kind, value FROM f GROUP BY 1, 2 HAVING count(DISTINCT key) > 1) SELECT DISTINCT key, kind, value FROM f JOIN w USING (kind, value)")
def case_graph(spark, d):
    found = cut(_patterns(spark, d).where("kind in ('email', 'date')"))
    wanted = found.groupBy("kind", "value").agg(F.count_distinct("key").alias("docs")).where("docs > 1")
    return P.case_graph(found, wanted)


@query(f"WITH {_FOUND} SELECT DISTINCT kind, value FROM f")
def case_ingest(spark, d):
    found = _patterns(spark, d)
    return P.case_ingest(found.where("kind = 'email'"), found.where("kind = 'date'"))


@query(f"WITH {_FOUND} SELECT kind, value, count(*) AS n FROM f GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 15")
def case_summary(spark, d):
    return P.case_summary(_patterns(spark, d).where("kind in ('email', 'date')"))


@query(f"WITH {_FOUND} SELECT DISTINCT key, value FROM f WHERE kind = 'date'")
def case_timeline(spark, d):
    return P.case_timeline(_patterns(spark, d))


@query("""WITH p AS (SELECT id, document_id, page_number, regexp_extract_all(lower(final_text), '[a-z0-9]+') AS w FROM (SELECT DISTINCT id, document_id, page_number, final_text FROM document_pages WHERE final_text IS NOT NULL)),
c AS (SELECT id, document_id, page_number, len(w) AS l, len(list_filter(w, lambda x: x = 'cartel')) AS t0 FROM p), s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (t0 > 0) AS d0 FROM c),
h AS (SELECT id, document_id, page_number, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * l / m)) AS score FROM c, s WHERE t0 > 0), a AS (SELECT h.*, filename, source_tag, count(*) OVER () AS total FROM h JOIN documents d ON d.id = document_id WHERE d.status = 'done'),
o AS (SELECT * FROM a ORDER BY score DESC, id LIMIT 20 OFFSET 20),
k AS (SELECT document_id, page_number, canonical_name, row_number() OVER (PARTITION BY document_id, page_number ORDER BY canonical_name) AS r FROM (SELECT DISTINCT document_id, page_number, canonical_name FROM mentions JOIN entities e ON e.id = entity_id))
SELECT id, o.document_id, o.page_number, filename, source_tag, round(greatest(0, least(1, 1 - score / 20)), 4) AS closeness, round(score, 6) AS score, coalesce(names, '') AS names, total FROM o LEFT JOIN (SELECT document_id, page_number, string_agg(canonical_name, '; ' ORDER BY r) AS names FROM k WHERE r <= 20 GROUP BY 1, 2) USING (document_id, page_number)""")
def search_results(spark, d):
    pages, documents, mentions, entities = _t(spark, d, "document_pages", "documents", "mentions", "entities")
    allowed = O.documents_list(documents, status="done").select(F.col("id").alias("document_id"))
    return P.result_list(S.bm25(pages, "cartel"), pages, documents, mentions, entities, allowed, page=2).withColumn("score", F.round("score", 6))


@query()
def search_windows(spark, d):
    pages = table(spark, d, "document_pages").where("final_text is not null").select("id", "final_text").distinct()
    return S.bm25(pages, "cartel ledger").join(pages, "id").select("id", P.best_window(F.col("final_text"), "cartel ledger").alias("snippet"))


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), q AS (SELECT * FROM v WHERE id % 100 = 0), s AS (SELECT q.id AS query_id, v.id, v.label, list_cosine_similarity(q.e, v.e) AS c FROM q JOIN v ON q.id <> v.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, id) AS k FROM s), t AS (SELECT * FROM r WHERE k <= 20 AND c >= 0.1 AND label % 2 = 1)
SELECT query_id, id, round(c, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, id) AS INTEGER) AS rank FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, id) <= 10""")
def similar_of_kind(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), (F.col("label") % 2 == 1).cast("string").alias("kind"))
    found = S.nearest(v, v.where("id % 100 = 0"), 20)
    return P.similar_above(found, v, 0.1, "true").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT 'claims' AS name, count(*) AS n FROM narrative_claims UNION ALL SELECT 'evidence', count(*) FROM narrative_evidence_spans UNION ALL SELECT 'events', count(DISTINCT event_id) FROM narrative_event_claim_map UNION ALL SELECT 'lineage', count(*) FROM narrative_claim_lineage")
def narrative_status(spark, d):
    c, e, m, n = _t(spark, d, "narrative_claims", "narrative_evidence_spans", "narrative_event_claim_map", "narrative_claim_lineage")
    return P.status_counts(claims=c, evidence=e, events=m.where("event_id is not null").select("event_id").distinct(), lineage=n)


@query("SELECT lower(trim(relation_type)) AS relation, count(*) AS n FROM narrative_claim_lineage GROUP BY 1")
def lineage_kinds(spark, d):
    return table(spark, d, "narrative_claim_lineage").groupBy(F.lower(F.trim("relation_type")).alias("relation")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (score >= 0.75) AS high, arg_min(id, (-score, id)) AS top_id, max(score) AS top FROM narrative_claim_lineage")
def lineage_overview(spark, d):
    return P.overview(table(spark, d, "narrative_claim_lineage"), "score", 0.75)


@query("SELECT id, source_type, CAST(CASE lower(trim(source_type)) WHEN 'court' THEN 0.9 WHEN 'press' THEN 0.5 ELSE 0.3 END AS DOUBLE) AS reliability FROM narrative_sources")
def source_reliability(spark, d):
    return P.source_reliability(table(spark, d, "narrative_sources"), {"court": 0.9, "press": 0.5}).select("id", "source_type", "reliability")


@query(f"WITH {_EDGES}, n AS (SELECT count(*) AS n FROM (SELECT id FROM entities UNION SELECT id FROM deg)) SELECT id, coalesce(d, 0) AS degree, round(coalesce(d, 0) / (n - 1), 9) AS centrality FROM (SELECT id FROM entities UNION SELECT id FROM deg) LEFT JOIN deg USING (id), n")
def degree_share(spark, d):
    return G.degree_share(_edges(spark, d), table(spark, d, "entities")).withColumn("centrality", F.round("centrality", 9))


@query(f"WITH r AS ({TYPED}) SELECT a, b, kind, confidence, document_id, CAST(1 AS INTEGER) AS weight, CAST(1 AS INTEGER) AS doc_count FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY confidence DESC, document_id DESC) AS k FROM r) WHERE k = 1")
def upserted_relationships(spark, d):
    return X.upsert_relationships(X.typed_relationships(*_t(spark, d, "document_pages", "mentions", "entities")))


@query("""WITH g AS (SELECT DISTINCT document_id FROM document_pages WHERE has_redactions), left_ AS (SELECT entity_id, count(*) AS n FROM mentions WHERE document_id NOT IN (SELECT document_id FROM g) GROUP BY 1)
SELECT e.id, n AS mention_count FROM entities e JOIN left_ l ON l.entity_id = e.id""")
def wiped_entities(spark, d):
    pages, mentions, entities = _t(spark, d, "document_pages", "mentions", "entities")
    gone = pages.where("has_redactions").select("document_id").distinct()
    return O.wipe_documents(entities, mentions, gone)["entities"].select("id", "mention_count")


@query("""WITH m AS (SELECT min(id) OVER (PARTITION BY entity_type, lower(trim(canonical_name))) AS keep, id FROM entities), v AS (SELECT id FROM m WHERE keep <> id) SELECT r.id, entity_a_id, entity_b_id FROM entity_relationships r WHERE entity_a_id NOT IN (SELECT id FROM v) AND entity_b_id NOT IN (SELECT id FROM v)""")
def edges_without_merged(spark, d):
    from docketeer.operators.resolve import drop_edges

    e = table(spark, d, "entities").select("id", "entity_type", F.lower(F.trim("canonical_name")).alias("n"))
    mapping = e.join(e.groupBy("entity_type", "n").agg(F.min("id").alias("new")), ["entity_type", "n"]).select(F.col("id").alias("old"), "new")
    return drop_edges(table(spark, d, "entity_relationships"), mapping).select("id", "entity_a_id", "entity_b_id")


@query("""SELECT id, document_id, CASE WHEN regexp_full_match(substr(normalized_date, 1, 10), '\\d{4}-\\d{2}-\\d{2}') THEN try_strptime(substr(normalized_date, 1, 10), '%Y-%m-%d') END::DATE AS day FROM (SELECT DISTINCT c.id, s.document_id, normalized_date FROM narrative_claims c JOIN narrative_evidence_spans s ON s.id = evidence_span_id)""")
def evidence_dates(spark, d):
    c, s = _t(spark, d, "narrative_claims", "narrative_evidence_spans")
    rows = c.select("id", "evidence_span_id", "normalized_date").join(s.select(F.col("id").alias("evidence_span_id"), "document_id"), "evidence_span_id")
    day = F.substring("normalized_date", 1, 10)
    return rows.select("id", "document_id", F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date")).alias("day")).distinct()


@query("""WITH c AS (SELECT DISTINCT id, speaker_entity_id, document_id, claim_type FROM claims WHERE speaker_entity_id IS NOT NULL) SELECT e.id, canonical_name, count(*) AS claims, count(DISTINCT document_id) AS documents, count(*) FILTER (claim_type = 'denial') AS denials FROM c JOIN entities e ON e.id = speaker_entity_id GROUP BY 1, 2""")
def actor_profiles(spark, d):
    claims, entities = _t(spark, d, "claims", "entities")
    c = claims.where("speaker_entity_id is not null").select("id", "speaker_entity_id", "document_id", "claim_type").distinct()
    who = entities.select(F.col("id").alias("speaker_entity_id"), "canonical_name")
    return c.groupBy("speaker_entity_id").agg(F.count("*").alias("claims"), F.count_distinct("document_id").alias("documents"), F.count_if(F.col("claim_type") == "denial").alias("denials")).join(who, "speaker_entity_id").withColumnRenamed("speaker_entity_id", "id")
