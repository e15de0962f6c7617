"""Queries of whole builds, each with its SQL where one can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketeer.functions.vectors import cosine
from docketeer.operators import builds as B
from docketeer.operators import extract as X
from docketeer.operators import graph as G
from docketeer.operators import narrative as N
from docketeer.operators import reports as P
from docketeer.operators import tables as O
from docketeer.plans.graphs import EDGES
from docketeer.plans.texts_and_claims import SQL as TEXTS
from docketeer.runtime import cut, table
from docketeer.sources import readers as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _edges(spark, d):
    return G.edges_of(table(spark, d, "entity_relationships"))


@query("""WITH t AS (SELECT DISTINCT id, claim_text AS x, regexp_extract_all(claim_text, '\\b([A-Z][a-z]+ [A-Z][a-z]+)\\b', 1) AS a FROM claims WHERE claim_text IS NOT NULL), n AS (SELECT id, x, list_filter(a, lambda n: n NOT IN ('United States', 'New York', 'Supreme Court', 'District Court', 'The Court')) AS a FROM t),
u AS (SELECT id, unnest(a) AS n, unnest(range(len(a))) AS place FROM n), k AS (SELECT id, arg_min(n, (-c, place)) AS n FROM (SELECT id, n, count(*) AS c, min(place) AS place FROM u GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT id, regexp_extract(x, '\\b(?:Judge|Dr\\.?|Mr\\.?|Ms\\.?|Mrs\\.?|Counsel|Agent|Officer) ([A-Z][a-z]+(?: [A-Z][a-z]+)?)\\b', 1) AS t FROM n) SELECT w.id, CASE WHEN t <> '' THEN t ELSE n END AS actor FROM w LEFT JOIN k USING (id)""")
def claim_actors(spark, d):
    c = table(spark, d, "claims").where("claim_text is not null").select("id", "claim_text").distinct()
    return c.select("id", B.actor(F.col("claim_text")).alias("actor"))


@query()
def built_claims(spark, d):
    """Claims told by the sentence shapes in all text units."""
    return B.build_narrative(S.text_units(table(spark, d, "document_pages"), table(spark, d, "documents")))["claims"].select("document_id", "page_number", "passage", "no", "s", "p", "o", "claim_type", "polarity", "day")


@query()
def built_events(spark, d):
    return B.build_narrative(S.text_units(table(spark, d, "document_pages"), table(spark, d, "documents")))["events"]


@query()
def intel_events(spark, d):
    return B.build_intel(table(spark, d, "claims"), table(spark, d, "entities"))["events"].withColumn("confidence", F.round("confidence", 6))


@query("""WITH RECURSIVE t AS (SELECT src_claim_id AS a, dst_claim_id AS b FROM narrative_claim_lineage WHERE src_claim_id <> dst_claim_id), n AS (SELECT a, b FROM t UNION SELECT b, a FROM t UNION SELECT a, a FROM t UNION SELECT b, b FROM t), r(a, b) AS (SELECT a, b FROM n UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a),
g AS (SELECT a AS id, min(b) AS group_id FROM r GROUP BY 1), c AS (SELECT DISTINCT id, document_id, sentiment, claim_type FROM claims JOIN g USING (id))
SELECT group_id, count(DISTINCT id) AS claims, count(DISTINCT document_id) AS documents, count(DISTINCT document_id) > 1 AS across, (coalesce(bool_or(sentiment = 'positive'), false) AND coalesce(bool_or(sentiment = 'negative'), false)) OR (coalesce(bool_or(claim_type = 'allegation'), false) AND coalesce(bool_or(claim_type = 'denial'), false)) AS contradictory, count(DISTINCT document_id) >= 3 AS chain
FROM c JOIN g USING (id) GROUP BY 1 HAVING count(DISTINCT id) > 1""")
def correlated_claims(spark, d):
    e = table(spark, d, "narrative_claim_lineage").select(F.col("src_claim_id").alias("a"), F.col("dst_claim_id").alias("b")).where("a <> b")
    return B.correlated_claims(G.components(e).withColumnRenamed("component", "group_id"), table(spark, d, "claims"))


@query(EDGES + """, m AS (SELECT entity_id AS id, count(*) AS mentions, count(DISTINCT document_id) AS documents FROM mentions GROUP BY 1), f AS (SELECT a AS id, b, weight, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS k FROM near),
s AS (SELECT f.id, string_agg(canonical_name, '; ' ORDER BY k) AS strongest FROM f JOIN entities e ON e.id = b WHERE k <= 5 GROUP BY 1), c AS (SELECT DISTINCT id, speaker_entity_id, subject_entity_id FROM claims)
SELECT e.id, canonical_name, entity_type, coalesce(mentions, 0) AS mentions, coalesce(documents, 0) AS documents, coalesce(d, 0) AS degree, coalesce(strongest, '') AS strongest, (SELECT count(*) FROM c WHERE speaker_entity_id = e.id) AS said, (SELECT count(*) FROM c WHERE subject_entity_id = e.id) AS told_of
FROM entities e LEFT JOIN m ON m.id = e.id LEFT JOIN deg ON deg.id = e.id LEFT JOIN s ON s.id = e.id""")
def dossiers(spark, d):
    return B.dossiers(table(spark, d, "entities"), table(spark, d, "mentions"), _edges(spark, d), table(spark, d, "claims"))


@query("""SELECT subject, count(*) AS claims, count(DISTINCT predicate) AS predicates, count(DISTINCT speaker) AS speakers, min(CASE WHEN trim(normalized_date) <> '' THEN normalized_date END) AS first, max(CASE WHEN trim(normalized_date) <> '' THEN normalized_date END) AS last FROM narrative_claims WHERE subject IS NOT NULL GROUP BY 1""")
def narrative_dossiers(spark, d):
    day = F.when(F.trim("normalized_date") != "", F.col("normalized_date"))
    return table(spark, d, "narrative_claims").where("subject is not null").groupBy("subject").agg(F.count("*").alias("claims"), F.count_distinct("predicate").alias("predicates"), F.count_distinct("speaker").alias("speakers"), F.min(day).alias("first"), F.max(day).alias("last"))


@query()
def community_texts(spark, d):
    e = _edges(spark, d)
    groups = cut(G.communities(e))
    return B.community_texts(groups, G.community_report(e, groups), table(spark, d, "entities"))


@query()
def graph_metrics(spark, d):
    return G.metrics_report(_edges(spark, d), table(spark, d, "entities"))


@query()
def top_influence(spark, d):
    return G.top_by(G.metrics_report(_edges(spark, d), table(spark, d, "entities")), "influence", table(spark, d, "entities"), "Person", 20)


@query("SELECT actor, incoming, outgoing, broker_type FROM (" + TEXTS["provenance_brokers"] + ") WHERE broker_type = 'relay'")
def relays(spark, d):
    edges = table(spark, d, "narrative_claim_lineage").select(F.col("src_claim_id").alias("src"), F.col("dst_claim_id").alias("dst")).where("src <> dst")
    return N.brokers(edges, table(spark, d, "claims")).where("broker_type = 'relay'")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_similarity(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").cast("array<double>").alias("va"))
    w = v.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("va").alias("vb"))
    return v.join(w, "a").select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("sim"))


@query("SELECT e.id, canonical_name, entity_type, mention_count FROM entities e ORDER BY entity_type NULLS LAST, canonical_name, id LIMIT 100 OFFSET 50")
def entities_by_name(spark, d):
    return table(spark, d, "entities").select("id", "canonical_name", "entity_type", "mention_count").orderBy(F.asc_nulls_last("entity_type"), "canonical_name", "id").offset(50).limit(100)


_SIM = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), p AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS sim FROM v x JOIN v y ON x.id < y.id)"""


@query(f"WITH {_SIM} SELECT v.id, count(p.a) AS reach FROM v LEFT JOIN p ON (p.a = v.id OR p.b = v.id) AND sim >= 0.3 GROUP BY 1")
def vector_reach(spark, d):
    v = _vectors(spark, d)
    return B.reach(cut(N.similar_pairs(v, 0.3)), v, 0.3)


@query()
def thread_seeds(spark, d):
    v = _vectors(spark, d)
    pairs = cut(N.similar_pairs(v, 0.3))
    return B.seeds(v.withColumn("day", F.lit(None).cast("date")), cut(N.leader_clusters(v, 0.3)), pairs).withColumn("score", F.round("score", 6))


@query(f"WITH {_SIM}, s AS (SELECT DISTINCT a, b FROM p WHERE sim >= 0.35), g AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings WHERE vec_id % 2 = 0) SELECT a, b, CAST(1 AS INTEGER) AS weight FROM s WHERE (a, b) NOT IN (SELECT (a, b) FROM g)")
def semantic_edges(spark, d):
    v = _vectors(spark, d)
    known = v.where("id % 2 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return B.semantic_edges(N.similar_pairs(v, 0.35), known, 0.35)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


@query(EDGES + ", k AS (SELECT 1) SELECT a AS id, b AS other, weight FROM near WHERE a IN (SELECT id FROM entities WHERE entity_type = 'Location')")
def location_ties(spark, d):
    near = G.both_ways(_edges(spark, d)).toDF("id", "other", "weight")
    return near.join(table(spark, d, "entities").where("entity_type = 'Location'").select("id"), "id", "left_semi")


@query("""WITH f AS (SELECT DISTINCT id AS document_id, unnest(regexp_extract_all(text, '\\b((?:19|20)\\d{2}-\\d{2}-\\d{2})\\b', 1)) AS day FROM documents WHERE text IS NOT NULL), t AS (SELECT DISTINCT day FROM f ORDER BY day LIMIT 200), k AS (SELECT * FROM f JOIN t USING (day)),
w AS (SELECT DISTINCT day, canonical_name AS n FROM k JOIN mentions USING (document_id) JOIN entities e ON e.id = entity_id), r AS (SELECT day, n, row_number() OVER (PARTITION BY day ORDER BY n) AS i FROM w)
SELECT day, documents, coalesce(names, '') AS names FROM (SELECT day, count(*) AS documents FROM k GROUP BY 1) LEFT JOIN (SELECT day, string_agg(n, '; ' ORDER BY n) AS names FROM r WHERE i <= 10 GROUP BY 1) USING (day)""")
def date_timeline(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    dates = docs.select(F.col("id").alias("document_id"), F.explode(F.regexp_extract_all("text", F.lit(r"\b((?:19|20)\d{2}-\d{2}-\d{2})\b"), 1)).alias("day"))
    return B.date_timeline(dates, table(spark, d, "mentions"), table(spark, d, "entities"))


@query()
def broker_path_names(spark, d):
    e = _edges(spark, d)
    top = G.degrees(e).orderBy(F.desc("degree"), "id").first()
    return B.named_paths(G.broker_paths(e, top["id"] if top else "", 20), table(spark, d, "entities"))


def _briefing(spark, d):
    return B.briefing_sections(table(spark, d, "documents"), table(spark, d, "entities"), table(spark, d, "entity_relationships"), table(spark, d, "narrative_claims"), _edges(spark, d))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'relationships', count(*) FROM entity_relationships UNION ALL SELECT 'claims', count(*) FROM narrative_claims")
def briefing_counts(spark, d):
    return _briefing(spark, d)["counts"]


@query(EDGES + "SELECT x.canonical_name AS name_a, y.canonical_name AS name_b, weight FROM (SELECT * FROM edges ORDER BY weight DESC, a, b LIMIT 30) JOIN entities x ON x.id = a JOIN entities y ON y.id = b")
def briefing_relationships(spark, d):
    return _briefing(spark, d)["relationships"]
