"""Queries over the entity graph, each with its SQL where one can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketeer.operators import graph as G
from docketeer.operators import resolve as R
from docketeer.runtime import table

QUERIES, SQL = {}, {}

EDGES = """WITH RECURSIVE edges AS (SELECT least(entity_a_id, entity_b_id) AS a, greatest(entity_a_id, entity_b_id) AS b, CAST(sum(coalesce(weight, 1)) AS BIGINT) AS weight FROM entity_relationships
WHERE entity_a_id IS NOT NULL AND entity_b_id IS NOT NULL AND entity_a_id <> entity_b_id GROUP BY 1, 2),
near AS (SELECT a, b, weight FROM edges UNION ALL SELECT b, a, weight FROM edges), deg AS (SELECT a AS id, count(*) AS d FROM near GROUP BY 1) """


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _edges(spark, d, min_weight: int = 1):
    return G.edges_of(table(spark, d, "entity_relationships"), min_weight)


@query(EDGES + "SELECT a, b, weight FROM edges")
def graph_edges(spark, d):
    return _edges(spark, d)


@query("WITH s AS (SELECT DISTINCT document_id AS g, entity_id AS i FROM mentions WHERE entity_id IS NOT NULL AND document_id IS NOT NULL) SELECT x.i AS a, y.i AS b, count(*) AS weight, count(*) AS doc_count FROM s x JOIN s y ON x.g = y.g AND x.i < y.i GROUP BY 1, 2")
def document_pairs(spark, d):
    return G.document_pairs(table(spark, d, "mentions"))


@query("SELECT r.id, entity_a_id, a.canonical_name AS name_a, entity_b_id, b.canonical_name AS name_b, weight FROM entity_relationships r JOIN entities a ON a.id = entity_a_id JOIN entities b ON b.id = entity_b_id WHERE weight >= 3 AND a.entity_type = 'Organization'")
def relationships_list(spark, d):
    return G.relationships_list(table(spark, d, "entity_relationships"), table(spark, d, "entities"), 3, "Organization").withColumn("weight", F.col("weight"))


@query(EDGES + "SELECT id, d AS degree, round(d / (SELECT max(d) FROM deg), 6) AS centrality FROM deg")
def degree_centrality(spark, d):
    return G.degrees(_edges(spark, d)).select("id", "degree", F.round("centrality", 6).alias("centrality"))


@query(EDGES + """, s AS (SELECT id AS start FROM entities WHERE entity_type = 'Aircraft'), h0 AS (SELECT start, start AS id FROM s), h1 AS (SELECT DISTINCT start, b AS id FROM s JOIN near ON start = a),
h2 AS (SELECT DISTINCT start, b AS id FROM h1 JOIN near ON h1.id = a) SELECT start, id, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT *, 0 AS depth FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY 1, 2""")
def two_hop_neighbourhood(spark, d):
    return G.neighbourhood(_edges(spark, d), table(spark, d, "entities").where("entity_type = 'Aircraft'").select("id"), 2)


@query("""WITH RECURSIVE e AS (SELECT event_id FROM narrative_event_claim_map), t AS (SELECT src_claim_id AS a, dst_claim_id AS b FROM narrative_claim_lineage WHERE src_claim_id <> dst_claim_id),
n AS (SELECT a, b FROM t UNION SELECT b, a FROM t UNION SELECT a, a FROM t UNION SELECT b, b FROM t), r(a, b) AS (SELECT a, b FROM n UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a) SELECT a AS id, min(b) AS component FROM r GROUP BY 1""")
def components(spark, d):
    e = table(spark, d, "narrative_claim_lineage").select(F.col("src_claim_id").alias("a"), F.col("dst_claim_id").alias("b")).where("a <> b")
    return G.components(e)


@query(EDGES + """, n AS (SELECT a, b FROM near), r(a, b) AS (SELECT a, a FROM n UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a), k AS (SELECT a AS id, min(b) AS component FROM r GROUP BY 1)
SELECT component, count(*) AS size, CAST(sum(coalesce(m, 0)) AS BIGINT) AS mentions, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS types FROM k LEFT JOIN entities e USING (id) LEFT JOIN (SELECT entity_id AS id, count(*) AS m FROM mentions GROUP BY 1) USING (id) GROUP BY 1 HAVING count(*) > 1""")
def cluster_report(spark, d):
    counts = table(spark, d, "mentions").groupBy("entity_id").agg(F.count("*").alias("mentions"))
    return G.cluster_report(_edges(spark, d), table(spark, d, "entities"), counts)


_PR = ", tot AS (SELECT a, sum(weight) AS w FROM near GROUP BY 1), link AS (SELECT near.a, b, weight / w AS p FROM near JOIN tot USING (a)), n AS (SELECT count(*) AS n FROM tot), s0 AS (SELECT a AS id, 1.0 / n AS s FROM tot, n)"
_PR_STEPS = "".join(f", s{k} AS (SELECT b AS id, 0.15 / any_value(n) + 0.85 * sum(p * s) AS s FROM link JOIN s{k - 1} ON id = a, n GROUP BY b)" for k in range(1, 21))


@query(EDGES + _PR + _PR_STEPS + " SELECT id, round(s, 9) AS score FROM s20")
def pagerank(spark, d):
    return G.pagerank(_edges(spark, d)).select("id", F.round("score", 9).alias("score"))


@query()
def eigenvector(spark, d):
    return G.eigenvector(_edges(spark, d)).select("id", F.round("score", 6).alias("score"))


@query(EDGES + ", tri AS (SELECT x.a AS id, count(*) / 2 AS t FROM near x JOIN near y ON x.a = y.a AND x.b <> y.b JOIN near z ON z.a = x.b AND z.b = y.b GROUP BY 1) SELECT id, round(CASE WHEN d < 2 THEN 0 ELSE 1 - coalesce(t, 0) / (d * (d - 1) / 2) END, 6) AS bridge FROM deg LEFT JOIN tri USING (id)")
def bridge_scores(spark, d):
    return G.bridge_scores(_edges(spark, d)).select("id", F.round("bridge", 6).alias("bridge"))


@query(EDGES + """, tri AS (SELECT x.a AS id, count(*) / 2 AS t FROM near x JOIN near y ON x.a = y.a AND x.b <> y.b JOIN near z ON z.a = x.b AND z.b = y.b GROUP BY 1),
sp AS (SELECT entity_id AS id, count(DISTINCT document_id) / (SELECT count(DISTINCT document_id) FROM mentions) AS s FROM mentions GROUP BY 1),
tg AS (SELECT subject_entity_id AS id, count(*) AS k FROM claims WHERE subject_entity_id IS NOT NULL GROUP BY 1), au AS (SELECT speaker_entity_id AS id, count(*) AS k FROM claims WHERE speaker_entity_id IS NOT NULL GROUP BY 1),
f AS (SELECT id, 0.30 * d / (SELECT max(d) FROM deg) + 0.25 * coalesce(s, 0) + 0.20 * coalesce(tg.k / (SELECT max(k) FROM tg), 0) + 0.15 * (CASE WHEN d < 2 THEN 0 ELSE 1 - coalesce(t, 0) / (d * (d - 1) / 2) END) + 0.10 * coalesce(au.k / (SELECT max(k) FROM au), 0) AS v
FROM deg LEFT JOIN tri USING (id) LEFT JOIN sp USING (id) LEFT JOIN tg USING (id) LEFT JOIN au USING (id)) SELECT id, round(v, 5) AS influence FROM f WHERE v >= 0.01""")
def influence_map(spark, d):
    return G.influence_map(_edges(spark, d), table(spark, d, "mentions"), table(spark, d, "claims")).select("id", F.round("influence", 5).alias("influence"))


@query()
def betweenness(spark, d):
    return G.betweenness(_edges(spark, d)).select("id", F.round("betweenness", 9).alias("betweenness"))


@query()
def communities(spark, d):
    return G.communities(_edges(spark, d))


@query()
def community_report(spark, d):
    e = _edges(spark, d)
    return G.community_report(e, G.communities(e))


@query()
def brokers(spark, d):
    e = _edges(spark, d)
    return G.brokers(e, G.communities(e), G.betweenness(e))


@query()
def broker_paths(spark, d):
    e = _edges(spark, d)
    top = G.degrees(e).orderBy(F.desc("degree"), "id").first()
    return G.broker_paths(e, top["id"] if top else "", 20)


@query()
def bridge_leads(spark, d):
    return G.bridges(_edges(spark, d))


@query(EDGES + "SELECT id, 'gatekeeper' AS lead, round(least(0.99, d / (SELECT max(d) FROM deg) / (1 + 0.15 * m)), 6) AS confidence FROM deg JOIN (SELECT entity_id AS id, count(*) AS m FROM mentions GROUP BY 1) USING (id) WHERE d >= 3 AND least(0.99, d / (SELECT max(d) FROM deg) / (1 + 0.15 * m)) >= 0.02")
def gatekeepers(spark, d):
    return G.gatekeepers(_edges(spark, d), table(spark, d, "mentions"), least=0.02).withColumn("confidence", F.round("confidence", 6))


_SPIKE = "SELECT entity_id AS id, 'spike' AS lead, m / d / (m + 1) * (1 - d / n) + 0.3 * d / n AS confidence FROM (SELECT entity_id, count(*) AS m, count(DISTINCT document_id) AS d FROM mentions GROUP BY 1), (SELECT count(DISTINCT document_id) AS n FROM mentions) WHERE d >= 2 AND m >= 3 AND m / d / (m + 1) * (1 - d / n) + 0.3 * d / n >= 0.02"


@query(f"SELECT id, lead, round(confidence, 6) AS confidence FROM ({_SPIKE})")
def spikes(spark, d):
    return G.spikes(table(spark, d, "mentions"), 0.02).withColumn("confidence", F.round("confidence", 6))


@query("""WITH p AS (SELECT DISTINCT document_id, entity_id FROM mentions WHERE entity_id IS NOT NULL), o AS (SELECT entity_id FROM p GROUP BY 1 HAVING count(*) = 1), c AS (SELECT document_id, count(*) AS a, count(o.entity_id) AS n FROM p LEFT JOIN o USING (entity_id) GROUP BY 1)
SELECT document_id AS id, 'outlier' AS lead, round(least(0.99, 0.4 + 0.5 * n / a + 0.02 * n), 6) AS confidence FROM c WHERE n >= 1""")
def outlier_documents(spark, d):
    return G.outlier_documents(table(spark, d, "mentions"), 1).withColumn("confidence", F.round("confidence", 6))


@query()
def leads(spark, d):
    return G.leads(_edges(spark, d), table(spark, d, "mentions"), gatekeeper=0.02, spike=0.02, alone=1)


@query(EDGES + ", k AS (SELECT DISTINCT entity_id AS id FROM mentions WHERE document_id IN (SELECT id FROM documents WHERE source_tag = (SELECT source_tag FROM documents WHERE source_tag <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))) SELECT a, b, weight FROM edges WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k)")
def tag_graph(spark, d):
    docs = table(spark, d, "documents")
    tag = docs.where("source_tag <> ''").groupBy("source_tag").count().orderBy(F.desc("count"), "source_tag").first()["source_tag"]
    mine = docs.where(F.col("source_tag") == tag).select(F.col("id").alias("document_id"))
    ids = table(spark, d, "mentions").join(mine, "document_id", "left_semi").select(F.col("entity_id").alias("id"))
    return G.restrict_to(_edges(spark, d), ids)


_STOP = "['the','of','and','a','an','in','for','llc','inc','corp','co','ltd','mr','mrs','ms','dr']"


@query(f"""WITH e AS (SELECT DISTINCT id, entity_type AS kind, trim(canonical_name) AS name, lower(trim(canonical_name)) AS low, list_distinct(list_filter(regexp_extract_all(lower(trim(canonical_name)), '[a-z]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))) AS t,
list_aggregate(list_transform(list_filter(regexp_split_to_array(trim(canonical_name), '\\s+'), lambda w: regexp_matches(w, '^\\p{{Lu}}')), lambda w: w[1]), 'string_agg', '') AS ini FROM entities WHERE canonical_name IS NOT NULL AND trim(canonical_name) <> ''),
p AS (SELECT x.id AS id_a, y.id AS id_b, (contains(x.low, y.low) OR contains(y.low, x.low)) AND least(length(x.name), length(y.name)) >= 4 AS inside,
CASE WHEN len(x.t) = 0 OR len(y.t) = 0 THEN 0 ELSE len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) END AS j,
CASE WHEN length(x.name) <= 30 AND length(y.name) <= 30 THEN 1 - levenshtein(x.low, y.low) / greatest(length(x.name), length(y.name)) ELSE 0 END AS r,
x.kind = 'Person' AND ((length(x.name) <= 4 AND upper(x.name) = x.name AND x.name = y.ini) OR (length(y.name) <= 4 AND upper(y.name) = y.name AND y.name = x.ini)) AS i FROM e x JOIN e y ON x.kind = y.kind AND x.id < y.id),
w AS (SELECT *, CASE WHEN j >= 0.6 THEN 0.55 + 0.35 * j ELSE 0 END AS cw, CASE WHEN r >= 0.75 THEN 0.85 * r ELSE 0 END AS ce FROM p), v AS (SELECT *, CASE WHEN cw >= 0.7 THEN cw ELSE greatest(cw, ce) END AS c2 FROM w), u AS (SELECT *, CASE WHEN c2 >= 0.7 THEN c2 ELSE greatest(c2, CASE WHEN coalesce(i, false) THEN 0.75 ELSE 0 END) END AS c3 FROM v)
SELECT id_a, id_b, round(CASE WHEN inside THEN 0.85 ELSE c3 END, 4) AS confidence, CASE WHEN inside THEN 'contained' WHEN c3 = cw THEN 'words' WHEN c3 = ce THEN 'edits' ELSE 'initials' END AS rule FROM u WHERE inside OR c3 >= 0.55""")
def duplicate_candidates(spark, d):
    return R.duplicate_candidates(table(spark, d, "entities")).select("id_a", "id_b", F.round("confidence", 4).alias("confidence"), "rule")


@query("""WITH r AS (SELECT canonical_name, id, row_number() OVER (PARTITION BY canonical_name ORDER BY coalesce(confidence, -1) DESC, CASE entity_type WHEN 'Organization' THEN 3 WHEN 'Location' THEN 2 WHEN 'Person' THEN 1 ELSE 0 END DESC, coalesce(mention_count, 0) DESC, id DESC) AS k FROM entities)
SELECT x.id AS old, y.id AS new FROM r x JOIN r y ON x.canonical_name IS NOT DISTINCT FROM y.canonical_name AND y.k = 1 WHERE x.k > 1""")
def cross_type_merges(spark, d):
    return R.cross_type_merges(table(spark, d, "entities"))


@query("""WITH m AS (SELECT min(id) OVER (PARTITION BY entity_type, lower(trim(canonical_name))) AS new, id AS old FROM entities),
x AS (SELECT a.new AS x, b.new AS y, weight, doc_count FROM entity_relationships r JOIN m a ON a.old = entity_a_id JOIN m b ON b.old = entity_b_id)
SELECT least(x, y) AS entity_a_id, greatest(x, y) AS entity_b_id, CAST(sum(weight) AS BIGINT) AS weight, max(doc_count) AS doc_count FROM x WHERE x <> y GROUP BY 1, 2""")
def merged_edges(spark, d):
    e = table(spark, d, "entities").select("id", "entity_type", F.lower(F.trim("canonical_name")).alias("n"))
    mapping = e.join(e.groupBy("entity_type", "n").agg(F.min("id").alias("new")), ["entity_type", "n"]).select(F.col("id").alias("old"), "new")
    return R.merge_edges(table(spark, d, "entity_relationships"), mapping)


@query()
def canonical_entities(spark, d):
    out = R.canonicalize(table(spark, d, "entities"), table(spark, d, "mentions"), table(spark, d, "entity_relationships"))
    return out["entities"].select("id", "entity_type", "canonical_name", F.size("aliases").alias("n_aliases"), "mention_count")
