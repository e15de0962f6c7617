"""Queries of the training-data problems and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketeer.runtime import table

TIES = ("repeats", "supports", "derives_from")


def _scanned(spark: SparkSession, d: str):
    names = table(spark, d, "entities").select(F.col("canonical_name").alias("name"))
    return table(spark, d, "document_pages").select("id", "document_id", "page_number", "ocr_used", "ocr_text", "final_text"), names


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from docketeer.llm.scan_repair import find_noise

    return find_noise(*_scanned(spark, d))


def p1_text(spark: SparkSession, d: str) -> DataFrame:
    from docketeer.llm.scan_repair import repair

    return repair(*_scanned(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from docketeer.llm.name_links import link_names

    return link_names(table(spark, d, "entities"), table(spark, d, "extracted_entities"), table(spark, d, "mentions")).select("id_a", "id_b")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from docketeer.llm.cooccurrence import associations

    return associations(table(spark, d, "mentions"), 5, 3.0).select(F.col("a").alias("entity_a_id"), F.col("b").alias("entity_b_id"))


def p3_weights(spark: SparkSession, d: str) -> DataFrame:
    """A fresh weight and doc_count for every pair that occurs together."""
    from docketeer.llm.cooccurrence import associations

    pairs = associations(table(spark, d, "mentions"), 1, 0.0)
    return pairs.select(F.col("a").alias("entity_a_id"), F.col("b").alias("entity_b_id"), F.col("n_ab").alias("weight"), F.col("n_ab").alias("doc_count"), (F.round("llr", 4) + F.lit(0.0)).alias("llr"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from docketeer.llm.repeated_lines import repeated_lines

    return repeated_lines(table(spark, d, "document_pages"), table(spark, d, "documents")).select("page_id", "line_no")


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    from docketeer.llm.repeated_lines import repeated_lines, without_lines

    pages = table(spark, d, "document_pages")
    return without_lines(pages, repeated_lines(pages, table(spark, d, "documents")))


def _personal(spark: SparkSession, d: str, scanned: bool):
    from docketeer.llm.personal_data import train

    pages, mentions, entities = table(spark, d, "document_pages"), table(spark, d, "mentions"), table(spark, d, "entities")
    clean = pages.where("not ocr_used")
    texts = (pages if scanned else clean).select(F.lit("document_pages").alias("table_name"), F.col("id").alias("record_id"), (F.coalesce("final_text", "ocr_text") if scanned else F.col("final_text")).alias("text"))
    texts = texts.unionByName(mentions.select(F.lit("mentions").alias("table_name"), F.col("id").alias("record_id"), F.col("context_text").alias("text")))
    return texts, train(clean, entities, table(spark, d, "extracted_entities"), mentions)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from docketeer.llm.personal_data import find_spans

    return find_spans(*_personal(spark, d, scanned=False))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every page and mention with placeholders; scanned pages without a final text have what the scanner read."""
    from docketeer.llm.personal_data import redact_texts

    return redact_texts(*_personal(spark, d, scanned=True))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from docketeer.llm.group_matches import connected_groups, tied_pairs

    groups = connected_groups(tied_pairs(table(spark, d, "narrative_claim_lineage"), TIES))
    return groups.select(F.col("id").alias("claim_id"), "group_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from docketeer.llm.tokenize_corpus import encode

    return encode(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and text as decoded from the ids."""
    from docketeer.llm.tokenize_corpus import decode, encode

    return decode(encode(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_passages(spark, d).select("doc_id", "item_id").distinct()


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    from docketeer.llm.leaked_items import find_passages

    return find_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from docketeer.llm.subjects import subjects

    return subjects(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """What the corpus is made of: documents and sentences of each subject."""
    from docketeer.llm.subjects import subject_shares

    shares = subject_shares(table(spark, d, "documents"), table(spark, d, "doc_labels"))
    return shares.groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("p") and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_PAIRS = """
WITH s AS (SELECT DISTINCT document_id AS g, entity_id AS i FROM mentions WHERE document_id IS NOT NULL AND entity_id IS NOT NULL),
k AS (SELECT count(DISTINCT g) AS n FROM s), c AS (SELECT i, count(*) AS n_i FROM s GROUP BY i),
p AS (SELECT x.i AS a, y.i AS b, count(*) AS n_ab FROM s x JOIN s y ON x.g = y.g AND x.i < y.i GROUP BY x.i, y.i)
"""

_LINES = """
WITH d AS (SELECT id AS document_id, source_tag FROM documents WHERE source_tag IS NOT NULL AND trim(source_tag) <> ''),
z AS (SELECT source_tag, count(*) AS n_tag FROM d GROUP BY source_tag),
p AS (SELECT DISTINCT id, document_id, string_split(final_text, chr(10)) AS ls FROM document_pages WHERE NOT ocr_used AND final_text IS NOT NULL),
l AS (SELECT id AS page_id, document_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM p),
q AS (SELECT page_id, document_id, line_no, regexp_replace(regexp_replace(lower(line), '(^|[^\\p{L}\\p{M}])(january|february|march|april|may|june|july|august|september|october|november|december)($|[^\\p{L}\\p{M}])', ' ', 'g'), '[^\\p{L}\\p{M}]+', '', 'g') AS k FROM l),
j AS (SELECT DISTINCT page_id, q.document_id, line_no, k, source_tag FROM q JOIN d USING (document_id) WHERE k <> ''),
e AS (SELECT source_tag, k FROM (SELECT source_tag, k, count(DISTINCT document_id) AS n FROM j GROUP BY source_tag, k) JOIN z USING (source_tag) WHERE n >= 3 AND n * 10 >= n_tag)
"""

SQL = {
    "p3_found": _PAIRS + "SELECT a AS entity_a_id, b AS entity_b_id FROM p JOIN c ca ON ca.i = a JOIN c cb ON cb.i = b, k WHERE n_ab >= 5 AND n_ab * n >= 3 * ca.n_i * cb.n_i",
    "p4_found": _LINES + """
SELECT page_id, CAST(line_no AS INTEGER) AS line_no FROM j JOIN e USING (source_tag, k)
""",
    "p4_clean": _LINES + """,
g AS (SELECT DISTINCT page_id, line_no FROM j JOIN e USING (source_tag, k)),
a AS (SELECT id AS page_id, final_text, string_split(final_text, chr(10)) AS ls FROM (SELECT DISTINCT id, final_text FROM document_pages)),
b AS (SELECT page_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM a),
m AS (SELECT page_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM b ANTI JOIN g USING (page_id, line_no) GROUP BY 1)
SELECT a.page_id, CASE WHEN final_text IS NULL THEN NULL WHEN a.page_id IN (SELECT page_id FROM g) THEN coalesce(t, '') ELSE final_text END AS clean_text FROM a LEFT JOIN m USING (page_id)
""",
    "p7_found": """
WITH RECURSIVE t AS (SELECT src_claim_id AS u, dst_claim_id AS v FROM narrative_claim_lineage WHERE lower(trim(relation_type)) IN ('repeats', 'supports', 'derives_from') AND src_claim_id IS NOT NULL AND dst_claim_id IS NOT NULL),
e AS (SELECT u, v FROM t UNION SELECT v, u FROM t UNION SELECT u, u FROM t UNION SELECT v, v FROM t),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT u AS claim_id, min(v) AS group_id FROM r GROUP BY u
""",
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p3_weights": _PAIRS + """
SELECT a AS entity_a_id, b AS entity_b_id, n_ab AS weight, n_ab AS doc_count, round(CASE WHEN n_ab * n >= ca.n_i * cb.n_i THEN 1 ELSE -1 END * 2 * (
CASE WHEN n_ab > 0 THEN n_ab * ln(n_ab * CAST(n AS DOUBLE) / (ca.n_i * cb.n_i)) ELSE 0 END
+ CASE WHEN ca.n_i - n_ab > 0 THEN (ca.n_i - n_ab) * ln((ca.n_i - n_ab) * CAST(n AS DOUBLE) / (ca.n_i * (n - cb.n_i))) ELSE 0 END
+ CASE WHEN cb.n_i - n_ab > 0 THEN (cb.n_i - n_ab) * ln((cb.n_i - n_ab) * CAST(n AS DOUBLE) / ((n - ca.n_i) * cb.n_i)) ELSE 0 END
+ CASE WHEN n - ca.n_i - cb.n_i + n_ab > 0 THEN (n - ca.n_i - cb.n_i + n_ab) * ln((n - ca.n_i - cb.n_i + n_ab) * CAST(n AS DOUBLE) / ((n - ca.n_i) * (n - cb.n_i))) ELSE 0 END), 4) + 0.0 AS llr
FROM p JOIN c ca ON ca.i = a JOIN c cb ON cb.i = b, k
""",
}
