"""Queries of the core operators: one for each operator or group of operators, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketeer.plans import builds, graphs, lists_and_counts, reports, texts_and_claims
from docketeer.operators.orphans import Reference, orphan_references, orphan_report
from docketeer.runtime import table

REFERENCES = [
    Reference("claims", "speaker_entity_id", "entities", "id", "id", key="id"),
    Reference("narrative_claims", "evidence_span_id", "narrative_evidence_spans", "id", "id", key="id"),
    Reference("narrative_event_claim_map", "claim_id", "claims", "id", r"concat(cast(event_id as string), '/', lower(regexp_replace(claim_id, '^\\s+|\\s+$', '')))"),
    Reference("narrative_sources", "cited_claim_id", "claims", "id", "id", key="id"),
]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    names = {n for r in REFERENCES for n in (r.table, r.target)}
    return orphan_references({n: table(spark, d, n) for n in names}, REFERENCES)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).where("origin = 'direct'").select("table_name", "record_id", "period", "status")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p5_found": p5_found, "p5_report": p5_report} | lists_and_counts.QUERIES | graphs.QUERIES | texts_and_claims.QUERIES | reports.QUERIES | builds.QUERIES


_REFS = """
WITH r AS (
SELECT 'claims' AS table_name, id AS record_id, created_at AS made, lower(trim(speaker_entity_id)) AS k, 'entities' AS target, lower(trim(id)) AS own FROM claims
UNION ALL SELECT 'narrative_claims', CAST(id AS VARCHAR), created_at, CAST(evidence_span_id AS VARCHAR), 'narrative_evidence_spans', CAST(id AS VARCHAR) FROM narrative_claims
UNION ALL SELECT 'narrative_event_claim_map', CAST(event_id AS VARCHAR) || '/' || lower(trim(claim_id)), created_at, lower(trim(claim_id)), 'claims', NULL FROM narrative_event_claim_map
UNION ALL SELECT 'narrative_sources', CAST(id AS VARCHAR), created_at, lower(trim(cited_claim_id)), 'claims', CAST(id AS VARCHAR) FROM narrative_sources),
t AS (
SELECT 'entities' AS target, lower(trim(id)) AS k, min(created_at) AS born FROM entities GROUP BY 2
UNION ALL SELECT 'narrative_evidence_spans', CAST(id AS VARCHAR), min(created_at) FROM narrative_evidence_spans GROUP BY 2
UNION ALL SELECT 'claims', lower(trim(id)), min(created_at) FROM claims GROUP BY 2),
c AS (
SELECT DISTINCT r.table_name, record_id, coalesce(strftime(made, '%Y-%m'), 'unknown') AS period, r.k, own, r.target, CASE WHEN t.k IS NULL THEN 'absent' WHEN born > made THEN 'late' END AS status
FROM r LEFT JOIN t ON r.target = t.target AND r.k = t.k WHERE r.k <> '')
"""


def oracle_sql() -> dict[str, str]:
    return lists_and_counts.SQL | graphs.SQL | texts_and_claims.SQL | reports.SQL | builds.SQL | {
        "p5_found": _REFS + "SELECT DISTINCT table_name, record_id, period, status FROM c WHERE status IS NOT NULL",
        "p5_report": _REFS
        + """, o AS (
SELECT DISTINCT table_name, record_id, period, status, 'direct' AS origin FROM c WHERE status IS NOT NULL
UNION SELECT x.table_name, x.record_id, x.period, min(y.status), 'inherited' FROM c x JOIN c y ON y.table_name = x.target AND y.own = x.k AND y.status IS NOT NULL WHERE x.status IS NULL GROUP BY 1, 2, 3)
SELECT table_name, period, status, origin, count(*) AS n FROM o GROUP BY ALL
""",
    }
