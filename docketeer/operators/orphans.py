"""Problem 5: references to records that do not exist, direct and inherited.

Each reference is compared with its target's keys by one left join; a fixpoint of semi-joins then walks down the
foreign-key graph and marks the rows that refer to an orphaned row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketeer.runtime import cut, empty_like

ROWS = "table_name string, record_id string, period string, status string, origin string"


@dataclass(frozen=True)
class Reference:
    """``record`` names the referring row in reports; ``key`` is the key by which other tables refer to that row."""

    table: str
    column: str
    target: str
    target_key: str
    record: str
    key: str | None = None
    created: str = "created_at"


def norm_key(c: Column) -> Column:
    """Trimmed of any white space, in lower case."""
    return F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))


def orphan_references(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """(table_name, record_id, period, status, origin).

    status ``absent``: no target row has the key; ``late``: one has, but the earliest was created after the referring row.
    origin ``direct``: the row's own reference is absent or late; ``inherited``: its reference is good but the row it names
    is itself an orphan, directly or in turn. period is yyyy-MM of the row's created_at, ``unknown`` if null;
    such rows, and those whose targets have no created_at, are never late. Null and blank references are no cases. Repeated rows
    come out once. Every round marks rows not marked before, so self-referring and cyclic key graphs end at the fixpoint too.
    """
    spark = next(iter(tables.values())).sparkSession
    targets = {}
    for t, k in {(r.target, r.target_key) for r in references}:
        created = F.col("created_at") if "created_at" in tables[t].columns else F.lit(None).cast("timestamp")
        targets[t, k] = tables[t].select(norm_key(F.col(k)).alias("k"), created.alias("born")).where("k <> ''").groupBy("k").agg(F.min("born").alias("born"), F.count("*").alias("there"))
    parts = []
    for r in references:
        src = tables[r.table]
        rows = src.select(
            F.lit(r.table).alias("table_name"),
            F.expr(r.record).cast("string").alias("record_id"),
            F.col(r.created).alias("made"),
            norm_key(F.col(r.column)).alias("k"),
            (norm_key(F.col(r.key)) if r.key else F.lit(None).cast("string")).alias("own"),
            F.lit(r.target).alias("target"),
        ).where("k <> ''")
        parts.append(rows.join(targets[r.target, r.target_key], "k", "left"))
    if not parts:
        return empty_like(spark, ROWS)
    checked = parts[0]
    for p in parts[1:]:
        checked = checked.unionByName(p)
    status = F.when(F.col("there").isNull(), "absent").when(F.col("born") > F.col("made"), "late")
    checked = cut(checked.select("table_name", "record_id", F.coalesce(F.date_format("made", "yyyy-MM"), F.lit("unknown")).alias("period"), "k", "own", "target", status.alias("status")).distinct())
    direct = checked.where("status is not null").withColumn("origin", F.lit("direct"))
    found = direct.select("table_name", "record_id", "period", "status", "origin")
    bad = cut(direct.where("own is not null").select(F.col("table_name").alias("target"), F.col("own").alias("k"), "status").groupBy("target", "k").agg(F.min("status").alias("status")))
    good = checked.where("status is null").drop("status")
    known = bad.select("target", "k")
    while not bad.isEmpty():
        hit = good.join(bad, ["target", "k"]).select("table_name", "record_id", "period", "own", "status", F.lit("inherited").alias("origin"))
        hit = cut(hit.distinct())
        found = found.unionByName(hit.select("table_name", "record_id", "period", "status", "origin"))
        bad = hit.where("own is not null").select(F.col("table_name").alias("target"), F.col("own").alias("k"), "status").groupBy("target", "k").agg(F.min("status").alias("status"))
        bad = cut(bad.join(known, ["target", "k"], "left_anti"))
        known = cut(known.unionByName(bad.select("target", "k")))
    return found.distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, period, status and origin."""
    return orphans.groupBy("table_name", "period", "status", "origin").agg(F.count("*").alias("n"))
