"""Orphan references: direct, late, inherited, and hostile input."""

from datetime import datetime as T

from docketeer.operators.orphans import Reference, orphan_references, orphan_report

REFS = [Reference("child", "parent_id", "parent", "id", "id", key="id"), Reference("grandchild", "child_id", "child", "id", "id")]


def tables(spark):
    parent = spark.createDataFrame([("P1", T(2020, 1, 1)), ("p2 ", T(2022, 1, 1)), (None, T(2020, 1, 1))], "id string, created_at timestamp")
    child = spark.createDataFrame(
        [("c1", " p1", T(2021, 5, 1)), ("c2", "P2", T(2021, 5, 1)), ("c3", "nobody", T(2021, 6, 1)), ("c3", "nobody", T(2021, 6, 1)), ("c4", None, T(2021, 6, 1)), ("c5", "  ", T(2021, 6, 1)), ("c6", "p2", None)],
        "id string, parent_id string, created_at timestamp",
    )
    grandchild = spark.createDataFrame([("g1", "C3", T(2023, 1, 1)), ("g2", "c1", T(2023, 1, 1)), ("g3", "c9", T(2023, 1, 1))], "id string, child_id string, created_at timestamp")
    return {"parent": parent, "child": child, "grandchild": grandchild}


def test_direct_late_inherited(spark):
    out = {(r.record_id, r.status, r.origin, r.period) for r in orphan_references(tables(spark), REFS).collect()}
    assert out == {("c2", "late", "direct", "2021-05"), ("c3", "absent", "direct", "2021-06"), ("g1", "absent", "inherited", "2023-01"), ("g3", "absent", "direct", "2023-01")}


def test_report_counts(spark):
    out = {(r.table_name, r.origin): r.n for r in orphan_report(orphan_references(tables(spark), REFS)).groupBy("table_name", "origin").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert out == {("child", "direct"): 2, ("grandchild", "direct"): 1, ("grandchild", "inherited"): 1}


def test_empty_tables_and_extra_columns(spark):
    t = {k: v.limit(0) for k, v in tables(spark).items()}
    assert orphan_references(t, REFS).count() == 0
    t = tables(spark)
    t["child"] = t["child"].selectExpr("*", "'x' as k", "'y' as status", "'z' as target")
    assert orphan_references(t, REFS).where("origin = 'direct'").count() == 3


def test_cycle_ends(spark):
    loop = spark.createDataFrame([("a", "b", T(2020, 1, 1)), ("b", "a", T(2020, 1, 1)), ("c", "zz", T(2020, 1, 1)), ("d", "c", T(2020, 1, 1)), ("e", "d", T(2020, 1, 1))], "id string, parent_id string, created_at timestamp")
    out = {r.record_id: r.origin for r in orphan_references({"loop": loop}, [Reference("loop", "parent_id", "loop", "id", "id", key="id")]).collect()}
    assert out == {"c": "direct", "d": "inherited", "e": "inherited"}
