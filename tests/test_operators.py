"""Resolution, search, claims, sources and streaming on small fixtures."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from docketeer.operators import narrative as N
from docketeer.operators import resolve as R
from docketeer.operators import search as S
from docketeer.operators import tables as O
from docketeer.sources import readers


def test_duplicate_candidates(spark):
    e = spark.createDataFrame(
        [("1", "Person", "Jonathan Smithe"), ("2", "Person", "Jonathan Smith"), ("3", "Person", "JS"), ("4", "Organization", "Global Widget Trading"), ("5", "Organization", "Widget Trading Global"), ("6", "Person", "Someone Else"), ("7", "Person", None)],
        "id string, entity_type string, canonical_name string",
    )
    got = {(r.id_a, r.id_b): r.rule for r in R.duplicate_candidates(e).collect()}
    assert got == {("1", "2"): "contained", ("1", "3"): "initials", ("2", "3"): "initials", ("4", "5"): "words"}


def test_merge_edges_drops_loops_and_sums(spark):
    r = spark.createDataFrame([("a", "b", 2, 2), ("b", "c", 3, 1), ("c", "a", 1, 4)], "entity_a_id string, entity_b_id string, weight int, doc_count int")
    m = spark.createDataFrame([("b", "a")], "old string, new string")
    assert [tuple(x) for x in R.merge_edges(r, m).collect()] == [("a", "c", 4, 4)]


def test_phrase_and_bm25(spark):
    p = spark.createDataFrame([("1", "The cartel ledger, the cartel ledger."), ("2", "A ledger of the cartel"), ("3", None), ("1", "The cartel ledger, the cartel ledger.")], "id string, final_text string")
    assert [tuple(r) for r in S.phrase_search(p, "cartel ledger").collect()] == [("1", 2)]
    scores = {r.id: r.score for r in S.bm25(p, "cartel").collect()}
    assert set(scores) == {"1", "2"} and scores["1"] > scores["2"]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in S.nearest(df, df.where("id % 10 = 0"), 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        assert [i for _, i in sorted(found)] == list(np.argsort(-s)[:3])


def test_leader_clusters_against_one_pass(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 5))
    x = centers[rng.integers(0, 6, 50)] + 0.35 * rng.normal(size=(50, 5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    leaders, want = [], {}
    for i in range(50):
        want[i] = next((j for j in leaders if u[i] @ u[j] >= 0.62), i)
        if want[i] == i:
            leaders.append(i)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<double>")
    assert {r.id: r.leader for r in N.leader_clusters(df).collect()} == want


def test_propagation_window(spark):
    ev = spark.createDataFrame([(1, "d1", 1, "according to X"), (2, "d2", 1, "nothing")], "id long, document_id string, page_number int, text string")
    c = spark.createDataFrame([(1, 1, "s", "p", "the same object", "X"), (2, 2, "s", "p", "the same object", "Y"), (3, 2, "s", "other", "the same object", "Y")], "id long, evidence_span_id long, subject string, predicate string, object string, speaker string")
    assert [(r.src, r.dst, r.edge_type) for r in N.narrative_propagation(c, ev).collect()] == [(1, 2, "REPEATS")]


def test_lineage_ties_copies(spark):
    t = "the witness said that the ledger was hidden in the archive of the harbour office until the following spring"
    c = spark.createDataFrame([("c1", "d1", 1, "x", t), ("c2", "d2", 1, "x", t), ("c3", "d3", 1, "x", t.replace("spring", "summer")), ("c4", "d4", 1, "x", "something else entirely was said by somebody on that day"), ("c5", "d5", 1, "x", None)], "id string, document_id string, page_number int, claim_type string, claim_text string")
    got = {(r.src, r.dst): r.relation for r in N.claim_lineage(c).collect()}
    assert got == {("c1", "c2"): "repeats", ("c1", "c3"): "repeats"}


def test_lineage_broadcasts_no_table(spark):
    t = "the witness said that the ledger was hidden in the archive of the harbour office until the following spring"
    c = spark.createDataFrame([(f"c{i}", f"d{i}", 1, "x", t if i % 2 else t.replace("spring", "summer")) for i in range(8)], "id string, document_id string, page_number int, claim_type string, claim_text string")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    found = N.claim_lineage(c)
    planned = found._jdf.queryExecution().executedPlan().toString()
    got = {(r.src, r.dst) for r in found.collect()}
    ran = found._jdf.queryExecution().executedPlan().toString()
    assert got == {("c0", "c1"), *((f"c{i % 2}", f"c{i}") for i in range(2, 8))}
    assert "SortMergeJoin" in planned and "Broadcast" not in planned + ran


def test_content_duplicates_and_annotations(spark):
    d = spark.createDataFrame([(1, "a", datetime(2020, 1, 2)), (2, "a", datetime(2020, 1, 1)), (3, None, datetime(2020, 1, 1))], "doc_id long, text string, created_at timestamp")
    assert {(r.doc_id, r.first_doc_id) for r in O.content_duplicates(d, ["created_at", "doc_id"]).collect()} == {(1, 2), (2, 2)}
    a = spark.createDataFrame([("n", 1, "x", False), ("n", 2, "y", False), ("m", 1, "z", False), ("m", 2, "z", True)], "id string, version int, body string, is_deleted boolean")
    assert [(r.id, r.body) for r in O.annotations_now(a).collect()] == [("n", "y")]


def test_dismissed_pairs(spark):
    e = spark.createDataFrame([("b", "ok [DISMISSED_PAIR:a] [DISMISSED_PAIR:c]"), ("a", None)], "id string, review_notes string")
    assert {tuple(r) for r in O.dismissed_pairs(e).collect()} == {("a", "b"), ("b", "c")}


def test_bundle_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "t", "x"), ("d2", "u", "y")], "id string, source_tag string, text string")
    claims = spark.createDataFrame([("c1", "d1", "e1", None), ("c2", "d2", None, "e2")], "id string, document_id string, speaker_entity_id string, subject_entity_id string")
    ents = spark.createDataFrame([("e1", "A"), ("e2", "B")], "id string, canonical_name string")
    path = readers.export_bundle(readers.bundle_parts(docs, claims, ents, "t"), str(tmp_path / "b.zip"), title="T")
    parts = readers.import_bundle(spark, path, str(tmp_path / "in"), "salt")
    assert parts["documents"].count() == 1 and parts["entities"].first().canonical_name == "A"
    assert parts["claims"].first().document_id == parts["documents"].first().id != "d1"
    assert parts["claims"].first().speaker_entity_id == parts["entities"].first().id


def test_file_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_text("same")
    (tmp_path / "b.md").write_text("same")
    (tmp_path / "c.exe").write_text("other")
    got = {r.path.rpartition("/")[2]: r.status for r in readers.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "ok", "b.md": "duplicate", "c.exe": "unsupported"}


def test_stream_ingest_is_repeatable(spark, tmp_path):
    from docketeer.streaming.ingest import current, file_stream, ingest

    src = str(tmp_path / "src")
    spark.createDataFrame([("d1", "one"), ("d2", "two"), ("d3", "one")], "document_id string, text string").coalesce(1).write.parquet(src)
    stream = file_stream(spark, src, "document_id string, text string")
    q = ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), lambda df: {"lengths": df.select("document_id", F.length("text").alias("n"))})
    q.awaitTermination()
    assert current(spark, str(tmp_path / "out"), "lengths").count() == 2


def test_entry_contract():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60


def test_duplicate_candidates_equal_all_pairs(spark):
    import random

    from docketeer.functions import text as T

    rng = random.Random(3)
    names = ["Alpha Beta Gamma Xylophonistically", "Alpha Beta Gamma Quintessentially", "Abcd", "Abxd", "abcd", "Abc"]
    for _ in range(60):
        low = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(3, 30))).strip() or "xyz"
        names.append(low)
        for _ in range(2):
            slipped = list(low)
            for _ in range(max(1, len(low) // 4)):
                at, how = rng.randrange(len(slipped) + 1), rng.randrange(3)
                slipped[at : at + (how > 0)] = [] if how == 1 else [rng.choice("qrstuvwxyz")]
            names.append("".join(slipped).strip() or "xyz")
    e = spark.createDataFrame([(f"i{k:03}", "Organization", n) for k, n in enumerate(names)], "id string, entity_type string, canonical_name string")
    c = e.select("id", F.col("entity_type").alias("kind"), F.trim("canonical_name").alias("n"))
    c = c.select("id", "kind", "n", F.lower("n").alias("l"), T.significant_tokens(F.col("n")).alias("t"))
    every = c.toDF("id_a", "kind", "na", "la", "ta").crossJoin(c.toDF("id_b", "kind_b", "nb", "lb", "tb")).where("id_a < id_b")
    want = {(r.id_a, r.id_b, r.rule) for r in every.select("id_a", "id_b", *R._confidence()).where("confidence >= 0.55").collect()}
    got = {(r.id_a, r.id_b, r.rule) for r in R.duplicate_candidates(e).collect()}
    assert ("i000", "i001", "words") in got and sum(x[2] == "edits" for x in want) > 20 and got == want
