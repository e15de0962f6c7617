"""Readers, builds and wiping on small fixtures, with nulls, ties, repeated rows and empty tables."""

from docketeer.operators import builds as B
from docketeer.operators import extract as X
from docketeer.operators import graph as G
from docketeer.operators import narrative as N
from docketeer.operators import reports as P
from docketeer.operators import resolve as R
from docketeer.operators import tables as O


def test_json_is_repaired():
    assert P.repair_json('```json\n[{"a": 1}, {"b": 2,}]\n```') == [{"a": 1}, {"b": 2}]
    assert P.repair_json('[{"a": 1}, {"b": ') == [{"a": 1}] and P.repair_json(None) == [] and P.repair_json("nothing") == []


def test_aliases_change(spark):
    e = spark.createDataFrame([("1", "A", ["x", "y"]), ("2", "B", None)], "id string, canonical_name string, aliases array<string>")
    c = spark.createDataFrame([("1", "x", True), ("1", "z", False), ("1", "A", False), ("2", "q", False), ("9", "q", False), ("1", None, False)], "id string, alias string, remove boolean")
    assert {r.id: r.aliases for r in P.add_alias(e, c).collect()} == {"1": ["y", "z"], "2": ["q"]}


def test_wiping_twice_changes_nothing_more(spark):
    e = spark.createDataFrame([("e1", 9), ("e2", 9), ("e3", 9)], "id string, mention_count int")
    m = spark.createDataFrame([("e1", "d1"), ("e1", "d2"), ("e2", "d1"), (None, "d2")], "entity_id string, document_id string")
    gone = spark.createDataFrame([("d1",), ("d1",), (None,)], "document_id string")
    once = O.wipe_documents(e, m, gone, pages=m)
    twice = O.wipe_documents(once["entities"], once["mentions"], gone)
    assert {(r.id, r.mention_count) for r in once["entities"].collect()} == {(r.id, r.mention_count) for r in twice["entities"].collect()} == {("e1", 1)}
    assert once["pages"].count() == 2 and O.reingest(m, m.limit(0)).count() == 4


def test_model_findings_win(spark):
    ddl = "document_id string, page_number int, entity_type string, raw_name string, char_start int, char_end int"
    regex = spark.createDataFrame([("d", 1, "Person", "John Smith", 0, 10), ("d", 1, "Person", "Mary Jones", 20, 30), ("d", 1, "Aircraft", "N12345", 40, 46)], ddl)
    model = spark.createDataFrame([("d", 1, "Person", "Mr John Smith", 0, 13)], ddl)
    assert {r.raw_name for r in X.merge_found(regex, model).collect()} == {"Mary Jones", "N12345"} | {r.raw_name for r in model.where("raw_name not like 'Mr %'").collect()}
    assert X.merge_found(regex, model.limit(0)).count() == 3


def test_similar_pairs_against_brute_force(spark):
    import math
    import random

    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(100, [0.0] * 5), (101, None)]
    df = spark.createDataFrame([*rows, rows[0]], "id long, vector array<double>")

    def cos(a, b):
        n = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    want = {(i, j) for i, a in rows for j, b in rows if i < j and a and b and cos(a, b) >= 0.5}
    for block in (7, 1000):
        assert {(r.a, r.b) for r in N.similar_pairs(df, 0.5, block).collect()} == want
    assert N.similar_pairs(df.limit(0), 0.5).count() == 0


def test_seeds_and_flags(spark):
    import datetime as dt

    v = spark.createDataFrame([("a", [1.0, 0.0], dt.date(2020, 1, 1)), ("b", [1.0, 0.1], dt.date(2021, 1, 1)), ("c", [0.0, 1.0], None)], "id string, vector array<double>, day date")
    clusters = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "id string, leader string")
    got = B.seeds(v, clusters, N.similar_pairs(v, 0.5)).collect()
    assert [(r.leader, r.seed) for r in got] == [("a", "a")]
    dag = spark.createDataFrame([("a", "a", "b", 1, 0.3), ("a", "a", "d", 1, 0.4)], "leader string, parent string, child string, depth int, mutation double")
    threads = spark.createDataFrame([("a", 3, 0.5)], "leader string, nodes long, coherence double")
    who = spark.createDataFrame([("a", "x"), ("b", "y"), ("d", None)], "id string, actor string")
    assert [r.leader for r in B.manipulated(dag, threads, who).collect()] == ["a"] and B.manipulated(dag, threads, who.where("actor = 'x'")).count() == 0


def test_redaction_rules(spark):
    shapes = spark.createDataFrame([("d", 1, [0.0, 0.1], 40.0, 9.0), ("d", 1, [0.0, 0.9], 40.0, 9.0), ("d", 2, None, 40.0, 9.0), ("d", 2, [0.0], 20.0, 9.0)], "document_id string, page_number int, fill array<double>, width double, height double")
    assert P.redaction_marks(shapes).count() == 1
    words = spark.createDataFrame([("d", 1, 0, "the"), ("d", 1, 1, "hidden"), ("d", 1, 2, "other"), ("d", 2, 0, "seen")], "document_id string, page_number int, no int, word string")
    pages = spark.createDataFrame([("d", 1, "the other"), ("d", 2, "seen")], "document_id string, page_number int, final_text string")
    assert [(r.page_number, r.word) for r in P.hidden_words(words, pages).collect()] == [(1, "hidden")]


def test_results_past_the_end_are_empty(spark):
    hits = spark.createDataFrame([("p1", 2.0), ("p2", 2.0), ("p3", 1.0)], "id string, score double")
    pages = spark.createDataFrame([(f"p{i}", f"d{i}", 1) for i in (1, 2, 3)], "id string, document_id string, page_number int")
    docs = spark.createDataFrame([(f"d{i}", "f", None) for i in (1, 2, 3)], "id string, filename string, source_tag string")
    ment = spark.createDataFrame([("d1", 1, "e"), ("d1", 1, "e"), ("d1", 2, "e")], "document_id string, page_number int, entity_id string")
    ents = spark.createDataFrame([("e", "Name")], "id string, canonical_name string")
    got = P.result_list(hits, pages, docs, ment, ents, page=1, size=2).orderBy("id").collect()
    assert [(r.id, r.names, r.total) for r in got] == [("p1", "Name", 3), ("p2", "", 3)]
    assert P.result_list(hits, pages, docs, ment, ents, page=9).count() == 0


def test_isolated_entities_count(spark):
    e = spark.createDataFrame([("a", "b", 1)], "a string, b string, weight long")
    n = spark.createDataFrame([("a",), ("z",)], "id string")
    assert {(r.id, r.centrality) for r in G.degree_share(e, n).collect()} == {("a", 0.5), ("b", 0.5), ("z", 0.0)}
    new = spark.createDataFrame([("b", "a", 0.9), ("z", "a", 0.8), ("a", "z", 0.9), ("z", "z", 0.99)], "a string, b string, sim double")
    assert [(r.a, r.b) for r in B.semantic_edges(new, e).collect()] == [("a", "z")]


def test_edges_of_merged_rows_leave(spark):
    rel = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("3", "a", "c"), ("4", None, "c")], "id string, entity_a_id string, entity_b_id string")
    mapping = spark.createDataFrame([("b", "a"), ("a", "a")], "old string, new string")
    assert {r.id for r in R.drop_edges(rel, mapping).collect()} == {"3", "4"}


def test_models_are_callables(spark):
    texts = spark.createDataFrame([("1", "a b. c d."), ("2", None), ("3", "bad"), ("4", "")], "id string, text string")

    def ask(t):
        if t == "bad":
            raise ValueError
        return '[{"claim_text": "x", "claim_type": "odd"}]' if t else ""

    assert [tuple(r) for r in B.model_claims(texts, ask).collect()] == [("1", "x", "observation", "neutral")]
    assert {(r.key, r.no, tuple(r.vector)) for r in B.index_texts(texts, lambda xs: [[len(x)] for x in xs]).collect()} == {("1", 0, (9.0,)), ("3", 0, (3.0,))}


def test_bundle_threads(spark):
    from docketeer.sources import readers as S

    claims = spark.createDataFrame([("c1",), ("c2",)], "id string")
    parts = {"claims": claims, "entities": spark.createDataFrame([("e1",)], "id string")}
    out = S.bundle_threads(
        parts, spark.createDataFrame([("t1",), ("t2",)], "thread_id string"), spark.createDataFrame([("t1", "c1"), ("t2", "c9")], "thread_id string, claim_id string"),
        spark.createDataFrame([("c1", "c2"), ("c1", "c9")], "src string, dst string"), spark.createDataFrame([("c2", "c1"), (None, "c1")], "claim_a string, claim_b string"), spark.createDataFrame([("e1",), ("e2",)], "actor string"),
    )
    assert {k: out[k].count() for k in ("nodes", "threads", "edges", "contradictions", "brokers")} == dict.fromkeys(("nodes", "threads", "edges", "contradictions", "brokers"), 1)
