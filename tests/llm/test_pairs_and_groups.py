"""Co-occurrence, match groups, repeated lines: against brute force, and hostile input."""

import itertools
import random

from docketeer.llm.cooccurrence import associations
from docketeer.llm.group_matches import connected_groups, tied_pairs
from docketeer.llm.repeated_lines import cardinalities, line_key, repeated_lines, without_lines


def brute_groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def test_groups_against_union_find(spark):
    rng = random.Random(4)
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(0, 70)]  # a chain
    pairs += [("c500", f"c{i}") for i in range(501, 540)] + [("c539", "a001")]  # a star whose smallest member is a leaf
    pairs += [(f"x{rng.randrange(40):02}", f"x{rng.randrange(40):02}") for _ in range(25)]
    pairs += [("s1", "s1"), ("b", "a"), ("a", "b"), ("a", "b")]
    rng.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (None, "a"), ("q", None)], "u string, v string")
    assert {r.id: r.group_id for r in connected_groups(df).collect()} == brute_groups(pairs)
    assert connected_groups(df.limit(0)).count() == 0


def test_peeling_may_stop_early(spark):
    pairs = [(f"n{i:02}", f"n{i + 1:02}") for i in range(30)]
    df = spark.createDataFrame(pairs, "u string, v string")
    assert {r.group_id for r in connected_groups(df, peel_rounds=2).collect()} == {"n00"}


def test_kinds_are_trimmed(spark):
    df = spark.createDataFrame([("a", "b", " Repeats\t"), ("b", "c", "other"), ("c", "d", None), ("d", "e", "")], "src_claim_id string, dst_claim_id string, relation_type string")
    assert [tuple(r) for r in tied_pairs(df, ("repeats",)).collect()] == [("a", "b")]


def test_associations_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(f"d{d}", f"e{e}") for d in range(40) for e in rng.sample(range(12), rng.randrange(1, 7))]
    rows += [(f"d{d}", "hub") for d in range(38)] + [("d1", "e1"), (None, "e1"), ("d2", None)]
    docs = {}
    for d, e in rows:
        if d and e:
            docs.setdefault(d, set()).add(e)
    n, count, single = len(docs), {}, {}
    for es in docs.values():
        for e in es:
            single[e] = single.get(e, 0) + 1
        for p in itertools.combinations(sorted(es), 2):
            count[p] = count.get(p, 0) + 1
    df = spark.createDataFrame(rows, "document_id string, entity_id string")
    for least, lift in ((1, 0.0), (3, 1.2), (5, 3.0)):
        want = {p: c for p, c in count.items() if c >= least and c * n >= lift * single[p[0]] * single[p[1]]}
        assert {(r.a, r.b): r.n_ab for r in associations(df, least, lift).collect()} == want
    assert associations(df.limit(0), 1, 0.0).count() == 0


def test_repeated_lines(spark):
    docs = spark.createDataFrame([(f"d{i}", "s", i) for i in range(20)] + [("e1", "", 90), ("e2", None, 91)], "id string, source_tag string, k int")
    body = ["Share this page (12 shares)", "SHARE  this page — 9 shares!", "share THIS page (shares) May"]
    pages = [(f"p{i}", f"d{i}", False, f"{body[i % 3]}\nunique text number{chr(97 + i)}\n\n12345") for i in range(5)]
    pages += [("p0", "d0", False, pages[0][3]), ("o", "d9", True, body[0]), ("n", "d8", False, None), ("x", "e1", False, body[0]), ("y", "gone", False, body[0])]
    p = spark.createDataFrame(pages, "id string, document_id string, ocr_used boolean, final_text string")
    found = repeated_lines(p, docs)
    assert {(r.page_id, r.line_no, r.n_docs) for r in found.collect()} == {(f"p{i}", 0, 5) for i in range(5)}
    clean = {r.page_id: r.clean_text for r in without_lines(p, found).collect()}
    assert clean["p1"] == "unique text numberb\n\n12345" and clean["n"] is None and clean["x"] == body[0]
    assert repeated_lines(p.limit(0), docs).count() == 0


def test_line_key(spark):
    df = spark.createDataFrame([("Retrieved on 3 March 2020!",), ("retrieved ON 1 May",), ("2020-01-01 ...",)], "l string")
    assert [r[0] for r in df.select(line_key(df.l)).collect()] == ["retrievedon", "retrievedon", ""]


def test_unions_in_either_form(spark):
    rng = random.Random(5)
    rows = [("s", b"k%d" % (i % 5), i, i % 2, sorted(rng.sample(range(32768), rng.randrange(1, 60)))) for i in range(40)] + [("s", b"one", 99, 0, [0, 32767])]
    df = spark.createDataFrame(rows, "source_tag string, key binary, variant long, span long, docs array<int>")
    df = df.withColumn("docs", df.docs.cast("array<smallint>"))
    want = {}
    for s, k, _, span, docs in rows:
        want.setdefault((s, k, span), set()).update(docs)
    for dense in (0, 40, 100_000):
        assert {(r.source_tag, bytes(r.key), r.span): r.n for r in cardinalities(df, dense).collect()} == {k: len(v) for k, v in want.items()}, dense
