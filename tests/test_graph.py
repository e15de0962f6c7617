"""Graph operators against brute force on small graphs."""

import itertools
import random

from docketeer.operators import graph as G


def edges(spark, pairs):
    return spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in pairs], "a string, b string, weight bigint")


STAR_AND_TAIL = [("h", x, 1) for x in "abcd"] + [("d", "e", 1), ("e", "f", 1), ("x", "y", 3)]


def test_edges_are_ordered_and_summed(spark):
    r = spark.createDataFrame([("b", "a", 2), ("a", "b", None), ("a", "a", 5), (None, "a", 1)], "entity_a_id string, entity_b_id string, weight int")
    assert [tuple(x) for x in G.edges_of(r).collect()] == [("a", "b", 3)]


def test_components_of_long_chain(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}", 1) for i in range(60)] + [("z1", "z2", 1)]
    out = {r.id: r.component for r in G.components(edges(spark, chain)).collect()}
    assert len(out) == 63 and {out[f"n{i:03}"] for i in range(61)} == {"n000"} and out["z2"] == "z1"
    assert G.components(edges(spark, chain).limit(0)).count() == 0


def test_document_pairs_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"d{rng.randrange(12)}", f"e{rng.randrange(9)}") for _ in range(80)] + [(None, "e1"), ("d1", None)]
    df = spark.createDataFrame(rows, "document_id string, entity_id string")
    docs = {}
    for d, e in rows:
        if d and e:
            docs.setdefault(d, set()).add(e)
    want = {}
    for es in docs.values():
        for p in itertools.combinations(sorted(es), 2):
            want[p] = want.get(p, 0) + 1
    assert {(r.a, r.b): r.weight for r in G.document_pairs(df).collect()} == want


def test_bridge_scores_brute_force(spark):
    rng = random.Random(2)
    pairs = {tuple(sorted(rng.sample("abcdefghij", 2))) for _ in range(22)}
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in "abcdefghij"}
    want = {}
    for v, ns in near.items():
        if ns:
            all_ = list(itertools.combinations(sorted(ns), 2))
            want[v] = round(1 - sum(p in pairs for p in all_) / len(all_), 9) if all_ else 0.0
    got = {r.id: round(r.bridge, 9) for r in G.bridge_scores(edges(spark, [(a, b, 1) for a, b in pairs])).collect()}
    assert got == want


def test_betweenness_of_a_path(spark):
    out = {r.id: r.betweenness for r in G.betweenness(edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)])).collect()}
    assert out["a"] == 0 and abs(out["b"] - 4 / 6) < 1e-9 and abs(out["c"] - 4 / 6) < 1e-9


def test_bridges_and_paths(spark):
    e = edges(spark, STAR_AND_TAIL)
    assert {r.id for r in G.bridges(e).collect()} == {"h", "d", "e"}
    paths = [r.path for r in G.broker_paths(e, "d", 3).collect()]
    assert len(paths) == 3 and all(" d " in p for p in paths)


def test_pagerank_sums_to_one_and_hops(spark):
    e = edges(spark, STAR_AND_TAIL)
    assert abs(sum(r.score for r in G.pagerank(e, 10).collect()) - 1) < 1e-9
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.depth) for r in G.neighbourhood(e, start, 2).collect()} == {("a", 0), ("h", 1), ("b", 2), ("c", 2), ("d", 2)}


def test_eigenvector_favours_the_hub(spark):
    out = {r.id: r.score for r in G.eigenvector(edges(spark, STAR_AND_TAIL[:6]), 10).collect()}
    assert max(out, key=out.get) == "h"


def _random_graph(n, m, seed, heaviest):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return [(f"v{a:03}", f"v{b:03}", rng.randint(1, heaviest)) for a, b in sorted(pairs)]


def _all_paths(rows, length):
    """Every shortest path between two vertices, by brute force."""
    near = {}
    for a, b, w in rows:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = length(w)
    out = {}
    for s in near:
        best = {s: (0.0, [(s,)])}
        todo = [s]
        while todo:
            v = min(todo, key=lambda x: best[x][0])
            todo.remove(v)
            for w, d in near[v].items():
                far = best[v][0] + d
                if w not in best or far < best[w][0] - 1e-9:
                    if w not in todo:
                        todo.append(w)
                    best[w] = (far, [(*p, w) for p in best[v][1]])
                elif abs(far - best[w][0]) < 1e-9:
                    best[w] = (best[w][0], best[w][1] + [(*p, w) for p in best[v][1]])
        out |= {(s, t): sorted(ps) for t, (_, ps) in best.items() if t != s}
    return near, out


def test_betweenness_and_broker_paths_brute_force(spark):
    rows = _random_graph(30, 60, 5, 3)
    near, paths = _all_paths(rows, float)
    n = len(near)
    want = {v: sum(sum(v in p[1:-1] for p in ps) / len(ps) for ps in paths.values()) / ((n - 1) * (n - 2)) for v in near}
    got = {r.id: r.betweenness for r in G.betweenness(edges(spark, rows)).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    hub = max(near, key=lambda v: (len(near[v]), v))
    _, paths = _all_paths(rows, lambda w: 1 / w)
    through = [ps[0] for (s, t), ps in paths.items() if s < t and hub in ps[0][1:-1]]
    ranked = sorted((-(len(p) + min(p.index(hub), len(p) - 1 - p.index(hub))), len(p), " > ".join(p)) for p in through)
    assert [(-r.score, r.path) for r in G.broker_paths(edges(spark, rows), hub, 12).collect()] == [(s, p) for s, _, p in ranked[:12]]


def test_bridges_brute_force_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(G, "TASK_EDGES", 15)
    rows = _random_graph(60, 75, 6, 1)
    near, _ = _all_paths(rows, float)
    top, want = max(map(len, near.values())), {}
    for v in near:
        left, parts = set(near[v]), 0
        while left:
            parts += 1
            stack, seen = [left.pop()], {v}
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    stack += near[x]
            left -= seen
        if parts > 1:
            want[v] = round(min(0.99, 0.55 + 0.1 * (parts - 2) + 0.25 * len(near[v]) / top), 9)
    assert len(want) > 5 and {r.id: round(r.confidence, 9) for r in G.bridges(edges(spark, rows)).collect()} == want


def test_graphs_of_many_light_ties_are_not_refused(spark, tmp_path):
    from docketeer.plans.graphs import QUERIES

    e = spark.range(210_000).selectExpr("concat('a', id % 700) as a", "concat('b', id div 700) as b", "1L as weight")
    assert G.bridges(e.union(spark.sql("select 'a0', 'z', 1L"))).first().id == "a0"
    light = [("a", "b", 1), ("b", "c", 2), ("c", "d", 3)]
    spark.createDataFrame(light, "entity_a_id string, entity_b_id string, weight int").write.parquet(f"{tmp_path}/entity_relationships.parquet")
    assert {r.id for r in QUERIES["betweenness"](spark, tmp_path).where("betweenness > 0").collect()} == {"b", "c"}
    assert {r.id for r in QUERIES["brokers"](spark, tmp_path).where("betweenness > 0").collect()} == {"b", "c"}
    assert {r.id for r in QUERIES["bridge_leads"](spark, tmp_path).collect()} == {"b", "c"}
    assert [r.path for r in QUERIES["broker_paths"](spark, tmp_path).collect()] == ["a > b > c > d", "a > b > c"]


def test_leads_have_bridges(spark):
    mentions = spark.createDataFrame([("d1", "h"), ("d2", "h")], "document_id string, entity_id string")
    e = edges(spark, STAR_AND_TAIL)
    got = {r.id: (r.lead, round(r.confidence, 9)) for r in G.leads(e, mentions).collect()}
    # h, of 4 ties and as many parts without it, is a gatekeeper of confidence 0.77 as well
    assert got["h"] == ("bridge", 0.99) and got["d"] == ("bridge", 0.675) and got["e"] == ("bridge", 0.675)
