"""The weighted entity graph: edges, centralities, components, leads."""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketeer.runtime import cut, lookup_side

#: Ties times sources that a task follows at once.
BLOCK_CELLS = 2_000_000
#: Edges that a task thins at once.
TASK_EDGES = 500_000


def edges_of(relationships: DataFrame, min_weight: int = 1) -> DataFrame:
    """(a, b, weight): one row for each unordered pair, ends in order, repeated pairs summed, loops and null ends out; a null weight is 1."""
    w = F.coalesce("weight", F.lit(1)).cast("bigint")
    pairs = relationships.where("entity_a_id is not null and entity_b_id is not null and entity_a_id <> entity_b_id")
    pairs = pairs.select(F.least("entity_a_id", "entity_b_id").alias("a"), F.greatest("entity_a_id", "entity_b_id").alias("b"), w.alias("weight"))
    return pairs.groupBy("a", "b").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= min_weight)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def document_pairs(mentions: DataFrame) -> DataFrame:
    """(a, b, weight, doc_count): pairs of entities mentioned in a common document; both counts are documents.

    Each document's entities are listed once; an entity is paired with those behind it in the list.
    """
    seen = mentions.where("entity_id is not null and document_id is not null").select("document_id", "entity_id").distinct()
    lists = seen.groupBy("document_id").agg(F.sort_array(F.collect_list("entity_id")).alias("e"))
    heads = lists.select("e", F.explode(F.sequence(F.lit(1), F.size("e"))).alias("i"))
    pairs = heads.where(F.col("i") < F.size("e")).select(F.element_at("e", F.col("i")).alias("a"), F.explode(F.slice("e", F.col("i") + 1, F.size("e"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).withColumn("doc_count", F.col("weight"))


def relationships_list(relationships: DataFrame, entities: DataFrame, min_weight: int = 1, kind: str | None = None) -> DataFrame:
    """Edges with names; ``kind`` filters the a side only."""
    names = entities.select("id", "canonical_name", "entity_type")
    a = names.toDF("entity_a_id", "name_a", "type_a")
    if kind:
        a = a.where(F.col("type_a") == kind)
    b = names.toDF("entity_b_id", "name_b", "type_b")
    return relationships.where(F.col("weight") >= min_weight).join(a, "entity_a_id").join(b, "entity_b_id").select("id", "entity_a_id", "name_a", "entity_b_id", "name_b", "weight")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, centrality): neighbours, and their share of the largest degree."""
    deg = both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    top = deg.agg(F.max("degree").alias("top"))
    return deg.crossJoin(F.broadcast(top)).select("id", "degree", (F.col("degree") / F.col("top")).alias("centrality"))  # a one-row side


def degree_share(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, degree, centrality): neighbours, and their share of all others, of ``nodes`` (id) and of what the edges name; vertices without edges have 0."""
    ids = nodes.select("id").where("id is not null").unionByName(edges.select(F.col("a").alias("id"))).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    deg = both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    n = ids.agg(F.count("*").alias("n"))
    out = ids.join(deg, "id", "left").fillna(0, ["degree"]).crossJoin(F.broadcast(n))  # a one-row side
    return out.select("id", "degree", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def metrics_report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, degree, pagerank, betweenness, eigenvector, influence): .40 PageRank, .35 betweenness and .25 eigenvector, each of its largest; all by id.
    Vertices without edges have only zeros."""
    out = degree_share(edges, nodes).select("id", "degree")
    parts = {"pagerank": pagerank(edges).toDF("id", "pagerank"), "betweenness": betweenness(edges), "eigenvector": eigenvector(edges).toDF("id", "eigenvector")}
    score = F.lit(0.0)
    for (name, df), weight in zip(parts.items(), (0.40, 0.35, 0.25), strict=True):
        df = cut(df)
        top = df.agg(F.max(name).alias(f"top_{name}"))
        out = out.join(df, "id", "left").fillna(0.0, [name]).crossJoin(F.broadcast(top))  # a one-row side
        score = score + weight * F.when(F.col(f"top_{name}") > 0, F.col(name) / F.col(f"top_{name}")).otherwise(0.0)
    return out.select("id", "degree", "pagerank", "betweenness", "eigenvector", score.alias("influence"))


def top_by(report: DataFrame, metric: str, names: DataFrame, kind: str | None = None, top: int = 20) -> DataFrame:
    """(id, canonical_name, entity_type, value): the ``top`` by a metric; the type is filtered after the metric was scaled over all."""
    rows = report.select("id", F.col(metric).alias("value")).join(names.select("id", "canonical_name", "entity_type"), "id")
    if kind is not None:
        rows = rows.where(F.col("entity_type") == kind)
    return rows.orderBy(F.desc("value"), "id").limit(top)


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """(start, id, depth): what the asked vertices (id) reach within ``hops`` (at most 4), each at its least depth."""
    near = both_ways(edges).select("a", "b")
    reached = starts.select(F.col("id").alias("start"), F.col("id"), F.lit(0).alias("depth"))
    frontier = reached
    for depth in range(1, min(hops, 4) + 1):
        step = frontier.join(near, frontier.id == near.a).select("start", F.col("b").alias("id")).distinct()
        frontier = cut(step.join(reached.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        reached = reached.unionByName(frontier)
    return reached


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, score): weighted, a fixed number of rounds; vertices without edges aren't in the graph, so none dangles."""
    near = both_ways(edges)
    out = near.groupBy("a").agg(F.sum("weight").alias("total"))
    links = cut(near.join(out, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("p")))
    n = out.count()
    scores = out.select(F.col("a").alias("id"), F.lit(1.0 / max(n, 1)).alias("score"))
    for k in range(rounds):
        flow = links.join(scores, links.a == scores.id).groupBy(F.col("b").alias("id")).agg(F.sum(F.col("p") * F.col("score")).alias("in"))
        scores = flow.select("id", (F.lit((1 - damping) / max(n, 1)) + damping * F.col("in")).alias("score"))
        if k % 5 == 4:
            scores = cut(scores)
    return scores


def eigenvector(edges: DataFrame, rounds: int = 24) -> DataFrame:
    """(id, score): power iteration on the weighted graph shifted by the identity, of unit length. Each round is one join and one sum behind a checkpoint."""
    near = cut(both_ways(edges))
    scores = cut(near.select(F.col("a").alias("id")).distinct().withColumn("score", F.lit(1.0)))
    for _ in range(rounds):
        flow = near.join(scores, near.a == scores.id).groupBy(F.col("b").alias("id")).agg(F.sum(F.col("weight") * F.col("score")).alias("in"))
        moved = cut(scores.join(flow, "id").select("id", (F.col("score") + F.col("in")).alias("score")))
        size = moved.agg(F.sqrt(F.sum(F.col("score") * F.col("score")))).first()[0] or 1.0
        scores = moved.select("id", (F.col("score") / F.lit(size)).alias("score"))
    return scores


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each connected component, by star contraction."""
    spark = edges.sparkSession
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if pairs.isEmpty():
        return spark.createDataFrame([], "id string, component string")
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionByName(roots)


def cluster_report(edges: DataFrame, entities: DataFrame, counts: DataFrame) -> DataFrame:
    """(component, size, mentions, types): components of more than one vertex; counts: entity_id, mentions."""
    member = components(edges).join(entities.select("id", "entity_type"), "id", "left").join(counts.select(F.col("entity_id").alias("id"), "mentions"), "id", "left")
    out = member.groupBy("component").agg(F.count("*").alias("size"), F.sum(F.coalesce("mentions", F.lit(0))).alias("mentions"), F.array_join(F.array_sort(F.collect_set("entity_type")), ",").alias("types"))
    return out.where("size > 1")


def bridge_scores(edges: DataFrame) -> DataFrame:
    """(id, bridge): the share of a vertex's neighbour pairs that aren't tied; 0 for fewer than two neighbours.

    Triangles are listed from the end of lower degree, which bounds the fan-out of hubs.
    """
    deg = cut(both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("d")))
    rank = edges.select("a", "b").join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    forward = F.struct("da", "a") < F.struct("db", "b")
    directed = cut(rank.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedge = directed.alias("p").join(directed.alias("q"), F.col("p.x") == F.col("q.x")).where("p.y < q.y").select("p.x", F.col("p.y").alias("y"), F.col("q.y").alias("z"))
    closed = edges.select(F.col("a").alias("y"), F.col("b").alias("z"))
    triangles = wedge.join(closed, ["y", "z"], "left_semi")
    corner = triangles.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    pairs = F.col("d") * (F.col("d") - 1) / 2
    return deg.join(corner, "id", "left").select("id", F.when(F.col("d") < 2, 0.0).otherwise(1 - F.coalesce("t", F.lit(0)) / pairs).alias("bridge"))


def influence_map(edges: DataFrame, mentions: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, influence): .30 degree + .25 document spread + .20 claims about + .15 bridge + .10 claims by, each of its largest; below 0.01 left out."""
    deg = degrees(edges).select("id", "centrality")
    n = mentions.agg(F.count_distinct("document_id").alias("n"))
    spread = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count_distinct("document_id").alias("docs")).crossJoin(F.broadcast(n)).select("id", (F.col("docs") / F.col("n")).alias("spread"))

    def share(c: str, name: str) -> DataFrame:
        k = claims.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("id")).agg(F.count("*").alias("k"))
        return k.crossJoin(F.broadcast(k.agg(F.max("k").alias("top")))).select("id", (F.col("k") / F.col("top")).alias(name))  # a one-row side

    out = deg.join(spread, "id", "left").join(share("subject_entity_id", "target"), "id", "left").join(bridge_scores(edges), "id", "left").join(share("speaker_entity_id", "authority"), "id", "left").fillna(0.0)
    score = 0.30 * F.col("centrality") + 0.25 * F.col("spread") + 0.20 * F.col("target") + 0.15 * F.col("bridge") + 0.10 * F.col("authority")
    return out.select("id", score.alias("influence")).where("influence >= 0.01")


def _compact(edges: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The graph in numbers: its vertices in order, where each vertex's ties begin, their other ends, their lengths (the weights, above 0).

    12 bytes for each direction of a tie, read partition by partition; no number of edges is refused.
    """
    e = cut(edges.select("a", "b", F.col("weight").cast("double").alias("w")))
    ids = [r["id"] for r in e.select(F.explode(F.array("a", "b")).alias("id")).distinct().orderBy("id").toLocalIterator()]
    number = {v: i for i, v in enumerate(ids)}
    ends, length = array("i"), array("d")
    for r in e.toLocalIterator():
        ends.append(number[r["a"]])
        ends.append(number[r["b"]])
        length.append(r["w"])
    u, v = np.array(ends, np.int32).reshape(-1, 2).T
    tail, head, w = np.concatenate([u, v]), np.concatenate([v, u]), np.tile(np.array(length), 2)
    order = np.lexsort((head, tail))
    start = np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=len(ids)))]).astype(np.int64)
    return ids, start, head[order], w[order]


def _distances(start: np.ndarray, head: np.ndarray, length: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """From each source to each vertex, all sources at once: what came nearer in a round is followed in the next."""
    n = len(start) - 1
    dist = np.full(len(sources) * n, np.inf)
    moved = np.arange(len(sources)) * n + sources
    dist[moved] = 0.0
    while len(moved):
        v = moved % n
        k = start[v + 1] - start[v]
        tie = np.arange(k.sum()) + np.repeat(start[v] - np.cumsum(k) + k, k)
        to = np.repeat(moved - v, k) + head[tie]
        far = np.repeat(dist[moved], k) + length[tie]
        near = far < dist[to] - 1e-12
        to, far = to[near], far[near]
        np.minimum.at(dist, to, far)
        moved = np.unique(to)
    return dist.reshape(len(sources), n)


def _shortest_ties(start: np.ndarray, head: np.ndarray, length: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tail, head) of the ties on shortest paths, the nearest heads first."""
    tail = np.repeat(np.arange(len(start) - 1), np.diff(start))
    with np.errstate(invalid="ignore"):
        row, tie = np.nonzero(np.abs(dist[:, tail] + length - dist[:, head]) <= 1e-11)
    order = np.argsort(dist[row, head[tie]], kind="stable")
    row, tie = row[order], tie[order]
    return row, tail[tie], head[tie]


def _blocks(graph, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sources of a task, as many at once as BLOCK_CELLS allows, and their distances."""
    ids, start, head, length = graph
    at_once = max(1, BLOCK_CELLS // max(1, len(head)))
    for batch in batches:
        for k in range(0, len(batch), at_once):
            sources = batch["i"].to_numpy()[k : k + at_once]
            yield sources, _distances(start, head, length, sources)


def _sources(spark, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "i").repartition(max(1, min(512, n // 50)))


def betweenness(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """(id, betweenness): normalised, exact; an edge's weight is its length, so heavy ties are long. One task for each part of the sources.

    Every task holds the graph in numbers; sources are followed in blocks of bounded size.
    """
    spark = edges.sparkSession
    graph = _compact(edges if weighted else edges.withColumn("weight", F.lit(1)))
    n = len(graph[0])
    if not n:
        return spark.createDataFrame([], "id string, betweenness double")
    shared = spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, *g = shared.value
        total = np.zeros(n)
        for sources, dist in _blocks(shared.value, batches):
            row, tail, head = _shortest_ties(*g, dist)
            far = dist[row, head]
            u, w = row * n + tail, row * n + head
            steps = [*np.flatnonzero(np.diff(far, prepend=-1.0)), len(far)]
            paths, part = np.zeros(dist.size), np.zeros(dist.size)
            paths[np.arange(len(sources)) * n + sources] = 1.0
            spans = [slice(x, y) for x, y in itertools.pairwise(steps)]
            for k in spans:
                np.add.at(paths, w[k], paths[u[k]])
            for k in reversed(spans):
                np.add.at(part, u[k], paths[u[k]] / paths[w[k]] * (1 + part[w[k]]))
            part[np.arange(len(sources)) * n + sources] = 0.0
            total += part.reshape(dist.shape).sum(axis=0)
        yield pd.DataFrame({"id": ids, "part": total})

    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    parts = _sources(spark, n).mapInPandas(run, "id string, part double")
    return parts.groupBy("id").agg((F.sum("part") * scale).alias("betweenness"))


def broker_paths(edges: DataFrame, entity: str, limit: int = 10) -> DataFrame:
    """(path, score): shortest paths (length 1 / weight) that pass through ``entity``, each in one direction, of equal ones the first by name."""
    spark = edges.sparkSession
    graph = _compact(edges.withColumn("weight", 1.0 / F.greatest(F.col("weight"), F.lit(1))))
    n = len(graph[0])
    if entity not in graph[0]:
        return spark.createDataFrame([], "path string, score double")
    shared, middle = spark.sparkContext.broadcast(graph), graph[0].index(entity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, *g = shared.value
        best: list[tuple] = []
        for sources, dist in _blocks(shared.value, batches):
            row, tail, head = _shortest_ties(*g, dist)
            cuts = np.argsort(row, kind="stable")
            row, tail, head = row[cuts], tail[cuts], head[cuts]
            ends = np.searchsorted(row, np.arange(len(sources) + 1))
            for k, s in enumerate(sources.tolist()):
                # vertices are numbered by name, so that the smallest tuple is the first by name
                path = {s: (s,)}
                for u, v in zip(tail[ends[k] : ends[k + 1]].tolist(), head[ends[k] : ends[k + 1]].tolist(), strict=True):
                    if v not in path or (*path[u], v) < path[v]:
                        path[v] = (*path[u], v)
                for t, p in path.items():
                    if s < t and middle in p[1:-1]:
                        i = p.index(middle)
                        best.append((-float(len(p) + min(i, len(p) - 1 - i)), len(p), p))
                if len(best) > 100_000:
                    best = _first(best, ids, limit)
        rows = _first(best, ids, limit)
        yield pd.DataFrame({"path": [" > ".join(ids[v] for v in p) for _, _, p in rows], "score": [-s for s, _, _ in rows], "size": [n for _, n, _ in rows]}, columns=["path", "score", "size"]).astype({"path": "object", "score": "float64", "size": "int32"})

    out = _sources(spark, n).mapInPandas(run, "path string, score double, size int")
    return out.orderBy(F.desc("score"), "size", "path").limit(limit).select("path", "score")


def _first(paths: list[tuple], ids: list[str], limit: int) -> list[tuple]:
    """The first ``limit`` of (-score, size, path), and by their written form where these agree."""
    paths.sort(key=lambda x: x[:2])
    last = paths[min(limit, len(paths)) - 1][:2] if paths else None
    return sorted((x for x in paths if x[:2] <= last), key=lambda x: (*x[:2], " > ".join(ids[v] for v in x[2])))[:limit]


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community): label propagation by weight; of equal labels the smallest. Names of communities are their smallest members."""
    near = both_ways(edges)
    labels = near.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id"))
    for k in range(rounds):
        votes = near.join(labels, near.b == labels.id).groupBy("a", "label").agg(F.sum("weight").alias("w"))
        # half of the vertices move in each round, so that pairs don't swap labels for ever
        moved = votes.groupBy(F.col("a").alias("id")).agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("new"))
        labels = labels.join(moved, "id").select("id", F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == k % 2, F.col("new")).otherwise(F.col("label")).alias("label"))
        labels = cut(labels)
    name = labels.groupBy("label").agg(F.min("id").alias("community"))
    return labels.join(name, "label").select("id", "community")


def community_report(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(community, size, edges, density)."""
    inner = edges.join(groups.select(F.col("id").alias("a"), "community"), "a").join(groups.select(F.col("id").alias("b"), F.col("community").alias("other")), "b").where("community = other")
    n = groups.groupBy("community").agg(F.count("*").alias("size"))
    m = inner.groupBy("community").agg(F.count("*").alias("edges"))
    out = n.join(m, "community", "left").fillna(0, ["edges"])
    return out.withColumn("density", F.when(F.col("size") > 1, 2 * F.col("edges") / (F.col("size") * (F.col("size") - 1))).otherwise(0.0))


def brokers(edges: DataFrame, groups: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, betweenness, bridged): how many communities other than its own a vertex's neighbours are in."""
    g = groups.select("id", "community")
    near = both_ways(edges).select(F.col("a").alias("id"), F.col("b").alias("other"))
    spans = near.join(g, "id").join(g.toDF("other", "theirs"), "other").where("community <> theirs").groupBy("id").agg(F.count_distinct("theirs").alias("bridged"))
    return scores.join(spans, "id", "left").select("id", "betweenness", F.coalesce("bridged", F.lit(0)).alias("bridged"))


def gatekeepers(edges: DataFrame, mentions: DataFrame, min_degree: int = 3, least: float = 0.3) -> DataFrame:
    """Leads: many ties for few mentions."""
    deg = degrees(edges).where(F.col("degree") >= min_degree)
    m = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("m"))
    score = F.least(F.lit(0.99), F.col("centrality") / (1 + 0.15 * F.col("m")))
    return deg.join(m, "id").select("id", F.lit("gatekeeper").alias("lead"), score.alias("confidence")).where(F.col("confidence") >= least)


def spikes(mentions: DataFrame, least: float = 0.35) -> DataFrame:
    """Leads: entities mentioned densely in few documents."""
    n = mentions.agg(F.count_distinct("document_id").alias("n"))
    c = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("m"), F.count_distinct("document_id").alias("d")).where("d >= 2 and m >= 3").crossJoin(F.broadcast(n))
    ratio = F.col("m") / F.col("d")
    score = ratio / (F.col("m") + 1) * (1 - F.col("d") / F.col("n")) + 0.3 * F.col("d") / F.col("n")
    return c.select("id", F.lit("spike").alias("lead"), score.alias("confidence")).where(F.col("confidence") >= least)


def outlier_documents(mentions: DataFrame, least: int = 3) -> DataFrame:
    """Leads: documents with at least ``least`` entities found nowhere else."""
    pairs = mentions.where("entity_id is not null").select("document_id", "entity_id").distinct()
    alone = pairs.groupBy("entity_id").agg(F.count("*").alias("d")).where("d = 1").select("entity_id", F.lit(1).alias("only"))
    per = pairs.join(alone, "entity_id", "left").groupBy("document_id").agg(F.count("*").alias("all"), F.count("only").alias("n")).where(F.col("n") >= least)
    return per.select(F.col("document_id").alias("id"), F.lit("outlier").alias("lead"), F.least(F.lit(0.99), 0.4 + 0.5 * F.col("n") / F.col("all") + 0.02 * F.col("n")).alias("confidence"))


def _neighbours(pairs: pd.DataFrame) -> tuple[list, list[list[int]]]:
    number, ids = pd.factorize(pd.concat([pairs["a"], pairs["b"]]))
    near: list[list[int]] = [[] for _ in ids]
    for x, y in zip(number[: len(pairs)].tolist(), number[len(pairs) :].tolist(), strict=True):
        near[x].append(y)
        near[y].append(x)
    return list(ids), near


def _certificate(pairs: pd.DataFrame) -> pd.DataFrame:
    """At most two edges for each vertex that hold together, without any one vertex, what all edges hold together without it.

    A breadth-first forest and a spanning forest of the other edges: an edge at x outside the first forest leads to a vertex that was
    reached before x was left, so that its way to the root avoids x. It holds for any edges joined to them as well.
    """
    ids, near = _neighbours(pairs)
    above, other = [-1] * len(ids), list(range(len(ids)))
    kept = []
    for root in range(len(ids)):
        if above[root] < 0:
            above[root], queue = root, [root]
            for v in queue:
                for w in near[v]:
                    if above[w] < 0:
                        above[w] = v
                        queue.append(w)
                        kept.append((v, w))

    def top(v: int) -> int:
        while other[v] != v:
            other[v] = v = other[other[v]]
        return v

    for v, ws in enumerate(near):
        for w in ws:
            if v < w and above[w] != v and above[v] != w and (x := top(v)) != (y := top(w)):
                other[x] = y
                kept.append((v, w))
    return pd.DataFrame([(ids[v], ids[w]) for v, w in kept], columns=["a", "b"])


def _parts_without(pairs: pd.DataFrame) -> pd.DataFrame:
    """(id, parts): into how many parts a vertex's neighbours fall without it, where there is more than one; depth first, without recursion."""
    ids, near = _neighbours(pairs)
    seen, low, parts, count = [0] * len(ids), [0] * len(ids), [1] * len(ids), 0
    for root in range(len(ids)):
        if seen[root]:
            continue
        count += 1
        seen[root] = low[root] = count
        parts[root], stack = 0, [(root, -1, iter(near[root]))]
        while stack:
            v, up, rest = stack[-1]
            for w in rest:
                if not seen[w]:
                    count += 1
                    seen[w] = low[w] = count
                    stack.append((w, v, iter(near[w])))
                    break
                if w != up:
                    low[v] = min(low[v], seen[w])
            else:
                stack.pop()
                if up >= 0:
                    low[up] = min(low[up], low[v])
                    parts[up] += low[v] >= seen[up]
    return pd.DataFrame([(ids[v], k) for v, k in enumerate(parts) if k > 1], columns=["id", "parts"])


def bridges(edges: DataFrame) -> DataFrame:
    """Leads: vertices without which their neighbours fall apart, of any number of edges.

    Tasks thin their edges to two for each vertex, which keeps every answer, and are joined four by four until one task holds the rest.
    """

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _certificate(pd.concat([pd.DataFrame({"a": [], "b": []}, dtype="object"), *batches]))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _parts_without(pd.concat([pd.DataFrame({"a": [], "b": []}, dtype="object"), *batches]))

    ties = cut(edges.select("a", "b"))
    tasks = -(-ties.count() // TASK_EDGES)
    while tasks > 1:
        ties = cut(ties.repartition(tasks).mapInPandas(thin, "a string, b string"))
        tasks = -(-tasks // 4)
    apart = ties.repartition(1).mapInPandas(parts, "id string, parts int")
    score = 0.55 + 0.1 * (F.col("parts") - 2) + 0.25 * F.col("centrality")
    return degrees(edges).join(apart, "id").select("id", F.lit("bridge").alias("lead"), F.least(F.lit(0.99), score).alias("confidence"))


def leads(edges: DataFrame, mentions: DataFrame, top: int = 50, gatekeeper: float = 0.3, spike: float = 0.35, alone: int = 3) -> DataFrame:
    """All kinds of leads, the best of each entity or document, the ``top`` ones; ``gatekeeper``, ``spike`` and ``alone`` are these kinds' least values."""
    every = gatekeepers(edges, mentions, least=gatekeeper).unionByName(bridges(edges)).unionByName(spikes(mentions, spike)).unionByName(outlier_documents(mentions, alone))
    best = every.groupBy("id").agg(F.max_by(F.struct("lead", "confidence"), F.struct("confidence", "lead")).alias("s")).select("id", "s.*")
    return best.orderBy(F.desc("confidence"), "id").limit(top)


def restrict_to(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose ends are both in ``ids`` (id)."""
    side = lookup_side(ids.select("id").distinct())
    return edges.join(side.withColumnRenamed("id", "a"), "a", "left_semi").join(side.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b", "weight")


def rank_in(df: DataFrame, by: list[str], order: list, top: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
