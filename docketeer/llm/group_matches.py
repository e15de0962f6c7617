"""Problem 7: one group id for all records tied directly or through others.

The component of the highest-degree vertex is peeled off by breadth-first frontier joins and removed by anti-join;
the components that remain get their smallest member by minimum propagation with star contraction, whose
number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketeer.runtime import cut, empty_like

#: Breadth-first rounds before what is left of a long-drawn component goes to the propagation.
PEEL_ROUNDS = 8


def tied_pairs(lineage: DataFrame, kinds: tuple[str, ...], src: str = "src_claim_id", dst: str = "dst_claim_id", kind: str = "relation_type") -> DataFrame:
    """(u, v) of the rows whose kind, trimmed and in lower case, is one of ``kinds``; null ends leave."""
    return (
        lineage.where(F.lower(F.regexp_replace(F.col(kind), r"^\s+|\s+$", "")).isin(*kinds))
        .select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u is not null and v is not null")
    )


def connected_groups(pairs: DataFrame, peel_rounds: int = PEEL_ROUNDS) -> DataFrame:
    """(id, group_id): every id in ``pairs`` (u, v), with the smallest id of its component.

    Repeated, reversed and self pairs change nothing; an id tied only to itself is a group of its own; rows with a null
    end are ignored; an empty table gives no rows.
    """
    spark = pairs.sparkSession
    ends = pairs.where("u is not null and v is not null").select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"))
    edges = cut(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    alone = ends.where("u = v").select(F.col("u").alias("id")).distinct()
    giant, rest = _peel(edges, peel_rounds)
    labels = _propagate(rest)
    if giant is not None:
        labels = _join_giant(giant, labels)
    if labels is None:
        labels = empty_like(spark, "id string, group_id string")
    return labels.unionByName(alone.join(labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("group_id")))


def _peel(edges: DataFrame, rounds: int) -> tuple[DataFrame | None, DataFrame]:
    """The vertices reached from the highest-degree vertex, and the edges outside; edges that still cross keep the root as their inner end."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    top = both.groupBy("u").count().orderBy(F.desc("count"), "u").limit(1).collect()
    if not top:
        return None, edges
    root = top[0]["u"]
    frontier = visited = cut(edges.sparkSession.createDataFrame([(root,)], "id string"))
    for _ in range(rounds):
        # the frontier side is small at first and shuffled later: Spark picks by size
        near = both.join(frontier, both.u == frontier.id, "left_semi").select(F.col("v").alias("id")).distinct()
        frontier = cut(near.join(visited, "id", "left_anti"))
        if frontier.isEmpty():
            break
        visited = cut(visited.unionByName(frontier))
    marked = edges.join(visited.select(F.col("id").alias("u"), F.lit(True).alias("in_u")), "u", "left").join(visited.select(F.col("id").alias("v"), F.lit(True).alias("in_v")), "v", "left")
    crossing = marked.where("in_u is null or in_v is null")
    rest = crossing.select(F.when(F.col("in_u"), F.lit(root)).otherwise(F.col("u")).alias("x"), F.when(F.col("in_v"), F.lit(root)).otherwise(F.col("v")).alias("y"))
    rest = cut(rest.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct())
    return visited.withColumn("root", F.lit(root)), rest


def _propagate(edges: DataFrame) -> DataFrame | None:
    """(id, group_id) of the edges' vertices: alternate large-star and small-star until nothing moves.

    Every round hangs each vertex's neighbours on the smallest one known; minima come from partial aggregation,
    so a hub's neighbours are never gathered.
    """
    edges = edges.select("u", "v")
    if edges.isEmpty():
        return None
    seen = _print_of(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = _print_of(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.groupBy("u").agg(F.min("v").alias("group_id")).select(F.col("u").alias("id"), "group_id").unionByName(roots.select("id", F.col("id").alias("group_id")))


def _print_of(edges: DataFrame) -> tuple:
    """Count and two order-free checksums of a set of pairs: equal when a round has moved nothing."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, 'x', u))")).first())


def _join_giant(giant: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Give the peeled vertices their group: the smallest of themselves and of what the root's label gathered outside."""
    root = giant.select("root").first()["root"]
    least = giant.agg(F.min("id")).first()[0]
    if labels is None:
        return giant.select("id", F.lit(least).alias("group_id"))
    labels = cut(labels)
    hit = labels.where(F.col("id") == root).select("group_id").first()
    outer = hit["group_id"] if hit else root
    least = min(least, outer)
    others = labels.where(F.col("id") != root).select("id", F.when(F.col("group_id") == outer, F.lit(least)).otherwise(F.col("group_id")).alias("group_id"))
    return others.unionByName(giant.select("id", F.lit(least).alias("group_id")))
