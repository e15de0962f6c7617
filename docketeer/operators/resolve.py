"""Duplicate candidates, merging and canonicalisation of entities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketeer.functions import lists
from docketeer.functions import text as T
from docketeer.runtime import cut


def duplicate_candidates(entities: DataFrame, min_confidence: float = 0.55) -> DataFrame:
    """(id_a, id_b, confidence, rule) of the same type: containment, shared words, edit distance, initials, in this order of trust.

    Each rule has its own blocks, which are complete for it: of a contained name every four-letter piece is in the other, the rarest is asked for;
    of names that share .6 of their words one is among the rarest n - ceil(.6 n) + 1 of either; of names within a quarter of edits the longer,
    cut in one piece more than there may be edits, has a piece that stands unchanged near its place in the other; initials are equal keys.
    Rows with null names or types leave.
    """
    e = cut(entities.where("canonical_name is not null and trim(canonical_name) <> ''").select("id", F.col("entity_type").alias("kind"), F.trim("canonical_name").alias("name")).distinct())
    e = e.withColumn("low", F.lower("name")).withColumn("tokens", F.array_distinct(T.significant_tokens(F.col("name"))))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - 3), lambda i: F.substring(F.col("low"), i, F.lit(4))))
    inside = _rare(e.where("length(low) >= 4").select("id", "kind", F.explode(grams).alias("key")), lambda n: F.lit(1))
    words = _rare(e.select("id", "kind", F.explode("tokens").alias("key")), lambda n: n - F.ceil(0.6 * n - 1e-9) + 1)
    edits = _edit_keys(e.select("id", "kind", "low"))
    ini = e.where("kind = 'Person'").select("id", "kind", T.initials(F.col("name")).alias("key"))
    short = e.where((F.col("kind") == "Person") & (F.length("name") <= 4)).select("id", "kind", F.col("name").alias("key"))
    same = ini.unionByName(short).distinct()
    pairs = None
    for probe, keys in (inside, words, edits, (same, same)):
        met = probe.alias("a").join(keys.alias("b"), ["kind", "key"]).where("a.id <> b.id").select("kind", F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"))
        pairs = met if pairs is None else pairs.unionByName(met)
    pairs = pairs.distinct()
    a = e.select(F.col("id").alias("id_a"), F.col("name").alias("na"), F.col("low").alias("la"), F.col("tokens").alias("ta"))
    b = e.select(F.col("id").alias("id_b"), F.col("name").alias("nb"), F.col("low").alias("lb"), F.col("tokens").alias("tb"))
    scored = pairs.join(a, "id_a").join(b, "id_b")
    return scored.select("id_a", "id_b", *_confidence()).where(F.col("confidence") >= min_confidence)


def _rare(keys: DataFrame, least) -> tuple[DataFrame, DataFrame]:
    """The ``least``(n) rarest of each row's n keys, and all keys. Keys found once meet nothing, but they take their places among the rarest."""
    keys = cut(keys)
    size = keys.groupBy("kind", "key").agg(F.count("*").alias("df"))
    rare = keys.join(size, ["kind", "key"]).groupBy("id", "kind").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("k"))
    rare = rare.select("id", "kind", F.explode(F.slice("k", F.lit(1), least(F.size("k")).cast("int"))).alias("k"))
    return rare.where("k.df > 1").select("id", "kind", F.col("k.key").alias("key")), keys


def pieces(n: int) -> list[tuple[int, int]]:
    """(begin, length) of the pieces of a name of n letters: one more than a quarter of n edits can touch."""
    k = n // 4 + 1
    short, long = n // k, n % k
    return [(i * short + max(0, i - (k - long)), short + (i >= k - long)) for i in range(k)]


def _edit_keys(names: DataFrame, longest: int = 30) -> tuple[DataFrame, DataFrame]:
    """Keys of names as the longer and as the shorter of a pair: its length, a piece's number and letters. A piece with i pieces before it
    and j behind it is moved by at most i from the left, or by at most j from the right, if it is the first left whole."""

    def cut_up(longer: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for id_, kind, low in zip(batch["id"], batch["kind"], batch["low"], strict=True):
                    m = len(low)
                    keys = set()
                    for n in [m] if longer else range(m, min(longest, m + m // 3) + 1):
                        for i, (at, size) in enumerate(pieces(n)):
                            k, d = n // 4, m - n
                            places = [at] if longer else range(max(0, at - i, at + d - (k - i)), min(m - size, at + i, at + d + k - i) + 1)
                            keys.update(f"{n} {i} {low[p : p + size]}" for p in places)
                    rows += [(id_, kind, key) for key in keys]
                yield pd.DataFrame(rows, columns=["id", "kind", "key"])

        return run

    brief = names.where(F.length("low") <= longest)
    return tuple(brief.mapInPandas(cut_up(x), "id string, kind string, key string") for x in (True, False))


def _confidence():
    na, nb, la, lb = F.col("na"), F.col("nb"), F.col("la"), F.col("lb")
    contained = (F.contains(lb, la) | F.contains(la, lb)) & (F.least(F.length(na), F.length(nb)) >= 4)
    shared = T.jaccard(F.col("ta"), F.col("tb"))
    longest = F.greatest(F.length(na), F.length(nb))
    ratio = 1 - F.levenshtein(la, lb) / longest
    both_short = (F.length(na) <= 30) & (F.length(nb) <= 30)
    words = F.when(shared >= 0.6, 0.55 + 0.35 * shared).otherwise(0.0)
    edits = F.when(both_short & (ratio >= 0.75), 0.85 * ratio).otherwise(0.0)
    ini = F.when((F.col("kind") == "Person") & (T.initials_match(na, nb) | T.initials_match(nb, na)), 0.75).otherwise(0.0)
    # a later rule is asked only while the confidence is below .7
    second = F.when(words >= 0.7, words).otherwise(F.greatest(words, edits))
    third = F.when(second >= 0.7, second).otherwise(F.greatest(second, ini))
    rule = F.when(contained, "contained").when(third == 0, None).when(third == words, "words").when(third == edits, "edits").otherwise("initials")
    return F.when(contained, 0.85).otherwise(third).alias("confidence"), rule.alias("rule")


def without_dismissed(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    return pairs.join(dismissed, ["id_a", "id_b"], "left_anti")


def merge_mentions(mentions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mentions with their entity replaced by mapping (old, new)."""
    return mentions.join(mapping.select(F.col("old").alias("entity_id"), "new"), "entity_id", "left").withColumn("entity_id", F.coalesce("new", "entity_id")).drop("new")


def merge_edges(relationships: DataFrame, mapping: DataFrame) -> DataFrame:
    """(entity_a_id, entity_b_id, weight, doc_count) after merging by mapping (old, new): weights summed, doc_count the largest, loops gone, ends in order."""
    a, b = mapping.toDF("entity_a_id", "new_a"), mapping.toDF("entity_b_id", "new_b")
    moved = relationships.join(a, "entity_a_id", "left").join(b, "entity_b_id", "left")
    moved = moved.select(F.coalesce("new_a", "entity_a_id").alias("x"), F.coalesce("new_b", "entity_b_id").alias("y"), "weight", "doc_count").where("x <> y")
    return moved.groupBy(F.least("x", "y").alias("entity_a_id"), F.greatest("x", "y").alias("entity_b_id")).agg(F.sum("weight").alias("weight"), F.max("doc_count").alias("doc_count"))


def drop_edges(relationships: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relationships without those of the merged rows: the other rule for merging by mapping (old, new), which doesn't sum."""
    gone = mapping.where("old <> new").select("old").distinct()
    return relationships.join(gone, relationships.entity_a_id == gone.old, "left_anti").join(gone, relationships.entity_b_id == gone.old, "left_anti")


def merge_entities(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entities after merging: the kept row's fields, aliases of both and the merged names, counts summed, the best confidence."""
    moved = entities.join(mapping.select(F.col("old").alias("id"), "new"), "id", "left").withColumn("keep", F.coalesce("new", "id"))
    group = moved.groupBy("keep").agg(
        F.max_by(F.struct("entity_type", "canonical_name"), (F.col("id") == F.col("keep")).cast("int")).alias("s"),
        F.flatten(F.collect_list(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("canonical_name")))).alias("names"),
        F.sum("mention_count").alias("mention_count"), F.max("confidence").alias("confidence"),
    )
    return group.select(F.col("keep").alias("id"), "s.entity_type", "s.canonical_name", F.array_remove(F.array_distinct(F.array_sort("names")), F.col("s.canonical_name")).alias("aliases"), "mention_count", "confidence")


def cross_type_merges(entities: DataFrame) -> DataFrame:
    """(old, new): rows of one name under several types go to the one of most confidence, then type rank, then mentions."""
    rank = F.lit(0)
    for kind, r in lists.TYPE_RANK.items():
        rank = F.when(F.col("entity_type") == kind, r).otherwise(rank)
    e = entities.select("id", F.col("canonical_name").alias("name"), F.struct(F.coalesce("confidence", F.lit(-1.0)), rank, F.coalesce("mention_count", F.lit(0)), "id").alias("worth"))
    best = e.groupBy("name").agg(F.max_by("id", "worth").alias("new"), F.count("*").alias("n")).where("n > 1")
    return e.join(best, "name").where("id <> new").select(F.col("id").alias("old"), "new")


def judge_merges(entities: DataFrame) -> DataFrame:
    """(old, new): ``Judge X`` where X is there as well."""
    titled = entities.where(F.startswith("canonical_name", F.lit("Judge "))).select(F.col("id").alias("old"), F.substring(F.col("canonical_name"), F.lit(7), F.length("canonical_name")).alias("name"))
    plain = entities.groupBy(F.col("canonical_name").alias("name")).agg(F.min("id").alias("new"))
    return titled.join(plain, "name").where("old <> new").select("old", "new")


def canonicalize(entities: DataFrame, mentions: DataFrame, relationships: DataFrame, junk: list[str] | None = None, explicit: list[tuple[str, str]] | None = None, types: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The passes in order: noise out, one row for each name, judges, the caller's merges and types. Returns entities, mentions, relationships."""
    e = entities.where(~T.canonical_noise(F.col("canonical_name"), F.col("entity_type"), junk))
    steps = [cross_type_merges, judge_merges]
    spark = entities.sparkSession
    for step in steps:
        mapping = cut(step(e))
        e, mentions, relationships = merge_entities(e, mapping), merge_mentions(mentions, mapping), merge_edges(relationships, mapping)
    if explicit:
        pairs = spark.createDataFrame(explicit, "keep string, kill string")
        byname = e.select("id", "canonical_name")
        mapping = cut(pairs.join(byname.toDF("new", "keep"), "keep").join(byname.toDF("old", "kill"), "kill").select("old", "new"))
        e, mentions, relationships = merge_entities(e, mapping), merge_mentions(mentions, mapping), merge_edges(relationships, mapping)
    if types:
        fixes = spark.createDataFrame(sorted(types.items()), "canonical_name string, right string")
        e = e.join(F.broadcast(fixes), "canonical_name", "left").withColumn("entity_type", F.coalesce("right", "entity_type")).drop("right")  # the caller's list
    kept = e.select("id")
    mentions = mentions.join(kept.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi")
    relationships = relationships.join(kept.withColumnRenamed("id", "entity_a_id"), "entity_a_id", "left_semi").join(kept.withColumnRenamed("id", "entity_b_id"), "entity_b_id", "left_semi")
    return {"entities": e, "mentions": mentions, "relationships": relationships}
