"""Claims and narratives: contradictions, propagation, lineage, scores, and provenance of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketeer.functions import lists
from docketeer.functions import text as T
from docketeer.operators.graph import rank_in
from docketeer.runtime import cut, lookup_side, shuffled_side


def claim_propagation(claims: DataFrame, min_docs: int = 2) -> DataFrame:
    """Claims of one subject and type (nulls are a group too) that several documents carry; ``unchallenged`` if no denial is among them."""
    c = claims.distinct()
    out = c.groupBy("subject_entity_id", "claim_type").agg(
        F.count("*").alias("claims"), F.count_distinct("document_id").alias("documents"), F.count_distinct("speaker_entity_id").alias("speakers"),
        F.substring(F.min_by("claim_text", F.struct("created_at", "id")), 1, 200).alias("sample"), F.min((F.col("sentiment") != "negative").cast("int")).alias("calm"),
    )
    return out.where(F.col("documents") >= min_docs).select("subject_entity_id", "claim_type", "claims", "documents", "speakers", "sample", (F.coalesce("calm", F.lit(1)) == 1).alias("unchallenged"))


def claim_contradictions(claims: DataFrame) -> DataFrame:
    """(subject, claim_a, claim_b, reason): a subject's first three allegations against its first three denials, and two positive against two negative, of other documents."""
    c = claims.where("subject_entity_id is not null").select("id", "subject_entity_id", "document_id", "claim_type", "sentiment", "created_at").distinct()

    def first(cond: str, n: int, name: str) -> DataFrame:
        return rank_in(c.where(cond), ["subject_entity_id"], ["created_at", "id"], n).select("subject_entity_id", F.col("id").alias(name), F.col("document_id").alias(f"doc_{name}"))

    def against(x: DataFrame, y: DataFrame, reason: str) -> DataFrame:
        return x.join(y, "subject_entity_id").where("doc_claim_a <> doc_claim_b").select("subject_entity_id", "claim_a", "claim_b", F.lit(reason).alias("reason"))

    deny = against(first("claim_type = 'allegation'", 3, "claim_a"), first("claim_type = 'denial'", 3, "claim_b"), "allegation_denial")
    mood = against(first("sentiment = 'positive'", 2, "claim_a"), first("sentiment = 'negative'", 2, "claim_b"), "sentiment")
    return deny.unionByName(mood)


def mixed_sentiment(claims: DataFrame, least: float = 0.5) -> DataFrame:
    """Subjects with positive and negative claims of enough confidence."""
    c = claims.where((F.col("confidence") >= least) & F.col("subject_entity_id").isNotNull()).distinct()
    out = c.groupBy("subject_entity_id").agg(F.count_if(F.col("sentiment") == "positive").alias("positive"), F.count_if(F.col("sentiment") == "negative").alias("negative"), F.count_distinct("document_id").alias("documents"))
    return out.where("positive > 0 and negative > 0")


def narrative_contradictions(claims: DataFrame, evidence: DataFrame, similarity: bool = True) -> DataFrame:
    """(src, dst, score): claims of one subject and predicate that differ: polarity .6, object .35 (ratio under .35), date .25; from .6 on.

    A pair needs unlike polarity, or both other signs; only such pairs are compared.
    """
    spans = evidence.select(F.col("id").alias("evidence_span_id")).distinct()
    c = claims.join(spans, "evidence_span_id", "left_semi").select(
        "id", T.normalize(F.col("subject")).alias("s"), T.normalize(F.col("predicate")).alias("p"), T.normalize(F.col("object")).alias("o"), F.coalesce("polarity", F.lit("")).alias("pol"), "normalized_date"
    )
    c = cut(c.distinct())
    a, b = c.toDF("src", "s", "p", "oa", "pa", "da"), c.toDF("dst", "s", "p", "ob", "pb", "db")
    pairs = a.join(b, ["s", "p"]).where("src < dst and (pa <> pb or (oa <> '' and ob <> '' and oa <> ob and da <> db))")
    ratio = T.sequence_ratio(F.col("oa"), F.col("ob")) if similarity else T.jaccard(F.split("oa", " "), F.split("ob", " "))
    pairs = pairs.withColumn("sim", F.when((F.col("oa") != "") & (F.col("ob") != ""), ratio))
    score = F.when(F.col("pa") != F.col("pb"), 0.6).otherwise(0.0) + F.when(F.col("sim") < 0.35, 0.35).otherwise(0.0) + F.when((F.col("da") != "") & (F.col("db") != "") & (F.col("da") != F.col("db")), 0.25).otherwise(0.0)
    return pairs.select("src", "dst", F.least(F.lit(1.0), score).alias("score")).where("score >= 0.6")


def narrative_propagation(claims: DataFrame, evidence: DataFrame, window: int = 49) -> DataFrame:
    """(src, dst, edge_type, score): each claim against the ``window`` that follow it in order of document, page and id, of the same subject and predicate.

    The order is numbered by range partitions: each partition counts itself and adds the counts before it, so no task sees all rows.
    """
    spans = evidence.select(F.col("id").alias("evidence_span_id"), "document_id", "page_number", F.col("text").alias("evidence"))
    c = claims.join(spans, "evidence_span_id").select("id", "document_id", "page_number", "evidence", T.normalize(F.col("subject")).alias("s"), T.normalize(F.col("predicate")).alias("p"), T.normalize(F.col("object")).alias("o"), T.normalize(F.coalesce("speaker", "subject")).alias("who"), T.normalize(F.col("speaker")).alias("spk"))
    rows = numbered(c, ["document_id", "page_number", "id"])
    a = rows.select(F.col("id").alias("src"), "s", "p", F.col("o").alias("oa"), F.col("document_id").alias("da"), F.col("who").alias("wa"), F.col("n").alias("na"), F.explode(F.array(F.floor(F.col("n") / window), F.floor(F.col("n") / window) + 1)).alias("bin"))
    b = rows.select(F.col("id").alias("dst"), "s", "p", F.col("o").alias("ob"), F.col("document_id").alias("db"), F.col("spk").alias("sb"), F.col("n").alias("nb"), F.floor(F.col("n") / window).alias("bin"), T.normalize(F.col("evidence")).alias("ev"))
    pairs = a.join(b, ["bin", "s", "p"]).where(F.col("nb").between(F.col("na") + 1, F.col("na") + window)).withColumn("sim", T.sequence_ratio(F.col("oa"), F.col("ob")))
    cue = F.col("ev").rlike("|".join(lists.ATTRIBUTION_CUES))
    kind = F.when((F.col("sim") >= 0.9) & (F.col("da") != F.col("db")), "REPEATS").when(cue & (F.col("sim") >= 0.55) & (F.col("wa") == F.col("sb")), "DERIVES_FROM").when((F.col("sim") >= 0.72) & (F.col("da") != F.col("db")), "SUPPORTS")
    return pairs.select("src", "dst", kind.alias("edge_type"), F.col("sim").alias("score")).where("edge_type is not null")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with n = 0, 1, ... in order, without gathering the rows in one task."""
    parted = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id()))
    sizes = parted.groupBy("part").agg(F.count("*").alias("c"), F.min("k").alias("first")).orderBy("part").collect()  # one row for each partition
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r["part"], total - r["first"]))
        total += r["c"]
    spark = df.sparkSession
    table = spark.createDataFrame(offsets or [(0, 0)], "part int, shift bigint")
    return parted.join(F.broadcast(table), "part").withColumn("n", F.col("k") + F.col("shift")).drop("part", "k", "shift")


def claim_lineage(claims: DataFrame, least: float = 0.8) -> DataFrame:
    """(src, dst, relation, score): claims whose texts share word shingles to ``least`` and then agree as sequences: repeats from .93 in other documents, supports from .82 of the same type on another page.

    Equal texts are one class: the text's first claim stands for it and the others are tied to it. Classes meet by the rarest of their
    five-word shingles (a prefix filter, which loses no pair at this similarity). No side of a join is broadcast.
    """
    c = cut(claims.where("claim_text is not null").select("id", "document_id", "page_number", "claim_type", T.normalize_claim(T.clean_claim_text(F.col("claim_text"))).alias("t")).where("length(t) >= 20").distinct())
    heads = cut(c.groupBy("t").agg(F.min("id").alias("head")))
    copies = c.join(shuffled_side(heads), "t").where("id <> head").select(F.col("head").alias("src"), F.col("id").alias("dst"))
    words = heads.select("head", F.split("t", " ").alias("w"))
    shingles = words.select("head", F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 5), " ")))).alias("sh"))
    flat = shingles.select("head", F.size("sh").alias("n"), F.explode("sh").alias("g"))
    df = flat.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    ranked = flat.join(shuffled_side(df), "g").groupBy("head", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("r"))
    # shingles found once can't be shared; they fill the prefix first
    prefix = F.floor((1 - least) * F.col("n")) + 1 - (F.col("n") - F.size("r"))
    keys = ranked.where(prefix > 0).select("head", "n", F.explode(F.slice("r", F.lit(1), prefix.cast("int"))).alias("e")).select("head", "n", "e.g")
    pairs = keys.alias("a").join(shuffled_side(keys.alias("b")), "g").where(f"a.head < b.head and a.n >= {least} * b.n and b.n >= {least} * a.n").select(F.col("a.head").alias("x"), F.col("b.head").alias("y")).distinct()
    sh = shingles.select("head", "sh")
    inter = F.size(F.array_intersect("sx", "sy"))
    near = pairs.join(shuffled_side(sh.toDF("x", "sx")), "x").join(shuffled_side(sh.toDF("y", "sy")), "y").where(inter >= least * (F.size("sx") + F.size("sy") - inter)).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    both = near.unionByName(copies)
    side = c.select("id", "document_id", "page_number", "claim_type", "t")
    full = both.join(shuffled_side(side.toDF("src", "da", "pa", "ka", "ta")), "src").join(shuffled_side(side.toDF("dst", "db", "pb", "kb", "tb")), "dst")
    full = full.withColumn("sim", F.when(F.col("ta") == F.col("tb"), 1.0).otherwise(T.sequence_ratio(F.col("ta"), F.col("tb"))))
    other, elsewhere = F.col("da") != F.col("db"), (F.col("da") != F.col("db")) | (F.col("pa") != F.col("pb"))
    kind = F.when((F.col("sim") >= 0.93) & other, "repeats").when((F.col("sim") >= 0.82) & elsewhere & F.col("ka").eqNullSafe(F.col("kb")), "supports")
    return full.select("src", "dst", kind.alias("relation"), F.round("sim", 6).alias("score")).where("relation is not null").distinct()


def claim_entity_links(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """(claim_id, entity_id, score): entities whose normalised name, of four characters or more, stands in a claim's text.

    Names are met through their first word, which every claim holding the name must have.
    """
    e = entities.where(F.col("entity_type").isin("Person", "Organization", "Location")).select(F.col("id").alias("entity_id"), "entity_type", T.normalize_claim(F.col("canonical_name")).alias("name")).where("length(name) >= 4")
    e = e.withColumn("first", F.split("name", " ")[0])
    c = claims.where("claim_text is not null").select(F.col("id").alias("claim_id"), T.normalize_claim(F.col("claim_text")).alias("t")).distinct()
    # a name may begin inside a word; its first word then is the end of that word, so ends are offered too
    words = c.select("claim_id", "t", F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    keys = words.select("claim_id", "t", F.explode(F.array_distinct(F.concat(F.array("w"), F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(F.col("w"), i, F.length("w"))), F.array(F.regexp_replace("w", r"[:/._,\-]+$", ""))))).alias("first")).where("first <> ''")
    whole = keys.join(e, "first").where(F.contains("t", F.col("name")))
    # one-word names may also end inside a word
    return whole.select("claim_id", "entity_id", F.when(F.col("entity_type") == "Person", 1.0).otherwise(0.8).alias("score")).distinct()


def temporal_anomalies(events: DataFrame) -> DataFrame:
    """(actor, date, id_a, id_b): the same actor on one day at two places; events: id, actor, date, place."""
    e = events.where("actor is not null and date is not null and trim(place) <> ''").select("id", T.normalize(F.col("actor")).alias("actor"), "date", T.normalize(F.col("place")).alias("place")).where("place <> '' and actor <> ''")
    a, b = e.toDF("id_a", "actor", "date", "pa"), e.toDF("id_b", "actor", "date", "pb")
    return a.join(b, ["actor", "date"]).where("id_a < id_b and pa <> pb").select("actor", "date", "id_a", "id_b")


def event_support(event_map: DataFrame) -> DataFrame:
    """(event_id, supports, contradictions, confidence): s / (s + c + 1)."""
    out = event_map.groupBy("event_id").agg(F.count_if(F.coalesce("role", F.lit("")) != "contradiction").alias("supports"), F.count_if(F.col("role") == "contradiction").alias("contradictions"))
    return out.withColumn("confidence", F.col("supports") / (F.col("supports") + F.col("contradictions") + 1))


def canonical_events(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(event_key, claims, first_claim, event_type, documents): claims with the same normalised subject, predicate, object and date are one event."""
    doc = evidence.select(F.col("id").alias("evidence_span_id"), "document_id")
    c = claims.join(doc, "evidence_span_id", "left").withColumn("event_key", T.event_key(F.col("subject"), F.col("predicate"), F.col("object"), F.col("normalized_date")))
    out = c.groupBy("event_key").agg(F.count("*").alias("claims"), F.min("id").alias("first_claim"), F.min_by(T.event_type(F.col("predicate"), F.col("claim_type")), "id").alias("event_type"), F.count_distinct("document_id").alias("documents"))
    return out


def entity_scores(claims: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(entity, influence, witness, contradictions) of the claims' subjects over edges (src, dst, edge_type, score): a fixed number of rounds, nothing for dangling mass."""
    c = claims.where("trim(subject) <> ''").select("id", F.trim("subject").alias("entity"), "speaker")
    names = cut(c.select("entity").distinct())
    n = max(names.count(), 1)
    ends = edges.join(c.select(F.col("id").alias("src"), F.col("entity").alias("x")), "src").join(c.select(F.col("id").alias("dst"), F.col("entity").alias("y")), "dst")
    w = F.greatest(F.lit(0.001), F.coalesce("score", F.lit(0.0)))
    flow = ends.select("x", "y", w.alias("w"), "edge_type", F.coalesce("score", F.lit(0.0)).alias("score"))
    total = flow.groupBy("x").agg(F.sum("w").alias("all"))
    links = cut(flow.groupBy("x", "y").agg(F.sum("w").alias("w")).join(total, "x").select("x", "y", (F.col("w") / F.col("all")).alias("p")))
    scores = names.withColumn("influence", F.lit(1.0 / n))
    for k in range(rounds):
        got = links.join(scores, links.x == scores.entity).groupBy(F.col("y").alias("entity")).agg(F.sum(F.col("p") * F.col("influence")).alias("in"))
        scores = names.join(got, "entity", "left").select("entity", (F.lit((1 - damping) / n) + damping * F.coalesce("in", F.lit(0.0))).alias("influence"))
        if k % 5 == 4:
            scores = cut(scores)
    said = c.where("speaker is not null and speaker <> ''").groupBy("entity").agg((F.count("*") * 0.2).alias("said"))
    gain = F.when(F.col("edge_type") == "DERIVES_FROM", F.col("score")).when(F.col("edge_type") == "REPEATS", 0.6 * F.col("score")).otherwise(0.0)
    heard = flow.groupBy(F.col("x").alias("entity")).agg(F.sum(gain).alias("heard"))
    against = flow.where("edge_type = 'CONTRADICTS'").select(F.explode(F.array("x", "y")).alias("entity")).groupBy("entity").agg(F.count("*").alias("contradictions"))
    out = scores.join(said, "entity", "left").join(heard, "entity", "left").join(against, "entity", "left")
    return out.select("entity", "influence", (F.coalesce("said", F.lit(0.0)) + F.coalesce("heard", F.lit(0.0))).alias("witness"), F.coalesce("contradictions", F.lit(0)).alias("contradictions"))


def brokers(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """(actor, incoming, outgoing, broker_type): by how claims pass through their speakers; edges: src, dst."""
    who = claims.where("speaker_entity_id is not null").select("id", F.col("speaker_entity_id").alias("actor")).distinct()
    out = edges.join(who.toDF("src", "actor"), "src").groupBy("actor").agg(F.count("*").alias("outgoing"))
    inc = edges.join(who.toDF("dst", "actor"), "dst").groupBy("actor").agg(F.count("*").alias("incoming"))
    both = out.join(inc, "actor", "full").fillna(0, ["outgoing", "incoming"])
    kind = (
        F.when((F.col("outgoing") > 2 * F.col("incoming")) & (F.col("incoming") > 0) & (F.col("outgoing") >= 3), "amplifier").when((F.col("incoming") == 0) & (F.col("outgoing") >= 2), "originator")
        .when((F.col("incoming") >= 3) & (F.col("outgoing") == 0), "suppressor").otherwise("relay")
    )
    return both.withColumn("broker_type", kind)


def classify_contradictions(pairs: DataFrame) -> DataFrame:
    """(a, b, contradiction_type, severity) of pairs (a, b, sim, actor_a, actor_b, doc_a, doc_b, date_a, date_b, negation_differs), by the first rule that holds."""
    same, s = F.col("actor_a") == F.col("actor_b"), F.col("sim")
    gap = F.abs(F.datediff("date_a", "date_b"))
    known = F.col("actor_a").isNotNull() & F.col("actor_b").isNotNull()
    kind = (
        F.when(known & same & (gap > 365) & (s > 0.70), "temporal").when(known & ~same & (s > 0.78), "identity").when(known & same & (s > 0.72) & F.col("negation_differs"), "factual")
        .when(known & ~same & (s > 0.68) & (F.col("doc_a") != F.col("doc_b")), "presence")
    )
    severity = F.when(kind == "temporal", F.least(F.lit(0.95), 0.5 + 0.5 * s)).when(kind == "presence", 0.8 * s).otherwise(s)
    return pairs.select("a", "b", kind.alias("contradiction_type"), severity.alias("severity")).where("contradiction_type is not null")


def negation_words(text):
    return F.array_intersect(F.split(T.normalize(text), " "), F.array(*[F.lit(w) for w in lists.NEGATIONS]))


def leader_clusters(vectors: DataFrame, least: float = 0.62) -> DataFrame:
    """(id, leader): in order of id, a vector joins the first earlier leader whose cosine is ``least`` or more, else it leads.

    Rounds instead of one pass: in each, a vector without any earlier open neighbour leads and takes its open neighbours; which gives
    the same clusters. All similar pairs of the vectors (id, vector) are held as a table.
    """
    pairs = cut(similar_pairs(vectors, least))
    state = cut(vectors.select("id").distinct().withColumn("leader", F.lit(None).cast(vectors.schema["id"].dataType)))
    while not (open_ := state.where("leader is null").select("id")).isEmpty():
        # the first open vector always leads, so every round closes some
        live = pairs.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").join(open_.withColumnRenamed("id", "b"), "b", "left_semi")
        held = live.select(F.col("b").alias("id")).distinct()
        lead = open_.join(held, "id", "left_anti")
        take = live.join(lead.withColumnRenamed("id", "a"), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("new"))
        new = take.unionByName(lead.select("id", F.col("id").alias("new")))
        state = cut(state.join(new, "id", "left").select("id", F.coalesce("leader", "new").alias("leader")))
    return state


def similar_pairs(vectors: DataFrame, least: float, block: int = 2_000) -> DataFrame:
    """(a, b, sim), a < b: all pairs of cosine ``least`` or more. Blocks of about ``block`` vectors meet two by two as matrix products, each in a task of its own;
    nothing passes through the driver. Every vector is sent to as many tasks as there are blocks. Null vectors leave."""
    import numpy as np
    import pandas as pd

    rows = vectors.where("id is not null and vector is not null").select("id", "vector").distinct()
    kind = vectors.schema["id"].dataType.simpleString()
    n = max(1, -(-rows.count() // block))
    placed = rows.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    left = placed.select("id", "vector", F.col("k").alias("i"), F.explode(F.sequence(F.col("k"), F.lit(n - 1))).alias("j"))
    right = placed.select("id", "vector", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"), F.col("k").alias("j"))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        p, q = (np.stack(z["vector"].to_numpy()).astype(float) for z in (x, y))
        p, q = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (p, q))
        s = p @ q.T
        i, j = np.nonzero(s >= least)
        a, b = x["id"].to_numpy()[i], y["id"].to_numpy()[j]
        same = x["i"].iloc[0] == x["j"].iloc[0]
        keep = a < b if same else a != b
        a, b, s = a[keep], b[keep], s[i, j][keep]
        return pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "sim": s})

    tasks = min(4096, n * (n + 1) // 2 + 1)
    return left.repartition(tasks, "i", "j").groupBy("i", "j").cogroup(right.repartition(tasks, "i", "j").groupBy("i", "j")).applyInPandas(meet, f"a {kind}, b {kind}, sim double")


def threads(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """(leader, nodes, coherence): clusters of two or more with the mean cosine of their members to the centroid."""
    from docketeer.functions.vectors import centroid, cosine

    member = vectors.join(clusters, "id")
    size = member.groupBy("leader").agg(F.count("*").alias("nodes")).where("nodes > 1")
    mid = centroid(member.join(size.select("leader"), "leader", "left_semi"), ["leader"], "vector").withColumnRenamed("vector", "mid")
    fit = member.join(mid, "leader").groupBy("leader").agg(F.avg(cosine(F.col("vector"), F.col("mid"))).alias("coherence"))
    return size.join(fit, "leader")


def thread_dag(vectors: DataFrame, clusters: DataFrame, least: float = 0.65) -> DataFrame:
    """(leader, parent, child, depth, mutation): within each cluster, breadth first from the leader; a child comes after its parent, and its first parent in order wins; mutation is 1 minus the cosine to the leader."""
    from docketeer.functions.vectors import cosine

    member = vectors.join(clusters, "id")
    size = member.groupBy("leader").agg(F.count("*").alias("k")).where("k > 1").select("leader")
    member = cut(member.join(lookup_side(size), "leader", "left_semi"))
    links = cut(cut(similar_pairs(vectors, least)).join(member.select(F.col("id").alias("a"), "leader"), "a").join(member.select(F.col("id").alias("b"), F.col("leader").alias("l2")), "b").where("leader = l2").select("leader", "a", "b"))
    seen = member.select("leader", F.col("leader").alias("id")).distinct()
    frontier, found, depth = seen, None, 0
    while True:
        depth += 1
        step = links.join(frontier.withColumnRenamed("id", "a"), ["leader", "a"]).join(seen.withColumnRenamed("id", "b"), ["leader", "b"], "left_anti")
        step = cut(step.groupBy("leader", "b").agg(F.min("a").alias("parent")).select("leader", "parent", F.col("b").alias("child"), F.lit(depth).alias("depth")))
        if step.isEmpty():
            break
        found = step if found is None else found.unionByName(step)
        frontier = step.select("leader", F.col("child").alias("id"))
        seen = cut(seen.unionByName(frontier))
    if found is None:
        kind = vectors.schema["id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"leader {kind}, parent {kind}, child {kind}, depth int, mutation double")
    v = vectors.select("id", "vector")
    full = found.join(v.toDF("leader", "lv"), "leader").join(v.toDF("child", "cv"), "child")
    return full.select("leader", "parent", "child", "depth", (1 - cosine(F.col("lv"), F.col("cv"))).alias("mutation"))
