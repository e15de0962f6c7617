"""Full-text, vector and hybrid search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketeer.functions import text as T
from docketeer.runtime import ship

#: Rows of the query block that a task holds at once; a search with more queries takes more passes.
QUERY_ROWS = 20_000


def terms(text: Column, stem: bool = False) -> Column:
    return T.stems(text) if stem else F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def postings(pages: DataFrame, key: str = "id", text: str = "final_text", stem: bool = False) -> DataFrame:
    """(id, term, tf, length, first): how often and where first a page has a term. Null texts give none."""
    words = pages.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), text).distinct().select("id", terms(F.col(text), stem).alias("w"))
    flat = words.select("id", F.size("w").alias("length"), F.posexplode("w").alias("at", "term"))
    return flat.groupBy("id", "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"), F.min("at").alias("first"))


def bm25(pages: DataFrame, query: str, key: str = "id", text: str = "final_text", stem: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): pages with any of the query's words, by BM25. Pages are scanned for these words only; nothing else is exploded."""
    asked = sorted({T.porter_stem(w) if stem else w for w in _words(query)})
    # a page is one id: repeated deliveries count once
    rows = pages.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), text).distinct().select("id", terms(F.col(text), stem).alias("w"))
    tf = [F.size(F.filter("w", _equals(t))).alias(f"t{i}") for i, t in enumerate(asked)]
    counted = rows.select("id", F.size("w").alias("length"), *tf)
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.sum((F.col(f"t{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(asked))])
    both = counted.where(" or ".join(f"t{i} > 0" for i in range(len(asked))) or "false").crossJoin(F.broadcast(stats))  # a one-row side
    score = F.lit(0.0)
    for i in range(len(asked)):
        tf_i, d = F.col(f"t{i}"), F.col(f"d{i}")
        idf = F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
        score = score + idf * tf_i * (k1 + 1) / (tf_i + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return both.select("id", score.alias("score"))


def _equals(term: str):
    return lambda x: x == F.lit(term)


def _words(query: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", query.lower())


def phrase_search(pages: DataFrame, phrase: str, key: str = "id", text: str = "final_text", stem: bool = True) -> DataFrame:
    """(id, hits): pages in which the phrase's words stand one behind the other."""
    ship(pages.sparkSession)
    asked = [T.porter_stem(w) if stem else w for w in _words(phrase)]
    if not asked:
        return pages.limit(0).select(F.col(key).alias("id"), F.lit(0).alias("hits"))
    pattern = " " + " ".join(asked) + " "
    joined = F.concat(F.lit(" "), F.array_join(terms(F.col(text), stem), "  "), F.lit(" "))
    spaced = pattern.replace(" ", "  ")[1:-1]
    rows = pages.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), text).distinct().select("id", joined.alias("j"))
    # words are parted by two blanks, so that hits that touch don't share one
    return rows.select("id", ((F.length("j") - F.length(F.replace("j", F.lit(spaced), F.lit("")))) / len(spaced)).cast("int").alias("hits")).where("hits > 0")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """(query_id, id, score, rank): the ``k`` most similar vectors to each query vector, the query's own id left out.

    Query blocks of bounded size go to every task and meet all vectors as one matrix product; each task keeps its best ``k``.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERY_ROWS))
    best = None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == block) if blocks > 1 else queries
        rows = part.select(id_col, vector).orderBy(id_col).collect()  # bounded by QUERY_ROWS, as told
        ids = [r[0] for r in rows]
        q = np.array([r[1] for r in rows], float).reshape(len(rows), -1)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            held = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0, object)
            for batch in batches:
                if not len(batch) or not len(ids):
                    continue
                m = np.stack(batch["v"].to_numpy()).astype(float)
                scores = q @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)).T
                names = np.broadcast_to(batch["i"].to_numpy(dtype=object), scores.shape)
                scores = np.where(names == np.array(ids, object)[:, None], -np.inf, scores)
                s, i = np.hstack([held[0], scores]), np.hstack([held[1], names])
                top = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
                held = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
            out = [(a, b, float(s)) for a, bs, ss in zip(ids, held[1], held[0], strict=True) for b, s in zip(bs, ss, strict=True) if np.isfinite(s)]
            yield pd.DataFrame(out, columns=["query_id", "id", "score"])

        kind = vectors.schema[id_col].dataType.simpleString()
        found = vectors.select(F.col(id_col).alias("i"), F.col(vector).alias("v")).mapInPandas(run, f"query_id {kind}, id {kind}, score double")
        best = found if best is None else best.unionByName(found)
    from docketeer.operators.graph import rank_in

    return rank_in(best, ["query_id"], [F.desc(F.round("score", 9)), "id"], k)


def hybrid(semantic: DataFrame, keyword: DataFrame, boost: DataFrame, weights: tuple[float, float, float] = (0.6, 0.3, 0.1), k: int = 20) -> DataFrame:
    """(id, score, signals): two ranked sets (id, score) joined in full, each by its best score, with a boost (id, boost); the weights are brought to sum 1."""
    total = sum(weights) or 1.0
    w = [x / total for x in weights]

    def scaled(df: DataFrame, name: str) -> DataFrame:
        top = df.agg(F.max("score").alias("top"))
        return df.groupBy("id").agg(F.max("score").alias("score")).crossJoin(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias(name))  # a one-row side

    out = scaled(semantic, "s").join(scaled(keyword, "k"), "id", "full").join(boost.select("id", "boost"), "id", "left")
    signals = F.concat_ws("+", F.when(F.col("s").isNotNull(), "semantic"), F.when(F.col("k").isNotNull(), "keyword"), F.when(F.col("boost") > 0, "graph"))
    score = w[0] * F.coalesce("s", F.lit(0.0)) + w[1] * F.coalesce("k", F.lit(0.0)) + w[2] * F.coalesce("boost", F.lit(0.0))
    return out.select("id", score.alias("score"), signals.alias("signals")).orderBy(F.desc("score"), "id").limit(k)


def graph_boost(mentions: DataFrame, centrality: DataFrame) -> DataFrame:
    """(document_id, page_number, boost): the largest centrality among a page's entities."""
    c = centrality.select(F.col("id").alias("entity_id"), "centrality")
    return mentions.join(c, "entity_id").groupBy("document_id", "page_number").agg(F.max("centrality").alias("boost"))
