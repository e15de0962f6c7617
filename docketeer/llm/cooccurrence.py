"""Problem 3: how often two entities occur in the same document, against chance.

Stripes: every entity gets an associative array of the neighbours that follow it in its documents. Arrays are
merged inside each map task, then by key behind one shuffle, and scored by the log-likelihood ratio.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketeer.runtime import cut, map_arrow

#: A document's list is handed out in runs of this many stripe heads, so that one huge document spreads over many tasks.
HEADS = 256
#: Pairs held in one task's arrays before they are passed on; memory, not a cap on results.
HELD = 1_500_000
#: A stripe is split into this many ranges of its neighbours, so that a hub's array never has to fit in one piece.
BLOCKS = 8


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays merged within the task: (a, block, b's, counts)."""
    held: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    n = 0

    def out() -> Iterator[pa.RecordBatch]:
        a_s, blocks, b_s, c_s = [], [], [], []
        for a, stripe in held.items():
            split = defaultdict(list)
            for b, c in stripe.items():
                split[sum(b.encode()) % BLOCKS].append((b, c))
            for block, items in split.items():
                a_s.append(a)
                blocks.append(block)
                b_s.append([b for b, _ in items])
                c_s.append([c for _, c in items])
            if len(a_s) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(a_s, pa.string()), pa.array(blocks, pa.int32()), pa.array(b_s, pa.list_(pa.string())), pa.array(c_s, pa.list_(pa.int64()))], names=["a", "block", "bs", "cs"])
                a_s, blocks, b_s, c_s = [], [], [], []
        if a_s:
            yield pa.RecordBatch.from_arrays([pa.array(a_s, pa.string()), pa.array(blocks, pa.int32()), pa.array(b_s, pa.list_(pa.string())), pa.array(c_s, pa.list_(pa.int64()))], names=["a", "block", "bs", "cs"])

    for batch in batches:
        for items, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for i in range(first, min(first + HEADS, len(items))):
                stripe = held[items[i]]
                before = len(stripe)
                for b in items[i + 1 :]:
                    stripe[b] += 1
                n += len(stripe) - before
                if n > HELD:
                    yield from out()
                    held.clear()
                    n = 0
    yield from out()


def _merge(least: int):
    """Merge the arrays of one key, which come one after the other, and keep counts of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, {}
        rows: list[tuple[str, str, int]] = []

        def close() -> None:
            rows.extend((key[0], b, c) for b, c in total.items() if c >= least)

        def batch_of(rows: list) -> pa.RecordBatch:
            a, b, c = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], names=["a", "b", "n_ab"])

        for batch in batches:
            for a, block, bs, cs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (a, block) != key:
                    if key:
                        close()
                    key, total = (a, block), {}
                    if len(rows) > 20_000:
                        yield batch_of(rows)
                        rows = []
                for b, c in zip(bs, cs, strict=True):
                    total[b] = total.get(b, 0) + c
        if key:
            close()
        if rows:
            yield batch_of(rows)

    return run


def associations(mentions: DataFrame, min_docs: int = 5, min_lift: float = 3.0, item: str = "entity_id", group: str = "document_id") -> DataFrame:
    """Pairs (a < b) in at least ``min_docs`` common groups that occur ``min_lift`` times as often as by chance, or more.

    Columns: a, b, n_ab, n_a, n_b, n, lift, llr (signed: negative when rarer than chance).

    Items in fewer than ``min_docs`` groups, or in more than n / min_lift of them, can't be in such a pair
    (n_ab <= min(n_a, n_b)), so they leave before any pair is formed; that also removes the hub that holds a third
    of all rows. ``min_docs=1, min_lift=0`` counts every pair. Rows with a null item or group count nowhere, repeated rows count once,
    an empty table gives no rows.
    """
    seen = cut(mentions.select(F.col(item).alias("i"), F.col(group).alias("g")).where("i is not null and g is not null").distinct())
    n = seen.select("g").distinct().count()
    sizes = cut(seen.groupBy("i").agg(F.count("*").alias("n_i")))
    kept = sizes.where((F.col("n_i") >= min_docs) & (F.col("n_i") * F.lit(float(min_lift)) <= F.lit(n)))
    lists = seen.join(kept.select("i"), "i").groupBy("g").agg(F.sort_array(F.collect_list("i")).alias("items")).where(F.size("items") > 1)
    heads = lists.select("items", F.explode(F.sequence(F.lit(0), F.size("items") - 2, F.lit(HEADS))).alias("first"))
    stripes = map_arrow(heads, _stripes, "a string, block int, bs array<string>, cs array<bigint>")
    merged = map_arrow(stripes.repartition("a", "block").sortWithinPartitions("a", "block"), _merge(min_docs), "a string, b string, n_ab bigint")
    scored = (
        merged.join(kept.select(F.col("i").alias("a"), F.col("n_i").alias("n_a")), "a")
        .join(kept.select(F.col("i").alias("b"), F.col("n_i").alias("n_b")), "b")
        .withColumn("n", F.lit(n).cast("bigint"))
    )
    keep = F.col("n_ab") * F.col("n") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b")
    return scored.where(keep).select("a", "b", "n_ab", "n_a", "n_b", "n", (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"), llr().alias("llr"))


def llr():
    """Dunning's log-likelihood ratio of the 2x2 table of (n_ab, n_a, n_b, n), signed by direction."""
    k11, n_a, n_b, n = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n"))
    k12, k21 = n_a - k11, n_b - k11
    k22 = n - n_a - n_b + k11

    def cell(k, row, col):
        return F.when(k > 0, k * F.log(k * n / (row * col))).otherwise(F.lit(0.0))

    total = 2 * (cell(k11, n_a, n_b) + cell(k12, n_a, n - n_b) + cell(k21, n - n_a, n_b) + cell(k22, n - n_a, n - n_b))
    return F.when(k11 * n >= n_a * n_b, total).otherwise(-total)
