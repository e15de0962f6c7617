"""Problem 4: lines that return in document after document of one source.

Every line variant of a source has its documents as compressed bitmap containers of 2**15 documents each: the array of
positions while these are few, a bitmap where they are many. The containers of variants that differ only in case, spacing,
punctuation, digits and month names are united, in the form that their number calls for; exact cardinalities are held
against the thresholds, and lines are deleted by looking up their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketeer.runtime import cut, lookup_side

#: The months as written out in English.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
#: Documents per container; 2**15 bits, the size of Spark's own bitmaps.
SPAN = 32768
#: Positions from which on a container is a bitmap: as an array of two bytes each it would be as long as that.
DENSE = 2048


def line_key(line: Column) -> Column:
    """What must be equal for lines to count as the same: the letters (with their marks), without case and month names; '' if none is left."""
    bare = F.regexp_replace(F.lower(line), rf"(?<![\p{{L}}\p{{M}}])(?:{MONTHS})(?![\p{{L}}\p{{M}}])", "")
    return F.regexp_replace(bare, r"[^\p{L}\p{M}]+", "")


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, document_id, line_no, line) of the pages' final_text, blank lines included in the count but left out."""
    lines = pages.where("final_text is not null").select(F.col("id").alias("page_id"), "document_id", F.posexplode(F.split("final_text", "\n", -1)).alias("line_no", "line"))
    return lines.where(F.trim("line") != "")


def cardinalities(containers: DataFrame, dense: int = DENSE) -> DataFrame:
    """(source_tag, key, span, n): documents in the union of the variants' containers (source_tag, key, variant, span, docs).

    Unions of up to ``dense`` positions in all are made on arrays, so no more is ever gathered for one; larger ones on bitmaps, which are built
    position by position in each task and joined by their bits. A single variant needs no union.
    """
    by = ["source_tag", "key", "span"]
    sizes = containers.groupBy(*by).agg(F.count("*").alias("variants"), F.sum(F.size("docs")).alias("all"))
    alone = sizes.where("variants = 1").select(*by, F.col("all").cast("bigint").alias("n"))
    several = sizes.where("variants > 1")
    few = containers.join(several.where(F.col("all") <= dense).select(*by), by, "left_semi")
    arrays = few.groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("docs")).select(*by, F.size("docs").cast("bigint").alias("n"))
    many = containers.join(lookup_side(several.where(F.col("all") > dense).select(*by)), by, "left_semi")
    bits = many.select(*by, "variant", F.explode("docs").alias("at")).groupBy(*by, "variant").agg(F.bitmap_construct_agg(F.col("at").cast("bigint")).alias("bits"))
    bitmaps = bits.groupBy(*by).agg(F.bitmap_or_agg("bits").alias("bits")).select(*by, F.bitmap_count("bits").alias("n"))
    return alone.unionByName(arrays).unionByName(bitmaps)


def repeated_lines(pages: DataFrame, documents: DataFrame, min_docs: int = 3, min_share: float = 0.10, where: str = "not ocr_used") -> DataFrame:
    """(page_id, line_no, source_tag, n_docs, n_tag): lines found in at least ``min_docs`` documents and ``min_share`` of all documents of their tag.

    pages: id, document_id, final_text and the columns of ``where``; documents: id, source_tag. Pages whose document is unknown or has
    a null or empty source_tag, null texts and lines without letters give no rows; repeated pages count once; very long lines are keyed
    by digest; empty tables give no rows.
    """
    docs = documents.select(F.col("id").alias("document_id"), "source_tag").where("source_tag is not null and trim(source_tag) <> ''")
    sizes = docs.groupBy("source_tag").agg(F.count("*").alias("n_tag"))
    # one number for each document, to stand for it in bitmaps; partitions are numbered apart, so no document needs a window over its tag.
    # Written once, so that a task that is repeated finds the same numbers
    numbered = cut(docs.groupBy("document_id", "source_tag").agg(F.lit(1)).select("document_id", "source_tag", F.monotonically_increasing_id().alias("number")))
    keyed = page_lines(pages.where(where)).withColumn("key", line_key(F.col("line"))).where("key <> ''")
    keyed = keyed.select("page_id", "document_id", "line_no", F.unhex(F.md5("key")).alias("key"), F.xxhash64("line").alias("variant")).distinct()
    lines = cut(keyed.join(numbered, "document_id"))
    containers = (
        lines.groupBy("source_tag", "key", "variant", F.expr(f"number div {SPAN}").alias("span"))
        .agg(F.array_sort(F.collect_set(F.expr(f"cast(number % {SPAN} as smallint)"))).alias("docs"))
    )
    totals = cardinalities(cut(containers)).groupBy("source_tag", "key").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    excess = cut(totals.join(lookup_side(sizes), "source_tag").where(F.col("n_docs") >= F.lit(float(min_share)) * F.col("n_tag")))
    # a tag has at most (lines per document) / min_share such keys; the size is checked all the same
    return lines.join(lookup_side(excess), ["source_tag", "key"]).select("page_id", "line_no", "source_tag", "n_docs", "n_tag")


def without_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, clean_text): every page's final_text without the lines in ``found`` (page_id, line_no); null stays null."""
    marks = found.groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    texts = pages.select(F.col("id").alias("page_id"), "final_text").distinct()
    kept = F.expr("filter(transform(split(final_text, '\\n', -1), (x, i) -> if(array_contains(gone, i), null, x)), x -> x is not null)")
    return texts.join(marks, "page_id", "left").select("page_id", F.when(F.col("gone").isNull(), F.col("final_text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"))
