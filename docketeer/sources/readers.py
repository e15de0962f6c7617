"""Sources and sinks: files, uploads, text units, bundles."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketeer.functions import lists
from docketeer.functions import text as T


def scan_files(spark: SparkSession, path: str, max_bytes: int = 500 * 1024 * 1024) -> DataFrame:
    """(path, extension, sha256, size, status) of files: ``ok``, ``unsupported`` by extension, ``too_large`` or ``duplicate`` of an earlier path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = f.select("path", ext.alias("extension"), F.when(F.col("length") <= max_bytes, F.sha2("content", 256)).alias("sha256"), F.col("length").alias("size"))
    first = rows.groupBy("sha256").agg(F.min("path").alias("first"))
    status = F.when(~F.col("extension").isin(lists.SOURCE_EXTENSIONS), "unsupported").when(F.col("size") > max_bytes, "too_large").when(F.col("path") != F.col("first"), "duplicate").otherwise("ok")
    return rows.join(first, "sha256", "left").select("path", "extension", "sha256", "size", status.alias("status"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_number, text): text and Markdown files whole, as page 1."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,md}")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.lit(1).alias("page_number"), F.col("value").alias("text"))


def read_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]] | None = None, ocr: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, page_number, text) of PDF and image files by the caller's parsers; a file that none can read is one empty page."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(pdf|png|jpe?g|tiff?|bmp)$")).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, content in zip(batch["path"], batch["content"], strict=True):
                texts: list[str] = []
                for read in (parse if p.lower().endswith(".pdf") else None, ocr):
                    if read and not any(len(t.strip()) >= 40 for t in texts):
                        try:
                            texts = read(content) or texts
                        except Exception:  # noqa: BLE001 - an unreadable file is an empty page, as for a missing parser
                            continue
                out += [(p, i, t) for i, t in enumerate(texts or [""], 1)]
            yield pd.DataFrame(out, columns=["path", "page_number", "text"])

    return rows.mapInPandas(run, "path string, page_number int, text string")


def text_units(pages: DataFrame, documents: DataFrame, source_tag: str | None = None, min_chars: int = 50) -> DataFrame:
    """(document_id, page_number, source_tag, text): the first non-blank of final and scanned text of done documents, from ``min_chars`` on."""
    docs = documents.where("status = 'done'").select(F.col("id").alias("document_id"), "source_tag")
    if source_tag is not None:
        docs = docs.where(F.col("source_tag") == source_tag)
    text = F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in ("ocr_text", "final_text")])
    rows = pages.select("document_id", "page_number", text.alias("text")).distinct().where(F.length(F.trim("text")) > min_chars)
    return rows.join(docs, "document_id").select("document_id", "page_number", "source_tag", "text")


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of generated JSON files: id, text, entities, tags and what else they hold."""
    return spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


def dataset_metadata(documents: DataFrame) -> DataFrame:
    """(doc_type, documents, tags, first, last)."""
    return documents.groupBy("doc_type").agg(F.count("*").alias("documents"), F.count_distinct("source_tag").alias("tags"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def exportable_tags(documents: DataFrame) -> DataFrame:
    return documents.where("source_tag is not null and trim(source_tag) <> ''").groupBy("source_tag").agg(F.count("*").alias("documents"))


def bundle_parts(documents: DataFrame, claims: DataFrame, entities: DataFrame, source_tag: str) -> dict[str, DataFrame]:
    """What belongs to one tag: its documents, their claims, and the entities that speak or are spoken of."""
    docs = documents.where(F.col("source_tag") == source_tag)
    mine = claims.distinct().join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    named = mine.select(F.explode(F.array("speaker_entity_id", "subject_entity_id")).alias("id")).where("id is not null").distinct()
    return {"documents": docs, "claims": mine, "entities": entities.join(named, "id", "left_semi")}


def bundle_threads(parts: dict[str, DataFrame], threads: DataFrame, nodes: DataFrame, edges: DataFrame, contradictions: DataFrame, brokers: DataFrame) -> dict[str, DataFrame]:
    """The bundle's ``parts`` with what hangs on its claims: nodes (thread_id, claim_id) of its claims, their threads (thread_id), the edges (src, dst) and
    contradictions (claim_a, claim_b) between its claims, and the brokers (actor) among its entities."""
    ids = parts["claims"].select("id").distinct()
    mine = nodes.join(ids.withColumnRenamed("id", "claim_id"), "claim_id", "left_semi")
    return parts | {
        "nodes": mine, "threads": threads.join(mine.select("thread_id").distinct(), "thread_id", "left_semi"),
        "edges": edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"),
        "contradictions": contradictions.join(ids.withColumnRenamed("id", "claim_a"), "claim_a", "left_semi").join(ids.withColumnRenamed("id", "claim_b"), "claim_b", "left_semi"),
        "brokers": brokers.join(parts["entities"].select(F.col("id").alias("actor")), "actor", "left_semi"),
    }


def export_bundle(parts: dict[str, DataFrame], path: str, title: str = "", author: str = "", notes: str = "") -> str:
    """A zip of one JSON array for each part, with case.json, notes.json and a manifest; rows are streamed through the driver, never held."""
    counts = {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in parts.items():
            n = 0
            with z.open(f"{name}.json", "w") as f:
                f.write(b"[")
                for row in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator():
                    f.write((b"," if n else b"") + row[0].encode())
                    n += 1
                f.write(b"]")
            counts[name] = n
        z.writestr("case.json", json.dumps({"title": title, "author": author}))
        z.writestr("notes.json", json.dumps({"notes": notes}))
        z.writestr("manifest.json", json.dumps({"counts": counts}))
    return path


def import_bundle(spark: SparkSession, path: str, folder: str, salt: str, keys: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The parts of a bundle with fresh ids: every value of a key column becomes a hash of it and ``salt``, the same everywhere, so references hold.

    ``folder`` is a shared folder for the unpacked parts. ``keys`` names the key columns of each part.
    """
    keys = keys or {"documents": ["id"], "claims": ["id", "document_id", "speaker_entity_id", "subject_entity_id"], "entities": ["id"]}
    out = {}
    with zipfile.ZipFile(path) as z:
        if "case.json" not in z.namelist():
            raise ValueError("not a bundle: case.json is missing")
        for name in [n for n in z.namelist() if n.endswith(".json") and n not in ("case.json", "notes.json", "manifest.json")]:
            z.extract(name, folder)
            part = name[:-5]
            df = spark.read.option("multiLine", "true").json(f"file://{folder}/{name}" if folder.startswith("/") else f"{folder}/{name}")
            for k in keys.get(part, []):
                if k in df.columns:
                    df = df.withColumn(k, F.when(F.col(k).isNotNull(), F.substring(F.sha2(F.concat(F.lit(salt), F.col(k).cast("string")), 256), 1, 32)))
            out[part] = df
    return out


def briefing(entities: DataFrame, mentions: DataFrame, top: int = 20) -> DataFrame:
    """(entity_type, canonical_name, mentions, rank): the ``top`` of each type, for a written briefing."""
    from docketeer.operators.graph import rank_in

    counts = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("mentions"))
    named = entities.select("id", "entity_type", "canonical_name").join(counts, "id")
    return rank_in(named, ["entity_type"], [F.desc("mentions"), "id"], top).select("entity_type", "canonical_name", "mentions", "rank")


def storage_path(tag, name):
    """{tag}/{content id}{extension} with everything unsafe replaced."""
    return F.concat(T.sanitize_tag(F.coalesce(tag, F.lit("untagged"))), F.lit("/"), F.substring(F.sha2(name, 256), 1, 32), F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,8})$", 1)))
