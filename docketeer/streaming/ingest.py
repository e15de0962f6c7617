"""Incremental ingestion and windows over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def ingest(documents: DataFrame, out: str, checkpoint: str, process: Callable[[DataFrame], dict[str, DataFrame]], key: str = "document_id", once: bool = True) -> StreamingQuery:
    """Write each batch's derived tables under ``out``, by batch, so that a repeated batch overwrites itself.

    ``documents`` must have ``text``; contents seen before are dropped by their digest, within the watermark if the stream has one.
    ``current`` reads the tables with the last version of each document.
    """
    fresh = documents.withColumn("sha256", F.sha2("text", 256)).dropDuplicates(["sha256"])

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        for name, table in process(df).items():
            table.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        df.unpersist()

    writer = fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, out: str, name: str, key: str = "document_id") -> DataFrame:
    """The rows of each document's last batch."""
    rows = spark.read.parquet(f"{out}/{name}")
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"])


def windowed_counts(events: DataFrame, when: str, keys: list[str], size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by event-time window; on a stream, rows later than ``late`` are left out and state is bounded by it."""
    return events.withWatermark(when, late).groupBy(F.window(when, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
