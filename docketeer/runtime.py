"""Session, table access and lineage control shared by every operator."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it is known or measured to have at most this many rows.
BROADCAST_ROWS = 200_000


def local_session(cores: int = 8, shuffle: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("DOCKETEER_DRIVER_MEMORY", "12g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application; nothing need be installed on them."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here, out = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="docketeer-code-")
    shutil.copytree(here, f"{out}/code/{here.name}", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{out}/{here.name}", "zip", f"{out}/code"))
    shutil.rmtree(f"{out}/code")
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow whose function may use this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise a plan in the reliable checkpoint folder and cut its lineage.

    The folder is the one named by ``spark.checkpoint.dir``; only where a local session names
    none (tests, a laptop) a temporary folder is set. On a cluster it must be named, as no machine's own folder is seen by all.
    """
    ship(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docketeer-"))
    return df.checkpoint(eager=True)


def lookup_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a join side for broadcast when its row count, measured unless given, is within BROADCAST_ROWS.

    ``df`` should be cut() before if it is costly. Beyond the bound it comes back unhinted, so that
    the join shuffles and AQE splits its skewed partitions.
    """
    if rows is None:
        rows = df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shuffled_side(df: DataFrame) -> DataFrame:
    """Mark a join by one side: neither side may pass through the driver, however small the optimiser takes it for.

    The estimate knows neither how many rows an explode makes nor how long texts are, so a table of any
    size can fall under spark.sql.autoBroadcastJoinThreshold. AQE still splits skewed partitions.
    """
    return df.hint("merge")


def empty_like(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)
