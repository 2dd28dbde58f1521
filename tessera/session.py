"""Session and table helpers shared by every query."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session is the caller's."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


#: Tables of long texts, whose work is in their rows rather than in their bytes.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables.

    A table of texts in fewer splits than the session has cores (a file of one row group cannot be split) is dealt out
    evenly first; larger tables are read as they are, without a shuffle.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXT_TABLES and df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or one of our own where it is unset and all run here."""
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not place and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return f"{(place or tempfile.mkdtemp(prefix='tessera-')).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the folder of spark.checkpoint.dir; one of our own where it is unset and all run here."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not place and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint(eager=True)
