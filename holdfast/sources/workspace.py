"""Shared scratch space: where lineage is cut and where small derived tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a session whose tasks run in the driver's own process gets a temporary folder without the
    setting; everything else, ``local-cluster`` too, must name one that every executor can reach.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    fallback = tempfile.mkdtemp(prefix="holdfast-")
    spark.conf.set(SETTING, fallback)
    return fallback


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage; a lost executor re-reads, never re-derives."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder; none if there is no such folder."""
    fs, folder = _folder(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []


def make_folder(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.mkdirs(folder)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that the library wrote, with all it holds."""
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)


def spread(df: DataFrame, key: str, partitions: int | None) -> DataFrame:
    """Even out a table in few files before CPU-heavy row work, if the caller asks for it.

    Large tables have enough splits; shuffling them would only move the texts.
    """
    return df.repartition(partitions, key) if partitions and not evenly_split(df, partitions) else df


def evenly_split(df: DataFrame, partitions: int) -> bool:
    """Whether no split of a table holds more than twice its share of the rows for so many tasks.

    No column is read; over stored files the row counts come from their footers.
    """
    splits = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("rows"))
    found = splits.agg(F.max("rows").alias("most"), F.sum("rows").alias("all")).first()
    return found["all"] is None or found["most"] * partitions <= 2 * found["all"]


def written_keys(keys: DataFrame) -> DataFrame:
    """Keys written first: every use reads the same ones, and their size is known when the joins are planned."""
    path = fresh_dir(keys.sparkSession, "keys")
    keys.write.parquet(path)
    return keys.sparkSession.read.parquet(path)
