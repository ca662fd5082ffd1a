"""Parquet table scans and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder (any Hadoop path)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores, dealt to all of them before costly expressions; other scans as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slices(batches, rows: int = 64):
    """Arrow batches a few rows at a time, so that only those become Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='textorium-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """The rows of df as a Parquet table in the shared folder, so that later reads don't depend on any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/textorium/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.parquet(path)


def released(df: DataFrame) -> None:
    """Empties a table that `written` returned, once nothing reads it any more: its files give way to an empty table."""
    if files := df.inputFiles():
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])
