"""The folder that the driver and all executors see: lineage cuts and intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "/tmp/checkpoints/quillmesh"
_written: list[str] = []


def folder(spark: SparkSession) -> str:
    """That of spark.checkpoint.dir, or one set by the caller; in a local session without either, as in tests, LOCAL; else ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return LOCAL
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark))
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _written.append(file.get())
    return out


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{folder(spark)}/{uuid.uuid4().hex}-{name}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again."""
    path = new_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes what cut(), written() and new_path() made in this process; call it when results are stored. How many there were."""
    jvm, n = spark.sparkContext._jvm, len(_written)
    while _written:
        p = jvm.org.apache.hadoop.fs.Path(_written.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return n
