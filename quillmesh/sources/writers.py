"""Sinks: compressed text, partitioned experiments, and the skip-if-present test of sweeps."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv_gz(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("compression", "gzip").csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Parquet by relation, so that a subset of relations is a subset of folders."""
    edges.write.mode("overwrite").partitionBy("relation").parquet(path)


def write_experiment(results: DataFrame, metrics: DataFrame, root: str, experiment: str) -> None:
    """Results and metrics of one experiment, each in its partition of a shared table."""
    for name, df in (("results", results), ("metrics", metrics)):
        df.withColumn("experiment", F.lit(experiment)).write.mode("append").partitionBy("experiment").parquet(f"{root}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished output is there, in any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) or (fs.exists(p) and fs.getFileStatus(p).isFile()))


def cached_name(path: str, spark: SparkSession) -> str:
    """A name for what is derived from text files that changes with their content: counts and sums of their lines' hashes, whatever the files' sizes."""
    lines = spark.read.text(path)
    row = lines.agg(F.count(F.lit(1)), F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), "value").cast("decimal(38,0)"))).first()
    return hashlib.md5("|".join(map(str, row)).encode()).hexdigest()[:10]
