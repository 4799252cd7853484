"""Path checks and small control files through Spark's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    return [p for p in paths if exists(spark, p)]
