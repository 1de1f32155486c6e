"""Small tables without in-place update: every write is a new numbered folder, readers take the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system that serves ``path`` and the path as it knows it."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        return []
    found = []
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit():
            done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if fs.exists(done):
                found.append(int(name[1:]))
    return sorted(found)


def write(table: DataFrame, path: str, version: int | None = None) -> int:
    """Write the next version (or exactly ``version``, so that a retried batch overwrites itself)."""
    if version is None:
        known = versions(table.sparkSession, path)
        version = known[-1] + 1 if known else 0
    table.write.mode("overwrite").parquet(f"{path}/v{version}")
    return version


def read(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version (older than ``before``), None when there is none."""
    known = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/v{known[-1]}") if known else None
