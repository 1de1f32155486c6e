"""The stored log table: parquet, one folder per UTC day, time-sorted files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import clock
from . import snapshots


def with_log_date(logs: DataFrame) -> DataFrame:
    return logs.withColumn("log_date", F.to_date("timestamp"))


def write_logs(logs: DataFrame, path: str, mode: str = "append", files_per_day: int | None = None) -> None:
    """Append to the day folders.

    Rows are dealt by day with a rebalance, which needs no sampling pass over the rows: AQE splits a busy
    day into as many tasks as its volume asks for and joins quiet ones. Files are sorted by time, so
    row-group statistics prune. ``files_per_day`` fixes the number of time ranges instead, at
    the price of a sampling pass.
    """
    dated = with_log_date(logs)
    keys = ["log_date", "timestamp"]
    spread = dated.repartitionByRange(files_per_day, *keys) if files_per_day else dated.hint("rebalance", F.col("log_date"))
    (
        spread.sortWithinPartitions(*keys)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.bloom.filter.enabled#fromhost_ip", "true")
        .partitionBy("log_date")
        .parquet(path)
    )


def add_piece(logs: DataFrame, path: str, kind: str) -> list[snapshots.Entry]:
    """Write rows as a piece of the table at ``path``; they count once the entries are committed."""
    piece = snapshots.new_piece(kind)
    write_logs(logs.drop("log_date"), snapshots.piece_path(path, piece), mode="overwrite")
    return snapshots.written(logs.sparkSession, path, piece)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed version, or plain day folders where nothing is ever committed."""
    return spark.read.parquet(path) if snapshots.current(spark, path) is None else snapshots.read(spark, path)


def day_bounds(columns: list[str], start: dt.datetime | str | None, end: dt.datetime | str | None) -> list[Column]:
    """Day-folder predicates implied by a timestamp range, so that folders are pruned."""
    if "log_date" not in columns:
        return []
    bounds = []
    if start is not None:
        bounds.append(F.col("log_date") >= F.lit(clock.as_datetime(start).date()))
    if end is not None:
        bounds.append(F.col("log_date") <= F.lit(clock.as_datetime(end).date()))
    return bounds


def spread(table: DataFrame, cores: int | None = None) -> DataFrame:
    """Use all cores on a table that is read as a few splits; larger tables are left as they are read.

    For per-row work that costs far more than moving the row once. Call it on the plain table,
    where counting the splits needs no more than the file listing.
    """
    wanted = cores or table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(wanted) if table.rdd.getNumPartitions() * 2 <= wanted else table
