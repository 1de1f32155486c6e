"""Tables by day as snapshots: folders of files that never change, and a versioned list of those that count.

Writers put their rows into a new piece (a folder of day folders) and then commit: a new version
of the list names the pieces of each day. A failure before the commit leaves a piece nobody
reads; readers of an older version keep seeing what they saw. Nothing is ever read and overwritten
in one go. The list has one row per day and piece and is handled on the driver.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import versions

LIST_SCHEMA = "log_date date, piece string, rows long, columns string"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Entry:
    """Rows of a day in a piece; ``columns`` is their schema."""

    log_date: dt.date | None
    piece: str
    rows: int
    columns: str


def _list_path(path: str) -> str:
    return f"{path}/_snapshots"


def piece_path(path: str, piece: str) -> str:
    return f"{path}/data/piece={piece}"


def current(spark: SparkSession, path: str) -> int | None:
    """The newest version, None if nothing has been committed."""
    known = versions.versions(spark, _list_path(path))
    return known[-1] if known else None


def entries(spark: SparkSession, path: str, version: int | None = None) -> list[Entry]:
    """What a version (the newest unless told) consists of."""
    version = current(spark, path) if version is None else version
    if version is None:
        return []
    rows = spark.read.schema(LIST_SCHEMA).parquet(f"{_list_path(path)}/v{version}").collect()
    return sorted((Entry(*r) for r in rows), key=lambda e: (str(e.log_date), e.piece))


def new_piece(kind: str) -> str:
    return f"{kind}-{uuid.uuid4().hex}"


def written(spark: SparkSession, path: str, piece: str) -> list[Entry]:
    """Entries of a piece that has just been written; none if it has no rows."""
    fs, where = versions.file_system(spark, piece_path(path, piece))
    if not fs.exists(where) or not any(s.getPath().getName().startswith("log_date=") for s in fs.listStatus(where)):
        return []
    rows = spark.read.parquet(piece_path(path, piece))
    columns = rows.drop("log_date").schema.json()
    days = rows.groupBy("log_date").agg(F.count("*").alias("n")).collect()  # one row per day, from file footers
    return [Entry(r["log_date"], piece, r["n"], columns) for r in days]


def commit(
    spark: SparkSession, path: str, add: Iterable[Entry] = (), drop: Callable[[Entry], bool] = lambda e: False, base: int | None = None
) -> int:
    """Make the next version: without the entries that ``drop`` picks, with those of ``add``.

    ``base`` is the version the change was derived from. If another writer has committed since,
    this fails and changes nothing.
    """
    now = current(spark, path)
    if base is not None and now != base:
        raise RuntimeError(f"version {now} of {path} has been committed since version {base}")
    kept = [e for e in entries(spark, path, now) if not drop(e)] if now is not None else []
    rows = [(e.log_date, e.piece, e.rows, e.columns) for e in [*kept, *add]]
    following = 0 if now is None else now + 1
    spark.createDataFrame(rows, LIST_SCHEMA).coalesce(1).write.mode("error").parquet(f"{_list_path(path)}/v{following}")
    return following


def read(spark: SparkSession, path: str, chosen: list[Entry] | None = None) -> DataFrame:
    """Rows of the newest version, or of ``chosen`` entries. Columns that a piece lacks are null."""
    found = entries(spark, path) if chosen is None else chosen
    fields: dict[str, T.StructField] = {}
    for columns in dict.fromkeys(e.columns for e in found):
        for field in T.StructType.fromJson(json.loads(columns)).fields:
            fields.setdefault(field.name, field)
    schema = T.StructType([*fields.values(), T.StructField("log_date", T.DateType())])
    if not found:
        return spark.createDataFrame([], schema)
    folders = [f"{piece_path(path, e.piece)}/log_date={e.log_date.isoformat() if e.log_date else NO_DAY}" for e in found]
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).select(*schema.names)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove pieces that none of the newest ``keep`` versions names, and older versions; returns the pieces.

    Not to be run beside a writer, as an uncommitted piece looks like one that is left over.
    """
    known = versions.versions(spark, _list_path(path))
    wanted = {e.piece for v in known[-keep:] for e in entries(spark, path, v)}
    fs, where = versions.file_system(spark, f"{path}/data")
    gone = []
    for status in fs.listStatus(where) if fs.exists(where) else []:
        name = status.getPath().getName().removeprefix("piece=")
        if name not in wanted:
            fs.delete(status.getPath(), True)
            gone.append(name)
    for version in known[:-keep]:
        fs, where = versions.file_system(spark, f"{_list_path(path)}/v{version}")
        fs.delete(where, True)
    return sorted(gone)
