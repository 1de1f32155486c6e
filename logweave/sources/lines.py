"""Newline-framed text, as a table or as a stream."""

from __future__ import annotations

import re
import urllib.parse
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

COMPRESSED = ("gz", "bz2", "zst", "lz4", "snappy", "deflate")
BLOCK = 1 << 16
FILES_PER_TASK = 1000
MAX_BROADCAST_TAILS = 100_000
_TAILS = "_file string, _size long, _sum long"
# Names by which Arrow's file systems know a scheme, where they know it.
_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}


def read_lines(spark: SparkSession, path: str, whole_lines: bool = True) -> DataFrame:
    """Non-empty lines of text files, parted by LF alone. Large files are split across tasks.

    A last line without its LF is still being written: it is left out, and read once it is
    whole. ``whole_lines=False`` takes it as it is.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    tails = _open_tails(spark, text, text.inputFiles()) if whole_lines else []
    if not tails:
        return _framed(text)
    # Only files with an open tail are looked at by name; of equal lines the last one is the tail.
    named = text.withColumns({"_file": F.regexp_replace("_metadata.file_path", "^file:/+", "file:/"), "_size": F.octet_length("value")})
    opened = spark.createDataFrame(tails, _TAILS)
    few = F.broadcast if len(tails) <= MAX_BROADCAST_TAILS else lambda df: df
    placed = named.withColumn("_at", F.monotonically_increasing_id()).join(few(opened), ["_file", "_size"], "left")
    suspect = F.col("_sum").isNotNull() & (F.crc32(F.col("value").cast("binary")) == F.col("_sum"))
    last = F.row_number().over(Window.partitionBy("_file").orderBy(F.desc("_at")))
    tail = placed.filter(suspect).withColumn("_n", last).filter("_n = 1").select("_file", "_at")
    return _framed(placed.join(few(tail), ["_file", "_at"], "left_anti"))


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Non-empty lines of files as they land. Files must be complete when they appear,

    so an unterminated tail is never read: writers rename a file into the folder once closed.
    """
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _framed(reader.text(path))


def _plain_name(name: str) -> str:
    return re.sub("^file:/+", "file:/", name)


def _open_tails(spark: SparkSession, text: DataFrame, files: list[str]) -> list[tuple[str, int, int]]:
    """(file, bytes, crc32) of last lines that lack their LF; compressed files are whole.

    Tasks open the files and read their last blocks; the driver gets a row for a file that is being
    written. Where Arrow does not know the file system, the lines are added up by file
    instead: those of a file with an open tail make a byte more than the file has.
    """
    plain = [f for f in files if f.rsplit(".", 1)[-1] not in COMPRESSED]
    known = [f for f in plain if f.split(":", 1)[0] in _SCHEMES]
    found = []
    if known:
        names = spark.createDataFrame([(f,) for f in known], "name string")
        found += names.repartition(-(-len(known) // FILES_PER_TASK)).mapInPandas(_tails_of, _TAILS).collect()
    if len(known) < len(plain):
        found += _tails_by_sums(text, [f for f in plain if f.split(":", 1)[0] not in _SCHEMES]).collect()
    return [tuple(r) for r in found]


def _tails_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for names in batches:
        rows = [(_plain_name(n), *tail) for n in names["name"] if (tail := _tail(n)) is not None]
        yield pd.DataFrame(rows, columns=["_file", "_size", "_sum"])


def _tail(name: str) -> tuple[int, int] | None:
    """(bytes, crc32) of a file's last line if it lacks its LF; holds a block of the file at a time."""
    from pyarrow import fs

    scheme, rest = name.split(":", 1)
    path = urllib.parse.unquote(rest)
    if scheme == "file":
        system, where = fs.LocalFileSystem(), "/" + path.lstrip("/")
    else:
        system, where = fs.FileSystem.from_uri(f"{_SCHEMES[scheme]}:{path}")
    with system.open_input_file(where) as source:
        size = source.size()
        if not size or source.read_at(1, size - 1) == b"\n":
            return None
        start, begin = size, 0
        while start:
            step = min(start, BLOCK)
            start -= step
            at = source.read_at(step, start).rfind(b"\n")
            if at >= 0:
                begin = start + at + 1
                break
        total = 0
        for at in range(begin, size, BLOCK):
            total = zlib.crc32(source.read_at(min(BLOCK, size - at), at), total)
        return size - begin, total


def _tails_by_sums(text: DataFrame, files: list[str]) -> DataFrame:
    """The tails of :func:`_tail` in expressions alone, at the price of a pass over the lines."""
    line = F.col("value").cast("binary")
    sized = text.select(
        F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_file"),
        F.col("_metadata.file_size").alias("_whole"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"),
        F.struct(F.octet_length("value").cast("long").alias("_size"), F.crc32(line).alias("_sum")).alias("_line"),
    )
    wanted = sized.sparkSession.createDataFrame([(_plain_name(f),) for f in files], "_file string")
    by_file = sized.join(wanted, "_file", "left_semi").groupBy("_file").agg(
        F.sum(F.col("_line._size") + 1).alias("_read"), F.max("_whole").alias("_whole"), F.max_by("_line", "_at").alias("_line")
    )
    return by_file.filter("_read > _whole").select("_file", "_line._size", "_line._sum")


def _framed(df: DataFrame) -> DataFrame:
    line = F.col("value")
    stripped = F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    return df.select(stripped.alias("line")).filter("line != ''")
