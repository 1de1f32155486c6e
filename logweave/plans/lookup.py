"""Search over a stored log table by way of its word lists."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import clock, search
from ..operators import filters
from ..sources import snapshots, term_index


def search_table(spark: SparkSession, table_path: str, flt: filters.LogFilter) -> DataFrame:
    """Rows of the newest version that pass a filter with a stemmed search.

    Of pieces whose words are listed (:func:`term_index.refresh`) only files with the words are read, and no row
    is stemmed. Pieces that are not listed yet are searched row by row; the rows found are the same.
    """
    held = _in_range(snapshots.entries(spark, table_path), flt)
    if not held:
        return snapshots.read(spark, table_path).limit(0)
    if not flt.search or not flt.stemming:
        return filters.apply(snapshots.read(spark, table_path, held), flt)
    done = term_index.indexed(spark, table_path)
    listed, others = [e for e in held if e.piece in done], [e for e in held if e.piece not in done]
    parts = []
    if listed:
        forms, files = term_index.look_up(spark, table_path, flt.search, listed)
        rows = snapshots.read(spark, table_path, listed)
        if files is not None:
            reader = spark.read.schema(rows.schema).option("basePath", f"{table_path}/data")
            rows = reader.parquet(*files).select(*rows.columns) if files else rows.limit(0)
        raw = F.col("raw_message") if "raw_message" in rows.columns else F.lit("")
        line = search.token_line(search.message_text(F.col("message"), raw))
        parts.append(filters.apply(rows, replace(flt, search="")).filter(search.matches_forms(line, flt.search, forms)))
    if others:
        parts.append(filters.apply(snapshots.read(spark, table_path, others), flt))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _in_range(entries: list[snapshots.Entry], flt: filters.LogFilter) -> list[snapshots.Entry]:
    first = clock.as_datetime(flt.start).date() if flt.start is not None else None
    last = clock.as_datetime(flt.end).date() if flt.end is not None else None
    inside = lambda e: e.log_date is None or ((first is None or e.log_date >= first) and (last is None or e.log_date <= last))
    return [e for e in entries if inside(e)]
