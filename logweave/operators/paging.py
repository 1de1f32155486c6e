"""Pages over the log table, newest first unless asked otherwise."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clock

# Page sizes where none is asked for.
LOG_PAGE = 50
SAVED_QUERY_PAGE = 100
EXPORT_PAGE = 1000

# From this offset on, ranges of rows before the page are counted and skipped.
DEEP_OFFSET = 10_000


def page_size(asked: int | None, default: int = LOG_PAGE) -> int:
    """The size asked for, whatever it is; the default where there is none. A negative size is refused."""
    if asked is not None and asked < 0:
        raise ValueError("a page size cannot be negative")
    return asked or default


def order(sort: str = "newest") -> list[Column]:
    newest = [F.desc("timestamp"), F.desc("id")]
    return {
        "newest": newest,
        "oldest": [F.asc("timestamp"), F.asc("id")],
        "severity": [F.asc("severity"), *newest],
        "hostname": [F.asc("hostname"), *newest],
    }[sort]


def page(
    logs: DataFrame,
    size: int,
    sort: str = "newest",
    after: tuple | None = None,
    offset: int = 0,
    deep: int = DEEP_OFFSET,
) -> DataFrame:
    """One page with a ``has_more`` flag.

    ``after`` is the last row seen: (timestamp, id), with the severity or host name before them
    where these come first in the order. One row more than the page is taken, by a top-k that never sorts the
    table; the flag is then computed over those few rows. From an offset of ``deep`` on, rows are
    first counted by key and hour, so that a task holds those of the hour the page starts in, not all before it.
    """
    if after is not None:
        logs = logs.filter(beyond_key(sort, after) if sort in KEYED else beyond(after, ascending=sort == "oldest"))
    if offset >= deep:
        logs, offset = _skip(logs, sort, offset)
    top = logs.orderBy(*order(sort))
    if offset:
        top = top.offset(offset)
    top = top.limit(size + 1)
    ranked = top.withColumn("_rn", F.row_number().over(Window.orderBy(*order(sort))))
    flagged = ranked.withColumn("has_more", F.max("_rn").over(Window.partitionBy()) > size)
    return flagged.filter(F.col("_rn") <= size).drop("_rn")


# Orders by a column, then newest first.
KEYED = ("severity", "hostname")


def _skip(logs: DataFrame, sort: str, offset: int) -> tuple[DataFrame, int]:
    """Rows from the start of the range on that the offset falls into, and what is left of the offset."""
    rest, within = logs, logs
    if sort in KEYED:
        key = F.col(sort)
        found = _range_of(logs.groupBy(key.alias("at")).agg(F.count("*").alias("n")), F.asc("at"), offset)
        if found is None:
            return logs.limit(0), 0
        at, before = found
        offset -= before
        own = key.isNull() if at is None else key == F.lit(at)
        later = key.isNotNull() if at is None else key > F.lit(at)  # nulls come first
        within = logs.filter(own)
    ascending = sort == "oldest"
    hour = F.unix_micros(F.date_trunc("hour", "timestamp"))
    found = _range_of(within.groupBy(hour.alias("at")).agg(F.count("*").alias("n")), F.asc("at") if ascending else F.desc("at"), offset)
    if found is None:
        return logs.limit(0), 0
    at, before = found
    time = F.col("timestamp")
    if at is None:  # first in rising order, last in falling order
        reached = F.lit(True) if ascending else time.isNull()
    elif ascending:
        reached = time >= F.timestamp_micros(F.lit(at))
    else:
        reached = (time < F.timestamp_micros(F.lit(at + 3_600_000_000))) | time.isNull()
    rest = rest.filter((own & reached) | later if sort in KEYED else reached)
    return rest, offset - before


def _range_of(counts: DataFrame, direction: Column, offset: int) -> tuple | None:
    """(value, rows before it) of the value of (at, n) that holds the row at the offset; one row per value is ordered."""
    upto = F.sum("n").over(Window.orderBy(direction).rowsBetween(Window.unboundedPreceding, 0))
    row = counts.withColumn("upto", upto).filter(F.col("upto") > offset).orderBy("upto").first()
    return None if row is None else (row["at"], row["upto"] - row["n"])


def beyond_key(sort: str, cursor: tuple) -> Column:
    """Rows after a cursor of (severity or host name, timestamp, id); null names come first."""
    if len(cursor) != 3:
        raise ValueError("a cursor of this order is (value, timestamp, id)")
    value, *newest = cursor
    key, later = F.col(sort), beyond(tuple(newest))
    if value is None:
        return key.isNotNull() | later
    return (key >= F.lit(value)) & ((key > F.lit(value)) | later)


def beyond(cursor: tuple[dt.datetime | str, int], ascending: bool = False) -> Column:
    """Rows after the cursor. The first term alone is a range on time, so files are still pruned."""
    ts, row_id = clock.at(cursor[0]), F.lit(cursor[1])
    t, i = F.col("timestamp"), F.col("id")
    if ascending:
        return (t >= ts) & ((t > ts) | (i > row_id))
    return (t <= ts) & ((t < ts) | (i < row_id))


def with_alias(logs: DataFrame, aliases: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """Add ``display_name`` from the device aliases, empty when there is none.

    The alias table is broadcast when its counted size allows it.
    """
    names = aliases.select(F.col("fromhost_ip").alias("_device"), F.col("display_name").alias("_name"))
    if names.limit(max_broadcast + 1).count() <= max_broadcast:
        names = F.broadcast(names)
    joined = logs.join(names, F.coalesce("fromhost_ip", F.lit("")) == F.col("_device"), "left")
    return joined.withColumn("display_name", F.coalesce("_name", F.lit(""))).drop("_device", "_name")


def count(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count("*").alias("total"))
