"""Day and month partitions: names, bounds and what retention does with them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock

PREFIX = "syslog_logs_"
DEFAULT_DAYS = 30
_NAME = r"^syslog_logs_(\d{4})_(\d{2})(?:_(\d{2}))?\z"


def partition_name(ts: Column, unit: str = "day") -> Column:
    return F.concat(F.lit(PREFIX), F.date_format(ts, "yyyy_MM_dd" if unit == "day" else "yyyy_MM"))


def partition_bounds(names: DataFrame, column: str = "name") -> DataFrame:
    """Add ``start`` and ``end`` of the day or month a name stands for, NULL for other names."""
    part = lambda i: F.regexp_extract(column, _NAME, i).try_cast("int")
    daily = part(3).isNotNull()
    first = F.try_make_timestamp(part(1), part(2), F.coalesce(part(3), F.lit(1)), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit("UTC"))
    start = F.when(F.col(column).rlike(_NAME), first)
    end = F.when(daily, start + F.expr("INTERVAL 1 DAY")).otherwise(start + F.expr("INTERVAL 1 MONTH"))
    return names.withColumns({"start": start, "end": end})


def cutoff(as_of: dt.datetime | str, days: int | None = None) -> dt.datetime:
    return clock.as_datetime(as_of) - dt.timedelta(days=DEFAULT_DAYS if not days or days < 1 else days)


def keep(logs: DataFrame, as_of: dt.datetime | str, days: int | None = None) -> DataFrame:
    """Rows that survive."""
    return logs.filter(F.col("timestamp") >= clock.at(cutoff(as_of, days)))


def plan(logs: DataFrame, as_of: dt.datetime | str, days: int | None = None, unit: str = "day") -> DataFrame:
    """Per partition: ``drop`` (ends by the cutoff), ``rewrite`` (straddles it) or ``keep``, with its rows."""
    limit = clock.at(cutoff(as_of, days))
    per_part = logs.groupBy(partition_name(F.col("timestamp"), unit).alias("name")).agg(F.count("*").alias("rows"))
    action = F.when(F.col("end") <= limit, "drop").when(F.col("start") < limit, "rewrite").otherwise("keep")
    return partition_bounds(per_part).withColumn("action", action)
