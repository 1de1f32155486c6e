"""Counts over time, in the caller's zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions import clock


def hourly(logs: DataFrame) -> DataFrame:
    """The stored roll-up: rows per UTC hour."""
    return logs.groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(F.count("*").alias("cnt"))


def from_hourly(rollup: DataFrame, interval: str, as_of: dt.datetime | str, zone: str | None = None) -> DataFrame:
    """Timeline over the default lookback, from the hourly roll-up."""
    unit = clock.unit_for(interval)
    start = clock.as_datetime(as_of) - dt.timedelta(days=clock.LOOKBACK_DAYS[unit])
    bucket = clock.trunc_in_zone(F.col("hour"), unit, clock.known_zone(zone))
    recent = rollup.filter(F.col("hour") >= clock.at(start))
    return recent.groupBy(bucket.alias("ts")).agg(F.sum("cnt").alias("cnt"))


def from_rows(
    logs: DataFrame,
    interval: str,
    as_of: dt.datetime | str,
    zone: str | None = None,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
) -> DataFrame:
    """Timeline from raw rows: minute grain or an explicit range; the last day when no start is given."""
    low = clock.as_datetime(start) if start else clock.as_datetime(as_of) - dt.timedelta(days=1)
    rows = logs.filter(F.col("timestamp") >= clock.at(low))
    if end:
        rows = rows.filter(F.col("timestamp") <= clock.at(end))
    bucket = clock.trunc_in_zone(F.col("timestamp"), clock.unit_for(interval), clock.known_zone(zone))
    return rows.groupBy(bucket.alias("ts")).agg(F.count("*").alias("cnt"))


def timeline(
    logs: DataFrame,
    rollup: DataFrame | None,
    interval: str,
    as_of: dt.datetime | str,
    zone: str | None = None,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
) -> DataFrame:
    """Roll-up where it gives exact results, raw rows otherwise."""
    unit, now, tz = clock.unit_for(interval), clock.as_datetime(as_of), clock.known_zone(zone)
    if start or end or unit == "minute":
        return from_rows(logs, interval, as_of, tz, start, end)
    lookback = now - dt.timedelta(days=clock.LOOKBACK_DAYS[unit])
    if rollup is None or not clock.has_whole_hour_offset(tz, lookback, now):
        # Hour rows would be split by the zone's day boundary. The lower bound stays on the
        # hour so that both ways cover the same rows.
        first_hour = lookback if lookback == lookback.replace(minute=0, second=0, microsecond=0) else (
            lookback.replace(minute=0, second=0, microsecond=0) + dt.timedelta(hours=1)
        )
        return from_rows(logs, interval, as_of, tz, start=first_hour)
    return from_hourly(rollup, interval, as_of, tz)


def fixed_width(logs: DataFrame, minutes: int) -> DataFrame:
    """True N-minute buckets."""
    window = F.window("timestamp", f"{minutes} minutes")
    return logs.groupBy(window.start.alias("ts")).agg(F.count("*").alias("cnt"))
