"""Timestamps: parsing, zones, truncation units."""

from __future__ import annotations

import datetime as dt
import zoneinfo

from pyspark.sql import Column, functions as F

# Interval names and the truncation unit each stands for.
INTERVAL_UNITS = {
    "1m": "minute",
    "5m": "minute",
    "15m": "minute",
    "30m": "minute",
    "1h": "hour",
    "6h": "hour",
    "1d": "day",
    "1w": "week",
    "1mon": "month",
    "minute": "minute",
    "hour": "hour",
    "day": "day",
    "week": "week",
    "month": "month",
}

# How far back a timeline reaches by default, in days.
LOOKBACK_DAYS = {"minute": 1, "hour": 7, "day": 30, "week": 90, "month": 365}

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()

_DATE_TIME = r"\d{4}-\d{2}-\d{2}%s\d{2}:\d{2}:\d{2}([.,]\d+)?"
_ZONED = "^" + _DATE_TIME % "T" + r"(Z|[+-]\d{2}:\d{2})\z"
_PLAIN = "^" + _DATE_TIME % "[T ]" + r"\z"
_STAMP = r"^([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}):(\d{2}):(\d{2})([.,]\d+)?\z"
_UNIX_DATE = r"^[A-Z][a-z]{2} ([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}):(\d{2}):(\d{2}) [A-Z]{3,4} (\d{4})\z"


def parse_timestamp(text: Column, as_of: Column | None = None) -> Column:
    """Try the accepted layouts in turn; NULL when none fits.

    Layouts without a zone are UTC. Layouts without a year get the latest year in which they
    lie no more than a day ahead of ``as_of`` (now unless given).
    """
    iso = F.replace(text, F.lit(","), F.lit("."))
    return F.coalesce(
        F.when(text.rlike(_ZONED), iso.try_cast("timestamp")),
        F.when(text.rlike(_PLAIN), F.concat(iso, F.lit("Z")).try_cast("timestamp")),
        F.when(text.rlike(_STAMP), _latest_year(text, F.current_timestamp() if as_of is None else as_of)),
        F.when(text.rlike(_UNIX_DATE), _from_parts(text, _UNIX_DATE, F.regexp_extract(text, _UNIX_DATE, 6).try_cast("int"))),
    )


def _latest_year(text: Column, as_of: Column) -> Column:
    """The stamp in the latest year that does not put it beyond ``as_of`` and a day; leap days go to leap years."""
    limit = as_of + F.expr("INTERVAL 1 DAY")
    month, day = _month(text, _STAMP), F.regexp_extract(text, _STAMP, 2).try_cast("int")
    clock_text = F.regexp_replace(text, r"^.*(\d{2}):(\d{2}):(\d{2}).*\z", "$1$2$3").try_cast("long")
    in_year = (month * 100 + day).cast("long") * 1000000 + clock_text
    year = F.year(limit) - (in_year > F.date_format(limit, "MMddHHmmss").cast("long")).cast("int")
    leap = year - year % 4
    leap = F.when((leap % 100 == 0) & (leap % 400 != 0), leap - 4).otherwise(leap)
    return _from_parts(text, _STAMP, F.when((month == 2) & (day == 29), leap).otherwise(year))


def _month(text: Column, pattern: str) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(text, pattern, 1)).cast("int")


def _from_parts(text: Column, pattern: str, year: Column) -> Column:
    part = lambda i: F.regexp_extract(text, pattern, i)
    number = lambda i: part(i).try_cast("int")
    seconds = F.concat(part(5), F.replace(part(6), F.lit(","), F.lit(".")) if pattern == _STAMP else F.lit(""))
    return F.try_make_timestamp(
        year,
        _month(text, pattern),
        number(2),
        number(3),
        number(4),
        seconds.try_cast("decimal(16,6)"),
        F.lit("UTC"),
    )


def unit_for(interval: str) -> str:
    return INTERVAL_UNITS.get(interval, "hour")


def known_zone(name: str | None) -> str:
    """The zone itself when it exists, else UTC."""
    try:
        return zoneinfo.ZoneInfo(name).key if name else "UTC"
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return "UTC"


def has_whole_hour_offset(name: str, start: dt.datetime, end: dt.datetime) -> bool:
    """Whether every offset the zone uses in the range is a whole number of hours."""
    zone = zoneinfo.ZoneInfo(name)
    day, step = start, dt.timedelta(days=1)
    while day <= end + step:
        offset = zone.utcoffset(day) or dt.timedelta()
        if offset.total_seconds() % 3600:
            return False
        day += step
    return True


def trunc_in_zone(ts: Column, unit: str, zone: str) -> Column:
    """Start of the calendar unit as seen on a clock in ``zone``."""
    if zone == "UTC":
        return F.date_trunc(unit, ts)
    return F.to_utc_timestamp(F.date_trunc(unit, F.from_utc_timestamp(ts, zone)), zone)


def text_in_zone(ts: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm:ss")


def at(ts: dt.datetime | str) -> Column:
    """A literal instant; text and naive values are UTC."""
    if isinstance(ts, str):
        ts = dt.datetime.fromisoformat(ts)
    if ts.tzinfo is None:
        ts = ts.replace(tzinfo=dt.timezone.utc)
    micros = (ts - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros).cast("long"))


def as_datetime(ts: dt.datetime | str) -> dt.datetime:
    if isinstance(ts, str):
        ts = dt.datetime.fromisoformat(ts)
    if ts.tzinfo is None:
        return ts.replace(tzinfo=dt.timezone.utc)
    return ts.astimezone(dt.timezone.utc)


def rfc3339(ts: str) -> Column:
    """A time as text to the second, in UTC, whatever zone the session has."""
    # Built from the epoch, as date_format writes the session's zone.
    us = F.floor(F.unix_micros(ts) / 1_000_000)
    days, rest = F.floor(us / 86_400).cast("int"), F.pmod(us, F.lit(86_400))
    part = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    day = F.date_from_unix_date(days).cast("string")
    return F.concat(day, F.lit("T"), part(F.floor(rest / 3600)), F.lit(":"), part(F.pmod(F.floor(rest / 60), F.lit(60))), F.lit(":"), part(F.pmod(rest, F.lit(60))), F.lit("Z"))
