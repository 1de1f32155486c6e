"""Severity ranks, floors and buckets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Syslog severity spellings by rank, most severe first.
SPELLINGS: list[tuple[str, ...]] = [
    ("emerg", "emergency"),
    ("alert",),
    ("crit", "critical"),
    ("err", "error"),
    ("warning", "warn"),
    ("notice",),
    ("info",),
    ("debug",),
]

# Spellings counted as errors by the top-errors report.
ERROR_SEVERITIES = ("err", "crit", "alert", "emerg")

# Long spellings pivoted by the device statistics.
DEVICE_SEVERITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")

SYSLOG_SEVERITIES = tuple(names[0] for names in SPELLINGS)

# Syslog facility names by number.
SYSLOG_FACILITIES = (
    "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp security console solaris-cron "
    "local0 local1 local2 local3 local4 local5 local6 local7"
).split()


def rank_of(name: str) -> int | None:
    """Driver-side rank of one spelling."""
    wanted = (name or "").lower()
    return next((i for i, names in enumerate(SPELLINGS) if wanted in names), None)


def rank(severity: Column) -> Column:
    """Rank 0 (most severe) to 7, NULL for a spelling that is not known."""
    lowered = F.lower(severity)
    expr = None
    for i, names in enumerate(SPELLINGS):
        cond = lowered.isin(*names)
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    return expr


def normalized(severity: Column) -> Column:
    """Fold synonyms to the short spelling; unknown spellings stay as they are."""
    lowered = F.lower(severity)
    expr = None
    for names in SPELLINGS:
        cond = lowered.isin(*names)
        expr = F.when(cond, names[0]) if expr is None else expr.when(cond, names[0])
    return expr.otherwise(severity)


def meets_floor(severity: Column, floor: str) -> Column:
    """At least as severe as ``floor``; an unknown spelling on either side passes."""
    limit = rank_of(floor)
    if limit is None:
        return F.lit(True)
    return F.coalesce(rank(severity) <= limit, F.lit(True))


def bucket(severity: Column) -> Column:
    """The coarser scale used in notifications. Unknown spellings read as critical."""
    known = rank(severity)
    return (
        F.when(known.isNull() | (known <= 2), "critical")
        .when(known == 3, "error")
        .when(known == 4, "warning")
        .otherwise("info")
    )
