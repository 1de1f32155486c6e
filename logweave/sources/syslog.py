"""Classic syslog text: ``<PRI>Mmm dd HH:MM:SS host app[pid]: message``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock, severity

_LINE = (
    r"^<(\d{1,3})>([A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}) (\S+) ([^:\[\s]+)(?:\[(\d+)\])?: ?((?s:.*))\z"
)


def parse_rfc3164(lines: DataFrame, column: str = "line", as_of: Column | None = None) -> DataFrame:
    """Split syslog lines into record fields; lines of any other shape are left out.

    Severity is the priority modulo 8 and facility the quotient, both by name. The year is the latest that fits ``as_of``.
    """
    part = lambda i: F.regexp_extract(column, _LINE, i)
    pri = part(1).cast("int")
    names = lambda values: F.array(*[F.lit(v) for v in values])
    # The stamp as a column: its parser looks at it many times.
    stamped = lines.filter(F.col(column).rlike(_LINE)).withColumn("_stamp", part(2))
    return stamped.select(
        *lines.columns,
        clock.parse_timestamp(F.col("_stamp"), as_of).alias("timestamp"),
        part(3).alias("hostname"),
        part(4).alias("app_name"),
        F.nullif(part(5), F.lit("")).alias("process_id"),
        F.try_element_at(names(severity.SYSLOG_SEVERITIES), pri % 8 + 1).alias("severity"),
        F.try_element_at(names(severity.SYSLOG_FACILITIES), F.floor(pri / 8).cast("int") + 1).alias("facility"),
        part(6).alias("message"),
    )
