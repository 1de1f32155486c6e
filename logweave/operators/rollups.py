"""Counts for dashboards.

Most reports here need a text minimum or a distinct count per group. Spark evaluates those by
sorting every input row, so each report first counts at the finest grain it needs with
fixed-width aggregates (hash aggregation, combined before the shuffle) and only then takes
minima and distinct counts over that far smaller result.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clock, severity

TOP_N = 10
ERROR_LOOKBACK_DAYS = 7


def _device() -> Column:
    return F.coalesce("fromhost_ip", F.lit(""))


def _since(as_of: dt.datetime | str, **delta: int) -> Column:
    return F.col("timestamp") >= clock.at(clock.as_datetime(as_of) - dt.timedelta(**delta))


def summary(logs: DataFrame, as_of: dt.datetime | str) -> DataFrame:
    """Totals, last hour, last day, distinct host names and devices."""
    grain = logs.groupBy("hostname", "fromhost_ip").agg(
        F.count("*").alias("n"),
        F.count_if(_since(as_of, hours=1)).alias("hour"),
        F.count_if(_since(as_of, days=1)).alias("day"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return grain.agg(
        total("n").alias("total_logs"),
        total("hour").alias("logs_last_hour"),
        total("day").alias("logs_last_day"),
        F.countDistinct("hostname").alias("unique_hosts"),
        F.countDistinct("fromhost_ip").alias("unique_devices"),
    )


def severity_counts(logs: DataFrame, normalize: bool = False) -> DataFrame:
    key = severity.normalized(F.col("severity")) if normalize else F.col("severity")
    return logs.groupBy(key.alias("severity")).agg(F.count("*").alias("cnt"))


def severity_share(counts: DataFrame) -> DataFrame:
    """Percent of the total per severity, in rank order, unknown spellings last."""
    # A handful of rows: one per severity spelling.
    total = F.sum("cnt").over(Window.partitionBy())
    return counts.filter("cnt > 0").select(
        "severity",
        "cnt",
        F.coalesce(severity.rank(F.col("severity")), F.lit(99)).alias("rank"),
        F.round(F.col("cnt") * 100.0 / total, 4).alias("percent"),
    )


def _top(df: DataFrame, *ties: str, n: int = TOP_N) -> DataFrame:
    return df.orderBy(F.desc("cnt"), *ties).limit(n)


def _message(prefix: int | None) -> Column:
    return F.left("message", F.lit(prefix)) if prefix else F.col("message")


def error_groups(logs: DataFrame, prefix: int | None = None) -> DataFrame:
    """Error rows counted per (message, device), with the first host name. ``prefix`` groups by that many first characters instead."""
    errors = logs.filter(F.col("severity").isin(*severity.ERROR_SEVERITIES))
    grain = errors.groupBy(_message(prefix).alias("message"), _device().alias("fromhost_ip"), "hostname")
    return (
        grain.agg(F.count("*").alias("n"))
        .groupBy("message", "fromhost_ip")
        .agg(F.min("hostname").alias("hostname"), F.sum("n").alias("cnt"))
    )


def top_errors(logs: DataFrame, as_of: dt.datetime | str, prefix: int | None = None) -> DataFrame:
    return _top(error_groups(logs.filter(_since(as_of, days=ERROR_LOOKBACK_DAYS)), prefix), "message", "fromhost_ip")


def device_groups(logs: DataFrame) -> DataFrame:
    grain = logs.groupBy(_device().alias("fromhost_ip"), "hostname").agg(F.count("*").alias("n"))
    return grain.groupBy("fromhost_ip").agg(F.min("hostname").alias("hostname"), F.sum("n").alias("cnt"))


def top_devices(logs: DataFrame) -> DataFrame:
    return _top(device_groups(logs), "fromhost_ip")


def range_aggregates(logs: DataFrame, as_of: dt.datetime | str, prefix: int | None = None) -> DataFrame:
    """Scalars, severities, top devices and top errors of a filtered range as (kind, key1, key2, key3, cnt).

    Errors are grouped by the whole message, or by its first ``prefix`` characters. The range is read once. It is counted at one common grain, and grouping sets over that
    grain give the rest.
    """
    is_error = F.col("severity").isin(*severity.ERROR_SEVERITIES)
    grain = (
        logs.groupBy(
            "severity",
            _device().alias("device"),
            "hostname",
            F.when(is_error, _message(prefix)).alias("error"),
        )
        .agg(
            F.count("*").alias("n"),
            F.count_if(_since(as_of, hours=1)).alias("hour"),
            F.count_if(_since(as_of, days=1)).alias("day"),
        )
    )
    sets = grain.groupingSets(
        [[], ["severity"], ["device"], ["error", "device"]], "severity", "device", "error"
    ).agg(
        F.grouping_id().alias("gid"),
        F.min("hostname").alias("host"),
        F.sum("n").alias("n"),
        F.sum("hour").alias("hour"),
        F.sum("day").alias("day"),
    )
    # Grouping id bits, high to low: severity, device, error; a set bit means "not grouped by".
    everything, by_severity, by_device, by_error = 7, 3, 5, 4
    gid = F.col("gid")
    none = F.lit(None).cast("string")

    def row(kind: str, key1: Column, key2: Column, key3: Column, cnt: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), key1.alias("key1"), key2.alias("key2"), key3.alias("key3"), cnt.alias("cnt")
        )

    scalar = lambda name, cnt: row("scalar", F.lit(name), none, none, F.coalesce(cnt, F.lit(0)).cast("long"))
    has_device = F.when(F.col("device") != "", 1).otherwise(0)
    rows = (
        F.when(
            gid == everything,
            F.array(
                scalar("total_logs", F.col("n")),
                scalar("logs_last_hour", F.col("hour")),
                scalar("logs_last_day", F.col("day")),
                scalar("unique_devices", F.lit(0)),
            ),
        )
        .when(gid == by_severity, F.array(row("severity", F.col("severity"), none, none, F.col("n"))))
        .when(
            gid == by_device,
            F.array(row("device", F.col("device"), F.col("host"), none, F.col("n")), scalar("unique_devices", has_device)),
        )
        .when(
            (gid == by_error) & F.col("error").isNotNull(),
            F.array(row("error", F.col("error"), F.col("device"), F.col("host"), F.col("n"))),
        )
    )
    merged = (
        sets.select(F.inline(rows))
        .groupBy("kind", "key1", "key2", "key3")
        .agg(F.sum("cnt").alias("cnt"))
    )
    ranked_kinds = F.col("kind").isin("device", "error")
    within = Window.partitionBy("kind", F.when(~ranked_kinds, F.col("key1"))).orderBy(F.desc("cnt"), "key1", "key2")
    return merged.withColumn("_rn", F.row_number().over(within)).filter(F.col("_rn") <= TOP_N).drop("_rn")


def log_rate(logs: DataFrame, as_of: dt.datetime | str, seconds: int = 10) -> DataFrame:
    """Rows per second over the trailing window."""
    recent = logs.filter(_since(as_of, seconds=seconds) & (F.col("timestamp") <= clock.at(as_of)))
    return recent.agg(F.count("*").alias("events"), (F.count("*") / F.lit(float(seconds))).alias("per_second"))


def top_hosts(logs: DataFrame, n: int = 20) -> DataFrame:
    return _top(logs.groupBy("hostname").agg(F.count("*").alias("cnt")), "hostname", n=n)


def data_version(logs: DataFrame) -> DataFrame:
    """Newest timestamp in epoch microseconds: a roll-up built at this version needs no refresh."""
    return logs.agg(F.unix_micros(F.max("timestamp")).alias("version"))


# 2^14 registers: a standard error of 0.81 percent of what is counted, merged or not.
SKETCH_BITS = 14
UNIQUE_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
UNIQUE_KINDS = {"unique_hosts": "hostname", "unique_devices": "fromhost_ip", "unique_messages": "message"}


def unique_sketches(logs: DataFrame) -> DataFrame:
    """Sketches of the distinct host names, devices and messages of each hour; nulls are not counted.

    Unlike distinct counts they can be merged over any range of hours, at 16 kB each at most.
    """
    # Hashes instead of texts, as a sketch ignores empty texts.
    seen = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    return logs.groupBy(F.to_date("timestamp").alias("log_date"), F.date_trunc("hour", "timestamp").alias("hour")).agg(
        *[F.hll_sketch_agg(seen(c), SKETCH_BITS).alias(kind) for kind, c in UNIQUE_KINDS.items()]
    )


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """One row of sketches per key (log_date and hour unless told), whatever pieces they came in."""
    return sketches.groupBy(*(keys or ("log_date", "hour"))).agg(*[F.hll_union_agg(kind).alias(kind) for kind in UNIQUE_KINDS])


def unique_estimates(sketches: DataFrame, *keys: str) -> DataFrame:
    """Estimated distinct counts per key, or over all rows without keys, with a standard error of ``UNIQUE_ERROR``."""
    merged = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(kind)), F.lit(0)).cast("long").alias(kind) for kind in UNIQUE_KINDS]
    return sketches.groupBy(*keys).agg(*merged)
