"""Per-device statistics, names and listings. The device key is the sender address, blank when unknown."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock, severity, text
from .paging import page_size

LIST_PAGE = 100
RELAY_STALE_MINUTES = 10
DEFAULT_SILENCE_MINUTES = 15


def _device() -> Column:
    return F.coalesce("fromhost_ip", F.lit(""))


def device_stats(logs: DataFrame, normalize: bool = False) -> DataFrame:
    """Counts, last sighting, severities and the relay of the newest row, per device.

    Counted first per (device, host, severity, relay) with hash aggregates; equal newest
    timestamps resolve to the greatest relay label.
    """
    key = severity.normalized(F.col("severity")) if normalize else F.col("severity")
    grain = logs.groupBy(_device().alias("fromhost_ip"), "hostname", key.alias("severity"), "via_relay").agg(
        F.count("*").alias("n"), F.max("timestamp").alias("seen")
    )
    named = [n if not normalize else severity.SPELLINGS[severity.rank_of(n)][0] for n in severity.DEVICE_SEVERITIES]
    pivoted = [
        F.sum(F.when(F.col("severity") == spelling, F.col("n")).otherwise(0)).alias(f"{name}_count")
        for name, spelling in zip(severity.DEVICE_SEVERITIES, named)
    ]
    newest = F.struct("seen", F.coalesce("via_relay", F.lit("")))
    return grain.groupBy("fromhost_ip").agg(
        F.min("hostname").alias("hostname"),
        F.sum("n").alias("total"),
        F.max("seen").alias("last_seen"),
        *pivoted,
        F.max_by("via_relay", newest).alias("via_relay"),
    )


def device_parsers(logs: DataFrame) -> DataFrame:
    """Sorted distinct rule names that have matched on each device."""
    pairs = logs.select(_device().alias("fromhost_ip"), F.explode("matched_parsers").alias("parser")).distinct()
    return pairs.groupBy("fromhost_ip").agg(F.array_sort(F.collect_set("parser")).alias("parsers"))


def device_stats_full(stats: DataFrame, parsers: DataFrame) -> DataFrame:
    joined = stats.join(parsers, "fromhost_ip", "left")
    return joined.withColumn("parsers", F.coalesce("parsers", F.array().cast("array<string>")))


def device_list(full: DataFrame, aliases: DataFrame) -> DataFrame:
    """Statistics with alias, old host name and the derived flags."""
    named = full.join(aliases.select("fromhost_ip", "display_name", "old_hostname"), "fromhost_ip", "left")
    return named.withColumns(
        {
            "display_name": F.coalesce("display_name", F.lit("")),
            "old_hostname": F.coalesce("old_hostname", F.lit("")),
            "has_parsed": F.size("parsers") > 0,
            "uses_proxy": F.coalesce(F.col("via_relay") != "", F.lit(False)),
        }
    )


def device_list_top(listing: DataFrame, limit: int | None = None) -> DataFrame:
    return listing.orderBy(F.desc("total"), "fromhost_ip").limit(page_size(limit, LIST_PAGE))


def shown_name(display_name: Column, hostname: Column, ip: Column) -> Column:
    return F.coalesce(*[text.blank_to_null(c) for c in (display_name, hostname, ip)], F.lit("-"))


def resolve_names(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``shown_name``: an alias found by address, host name or old host name, else the row's own names.

    Each lookup is an equi-join on a de-duplicated key.
    """

    def lookup(key: str, out: str) -> DataFrame:
        keyed = aliases.filter(F.col(key).isNotNull() & (F.col(key) != ""))
        return keyed.groupBy(F.col(key).alias(f"_{out}_key")).agg(F.min("display_name").alias(out))

    by_ip, by_old = lookup("fromhost_ip", "_by_ip"), lookup("old_hostname", "_by_old")
    by_host = lookup("hostname", "_by_host") if "hostname" in aliases.columns else None
    out = rows.join(by_ip, F.col("fromhost_ip") == F.col("__by_ip_key"), "left")
    found = ["_by_ip"]
    if by_host is not None:
        out = out.join(by_host, F.col("hostname") == F.col("__by_host_key"), "left")
        found.append("_by_host")
    out = out.join(by_old, F.col("hostname") == F.col("__by_old_key"), "left")
    found.append("_by_old")
    alias = F.coalesce(*[text.blank_to_null(F.col(c)) for c in found])
    named = out.withColumn("shown_name", shown_name(alias, F.col("hostname"), F.col("fromhost_ip")))
    return named.select(*rows.columns, "shown_name")


def latest_hostname(logs: DataFrame) -> DataFrame:
    """Host name of each device's newest row."""
    grain = logs.groupBy(_device().alias("fromhost_ip"), "hostname").agg(F.max("timestamp").alias("seen"))
    return grain.groupBy("fromhost_ip").agg(F.max_by("hostname", F.struct("seen", "hostname")).alias("old_hostname"))


def upsert_aliases(aliases: DataFrame, changes: DataFrame, logs: DataFrame) -> DataFrame:
    """Alias table after the changes (fromhost_ip, display_name); each also records the current host name."""
    named = changes.join(latest_hostname(logs), "fromhost_ip", "left").select(
        "fromhost_ip",
        F.col("display_name").alias("new_name"),
        F.col("old_hostname").alias("new_host"),
        F.lit(True).alias("changed"),
    )
    merged = aliases.join(named, "fromhost_ip", "full_outer")
    return merged.select(
        "fromhost_ip",
        F.coalesce("new_name", "display_name").alias("display_name"),
        F.when(F.col("changed"), F.col("new_host")).otherwise(F.col("old_hostname")).alias("old_hostname"),
    )


def relay_liveness(logs: DataFrame, relays: DataFrame, certificates: DataFrame, as_of: dt.datetime | str) -> DataFrame:
    """State of each registered relay from its certificate and its last forwarded row."""
    seen = logs.filter(F.col("via_relay").isNotNull()).groupBy(F.col("via_relay").alias("label")).agg(
        F.max("timestamp").alias("last_seen")
    )
    certs = certificates.select(F.col("id").alias("relay_cert_id"), F.col("status").alias("cert"))
    now = clock.at(as_of)
    age = F.unix_micros(now) - F.unix_micros("last_seen")
    status = (
        F.when(F.col("cert") == "revoked", "cert_revoked")
        .when(F.col("last_seen").isNull(), "never_seen")
        .when(age <= RELAY_STALE_MINUTES * 60_000_000, "online")
        .otherwise("stale")
    )
    shown = F.col("status").isin("online", "stale")
    joined = relays.join(certs, "relay_cert_id", "left").join(seen, "label", "left")
    return joined.withColumn("status", status).select(
        "label",
        F.coalesce("cert", F.lit("none")).alias("cert_status"),
        "status",
        F.when(shown, F.col("last_seen")).alias("last_seen"),
        F.when(shown, F.floor(age / 1_000_000)).alias("seconds_since_seen"),
    )
