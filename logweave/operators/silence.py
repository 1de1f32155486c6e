"""Devices that stopped sending: current state, transitions, status column."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock
from .devices import DEFAULT_SILENCE_MINUTES

# Silence levels by multiple of the threshold, mildest first.
LEVELS = (("warning", 1), ("error", 2), ("critical", 4))


@dataclass(frozen=True)
class SilenceRule:
    id: int
    threshold: int = 0
    cooldown_minutes: int = 0
    device_ips: tuple[str, ...] = ()

    @property
    def minutes(self) -> int:
        return self.threshold if self.threshold > 0 else DEFAULT_SILENCE_MINUTES


def level(age_us: Column, threshold_us: Column) -> Column:
    return (
        F.when(age_us >= threshold_us * 4, "critical").when(age_us >= threshold_us * 2, "error").otherwise("warning")
    )


def level_rank(name: Column) -> Column:
    names = [n for n, _ in LEVELS]
    return F.array_position(F.array(*[F.lit(n) for n in names]), name)


def applicable(devices: DataFrame, rules: list[SilenceRule]) -> DataFrame:
    """One row per device and rule that watches it. Rules are few and become part of the plan."""
    watched = [
        F.when(
            F.col("fromhost_ip").isin(*r.device_ips) if r.device_ips else F.lit(True),
            F.struct(
                F.lit(r.id).cast("long").alias("rule_id"),
                F.lit(r.minutes).alias("threshold_minutes"),
                F.lit(r.cooldown_minutes).alias("cooldown_minutes"),
            ),
        )
        for r in rules
    ]
    exploded = devices.withColumn("_rule", F.explode(F.array_compact(F.array(*watched))))
    return exploded.select(*devices.columns, "_rule.*")


def _age_us(as_of: dt.datetime | str, since: str) -> Column:
    return F.unix_micros(clock.at(as_of)) - F.unix_micros(since)


def _limit_us() -> Column:
    return F.col("threshold_minutes").cast("long") * 60_000_000


def silent_devices(devices: DataFrame, rules: list[SilenceRule], as_of: dt.datetime | str) -> DataFrame:
    """(rule, device) pairs silent at ``as_of`` without regard to earlier state.

    ``devices`` has fromhost_ip, hostname, last_seen.
    """
    age = _age_us(as_of, "last_seen")
    rows = applicable(devices, rules).withColumn("age_seconds", F.floor(age / 1_000_000))
    return rows.filter(age >= _limit_us()).withColumn("severity", level(age, _limit_us()))


def transitions(
    devices: DataFrame, rules: list[SilenceRule], state: DataFrame, as_of: dt.datetime | str
) -> DataFrame:
    """What changes against the stored state: ``silent``, ``escalated``, ``repeat``, ``quiet`` or ``recovered``.

    ``state`` has rule_id, device_ip, silent_since, last_severity, last_fired. A row fires
    when it escalates or when its cooldown has passed; ``quiet`` rows do neither.
    """
    pairs = applicable(devices, rules)
    previous = state.select("rule_id", F.col("device_ip").alias("fromhost_ip"), "silent_since", "last_severity", "last_fired")
    joined = pairs.join(previous, ["rule_id", "fromhost_ip"], "left")
    silent = _age_us(as_of, "last_seen") >= _limit_us()
    had_state = F.col("last_severity").isNotNull()
    rows = joined.filter(silent | had_state)
    since = F.coalesce("silent_since", "last_seen")
    severity = level(F.unix_micros(clock.at(as_of)) - F.unix_micros(since), _limit_us())
    cooled = F.coalesce(_age_us(as_of, "last_fired") >= F.col("cooldown_minutes").cast("long") * 60_000_000, F.lit(True))
    action = (
        F.when(~silent, "recovered")
        .when(~had_state, F.when(cooled, "silent").otherwise("quiet"))
        .when(level_rank(severity) > level_rank(F.col("last_severity")), "escalated")
        .when(cooled, "repeat")
        .otherwise("quiet")
    )
    return rows.select(
        "rule_id",
        "fromhost_ip",
        "hostname",
        action.alias("action"),
        F.when(silent, severity).otherwise("info").alias("severity"),
        since.alias("silent_since"),
        "last_seen",
        "threshold_minutes",
    )


def firings(changes: DataFrame) -> DataFrame:
    """Records to deliver for the transitions that fire: (rule_id, fromhost_ip, title, text, notify_severity)."""
    # The titles and texts of delivered records.
    host = F.coalesce("hostname", F.lit(""))
    back = F.col("action") == "recovered"
    title = F.concat(F.when(back, F.lit("Device back online: ")).otherwise(F.lit("Device silent: ")), host)
    resumed = F.concat(host, F.lit(" ("), "fromhost_ip", F.lit(") has resumed sending logs (was silent since "), clock.rfc3339("silent_since"), F.lit(")."))
    silent = F.concat(
        F.lit("No logs received from "), host, F.lit(" ("), "fromhost_ip", F.lit(") in over "), F.col("threshold_minutes").cast("string"),
        F.lit(" minutes. Last seen: "), clock.rfc3339("last_seen"),
    )
    fired = changes.filter(F.col("action") != "quiet")
    return fired.select("rule_id", "fromhost_ip", title.alias("title"), F.when(back, resumed).otherwise(silent).alias("text"), F.col("severity").alias("notify_severity"))


def next_state(state: DataFrame, changes: DataFrame, as_of: dt.datetime | str) -> DataFrame:
    """State table after the transitions: fired rows are upserted (keeping ``silent_since``), recovered ones removed."""
    fired = changes.filter(F.col("action").isin("silent", "escalated", "repeat", "recovered")).select(
        "rule_id",
        F.col("fromhost_ip").alias("device_ip"),
        F.col("silent_since").alias("_since"),
        F.col("severity").alias("_severity"),
        "action",
    )
    merged = state.join(fired, ["rule_id", "device_ip"], "full_outer").filter(
        F.coalesce(F.col("action") != "recovered", F.lit(True))
    )
    return merged.select(
        "rule_id",
        "device_ip",
        F.coalesce("silent_since", "_since").alias("silent_since"),
        F.coalesce("_severity", "last_severity").alias("last_severity"),
        F.when(F.col("action").isNotNull(), clock.at(as_of)).otherwise(F.col("last_fired")).alias("last_fired"),
    )


def status(devices: DataFrame, rules: list[SilenceRule], as_of: dt.datetime | str) -> DataFrame:
    """Per device the strictest threshold that applies and ``silent``, ``ok`` or ``no_rule``."""
    limits = [
        F.when(F.col("fromhost_ip").isin(*r.device_ips) if r.device_ips else F.lit(True), F.lit(r.minutes).cast("long"))
        for r in rules
    ]
    strictest = F.array_min(F.array(*limits)) if limits else F.lit(None).cast("long")
    age = _age_us(as_of, "last_seen")
    rows = devices.withColumn("threshold_minutes", strictest)
    return rows.withColumn(
        "silence_status",
        F.when(F.col("threshold_minutes").isNull(), "no_rule")
        .when(F.coalesce(age >= _limit_us(), F.lit(True)), "silent")
        .otherwise("ok"),
    )
