"""Queries over rules, notifications and the audit log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock, regex
from ..schema import ADMIN_ONLY_RULE_TYPES
from .paging import page_size


def _everyones(rule_type: str) -> Column:
    return ~F.col(rule_type).isin(*ADMIN_ONLY_RULE_TYPES)


def _targets(user_id: int, users: str) -> Column:
    return F.coalesce(F.array_contains(users, F.lit(user_id).cast("long")), F.lit(False))


def _broadcast_push(kind: str, users: str) -> Column:
    return (F.col(kind) == "push") & (F.coalesce(F.size(users), F.lit(0)) <= 0)


def visible_rules(
    alerts: DataFrame, alert_channels: DataFrame, channels: DataFrame, user_id: int, is_admin: bool = False
) -> DataFrame:
    """Rules a user may see: open types, or attached to a channel that reaches the user."""
    if is_admin:
        return alerts
    reaching = (
        alert_channels.join(channels.withColumnRenamed("id", "channel_id"), "channel_id")
        .filter(_targets(user_id, "user_ids") | _broadcast_push("type", "user_ids"))
        .select(F.col("alert_id").alias("id"))
    )
    flagged = alerts.join(reaching.distinct().withColumn("_reached", F.lit(True)), "id", "left")
    return flagged.filter(_everyones("rule_type") | F.col("_reached").isNotNull()).drop("_reached")


def notification_history(
    log: DataFrame,
    in_app: DataFrame,
    channels: DataFrame,
    user_id: int,
    is_admin: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Newest deliveries the user may see. 100 unless asked otherwise."""
    rows = log
    if not is_admin:
        targets = in_app.select(F.col("id").alias("in_app_notification_id"), F.col("target_user_ids").alias("_targets"))
        ch = channels.select(F.col("id").alias("channel_id"), F.col("type").alias("_type"), F.col("user_ids").alias("_users"))
        allowed = (
            _everyones("rule_type")
            | _targets(user_id, "_targets")
            | _targets(user_id, "_users")
            | F.coalesce(_broadcast_push("_type", "_users"), F.lit(False))
        )
        rows = (
            log.join(targets, "in_app_notification_id", "left").join(ch, "channel_id", "left").filter(allowed)
        ).select(*log.columns)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(page_size(limit, 100))


def history_by_firing(log: DataFrame) -> DataFrame:
    """Deliveries grouped by firing; a delivery without one stands alone. The newest row gives the attributes."""
    key = F.coalesce("firing_id", F.concat(F.lit("single-"), F.col("id").cast("string")))
    delivery = F.struct("id", "channel_name", "status")
    attributes = F.struct("alert_name", "rule_type", "created_at")
    return (
        log.groupBy(key.alias("firing"))
        .agg(
            F.max_by(attributes, F.struct("created_at", "id")).alias("first"),
            F.array_sort(F.collect_list(delivery)).alias("channels"),
        )
        .select("firing", "first.*", "channels")
    )


def _feed_condition(user_id: int, is_admin: bool) -> Column:
    broadcast = F.col("target_user_ids").isNull()
    if not is_admin:
        broadcast = broadcast & _everyones("alert_rule_type")
    return _targets(user_id, "target_user_ids") | broadcast


def user_feed(
    in_app: DataFrame, user_id: int, since_id: int = 0, is_admin: bool = False, limit: int | None = None
) -> DataFrame:
    """A user's notifications past ``since_id``, newest first; 50 unless asked otherwise."""
    rows = in_app.filter((F.col("id") > since_id) & _feed_condition(user_id, is_admin))
    return rows.orderBy(F.desc("id")).limit(page_size(limit))


def unread_counts(in_app: DataFrame, state: DataFrame, user_id: int, is_admin: bool = False) -> DataFrame:
    """Unread count and newest id for one user; the read mark itself when nothing is newer."""
    last_read = F.coalesce(
        state.filter(F.col("user_id") == user_id).select(F.max("last_read_id")).scalar(), F.lit(0).cast("long")
    )
    unread = in_app.filter((F.col("id") > last_read) & _feed_condition(user_id, is_admin))
    return unread.agg(F.count("*").alias("unread"), F.max("id").alias("_max")).select(
        "unread", F.coalesce("_max", last_read).alias("last_id")
    )


def mark_read(state: DataFrame, marks: DataFrame) -> DataFrame:
    """Read marks after an update; a mark never moves back. Both tables have (user_id, last_read_id)."""
    new = marks.groupBy("user_id").agg(F.max("last_read_id").alias("_new"))
    merged = state.join(new, "user_id", "full_outer")
    return merged.select("user_id", F.greatest("last_read_id", "_new").alias("last_read_id"))


def audit_filter(
    audit: DataFrame,
    username: str = "",
    action: str = "",
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
) -> DataFrame:
    rows = audit
    if start:
        rows = rows.filter(F.col("created_at") >= clock.at(start))
    if end:
        rows = rows.filter(F.col("created_at") <= clock.at(end))
    if action:
        rows = rows.filter(F.col("action") == action)
    if username:
        rows = rows.filter(F.col("username").ilike(f"%{regex.like_text(username)}%"))
    return rows


def audit_page(rows: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    ordered = rows.orderBy(F.desc("created_at"), F.desc("id"))
    return (ordered.offset(offset) if offset else ordered).limit(page_size(limit))


def slow_query_count(audit: DataFrame) -> DataFrame:
    return audit.filter(F.col("action") == "slow_query").agg(F.count("*").alias("total"))


def expiring_certificates(certificates: DataFrame, as_of: dt.datetime | str, days: int = 0) -> DataFrame:
    """Issued certificates that expire within the given days (30 by default), with whole days left."""
    within = days if days > 0 else 30
    now = clock.as_datetime(as_of)
    left_us = F.unix_micros("expires_at") - F.unix_micros(clock.at(now))
    # Whole days towards zero, as an integer conversion of hours / 24 gives.
    days_left = (F.signum(left_us.cast("double")) * F.floor(F.abs(left_us) / 86_400_000_000)).cast("long")
    return certificates.filter(
        (F.col("status") == "issued") & (F.col("expires_at") <= clock.at(now + dt.timedelta(days=within)))
    ).withColumn("days_left", days_left)
