"""Which channels and users a firing reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Channel types whose targets are merged into one delivery per firing.
MERGED_TYPES = ("push", "in_app")


def fan_out(firings: DataFrame, alert_channels: DataFrame, channels: DataFrame) -> DataFrame:
    """One row per delivery: (firing columns, channel_id, channel_type, targets).

    ``channels`` has id, type, enabled, user_ids. Push and in-app deliveries go out once, on
    the first channel of the type, to the union of all their users; any empty list makes it
    a broadcast (NULL targets). A firing without channels gives one ``no_channel`` row. The
    merge runs over the rule's channels, before the firings are joined.
    """
    attached = alert_channels.join(
        channels.filter("enabled").select(F.col("id").alias("channel_id"), "type", "user_ids"), "channel_id"
    )
    merged_type = F.col("type").isin(*MERGED_TYPES)
    per_delivery = attached.groupBy(
        F.col("alert_id").alias("rule_id"),
        F.col("type").alias("channel_type"),
        F.when(~merged_type, F.col("channel_id")).alias("_own"),
    ).agg(
        F.min("channel_id").alias("channel_id"),
        F.max(F.size("user_ids") == 0).alias("_broadcast"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("user_ids")))).alias("_users"),
    )
    targets = F.when(F.col("channel_type").isin(*MERGED_TYPES) & ~F.col("_broadcast"), F.col("_users"))
    deliveries = per_delivery.select("rule_id", "channel_id", "channel_type", targets.alias("targets"))
    return firings.join(deliveries, "rule_id", "left").withColumn(
        "status", F.when(F.col("channel_id").isNull(), "no_channel").otherwise("deliver")
    )
