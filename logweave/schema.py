"""Table shapes shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

FIELDS = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("label", T.StringType()),
            T.StructField("type", T.StringType()),
        ]
    )
)

RULE_LIBRARY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("match_type", T.StringType()),
        T.StructField("match_value", T.StringType()),
        T.StructField("regex", T.StringType()),
        T.StructField("fields", FIELDS),
        T.StructField("description", T.StringType()),
    ]
)

LOGS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("hostname", T.StringType(), False),
        T.StructField("fromhost_ip", T.StringType()),
        T.StructField("app_name", T.StringType()),
        T.StructField("process_id", T.StringType()),
        T.StructField("msg_id", T.StringType()),
        T.StructField("severity", T.StringType(), False),
        T.StructField("facility", T.StringType()),
        T.StructField("message", T.StringType(), False),
        T.StructField("raw_message", T.StringType()),
        T.StructField("parsed_fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("matched_parsers", T.ArrayType(T.StringType())),
        T.StructField("via_relay", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# The stored column widths.
MAX_LENGTHS = {
    "hostname": 255,
    "fromhost_ip": 255,
    "app_name": 255,
    "process_id": 50,
    "msg_id": 50,
    "severity": 20,
    "facility": 50,
    "via_relay": 255,
}

# Columns a field filter may name directly; anything else is a parsed field.
FILTERABLE_COLUMNS = (
    "hostname",
    "fromhost_ip",
    "severity",
    "app_name",
    "facility",
    "process_id",
    "msg_id",
    "message",
    "raw_message",
)

# Rule types only an administrator sees unless deliberately targeted.
ADMIN_ONLY_RULE_TYPES = ("audit_log", "relay_cert_expiring", "malformed_json")
