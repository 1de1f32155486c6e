"""N: notification and audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import notifications
from .alerts import split_users
from .inputs import (
    ALERT_CHANNELS_SQL,
    ALERTS_SQL,
    AUDIT_SQL,
    CHANNELS_SQL,
    IN_APP_SQL,
    NOTIFICATION_LOG_SQL,
    READ_STATE_SQL,
    Inputs,
)
from .registry import query

_USER = 8
_ADMIN = "('audit_log', 'relay_cert_expiring', 'malformed_json')"


def _has(users: str) -> str:
    return f"coalesce(list_contains(string_split({users}, ','), '{_USER}'), FALSE)"


def _with(**ctes: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({t})" for n, t in ctes.items()) + " "


def _channels(inp: Inputs) -> DataFrame:
    return split_users(inp.sql(CHANNELS_SQL), "users", "user_ids")


def _in_app(inp: Inputs) -> DataFrame:
    return split_users(inp.sql(IN_APP_SQL), "targets", "target_user_ids")


@query(
    "visible_rules",
    _with(alerts=ALERTS_SQL, alert_channels=ALERT_CHANNELS_SQL, channels=CHANNELS_SQL)
    + f"""SELECT id, name, rule_type FROM alerts a WHERE rule_type NOT IN {_ADMIN} OR EXISTS (SELECT 1 FROM alert_channels ac JOIN channels c ON c.id = ac.channel_id
        WHERE ac.alert_id = a.id AND ({_has('c.users')} OR (c.type = 'push' AND c.users = '')))""",
)
def visible_rules(inp: Inputs) -> DataFrame:
    return notifications.visible_rules(inp.sql(ALERTS_SQL), inp.sql(ALERT_CHANNELS_SQL), _channels(inp), _USER)


@query(
    "notification_history",
    _with(log=NOTIFICATION_LOG_SQL, in_app=IN_APP_SQL, channels=CHANNELS_SQL)
    + f"""SELECT l.id, l.alert_name, l.rule_type, l.status, l.created_at FROM log l LEFT JOIN in_app i ON i.id = l.in_app_notification_id LEFT JOIN channels c ON c.id = l.channel_id
    WHERE l.rule_type NOT IN {_ADMIN} OR {_has('i.targets')} OR {_has('c.users')} OR coalesce(c.type = 'push' AND c.users = '', FALSE)
    ORDER BY l.created_at DESC, l.id DESC LIMIT 500""",
)
def notification_history(inp: Inputs) -> DataFrame:
    history = notifications.notification_history(inp.sql(NOTIFICATION_LOG_SQL), _in_app(inp), _channels(inp), _USER, limit=500)
    return history.select("id", "alert_name", "rule_type", "status", "created_at")


@query(
    "history_by_firing",
    _with(log=NOTIFICATION_LOG_SQL)
    + """SELECT coalesce(firing_id, 'single-' || CAST(id AS VARCHAR)) AS firing, arg_max(alert_name, id) AS alert_name, arg_max(rule_type, id) AS rule_type,
        max(created_at) AS created_at, string_agg(CAST(id AS VARCHAR) || ' ' || channel_name || ' ' || status, ';' ORDER BY id) AS channels FROM log GROUP BY 1""",
)
def history_by_firing(inp: Inputs) -> DataFrame:
    grouped = notifications.history_by_firing(inp.sql(NOTIFICATION_LOG_SQL))
    line = lambda c: F.concat_ws(" ", c["id"].cast("string"), c["channel_name"], c["status"])
    return grouped.withColumn("channels", F.concat_ws(";", F.transform("channels", line)))


_FEED = f"({_has('targets')} OR (targets IS NULL AND alert_rule_type NOT IN {_ADMIN}))"


@query(
    "user_feed",
    _with(in_app=IN_APP_SQL) + f"SELECT id, title, alert_rule_type, targets, created_at FROM in_app WHERE id > 100 AND {_FEED} ORDER BY id DESC LIMIT 200",
)
def user_feed(inp: Inputs) -> DataFrame:
    feed = notifications.user_feed(_in_app(inp), _USER, since_id=100, limit=200)
    ids = F.when(F.col("target_user_ids").isNotNull(), F.concat_ws(",", F.col("target_user_ids").cast("array<string>")))
    return feed.select("id", "title", "alert_rule_type", ids.alias("targets"), "created_at")


@query(
    "unread_count",
    _with(in_app=IN_APP_SQL, state=READ_STATE_SQL)
    + f"""SELECT count(*) AS unread, coalesce(max(id), (SELECT max(last_read_id) FROM state WHERE user_id = {_USER}), 0) AS last_id
    FROM in_app WHERE id > coalesce((SELECT max(last_read_id) FROM state WHERE user_id = {_USER}), 0) AND {_FEED}""",
)
def unread_count(inp: Inputs) -> DataFrame:
    return notifications.unread_counts(_in_app(inp), inp.sql(READ_STATE_SQL), _USER)


_MARKS = "SELECT user_id, max(event_id) - 2000 AS last_read_id FROM events WHERE event_type = 'purchase' AND value > 60 GROUP BY user_id"


@query(
    "mark_read",
    _with(state=READ_STATE_SQL, marks=_MARKS)
    + "SELECT coalesce(s.user_id, m.user_id) AS user_id, greatest(s.last_read_id, m.last_read_id) AS last_read_id FROM state s FULL OUTER JOIN marks m ON s.user_id = m.user_id",
)
def mark_read(inp: Inputs) -> DataFrame:
    return notifications.mark_read(inp.sql(READ_STATE_SQL), inp.sql(_MARKS))


_AUDIT_WHERE = """username ILIKE '%admin4%' AND action = 'delete_user' AND created_at >= TIMESTAMP '1995-01-01 00:00:00'
    AND created_at <= TIMESTAMP '1999-12-31 00:00:00'"""


def _audit(inp: Inputs) -> DataFrame:
    return notifications.audit_filter(inp.sql(AUDIT_SQL), "admin4", "delete_user", "1995-01-01T00:00:00", "1999-12-31T00:00:00")


@query(
    "audit_search",
    _with(audit=AUDIT_SQL) + f"SELECT id, username, action, created_at FROM audit WHERE {_AUDIT_WHERE} ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 5",
)
def audit_search(inp: Inputs) -> DataFrame:
    return notifications.audit_page(_audit(inp), offset=5).select("id", "username", "action", "created_at")


@query("audit_count", _with(audit=AUDIT_SQL) + f"SELECT count(*) AS total FROM audit WHERE {_AUDIT_WHERE}")
def audit_count(inp: Inputs) -> DataFrame:
    return _audit(inp).agg(F.count("*").alias("total"))


@query("slow_query_count", _with(audit=AUDIT_SQL) + "SELECT count(*) AS total FROM audit WHERE action = 'slow_query'")
def slow_query_count(inp: Inputs) -> DataFrame:
    return notifications.slow_query_count(inp.sql(AUDIT_SQL))
