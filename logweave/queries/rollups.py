"""A: aggregations, timelines and device reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import devices, filters, rollups, silence, timeline
from .inputs import ALIASES_SQL, AS_OF, AS_OF_SQL, RELAY_CERTS_SQL, RELAYS_SQL, Inputs
from .registry import LIBRARY, over_logs, parsed_logs, parsed_sql, query, register

_HOUR, _DAY, _WEEK = (f"{AS_OF_SQL} - INTERVAL {n}" for n in ("1 HOUR", "1 DAY", "7 DAY"))
_ERRORS = "severity IN ('err', 'crit', 'alert', 'emerg')"
_RANGE = filters.LogFilter(start="2024-01-10T00:00:00", end="2024-01-30T23:30:00")
_RANGE_SQL = "timestamp >= TIMESTAMP '2024-01-10 00:00:00' AND timestamp <= TIMESTAMP '2024-01-30 23:30:00'"


@query(
    "dashboard_summary",
    over_logs(
        f"""SELECT count(*) AS total_logs, count(*) FILTER (timestamp >= {_HOUR}) AS logs_last_hour,
        count(*) FILTER (timestamp >= {_DAY}) AS logs_last_day, count(DISTINCT hostname) AS unique_hosts,
        count(DISTINCT fromhost_ip) AS unique_devices FROM logs"""
    ),
)
def dashboard_summary(inp: Inputs) -> DataFrame:
    return rollups.summary(inp.logs(), AS_OF)


_CLOSE = ("hosts", "devices", "messages")


@query(
    "unique_sketches",
    over_logs(
        f"""SELECT CAST(timestamp AS DATE) AS log_date, count(DISTINCT hostname) AS unique_hosts, count(DISTINCT fromhost_ip) AS unique_devices, count(DISTINCT message) AS unique_messages,
        {', '.join(f'TRUE AS {name}_close' for name in _CLOSE)} FROM logs WHERE {_RANGE_SQL} GROUP BY 1"""
    ),
)
def unique_sketches(inp: Inputs) -> DataFrame:
    """Distinct counts a day, and whether those merged from the sketches of its hours lie within four standard errors of them."""
    logs = filters.apply(inp.logs(), _RANGE)
    estimated = rollups.unique_estimates(rollups.unique_sketches(logs), "log_date")
    guesses = estimated.select("log_date", *[F.col(kind).alias(f"_{kind}") for kind in rollups.UNIQUE_KINDS])
    exact = logs.groupBy(F.to_date("timestamp").alias("log_date")).agg(*[F.countDistinct(c).alias(kind) for kind, c in rollups.UNIQUE_KINDS.items()])
    close = [
        (F.abs(F.col(f"_unique_{n}") - F.col(f"unique_{n}")) <= 4 * rollups.UNIQUE_ERROR * F.col(f"unique_{n}")).alias(f"{n}_close") for n in _CLOSE
    ]
    return exact.join(guesses, "log_date").select("log_date", *rollups.UNIQUE_KINDS, *close)


@query("severity_counts", over_logs("SELECT severity, count(*) AS cnt FROM logs GROUP BY severity"))
def severity_counts(inp: Inputs) -> DataFrame:
    return rollups.severity_counts(inp.logs())


@query("severity_counts_range", over_logs(f"SELECT severity, count(*) AS cnt FROM logs WHERE {_RANGE_SQL} GROUP BY severity"))
def severity_counts_range(inp: Inputs) -> DataFrame:
    return rollups.severity_counts(filters.apply(inp.logs(), _RANGE))


_RANK = """CASE severity WHEN 'emerg' THEN 0 WHEN 'emergency' THEN 0 WHEN 'alert' THEN 1 WHEN 'crit' THEN 2 WHEN 'critical' THEN 2 WHEN 'err' THEN 3
    WHEN 'error' THEN 3 WHEN 'warning' THEN 4 WHEN 'warn' THEN 4 WHEN 'notice' THEN 5 WHEN 'info' THEN 6 WHEN 'debug' THEN 7 ELSE 99 END"""


@query(
    "severity_share",
    over_logs(
        f"""SELECT severity, cnt, {_RANK} AS rank, round(cnt * 100.0 / sum(cnt) OVER (), 4) AS percent
        FROM (SELECT severity, count(*) AS cnt FROM logs GROUP BY severity) AS s"""
    ),
)
def severity_share(inp: Inputs) -> DataFrame:
    return rollups.severity_share(rollups.severity_counts(inp.logs()))


@query(
    "top_errors",
    over_logs(
        f"""SELECT left(message, 100) AS message, coalesce(fromhost_ip, '') AS fromhost_ip, min(hostname) AS hostname, count(*) AS cnt
        FROM logs WHERE {_ERRORS} AND timestamp >= {_WEEK} GROUP BY 1, 2 ORDER BY cnt DESC, 1, 2 LIMIT 10"""
    ),
)
def top_errors(inp: Inputs) -> DataFrame:
    return rollups.top_errors(inp.logs(), AS_OF, prefix=100).select("message", "fromhost_ip", "hostname", "cnt")


@query(
    "top_devices",
    over_logs(
        """SELECT coalesce(fromhost_ip, '') AS fromhost_ip, min(hostname) AS hostname, count(*) AS cnt FROM logs GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 10"""
    ),
)
def top_devices(inp: Inputs) -> DataFrame:
    return rollups.top_devices(inp.logs())


@query(
    "range_aggregates",
    over_logs(
        f"""SELECT 'scalar' AS kind, 'total_logs' AS key1, NULL AS key2, NULL AS key3, count(*) AS cnt FROM filtered
        UNION ALL SELECT 'scalar', 'logs_last_hour', NULL, NULL, count(*) FILTER (timestamp >= {_HOUR}) FROM filtered
        UNION ALL SELECT 'scalar', 'logs_last_day', NULL, NULL, count(*) FILTER (timestamp >= {_DAY}) FROM filtered
        UNION ALL SELECT 'scalar', 'unique_devices', NULL, NULL, count(DISTINCT fromhost_ip) FROM filtered
        UNION ALL SELECT 'severity', severity, NULL, NULL, count(*) FROM filtered GROUP BY severity
        UNION ALL SELECT * FROM (SELECT 'device', coalesce(fromhost_ip, '') AS k, min(hostname), NULL, count(*) AS cnt FROM filtered GROUP BY k ORDER BY cnt DESC, k LIMIT 10) AS d
        UNION ALL SELECT * FROM (SELECT 'error', left(message, 100) AS m, coalesce(fromhost_ip, '') AS k, min(hostname), count(*) AS cnt FROM filtered
            WHERE {_ERRORS} GROUP BY m, k ORDER BY cnt DESC, m, k LIMIT 10) AS e""",
        filtered=f"SELECT * FROM logs WHERE {_RANGE_SQL}",
    ),
)
def range_aggregates(inp: Inputs) -> DataFrame:
    return rollups.range_aggregates(filters.apply(inp.logs(), _RANGE), AS_OF, prefix=100)


_LONG = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")
_STATS = (
    "SELECT coalesce(fromhost_ip, '') AS fromhost_ip, min(hostname) AS hostname, count(*) AS total, max(timestamp) AS last_seen, "
    + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}_count" for s in _LONG)
    + " FROM logs GROUP BY 1"
)
_LAST_RELAY = """SELECT k AS fromhost_ip, via_relay FROM (SELECT coalesce(fromhost_ip, '') AS k, via_relay, row_number() OVER (PARTITION BY coalesce(fromhost_ip, '')
    ORDER BY timestamp DESC, coalesce(via_relay, '') DESC) AS rn FROM logs) AS r WHERE rn = 1"""
_STATS_COLUMNS = "s.fromhost_ip, s.hostname, s.total, s.last_seen, " + ", ".join(f"s.{s}_count" for s in _LONG) + ", r.via_relay"
_STATS_JOIN = "stats s JOIN relay r ON r.fromhost_ip = s.fromhost_ip"


@query("device_stats", over_logs(f"SELECT {_STATS_COLUMNS} FROM {_STATS_JOIN}", stats=_STATS, relay=_LAST_RELAY))
def device_stats(inp: Inputs) -> DataFrame:
    return devices.device_stats(inp.logs())


_PARSED = parsed_sql(LIBRARY, [])
_DEV_PARSERS = """SELECT fromhost_ip, string_agg(p, ',' ORDER BY p) AS parsers FROM
    (SELECT DISTINCT coalesce(fromhost_ip, '') AS fromhost_ip, unnest(parsers) AS p FROM parsed) AS u GROUP BY fromhost_ip"""


@query("device_parsers", over_logs("SELECT * FROM dp", parsed=_PARSED, dp=_DEV_PARSERS))
def device_parsers(inp: Inputs) -> DataFrame:
    found = devices.device_parsers(parsed_logs(inp, LIBRARY))
    return found.withColumn("parsers", F.concat_ws(",", "parsers"))


_FULL_CTES = {"stats": _STATS, "relay": _LAST_RELAY, "parsed": _PARSED, "dp": _DEV_PARSERS}
_FULL = f"SELECT {_STATS_COLUMNS}, coalesce(dp.parsers, '') AS parsers FROM {_STATS_JOIN} LEFT JOIN dp ON dp.fromhost_ip = s.fromhost_ip"


def _full(inp: Inputs) -> DataFrame:
    logs = inp.logs()
    return devices.device_stats_full(devices.device_stats(logs), devices.device_parsers(parsed_logs(inp, LIBRARY)))


@query("device_stats_full", over_logs(_FULL, **_FULL_CTES))
def device_stats_full(inp: Inputs) -> DataFrame:
    return _full(inp).withColumn("parsers", F.concat_ws(",", "parsers"))


_LIST = """SELECT f.fromhost_ip, f.hostname, f.total, f.last_seen, coalesce(a.display_name, '') AS display_name, coalesce(a.old_hostname, '') AS old_hostname,
    f.parsers <> '' AS has_parsed, coalesce(f.via_relay <> '', FALSE) AS uses_proxy FROM full_stats f LEFT JOIN aliases a ON a.fromhost_ip = f.fromhost_ip"""
_LIST_COLUMNS = ("fromhost_ip", "hostname", "total", "last_seen", "display_name", "old_hostname", "has_parsed", "uses_proxy")
_LIST_CTES = {**_FULL_CTES, "full_stats": _FULL, "aliases": ALIASES_SQL}


@query("device_list", over_logs(_LIST, **_LIST_CTES))
def device_list(inp: Inputs) -> DataFrame:
    return devices.device_list(_full(inp), inp.sql(ALIASES_SQL, with_logs=True)).select(*_LIST_COLUMNS)


@query("device_list_top", over_logs("SELECT * FROM listing ORDER BY total DESC, fromhost_ip LIMIT 20", **_LIST_CTES, listing=_LIST))
def device_list_top(inp: Inputs) -> DataFrame:
    listing = devices.device_list(_full(inp), inp.sql(ALIASES_SQL, with_logs=True))
    return devices.device_list_top(listing, 20).select(*_LIST_COLUMNS)


# Old names in the fixture carry a suffix, so a third of the rows is looked up by an old name.
_RENAMED = "CASE WHEN id % 3 = 0 THEN hostname || '-old' ELSE hostname END"
_NAME_ROWS = f"SELECT id, {_RENAMED} AS hostname, CASE WHEN id % 3 = 0 THEN NULL ELSE fromhost_ip END AS fromhost_ip FROM logs"


@query(
    "device_display_name",
    over_logs(
        """SELECT n.id, coalesce(nullif(i.display_name, ''), nullif(o.display_name, ''), nullif(n.hostname, ''), nullif(n.fromhost_ip, ''), '-') AS shown_name
        FROM named n LEFT JOIN aliases i ON i.fromhost_ip = n.fromhost_ip
        LEFT JOIN (SELECT old_hostname, min(display_name) AS display_name FROM aliases GROUP BY 1) o ON o.old_hostname = n.hostname""",
        named=_NAME_ROWS,
        aliases=ALIASES_SQL,
    ),
)
def device_display_name(inp: Inputs) -> DataFrame:
    rows = inp.sql(_NAME_ROWS, with_logs=True)
    return devices.resolve_names(rows, inp.sql(ALIASES_SQL, with_logs=True)).select("id", "shown_name")


_CHANGES = """SELECT fromhost_ip, 'Renamed ' || CAST(max(id) AS STRING) AS display_name FROM logs WHERE fromhost_ip IS NOT NULL AND severity = 'error' GROUP BY fromhost_ip"""


@query(
    "alias_upsert",
    over_logs(
        """SELECT coalesce(a.fromhost_ip, c.fromhost_ip) AS fromhost_ip, coalesce(c.display_name, a.display_name) AS display_name,
        CASE WHEN c.fromhost_ip IS NOT NULL THEN l.hostname ELSE a.old_hostname END AS old_hostname
        FROM aliases a FULL OUTER JOIN changes c ON a.fromhost_ip = c.fromhost_ip
        LEFT JOIN (SELECT * FROM (SELECT coalesce(fromhost_ip, '') AS k, hostname, row_number() OVER (PARTITION BY coalesce(fromhost_ip, '')
            ORDER BY timestamp DESC, hostname DESC) AS rn FROM logs) AS x WHERE rn = 1) l ON l.k = c.fromhost_ip""",
        aliases=ALIASES_SQL,
        changes=_CHANGES,
    ),
)
def alias_upsert(inp: Inputs) -> DataFrame:
    aliases, changes = inp.sql(ALIASES_SQL, with_logs=True), inp.sql(_CHANGES, with_logs=True)
    return devices.upsert_aliases(aliases, changes, inp.logs())


# --- timelines ---


@query("timeline_hourly", over_logs("SELECT date_trunc('hour', timestamp) AS hour, count(*) AS cnt FROM logs GROUP BY 1"))
def timeline_hourly(inp: Inputs) -> DataFrame:
    return timeline.hourly(inp.logs())


def _trunc(unit: str, zone: str, column: str = "timestamp") -> str:
    if zone == "UTC":
        return f"CAST(date_trunc('{unit}', {column}) AS TIMESTAMP)"
    local = f"timezone('{zone}', timezone('UTC', {column}))"
    return f"timezone('UTC', timezone('{zone}', CAST(date_trunc('{unit}', {local}) AS TIMESTAMP)))"


def _rollup_timeline(name: str, interval: str, unit: str, days: int, zone: str | None, sql_zone: str) -> None:
    def build(inp: Inputs) -> DataFrame:
        logs = inp.logs()
        return timeline.timeline(logs, timeline.hourly(logs), interval, AS_OF, zone)

    since = f"date_trunc('hour', timestamp) >= {AS_OF_SQL} - INTERVAL {days} DAY"
    register(name, build, over_logs(f"SELECT {_trunc(unit, sql_zone)} AS ts, CAST(count(*) AS BIGINT) AS cnt FROM logs WHERE {since} GROUP BY 1"))


_rollup_timeline("timeline_hour", "1h", "hour", 7, "UTC", "UTC")
_rollup_timeline("timeline_day", "day", "day", 30, "Europe/Warsaw", "Europe/Warsaw")
_rollup_timeline("timeline_week", "1w", "week", 90, "America/New_York", "America/New_York")
_rollup_timeline("timeline_month", "1mon", "month", 365, "Asia/Tokyo", "Asia/Tokyo")
_rollup_timeline("timeline_bad_tz", "day", "day", 30, "Mars/Olympus", "UTC")
_rollup_timeline("timeline_tz", "1d", "day", 30, "Asia/Kolkata", "Asia/Kolkata")


@query("timeline_minute", over_logs(f"SELECT date_trunc('minute', timestamp) AS ts, count(*) AS cnt FROM logs WHERE timestamp >= {_DAY} GROUP BY 1"))
def timeline_minute(inp: Inputs) -> DataFrame:
    return timeline.timeline(inp.logs(), None, "15m", AS_OF)


@query("timeline_range", over_logs(f"SELECT {_trunc('hour', 'Asia/Kolkata')} AS ts, count(*) AS cnt FROM logs WHERE {_RANGE_SQL} GROUP BY 1"))
def timeline_range(inp: Inputs) -> DataFrame:
    return timeline.timeline(inp.logs(), None, "6h", AS_OF, "Asia/Kolkata", start=_RANGE.start, end=_RANGE.end)


_NOW = "2024-01-15T10:00:00"


@query(
    "log_rate",
    over_logs(
        """SELECT count(*) AS events, count(*) / 3600.0 AS per_second FROM logs
        WHERE timestamp >= TIMESTAMP '2024-01-15 09:00:00' AND timestamp <= TIMESTAMP '2024-01-15 10:00:00'"""
    ),
)
def log_rate(inp: Inputs) -> DataFrame:
    return rollups.log_rate(inp.logs(), _NOW, seconds=3600)


_EXTERNAL = filters.Scope(severities=("err", "info", "debug"))


def _external(inp: Inputs) -> DataFrame:
    return filters.restrict(filters.apply(inp.logs(), _RANGE), _EXTERNAL)


_EXTERNAL_SQL = f"{_RANGE_SQL} AND severity IN ('err', 'info', 'debug')"


@query("external_stats_severity", over_logs(f"SELECT severity, count(*) AS cnt FROM logs WHERE {_EXTERNAL_SQL} GROUP BY 1"))
def external_stats_severity(inp: Inputs) -> DataFrame:
    return rollups.severity_counts(_external(inp))


@query(
    "external_stats_hosts",
    over_logs(f"SELECT hostname, count(*) AS cnt FROM logs WHERE {_EXTERNAL_SQL} GROUP BY 1 ORDER BY cnt DESC, hostname LIMIT 20"),
)
def external_stats_hosts(inp: Inputs) -> DataFrame:
    return rollups.top_hosts(_external(inp))


@query("rollup_watermark", over_logs("SELECT epoch_us(max(timestamp)) AS version FROM logs"))
def rollup_watermark(inp: Inputs) -> DataFrame:
    return rollups.data_version(inp.logs())


@query(
    "relay_liveness",
    over_logs(
        f"""SELECT r.label, coalesce(c.status, 'none') AS cert_status, s.status, CASE WHEN s.status IN ('online', 'stale') THEN v.last_seen END AS last_seen,
        CASE WHEN s.status IN ('online', 'stale') THEN CAST(floor((epoch_us({AS_OF_SQL}) - epoch_us(v.last_seen)) / 1000000) AS BIGINT) END AS seconds_since_seen
        FROM relays r LEFT JOIN certs c ON c.id = r.relay_cert_id LEFT JOIN seen v ON v.label = r.label,
        LATERAL (SELECT CASE WHEN c.status = 'revoked' THEN 'cert_revoked' WHEN v.last_seen IS NULL THEN 'never_seen'
            WHEN {AS_OF_SQL} - v.last_seen <= INTERVAL 10 MINUTE THEN 'online' ELSE 'stale' END AS status) s""",
        relays=RELAYS_SQL,
        certs=RELAY_CERTS_SQL,
        seen="SELECT via_relay AS label, max(timestamp) AS last_seen FROM logs WHERE via_relay IS NOT NULL GROUP BY 1",
    ),
)
def relay_liveness(inp: Inputs) -> DataFrame:
    return devices.relay_liveness(inp.logs(), inp.sql(RELAYS_SQL), inp.sql(RELAY_CERTS_SQL), AS_OF)


SILENCE_RULES = [
    silence.SilenceRule(1, threshold=900, cooldown_minutes=60),
    silence.SilenceRule(2, threshold=0, cooldown_minutes=600, device_ips=("10.0.1.2", "10.0.2.3", "10.0.3.4", "10.0.0.5")),
    silence.SilenceRule(3, threshold=240, device_ips=tuple(f"10.0.1.{b}" for b in range(1, 90))),
]
SILENCE_VALUES = """(SELECT CAST(rule_id AS BIGINT) AS rule_id, CAST(m AS BIGINT) AS minutes, CAST(c AS BIGINT) AS cooldown
    FROM (VALUES (1, 900, 60), (2, 15, 600), (3, 240, 0)) AS v(rule_id, m, c)) AS rules"""
SILENCE_APPLIES = """(rule_id = 1 OR (rule_id = 2 AND fromhost_ip IN ('10.0.1.2', '10.0.2.3', '10.0.3.4', '10.0.0.5'))
    OR (rule_id = 3 AND fromhost_ip LIKE '10.0.1.%' AND CAST(split_part(fromhost_ip, '.', 4) AS INT) < 90))"""
LAST_SEEN = "SELECT fromhost_ip, min(hostname) AS hostname, max(timestamp) AS last_seen FROM logs WHERE fromhost_ip IS NOT NULL GROUP BY 1"


def last_seen(inp: Inputs) -> DataFrame:
    """Known devices with their newest row."""
    return devices.device_stats(inp.logs().filter("fromhost_ip IS NOT NULL")).select("fromhost_ip", "hostname", "last_seen")


@query(
    "device_silence_status",
    over_logs(
        f"""SELECT d.fromhost_ip, t.m AS threshold_minutes, CASE WHEN t.m IS NULL THEN 'no_rule'
            WHEN {AS_OF_SQL} - d.last_seen >= t.m * INTERVAL 1 MINUTE THEN 'silent' ELSE 'ok' END AS silence_status
        FROM devices d LEFT JOIN (SELECT fromhost_ip, min(minutes) AS m FROM devices, {SILENCE_VALUES} WHERE rule_id > 1 AND {SILENCE_APPLIES} GROUP BY 1) t
            ON t.fromhost_ip = d.fromhost_ip""",
        devices=LAST_SEEN,
    ),
)
def device_silence_status(inp: Inputs) -> DataFrame:
    return silence.status(last_seen(inp), SILENCE_RULES[1:], AS_OF).select("fromhost_ip", "threshold_minutes", "silence_status")
