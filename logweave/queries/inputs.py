"""Input tables of the registered queries, derived from the given tables.

The expressions below are plain SQL that Spark and DuckDB both accept, so the library and its
check read identical rows. They cover every selector kind, both severity spellings, devices
without an address and rows forwarded by relays.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..session import use_utc, work_dir
from ..sources import tables

# The tables span January 2024.
AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"

_K = "regexp_extract(props, '([0-9]+)', 1)"
_USER = "CAST(user_id AS STRING)"
_MAC = "'aa:bb:cc:dd:ee:' || lpad(CAST(user_id % 100 AS STRING), 2, '0')"

LOG_COLUMNS = {
    "id": "event_id",
    "timestamp": "ts",
    "hostname": f"""CASE user_id % 6 WHEN 0 THEN 'ubnt-ap' WHEN 1 THEN 'cisco-sw' WHEN 2 THEN 'fgt-' WHEN 3 THEN 'mikrotik-'
        WHEN 4 THEN 'srv-' ELSE 'web-' END || {_USER}""",
    "fromhost_ip": """CASE WHEN user_id % 13 = 0 THEN NULL
        ELSE '10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 250 + 1 AS STRING) END""",
    "app_name": """CASE user_id % 6
        WHEN 4 THEN (CASE event_id % 6 WHEN 0 THEN 'sshd' WHEN 1 THEN 'CRON' WHEN 2 THEN 'sshd' WHEN 3 THEN 'systemd' ELSE 'kernel' END)
        WHEN 5 THEN NULL ELSE 'kernel' END""",
    "process_id": "CASE WHEN user_id % 6 = 4 THEN CAST(event_id % 30000 AS STRING) ELSE NULL END",
    "severity": """CASE WHEN event_type = 'error' AND value > 100 THEN 'crit' WHEN event_type = 'error' THEN 'err'
        WHEN event_type = 'purchase' THEN 'notice' WHEN event_type = 'signup' THEN 'info' WHEN event_type = 'view' THEN 'debug'
        WHEN event_id % 7 = 0 THEN 'error' WHEN event_id % 11 = 0 THEN 'emergency' ELSE 'warning' END""",
    "facility": "CASE WHEN event_id % 3 = 0 THEN 'local0' ELSE 'auth' END",
    "message": f"""CASE user_id % 6
        WHEN 0 THEN (CASE WHEN event_id % 2 = 0 THEN 'AP ' || {_MAC} || ' connected on site' || CAST(user_id % 3 AS STRING)
            ELSE 'client ' || {_MAC} || ' roamed on guest' || CAST(user_id % 5 AS STRING) || ' channel ' || {_K} END)
        WHEN 1 THEN (CASE event_id % 3
            WHEN 0 THEN '%BGP-5-ADJCHANGE: Neighbor 10.9.0.' || {_K} || ' session ' || (CASE WHEN event_id % 2 = 0 THEN 'Down' ELSE 'Up' END)
            WHEN 1 THEN '%LINK-3-UPDN: Interface Gi0/' || {_K} || ', change is up'
            ELSE '%SEC_LOGIN-4-FAILED: User=admin, Method=ssh, Reason=password, Info=try' || {_K} END)
        WHEN 2 THEN (CASE WHEN event_id % 3 = 0
            THEN 'traffic src=10.1.0.' || CAST(user_id % 250 AS STRING) || ' dst=10.2.0.' || {_K}
                || ' srcport=1024 dstport=443 action=accept policyid=' || {_K} || ' sessionid=' || CAST(event_id AS STRING)
                || ' proto=6 service=HTTPS devpriority=high utmstatus=allow'
            ELSE 'threat src=10.1.0.' || CAST(user_id % 250 AS STRING) || ' dst=10.2.0.' || {_K}
                || ' action=deny policyid=7 utmstatus=on msg="blocked by policy ' || {_K} || '"' END)
        WHEN 3 THEN (CASE event_id % 3
            WHEN 0 THEN 'User user' || {_USER} || ' logged ' || (CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END) || ' from 10.3.0.' || {_K}
            WHEN 1 THEN 'DHCPLease:assigned address=10.3.1.' || {_K} || ' mac-address=' || {_MAC}
            ELSE 'interface ether' || CAST(user_id % 8 AS STRING) || ' link ' || (CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END) END)
        WHEN 4 THEN (CASE event_id % 6
            WHEN 0 THEN 'Accepted password for user' || {_USER} || ' from 10.4.0.' || {_K} || ' port 22'
            WHEN 1 THEN '(root) CMD (backup ' || {_K} || ')'
            WHEN 2 THEN 'Failed password for invalid user guest' || {_USER} || ' from 10.4.1.' || {_K} || ' port 22'
            WHEN 3 THEN 'Started backup-' || {_K} || '.service'
            WHEN 4 THEN 'pam_unix(sshd:session): opened for user user' || {_USER} || '(uid=' || {_K} || ') by root'
            ELSE 'DROP IN=eth0 OUT= SRC=10.4.2.' || {_K} || ' DST=10.4.3.1' END)
        ELSE (CASE event_id % 4
            WHEN 0 THEN event_type || ' request failed connection timeout code ' || {_K}
            WHEN 1 THEN 'proxy from=10.5.0.' || {_K} || ' to=10.6.0.1 mac=' || {_MAC}
            WHEN 2 THEN '{{"time":"t' || {_K} || '","source":"dc1","event_id":4624,"event_data":{{"TargetUserName":"u' || {_USER}
                || '","TargetDomainName":"CORP","TargetSid":"S-1","LogonType":"3"}}}}'
            ELSE 'connections to upstream were ' || event_type || 'ed after timeouts' END) END""".replace("{{", "{").replace("}}", "}"),
    "raw_message": "CASE WHEN event_id % 9 = 0 THEN 'raw copy ' || event_type ELSE NULL END",
    "via_relay": "CASE WHEN event_id % 5 = 0 THEN 'relay-a' WHEN event_id % 5 = 1 THEN 'relay-b' ELSE NULL END",
}


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ",\n  ".join(f"{expr} AS {name}" for name, expr in columns.items()) + f"\nFROM {source}"


LOGS_SQL = _select(LOG_COLUMNS, "events")

_TS = "CAST(timestamp AS STRING)"
_MONTH = "substring('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(EXTRACT(month FROM timestamp) AS INT) * 3 - 2, 3)"
_DAY = "lpad(CAST(EXTRACT(day FROM timestamp) AS STRING), 2, ' ')"
_TIME = f"substring({_TS}, 12, 8)"

# The same instant in each accepted layout, plus one that is not accepted.
STAMP_SQL = f"""CASE id % 7
    WHEN 0 THEN replace({_TS}, ' ', 'T') || 'Z'
    WHEN 1 THEN replace({_TS}, ' ', 'T')
    WHEN 2 THEN {_TS}
    WHEN 3 THEN {_MONTH} || ' ' || {_DAY} || ' ' || {_TIME}
    WHEN 4 THEN 'Mon ' || {_MONTH} || ' ' || {_DAY} || ' ' || {_TIME} || ' UTC ' || CAST(EXTRACT(year FROM timestamp) AS STRING)
    WHEN 5 THEN replace({_TS}, ' ', 'T') || '+02:00'
    ELSE 'yesterday ' || {_TIME} END"""

_ESCAPED = """replace(message, '"', chr(92) || '"')"""
_IP = "coalesce(fromhost_ip, '')"
_APP = """CASE WHEN id % 23 = 0 THEN substring(CAST(timestamp AS STRING), 1, 10) || 'T' || substring(CAST(timestamp AS STRING), 12, 2)
    ELSE coalesce(app_name, '') END"""
_BODY = f"CASE WHEN id % 46 = 0 THEN '15:04 host CEF:0|x|' || {_ESCAPED} WHEN id % 19 = 0 THEN 'a' || chr(92) || 'u0000b' || {_ESCAPED} ELSE {_ESCAPED} END"
_HOST = "CASE WHEN id % 29 = 0 THEN '' ELSE hostname END"
_STAMPED = f"({STAMP_SQL})"

_WHOLE_LINE = f"""CASE id % 4
    WHEN 0 THEN '{{"timestamp":"' || {_STAMPED} || '","hostname":"' || {_HOST} || '","fromhost-ip":"' || (CASE WHEN id % 58 = 0 THEN '' ELSE {_IP} END)
        || '","app_name":"' || {_APP} || '","process_id":"' || coalesce(process_id, '') || '","severity":"' || severity
        || '","facility":"' || facility || '","message":"' || {_BODY} || '","syslog_tag":"tag' || CAST(id % 5 AS STRING)
        || '","via_relay":"' || coalesce(via_relay, '') || '"}}'
    WHEN 1 THEN '{{"timestamp":"","@timestamp":"' || {_STAMPED} || '","hostname":"' || {_HOST} || '","fromhost_ip":"' || {_IP}
        || '","program":"' || {_APP} || '","pid":"' || coalesce(process_id, '') || '","severity_text":"' || severity
        || '","facility_text":"' || facility || '","msg":"' || {_BODY} || '","msg_id":"ignored"}}'
    WHEN 2 THEN '{{"timereported":"' || {_STAMPED} || '","fromhost-ip":"' || {_IP} || '","programname":"' || {_APP}
        || '","procid":' || CAST(id AS STRING) || ',"syslogseverity-text":"' || severity || '","syslogfacility-text":"' || facility
        || '","message":"' || {_BODY} || '","raw_message":"raw ' || {_BODY} || '"}}'
    ELSE '{{"timestamp":"' || {_STAMPED} || '","hostname":"' || {_HOST} || '","severity":"' || severity || '","message":"' || {_BODY} || '"}}' END""".replace(
    "{{", "{"
).replace("}}", "}")

LINE_COLUMNS = {
    "id": "id",
    "whole": _WHOLE_LINE,
}
# Some lines are damaged: cut short, syntactically wrong, or only the tail of a record.
DAMAGE_SQL = """CASE
    WHEN id % 17 = 3 THEN left(whole, CAST(length(whole) - 3 - id % 20 AS INT))
    WHEN id % 31 = 5 THEN '{' || 'oops ' || whole
    WHEN id % 37 = 6 THEN right(whole, 20)
    ELSE whole END"""

LINES_SQL = f"""SELECT id, {DAMAGE_SQL} AS line FROM ({_select(LINE_COLUMNS, "logs")}) AS w"""

_PRI = "CAST((CASE WHEN facility = 'auth' THEN 4 ELSE 16 END) * 8 + id % 8 AS STRING)"
SYSLOG_SQL = f"""SELECT id, CASE WHEN id % 41 = 0 THEN 'no header ' || message ELSE
    '<' || {_PRI} || '>' || {_MONTH} || ' ' || {_DAY} || ' ' || {_TIME} || ' ' || hostname || ' ' || coalesce(app_name, 'app')
    || (CASE WHEN process_id IS NULL THEN '' ELSE '[' || process_id || ']' END) || ': ' || message END AS line
FROM logs"""

ALIASES_SQL = """SELECT fromhost_ip, 'Device ' || CAST(min(id) AS STRING) AS display_name, min(hostname) || '-old' AS old_hostname
FROM logs WHERE fromhost_ip IS NOT NULL AND severity = 'emergency' GROUP BY fromhost_ip"""

AUDIT_SQL = """SELECT o_orderkey AS id, o_custkey AS user_id,
    CASE WHEN o_custkey % 10 = 0 THEN 'Admin' || CAST(o_custkey % 50 AS STRING) ELSE 'user_' || CAST(o_custkey AS STRING) END AS username,
    CASE o_orderkey % 5 WHEN 0 THEN 'login' WHEN 1 THEN 'logout' WHEN 2 THEN 'update_rule' WHEN 3 THEN 'slow_query' ELSE 'delete_user' END AS action,
    o_orderpriority AS details, o_orderdate AS created_at FROM orders"""

# Target users are carried as comma-separated text, which both engines split.
CHANNELS_SQL = """SELECT s_suppkey AS id, s_name AS name,
    CASE s_suppkey % 4 WHEN 0 THEN 'push' WHEN 1 THEN 'in_app' WHEN 2 THEN 'email' ELSE 'webhook' END AS type,
    s_suppkey % 11 <> 0 AS enabled,
    CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE CAST(s_suppkey % 7 AS STRING) || ',' || CAST(s_suppkey % 5 + 7 AS STRING) END AS users
FROM supplier"""
ALERTS_SQL = """SELECT c_custkey AS id, c_name AS name,
    CASE c_custkey % 5 WHEN 0 THEN 'log_threshold' WHEN 1 THEN 'device_silence' WHEN 2 THEN 'audit_log' WHEN 3 THEN 'relay_cert_expiring'
        ELSE 'malformed_json' END AS rule_type FROM customer"""
ALERT_CHANNELS_SQL = """SELECT DISTINCT o_custkey AS alert_id, o_orderkey % (SELECT max(s_suppkey) + 1 FROM supplier) AS channel_id
FROM orders WHERE o_orderstatus = 'F'"""
IN_APP_SQL = """SELECT event_id AS id, user_id AS alert_id, 'Alert ' || event_type AS title,
    CASE event_id % 4 WHEN 0 THEN 'audit_log' WHEN 1 THEN 'malformed_json' ELSE 'log_threshold' END AS alert_rule_type,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS STRING) || ',' || CAST(user_id % 10 AS STRING) END AS targets,
    ts AS created_at FROM events"""
NOTIFICATION_LOG_SQL = """SELECT event_id AS id, user_id AS alert_id, 'rule ' || CAST(user_id AS STRING) AS alert_name,
    CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'f' || CAST(event_id - event_id % 3 AS STRING) END AS firing_id,
    event_id % (SELECT max(s_suppkey) + 1 FROM supplier) AS channel_id, 'channel ' || event_type AS channel_name,
    CASE event_id % 4 WHEN 0 THEN 'sent' WHEN 1 THEN 'failed' WHEN 2 THEN 'partial' ELSE 'no_channel' END AS status,
    CASE event_id % 3 WHEN 0 THEN 'audit_log' WHEN 1 THEN 'relay_cert_expiring' ELSE 'log_threshold' END AS rule_type,
    CASE WHEN event_id % 2 = 0 THEN event_id ELSE NULL END AS in_app_notification_id, ts AS created_at FROM events"""
READ_STATE_SQL = """SELECT user_id, max(event_id) AS last_read_id FROM events
WHERE event_id < (SELECT max(event_id) / 2 FROM events) AND event_type = 'click' AND value > 60 GROUP BY user_id"""
CERTIFICATES_SQL = """SELECT o_orderkey AS id, 'relay-' || CAST(o_orderkey AS STRING) AS label,
    CASE o_orderkey % 4 WHEN 0 THEN 'revoked' ELSE 'issued' END AS status,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END AS expires_at FROM orders"""
RELAYS_SQL = """SELECT 'relay-' || CASE s_suppkey WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE CAST(s_suppkey AS STRING) END AS label,
    CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS relay_cert_id FROM supplier"""
RELAY_CERTS_SQL = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 2 THEN 'revoked' ELSE 'issued' END AS status FROM supplier"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


_LANDED: dict[tuple[str, str], str] = {}


class Inputs:
    """The given tables and the fixtures over them, for one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = use_utc(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def sql(self, text: str, with_logs: bool = False) -> DataFrame:
        """Run a fixture's SQL over the given tables."""
        views = {t: f"logweave_{t}" for t in TABLES}
        for name in TABLES:
            if f" {name}" in text or (with_logs and name == "events"):
                self.table(name).createOrReplaceTempView(views[name])
                text = text.replace(f"FROM {name}", f"FROM {views[name]}")
        if with_logs:
            logs = LOGS_SQL.replace("FROM events", f"FROM {views['events']}")
            text = f"WITH logs AS ({logs}) {text}"
        return zoned(self.spark.sql(text))

    def logs(self, spread: bool = False) -> DataFrame:
        """The log table, without extracted fields. ``spread`` uses all cores for a table of a few files."""
        events = self.table("events")
        return zoned(log_columns(tables.spread(events) if spread else events))

    def lines(self) -> DataFrame:
        """Raw JSON lines of the log table, some of them damaged, as a landed table.

        Written once per session and input folder: the lines stand for files that exist before
        any query runs.
        """
        return self.spark.read.parquet(self.landed_path())

    def landed_path(self) -> str:
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _LANDED:
            path = work_dir(self.spark, "landed-lines")
            line_columns(self.logs(spread=True)).write.parquet(path)
            _LANDED[key] = path
        return _LANDED[key]

    def stream_logs(self) -> DataFrame:
        """The log table as a stream over the events files."""
        schema = self.table("events").schema
        reader = self.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
        return zoned(log_columns(reader.parquet(self.sf_dir)))


def log_columns(events: DataFrame) -> DataFrame:
    """Events (table or stream) as log rows."""
    return events.selectExpr(*[f"{expr} AS {name}" for name, expr in LOG_COLUMNS.items()])


def line_columns(logs: DataFrame) -> DataFrame:
    """Log rows (table or stream) as raw lines."""
    whole = logs.selectExpr(*[f"{expr} AS {name}" for name, expr in LINE_COLUMNS.items()])
    return whole.selectExpr("id", f"{DAMAGE_SQL} AS line")


def zoned(df: DataFrame) -> DataFrame:
    """Instants for zone-less timestamps (stored as UTC)."""
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in naive}) if naive else df


def plain(df: DataFrame) -> DataFrame:
    """Zone-less timestamps for instants, as the check compares them."""
    aware = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: df[c].cast("timestamp_ntz") for c in aware}) if aware else df
