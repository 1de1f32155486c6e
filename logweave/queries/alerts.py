"""R: alert evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import severity
from ..operators import alert_gate, alert_match, fanout, ingest, notifications, silence
from ..operators.alert_match import AlertRule, FieldCondition
from .ingest import DECODED
from .inputs import (
    ALERT_CHANNELS_SQL,
    ALERTS_SQL,
    AS_OF,
    AS_OF_SQL,
    AUDIT_SQL,
    CERTIFICATES_SQL,
    CHANNELS_SQL,
    Inputs,
)
from .registry import over_lines, over_logs, owners, parsed_logs, parsed_sql, query
from .rollups import LAST_SEEN, SILENCE_APPLIES, SILENCE_RULES, SILENCE_VALUES, last_seen

_FIELDS = ["session_state", "action", "username"]
PARSERS = owners(*_FIELDS)
PARSED = parsed_sql(PARSERS, _FIELDS)
_DEVICES = ("10.0.0.9", "10.0.0.21", "10.0.2.27", "10.0.2.15", "10.0.0.57")

RULES = [
    AlertRule(1, "errors", severity="err", threshold=5, window_minutes=60, cooldown_minutes=120),
    AlertRule(2, "timeouts", message_pattern="*FAILED*timeout*", threshold=2, window_minutes=240),
    AlertRule(
        3,
        "bgp down",
        parser_names=("Cisco IOS BGP",),
        field_conditions=(FieldCondition("session_state", "equals", "Down"),),
        threshold=2,
        window_minutes=600,
        cooldown_minutes=60,
    ),
    AlertRule(4, "denied", device_ips=_DEVICES, message_pattern="Action=DENY", threshold=0, window_minutes=5, cooldown_minutes=1440),
    AlertRule(
        5,
        "suspicious",
        severity="notice",
        field_conditions=(
            FieldCondition("action", "not_equals", "deny"),
            FieldCondition("username", "regex", r"^(user1\d*|admin)$"),
            FieldCondition("username", "contains", "USER2"),
        ),
        field_logic="or",
        fire_on_every_match=True,
    ),
    AlertRule(6, "odd floor", severity="bogus", message_pattern="dhcplease", threshold=10, window_minutes=1440, cooldown_minutes=30),
    AlertRule(7, "switched off", is_active=False),
]
_GATED = [r for r in RULES if r.is_active and not r.fire_on_every_match]

_RANK = """CASE lower(severity) WHEN 'emerg' THEN 0 WHEN 'emergency' THEN 0 WHEN 'alert' THEN 1 WHEN 'crit' THEN 2 WHEN 'critical' THEN 2 WHEN 'err' THEN 3
    WHEN 'error' THEN 3 WHEN 'warning' THEN 4 WHEN 'warn' THEN 4 WHEN 'notice' THEN 5 WHEN 'info' THEN 6 WHEN 'debug' THEN 7 END"""
_BUCKET = f"CASE WHEN coalesce({_RANK}, 0) <= 2 THEN 'critical' WHEN {_RANK} = 3 THEN 'error' WHEN {_RANK} = 4 THEN 'warning' ELSE 'info' END"
_DEVICES_SQL = ", ".join(f"'{d}'" for d in _DEVICES)
_OR_FIELDS = """coalesce(f_action <> 'deny', FALSE) OR coalesce(regexp_matches(f_username, '^(user1\\d*|admin)$'), FALSE)
    OR coalesce(contains(lower(f_username), 'user2'), FALSE)"""
_TESTS = {
    1: f"coalesce({_RANK} <= 3, TRUE)",
    2: "regexp_matches(message, '(?is)^.*FAILED.*timeout.*$')",
    3: "list_contains(parsers, 'Cisco IOS BGP') AND coalesce(f_session_state = 'Down', FALSE)",
    4: f"coalesce(fromhost_ip, '') IN ({_DEVICES_SQL}) AND contains(lower(message), 'action=deny')",
    5: f"coalesce({_RANK} <= 5, TRUE) AND ({_OR_FIELDS})",
    6: "contains(lower(message), 'dhcplease')",
}


def _matches_sql(ids) -> str:
    return " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS rule_id, * FROM parsed WHERE {_TESTS[i]}" for i in ids)


@query("alert_severity_floor", over_logs(f"SELECT id, severity FROM logs WHERE coalesce({_RANK} <= 4, TRUE)"))
def alert_severity_floor(inp: Inputs) -> DataFrame:
    return inp.logs().filter(severity.meets_floor(F.col("severity"), "Warn")).select("id", "severity")


@query("alert_notify_severity", over_logs(f"SELECT id, {_BUCKET} AS bucket FROM logs"))
def alert_notify_severity(inp: Inputs) -> DataFrame:
    return inp.logs().select("id", severity.bucket(F.col("severity")).alias("bucket"))


@query(
    "alert_message_pattern",
    over_logs(
        """SELECT id, contains(lower(message), 'link') AS plain, regexp_matches(message, '(?is)^.*user.*from.*$') AS glob,
        regexp_matches(message, '(?is)^%LINK.*up$') AS anchored FROM logs"""
    ),
)
def alert_message_pattern(inp: Inputs) -> DataFrame:
    test = alert_match.message_matches
    return inp.logs().select(
        "id", test("LINK").alias("plain"), test("*USER*From*").alias("glob"), test("%link*UP").alias("anchored")
    )


@query("alert_device", over_logs(f"SELECT id, fromhost_ip FROM logs WHERE coalesce(fromhost_ip, '') IN ({_DEVICES_SQL})"))
def alert_device(inp: Inputs) -> DataFrame:
    return inp.logs().filter(alert_match.device_matches(_DEVICES)).select("id", "fromhost_ip")


@query("alert_parsers", over_logs("SELECT id FROM parsed WHERE list_has_any(parsers, ['Cisco IOS BGP', 'SSHD Auth'])", parsed=PARSED))
def alert_parsers(inp: Inputs) -> DataFrame:
    return parsed_logs(inp, PARSERS).filter(alert_match.parsers_match(("Cisco IOS BGP", "SSHD Auth"))).select("id")


_AND_RULE = AlertRule(
    0, "", field_conditions=(FieldCondition("username", "contains", "USER"), FieldCondition("username", "not_equals", "user4"))
)


@query("alert_fields_and", over_logs("SELECT id FROM parsed WHERE contains(lower(f_username), 'user') AND f_username <> 'user4'", parsed=PARSED))
def alert_fields_and(inp: Inputs) -> DataFrame:
    return parsed_logs(inp, PARSERS).filter(alert_match.fields_match(_AND_RULE)).select("id")


@query("alert_fields_or", over_logs(f"SELECT id FROM parsed WHERE {_OR_FIELDS}", parsed=PARSED))
def alert_fields_or(inp: Inputs) -> DataFrame:
    return parsed_logs(inp, PARSERS).filter(alert_match.fields_match(RULES[4])).select("id")


@query("alert_matches", over_logs(f"SELECT rule_id, id FROM ({_matches_sql(_TESTS)}) AS m", parsed=PARSED))
def alert_matches(inp: Inputs) -> DataFrame:
    return alert_match.matched_rows(parsed_logs(inp, PARSERS), RULES).select("rule_id", "id")


@query(
    "alert_every_match",
    over_logs(
        f"""SELECT rule_id, id, 'Alert: suspicious' AS title, 'Matching log entry from ' || hostname || ': ' || message AS text, {_BUCKET} AS notify_severity
        FROM ({_matches_sql([5])}) AS m""",
        parsed=PARSED,
    ),
)
def alert_every_match(inp: Inputs) -> DataFrame:
    fired = alert_match.every_match_firings(parsed_logs(inp, PARSERS), RULES)
    return fired.select("rule_id", "id", "title", "text", "notify_severity")


def gate_sql(slots: str, settings: str, final: str, outer, **ctes: str) -> str:
    """The gate as a recursive query over numbered slots; ``settings`` has rule_id, threshold, window_us, cooldown_us."""
    numbered = f"SELECT s.*, k.threshold, k.window_us, k.cooldown_us, row_number() OVER (PARTITION BY s.rule_id ORDER BY slot) AS rn FROM ({slots}) AS s JOIN {settings} ON k.rule_id = s.rule_id"
    opened = "(g.we IS NULL OR n.t_us >= g.we)"
    count = f"(CASE WHEN {opened} THEN 0 ELSE g.cnt END + n.matches)"
    fires = f"({count} >= n.threshold AND (g.ce IS NULL OR n.t_us >= g.ce))"
    first = "(n.matches >= n.threshold)"
    walk = f"""SELECT n.rule_id, n.rn, n.slot, n.t_us, n.matches, n.matches AS acc, {first} AS fired,
            CASE WHEN {first} THEN 0 ELSE n.matches END AS cnt, CASE WHEN {first} THEN NULL ELSE n.t_us + n.window_us END AS we,
            CASE WHEN {first} THEN n.t_us + n.cooldown_us ELSE NULL END AS ce FROM numbered n WHERE rn = 1
        UNION ALL SELECT n.rule_id, n.rn, n.slot, n.t_us, n.matches, {count}, {fires}, CASE WHEN {fires} THEN 0 ELSE {count} END,
            CASE WHEN {fires} THEN NULL WHEN {opened} THEN n.t_us + n.window_us ELSE g.we END,
            CASE WHEN {fires} THEN n.t_us + n.cooldown_us ELSE g.ce END
        FROM g JOIN numbered n ON n.rule_id = g.rule_id AND n.rn = g.rn + 1"""
    # The first-row branch ignores the cooldown, as nothing has fired before it.
    sql = outer(final, **ctes, numbered=numbered, g=walk)
    return sql.replace("WITH logs", "WITH RECURSIVE logs", 1)


SLOTS = f"""SELECT rule_id, epoch_us(timestamp) // 500000 AS slot, count(*) AS matches, max(epoch_us(timestamp)) AS t_us
    FROM ({_matches_sql([r.id for r in _GATED])}) AS m GROUP BY 1, 2"""
SETTINGS = "(VALUES " + ", ".join(
    f"({r.id}, {max(r.threshold, 1)}, {r.window_minutes * 60_000_000}, {r.cooldown_minutes * 60_000_000})" for r in _GATED
) + ") AS k(rule_id, threshold, window_us, cooldown_us)"
THRESHOLD_SQL = gate_sql(
    SLOTS,
    SETTINGS,
    "SELECT rule_id, make_timestamp(t_us) AS fired_at, matches, CAST(acc AS BIGINT) AS accumulated FROM g WHERE fired",
    over_logs,
    parsed=PARSED,
)


@query("alert_threshold", THRESHOLD_SQL)
def alert_threshold(inp: Inputs) -> DataFrame:
    return alert_gate.threshold_firings(parsed_logs(inp, PARSERS), RULES).drop("slot")


_TITLES = "CASE rule_id " + " ".join(f"WHEN {r.id} THEN 'Alert: {r.name}'" for r in _GATED) + " END"
_MINUTES = "CASE rule_id " + " ".join(f"WHEN {r.id} THEN {r.window_minutes}" for r in _GATED) + " END"
_NEEDED = "CASE rule_id " + " ".join(f"WHEN {r.id} THEN {max(r.threshold, 1)}" for r in _GATED) + " END"
_LISTED = ", ".join(_DEVICES)
_CONDITIONS = f"""CASE rule_id WHEN 1 THEN 'Severity err or more severe (log severity: ' || severity || ');'
    WHEN 2 THEN 'Message matches pattern: "*FAILED*timeout*";'
    WHEN 3 THEN 'Parser matches one of: Cisco IOS BGP (log parsers: ' || array_to_string(parsers, ', ') || ');Field "session_state" equals "Down" (log value: "' || f_session_state || '");'
    WHEN 4 THEN 'Device is one of: {_LISTED} (log device: ' || coalesce(fromhost_ip, '') || ');Message matches pattern: "Action=DENY";'
    WHEN 6 THEN 'Severity bogus or more severe (log severity: ' || severity || ');Message matches pattern: "dhcplease";' END
    || 'Threshold reached: ' || CAST(acc AS VARCHAR) || ' matching log(s) within ' || CAST({_MINUTES} AS VARCHAR) || ' minute(s) (required: '
    || CAST({_NEEDED} AS VARCHAR) || ')'"""
FIRINGS_SQL = gate_sql(
    SLOTS,
    SETTINGS,
    f"""SELECT rule_id, id, make_timestamp(t_us) AS fired_at, CAST(acc AS BIGINT) AS accumulated, {_TITLES} AS title,
        CAST(acc AS VARCHAR) || ' matching log entries in the last ' || CAST({_MINUTES} AS VARCHAR) || ' minute(s). Latest from ' || hostname || ': ' || message AS text,
        {_BUCKET} AS notify_severity, {_CONDITIONS} AS conditions
    FROM (SELECT g.t_us, g.acc, m.*, row_number() OVER (PARTITION BY g.rule_id, g.slot ORDER BY m.id DESC) AS pick
        FROM g JOIN ({_matches_sql([r.id for r in _GATED])}) AS m ON m.rule_id = g.rule_id AND epoch_us(m.timestamp) = g.t_us WHERE g.fired) AS f WHERE pick = 1""",
    over_logs,
    parsed=PARSED,
)


@query("alert_firings", FIRINGS_SQL)
def alert_firings(inp: Inputs) -> DataFrame:
    fired = alert_gate.firing_records(parsed_logs(inp, PARSERS), RULES)
    return fired.select(
        "rule_id", "id", "fired_at", "accumulated", "title", "text", "notify_severity", F.concat_ws(";", "conditions").alias("conditions")
    )


_AUDIT_RULES = [
    AlertRule(21, "rule changes", rule_type="audit_log", audit_action="update_rule", cooldown_minutes=7 * 1440),
    AlertRule(22, "anything", rule_type="audit_log", cooldown_minutes=30 * 1440),
]
_AUDIT_SETTINGS = "(VALUES (21, 1, 60000000, 604800000000), (22, 1, 60000000, 2592000000000)) AS k(rule_id, threshold, window_us, cooldown_us)"
_AUDIT_SLOTS = """SELECT rule_id, epoch_us(created_at) // 500000 AS slot, count(*) AS matches, max(epoch_us(created_at)) AS t_us
    FROM (SELECT CAST(21 AS BIGINT) AS rule_id, created_at FROM audit WHERE action = 'update_rule' UNION ALL SELECT 22, created_at FROM audit) AS a GROUP BY 1, 2"""


@query(
    "alert_audit",
    gate_sql(_AUDIT_SLOTS, _AUDIT_SETTINGS, "SELECT rule_id, make_timestamp(t_us) AS fired_at, matches FROM g WHERE fired", over_logs, audit=AUDIT_SQL),
)
def alert_audit(inp: Inputs) -> DataFrame:
    return alert_gate.audit_firings(inp.sql(AUDIT_SQL), _AUDIT_RULES)


_BAD_RULE = AlertRule(31, "bad lines", rule_type="malformed_json", cooldown_minutes=360)
_BAD_SLOTS = """SELECT CAST(31 AS BIGINT) AS rule_id, epoch_us(l.timestamp) // 500000 AS slot, count(*) AS matches, max(epoch_us(l.timestamp)) AS t_us
    FROM decoded d JOIN logs l ON l.id = d.id WHERE d.defect IN ('malformed', 'truncated') GROUP BY 1, 2"""
_BAD_SETTINGS = "(VALUES (31, 1, 60000000, 21600000000)) AS k(rule_id, threshold, window_us, cooldown_us)"


_BAD_TEXT = "'A syslog line failed to parse as JSON during ingestion: ' || (CASE WHEN strlen(d.line) > 500 THEN left(d.line, 500) || '...' ELSE d.line END) AS text"
_BAD_LINES = """SELECT epoch_us(l.timestamp) AS t_us, {line} AS line FROM logs l JOIN decoded d ON d.id = l.id WHERE d.defect IN ('malformed', 'truncated') {group}"""
_BAD_SHOWN = ("rule_id", "fired_at", "title", "text", "notify_severity")


def _bad_firings(inp: Inputs, rule: AlertRule) -> DataFrame:
    decoded = ingest.decode(inp.lines()).filter(F.col("defect").isin("malformed", "truncated"))
    arrived = decoded.join(inp.logs().select("id", "timestamp"), "id").select("timestamp", "line")
    return alert_gate.malformed_firings(arrived, [rule]).select(*_BAD_SHOWN)


@query(
    "alert_malformed",
    gate_sql(
        _BAD_SLOTS,
        _BAD_SETTINGS,
        f"""SELECT g.rule_id, make_timestamp(g.t_us) AS fired_at, 'Alert: bad lines' AS title, {_BAD_TEXT}, 'warning' AS notify_severity
        FROM g JOIN ({_BAD_LINES.format(line='max(d.line)', group='GROUP BY 1')}) AS d ON d.t_us = g.t_us WHERE g.fired""",
        over_lines,
        decoded=DECODED,
    ),
)
def alert_malformed(inp: Inputs) -> DataFrame:
    """Lines that cannot be decoded, gated by cooldown; each is taken to arrive at its row's own time."""
    return _bad_firings(inp, _BAD_RULE)


@query(
    "alert_malformed_every",
    over_lines(
        f"""SELECT CAST(32 AS BIGINT) AS rule_id, make_timestamp(t_us) AS fired_at, 'Alert: each bad line' AS title, {_BAD_TEXT}, 'warning' AS notify_severity
        FROM ({_BAD_LINES.format(line='d.line', group='')}) AS d""",
        decoded=DECODED,
    ),
)
def alert_malformed_every(inp: Inputs) -> DataFrame:
    """The same rule without a cooldown: every line fires."""
    return _bad_firings(inp, AlertRule(32, "each bad line", rule_type="malformed_json", fire_on_every_match=True))


# --- silence ---

_AGE = f"(epoch_us({AS_OF_SQL}) - epoch_us(last_seen))"
_SILENT_LEVEL = "CASE WHEN {age} >= minutes * 240000000 THEN 'critical' WHEN {age} >= minutes * 120000000 THEN 'error' ELSE 'warning' END"


@query(
    "device_silence",
    over_logs(
        f"""SELECT rule_id, fromhost_ip, hostname, {_AGE} // 1000000 AS age_seconds, {_SILENT_LEVEL.format(age=_AGE)} AS severity
        FROM devices, {SILENCE_VALUES} WHERE {SILENCE_APPLIES} AND {_AGE} >= minutes * 60000000""",
        devices=LAST_SEEN,
    ),
)
def device_silence(inp: Inputs) -> DataFrame:
    found = silence.silent_devices(last_seen(inp), SILENCE_RULES, AS_OF)
    return found.select("rule_id", "fromhost_ip", "hostname", "age_seconds", "severity")


# Earlier state: half the devices, some of them mild, some fired recently.
_STATE = """SELECT rule_id, fromhost_ip AS device_ip, last_silent AS silent_since, last_severity, last_fired FROM (
    SELECT CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN 2 ELSE 3 END AS rule_id, fromhost_ip, max(timestamp) - INTERVAL '2' HOUR AS last_silent,
        CASE WHEN count(*) % 2 = 0 THEN 'warning' ELSE 'critical' END AS last_severity, max(timestamp) + INTERVAL '5' HOUR AS last_fired
    FROM logs WHERE fromhost_ip IS NOT NULL AND severity = 'emergency' GROUP BY 1, 2) AS s"""


_CHANGES = f"""SELECT rule_id, fromhost_ip, CASE WHEN NOT silent THEN 'recovered' WHEN last_severity IS NULL THEN 'silent'
            WHEN sev_rank > CASE last_severity WHEN 'warning' THEN 1 WHEN 'error' THEN 2 ELSE 3 END THEN 'escalated' WHEN cooled THEN 'repeat' ELSE 'quiet' END AS action,
            CASE WHEN silent THEN ['warning', 'error', 'critical'][sev_rank] ELSE 'info' END AS severity, since AS silent_since, hostname, last_seen, minutes
        FROM (SELECT *, CASE WHEN epoch_us({AS_OF_SQL}) - epoch_us(since) >= minutes * 240000000 THEN 3
                WHEN epoch_us({AS_OF_SQL}) - epoch_us(since) >= minutes * 120000000 THEN 2 ELSE 1 END AS sev_rank
            FROM (SELECT p.*, s.last_severity, coalesce(s.silent_since, p.last_seen) AS since, {_AGE} >= minutes * 60000000 AS silent,
                    coalesce(epoch_us({AS_OF_SQL}) - epoch_us(s.last_fired) >= cooldown * 60000000, TRUE) AS cooled
                FROM (SELECT * FROM devices, {SILENCE_VALUES} WHERE {SILENCE_APPLIES}) p LEFT JOIN state s ON s.rule_id = p.rule_id AND s.device_ip = p.fromhost_ip) AS a
            WHERE silent OR last_severity IS NOT NULL) AS b"""


@query(
    "silence_transitions",
    over_logs(
        "SELECT rule_id, fromhost_ip, action, severity, silent_since FROM changes",
        devices=LAST_SEEN,
        state=_STATE,
        changes=_CHANGES,
    ),
)
def silence_transitions(inp: Inputs) -> DataFrame:
    state = inp.sql(_STATE, with_logs=True)
    changes = silence.transitions(last_seen(inp), SILENCE_RULES, state, AS_OF)
    return changes.select("rule_id", "fromhost_ip", "action", "severity", "silent_since")


_STAMP = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"


@query(
    "silence_firings",
    over_logs(
        f"""SELECT rule_id, fromhost_ip, CASE WHEN action = 'recovered' THEN 'Device back online: ' ELSE 'Device silent: ' END || hostname AS title,
            CASE WHEN action = 'recovered' THEN hostname || ' (' || fromhost_ip || ') has resumed sending logs (was silent since ' || {_STAMP.format('silent_since')} || ').'
            ELSE 'No logs received from ' || hostname || ' (' || fromhost_ip || ') in over ' || minutes || ' minutes. Last seen: ' || {_STAMP.format('last_seen')} END AS text,
            severity AS notify_severity
        FROM changes WHERE action <> 'quiet'""",
        devices=LAST_SEEN,
        state=_STATE,
        changes=_CHANGES,
    ),
)
def silence_firings(inp: Inputs) -> DataFrame:
    """What is delivered for devices that fell silent, got worse, stay silent or came back."""
    state = inp.sql(_STATE, with_logs=True)
    return silence.firings(silence.transitions(last_seen(inp), SILENCE_RULES, state, AS_OF))


@query(
    "cert_expiring",
    f"""WITH certs AS ({CERTIFICATES_SQL}) SELECT id, label, expires_at, CAST(trunc((epoch_us(expires_at) - epoch_us(TIMESTAMP '1998-06-01 07:00:00')) / 86400000000.0) AS BIGINT) AS days_left
    FROM certs WHERE status = 'issued' AND expires_at <= TIMESTAMP '1998-06-01 07:00:00' + INTERVAL 30 DAY""",
)
def cert_expiring(inp: Inputs) -> DataFrame:
    certificates = inp.sql(CERTIFICATES_SQL)
    return notifications.expiring_certificates(certificates, "1998-06-01T07:00:00").select("id", "label", "expires_at", "days_left")


def split_users(df: DataFrame, column: str, out: str) -> DataFrame:
    """Comma-separated user ids as an array; empty text gives an empty array, NULL stays NULL."""
    ids = F.transform(F.split(column, ","), lambda u: u.cast("long"))
    return df.withColumn(out, F.when(F.col(column) == "", F.array().cast("array<bigint>")).otherwise(ids)).drop(column)


_MERGED = "('push', 'in_app')"


@query(
    "alert_fanout",
    over_logs(
        f"""SELECT f.id, d.channel_id, d.channel_type, d.targets, CASE WHEN d.channel_id IS NULL THEN 'no_channel' ELSE 'deliver' END AS status
        FROM (SELECT id, id % (SELECT max(id) + 1 FROM alerts) AS rule_id FROM logs) f LEFT JOIN (
            SELECT rule_id, channel_type, min(channel_id) AS channel_id,
                CASE WHEN channel_type IN {_MERGED} AND NOT bool_or(users = '') THEN (SELECT array_to_string(list_sort(list_distinct(flatten(list(
                    list_transform(string_split(users, ','), lambda u: TRY_CAST(u AS BIGINT)))))), ',')) END AS targets
            FROM (SELECT ac.alert_id AS rule_id, c.type AS channel_type, ac.channel_id, c.users,
                    CASE WHEN c.type IN {_MERGED} THEN NULL ELSE ac.channel_id END AS own
                FROM alert_channels ac JOIN channels c ON c.id = ac.channel_id WHERE c.enabled) AS a
            GROUP BY rule_id, channel_type, own) d ON d.rule_id = f.rule_id""",
        alerts=ALERTS_SQL,
        channels=CHANNELS_SQL,
        alert_channels=ALERT_CHANNELS_SQL,
    ),
)
def alert_fanout(inp: Inputs) -> DataFrame:
    """Every row stands for one firing; firings are spread over all rules."""
    n_rules = inp.sql(ALERTS_SQL).select(F.max("id") + 1).scalar()
    firings = inp.logs().select("id", (F.col("id") % n_rules).alias("rule_id"))
    channels = split_users(inp.sql(CHANNELS_SQL), "users", "user_ids")
    out = fanout.fan_out(firings, inp.sql(ALERT_CHANNELS_SQL), channels)
    shown = F.when(F.col("targets").isNotNull(), F.concat_ws(",", F.col("targets").cast("array<string>")))
    return out.select("id", "channel_id", "channel_type", shown.alias("targets"), "status")
