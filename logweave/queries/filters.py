"""F: predicates, and G1-G2 saved queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import filters, saved_query
from ..operators.filters import FieldFilter, LogFilter, Scope
from ..plans import lookup
from ..session import work_dir
from ..sources import snapshots, tables, term_index
from .inputs import Inputs
from .registry import LIBRARY, over_logs, owners, parsed_logs, parsed_sql, query, register

_SHOWN = ("id", "hostname", "fromhost_ip", "severity")


def _logs_filter(name: str, flt: LogFilter, where: str) -> None:
    def build(inp: Inputs) -> DataFrame:
        return filters.apply(inp.logs(), flt).select(*_SHOWN)

    register(name, build, over_logs(f"SELECT {', '.join(_SHOWN)} FROM logs WHERE {where}"))


def _parsed_filter(name: str, flt: LogFilter, fields: list[str], where: str, rules=None) -> None:
    rules = owners(*fields) if rules is None else rules

    def build(inp: Inputs) -> DataFrame:
        return filters.apply(parsed_logs(inp, rules), flt).select(*_SHOWN)

    register(name, build, over_logs(f"SELECT {', '.join(_SHOWN)} FROM parsed WHERE {where}", parsed=parsed_sql(rules, fields)))


_logs_filter("filter_hostname", LogFilter(hostname="fgt-20"), "hostname = 'fgt-20'")
_logs_filter("filter_device", LogFilter(fromhost_ip="10.0.1.2"), "coalesce(fromhost_ip, '') = '10.0.1.2'")
_logs_filter("filter_unknown_device", LogFilter(fromhost_ip="__unknown__"), "fromhost_ip IS NULL OR fromhost_ip = ''")
_logs_filter("filter_severity", LogFilter(severity="error"), "severity = 'error'")
_logs_filter("filter_app_name", LogFilter(app_name="SSH"), "app_name ILIKE '%SSH%'")
_logs_filter(
    "filter_time_range",
    LogFilter(start="2024-01-05T06:00:00", end="2024-01-09T18:30:00"),
    "timestamp >= TIMESTAMP '2024-01-05 06:00:00' AND timestamp <= TIMESTAMP '2024-01-09 18:30:00'",
)
_logs_filter("filter_devices", LogFilter(devices=("10.0.1.2", "10.0.2.23", "")), "coalesce(fromhost_ip, '') IN ('10.0.1.2', '10.0.2.23', '')")

_WORDS = "string_split_regex(trim(regexp_replace(lower(message || ' ' || coalesce(raw_message, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"
_FORMS = "['connect', 'connects', 'connected', 'connecting', 'connection', 'connections']"
_LATE = "['timeout', 'timeouts']"
_logs_filter(
    "filter_search",
    LogFilter(search="connection timeouts -signup"),
    f"list_has_any({_WORDS}, {_FORMS}) AND list_has_any({_WORDS}, {_LATE}) AND NOT list_has_any({_WORDS}, ['signup', 'signups', 'signuped'])",
)



@query(
    "filter_search_indexed",
    over_logs(
        f"""SELECT {', '.join(_SHOWN)} FROM logs WHERE (list_has_any({_WORDS}, {_FORMS}) AND list_has_any({_WORDS}, {_LATE})
        AND NOT list_has_any({_WORDS}, ['signup', 'signups', 'signuped'])) OR contains(array_to_string({_WORDS}, ' '), ' invalid user guest')"""
    ),
)
def filter_search_indexed(inp: Inputs) -> DataFrame:
    """The stored table, searched through the word lists of its files."""
    path = work_dir(inp.spark, "searched")
    snapshots.commit(inp.spark, path, tables.add_piece(inp.logs(), path, "load"))
    term_index.refresh(inp.spark, path)
    return lookup.search_table(inp.spark, path, LogFilter(search='connection timeouts -signup or "invalid users"')).select(*_SHOWN)


_ALL = LIBRARY
_parsed_filter("filter_has_fields", LogFilter(has_fields=True), [], "len(parsers) > 0", rules=_ALL)
_NEEDED = ("Cisco IOS BGP", "SSHD Auth")
_parsed_filter(
    "filter_required_parsers",
    LogFilter(required_parsers=_NEEDED),
    [],
    "list_has_any(parsers, ['Cisco IOS BGP', 'SSHD Auth'])",
    rules=[r for r in LIBRARY if r.name in _NEEDED],
)


def _ff(name: str, field: str, operator: str, values: tuple[str, ...], where: str) -> None:
    _parsed_filter(name, LogFilter(field_filters=(FieldFilter(field, operator, values),)), [field], where.replace("@", f"f_{field}"))


_ff("ff_eq", "action", "eq", ("deny",), "@ = 'deny'")
_ff("ff_neq", "action", "neq", ("deny",), "@ <> 'deny'")
_ff("ff_contains", "username", "contains", ("USER1",), "@ ILIKE '%USER1%'")
_ff("ff_not_contains", "username", "not_contains", ("USER1",), "@ NOT ILIKE '%USER1%'")
_ff("ff_in", "src_ip", "in", ("10.1.0.8", "10.1.0.20", "10.5.0.3"), "@ IN ('10.1.0.8', '10.1.0.20', '10.5.0.3')")
_ff("ff_notin", "src_ip", "not_in", ("10.1.0.8", "10.1.0.20"), "@ NOT IN ('10.1.0.8', '10.1.0.20')")
_ff("ff_startswith", "status", "starts_with", ("gi0",), "@ ILIKE 'gi0%'")
_ff("ff_endswith", "service", "endswith", ("S",), "@ ILIKE '%S'")
_ff("ff_gt", "policy_id", "gt", ("50",), "@ > '50'")
_ff("ff_gte", "policy_id", "gte", ("7",), "@ >= '7'")
_ff("ff_lt", "src_port", "lt", ("22",), "@ < '22'")
_ff("ff_lte", "src_port", "lte", ("22",), "@ <= '22'")
_ff("ff_regex", "ip_address", "regex", (r"\.[1-3]\d$",), r"regexp_matches(@, '\.[1-3]\d$')")
_ff("ff_is_empty", "mac_address", "is_empty", (), "@ IS NULL OR @ = ''")
_ff("ff_is_not_empty", "by_user", "is_not_empty", (), "@ IS NOT NULL AND @ <> ''")
_parsed_filter(
    "ff_unknown_field_ignored",
    LogFilter(field_filters=(FieldFilter("no such field!", "eq", ("x",)), FieldFilter("action", "eq", ("accept",)))),
    ["action"],
    "f_action = 'accept'",
)
_parsed_filter(
    "ff_no_values_ignored",
    LogFilter(field_filters=(FieldFilter("action", "eq", ()), FieldFilter("facility", "eq", ("local0",)))),
    ["action"],
    "facility = 'local0'",
)
_parsed_filter(
    "filter_combined",
    LogFilter(
        start="2024-01-03T00:00:00",
        devices=tuple(f"10.0.{a}.{b}" for a in range(4) for b in range(1, 120)),
        app_name="kern",
        has_fields=True,
        field_filters=(FieldFilter("action", "in", ("deny", "accept")), FieldFilter("message", "contains", ("10.2.0",))),
    ),
    ["action"],
    """timestamp >= TIMESTAMP '2024-01-03 00:00:00' AND app_name ILIKE '%kern%' AND len(parsers) > 0 AND f_action IN ('deny', 'accept')
    AND message ILIKE '%10.2.0%' AND fromhost_ip IS NOT NULL AND CAST(split_part(fromhost_ip, '.', 4) AS INT) < 120""",
)


def _scope(name: str, scope: Scope, where: str) -> None:
    def build(inp: Inputs) -> DataFrame:
        flt = LogFilter(start="2024-01-02T00:00:00")
        return filters.restrict(filters.apply(inp.logs(), flt), scope).select(*_SHOWN)

    register(name, build, over_logs(f"SELECT {', '.join(_SHOWN)} FROM logs WHERE timestamp >= TIMESTAMP '2024-01-02 00:00:00' AND ({where})"))


_HOSTS = ("fgt-20", "srv-4", "web-11")
_scope("scope_and", Scope(_HOSTS, ("err", "info")), "hostname IN ('fgt-20', 'srv-4', 'web-11') AND severity IN ('err', 'info')")
_scope("scope_or", Scope(_HOSTS, ("emergency",), "or"), "hostname IN ('fgt-20', 'srv-4', 'web-11') OR severity IN ('emergency')")

_ALLOWED = ["10.0.1.0/25", " 10.0.2.23 ", "", "10.0.0.300", "10.0.3.64/26", "nonsense/8"]
_NUM = "(CAST(split_part(fromhost_ip, '.', 3) AS INT) * 256 + CAST(split_part(fromhost_ip, '.', 4) AS INT))"


@query(
    "filter_cidr",
    over_logs(
        f"""SELECT id, fromhost_ip FROM logs WHERE fromhost_ip IS NOT NULL AND
        ({_NUM} BETWEEN 256 AND 383 OR fromhost_ip = '10.0.2.23' OR {_NUM} BETWEEN 832 AND 895)"""
    ),
)
def filter_cidr(inp: Inputs) -> DataFrame:
    return filters.allowed_addresses(inp.logs(), _ALLOWED).select("id", "fromhost_ip")


_V6 = "CASE WHEN id % 5 = 0 THEN concat('2001:db8:0:', lower(hex(id % 300)), '::1') WHEN id % 5 = 1 THEN concat('::ffff:', fromhost_ip) ELSE fromhost_ip END"
_V6_ALLOWED = [*_ALLOWED, "2001:db8:0:40::/58"]


def _both_families_sql() -> str:
    return over_logs(
        f"""SELECT id FROM logs WHERE CASE WHEN id % 5 = 0 THEN id % 300 BETWEEN 64 AND 127 ELSE fromhost_ip IS NOT NULL AND
        ({_NUM} BETWEEN 256 AND 383 OR fromhost_ip = '10.0.2.23' OR {_NUM} BETWEEN 832 AND 895) END"""
    )


@query("filter_cidr_v6", _both_families_sql())
def filter_cidr_v6(inp: Inputs) -> DataFrame:
    logs = inp.logs().withColumn("fromhost_ip", F.expr(_V6))
    return filters.allowed_addresses(logs, _V6_ALLOWED).select("id")


@query("filter_cidr_v6_long", _both_families_sql())
def filter_cidr_v6_long(inp: Inputs) -> DataFrame:
    """The same with a list too long for a predicate."""
    logs = inp.logs().withColumn("fromhost_ip", F.expr(_V6))
    return filters.allowed_addresses(logs, [*_V6_ALLOWED, *(f"192.0.2.{i}" for i in range(0, 255, 2)), *(f"fd00::{i:x}" for i in range(0, 400, 2))]).select("id")


# --- saved queries ---

_SAVED = saved_query.SavedQuery.from_json(
    """{"devices": ["10.0.0.9", "10.0.0.21", "10.0.2.27", "10.0.2.15"], "fields": ["src_ip", "action"],
    "filters": {"from": "2024-01-02T00:00:00", "severity": "", "field_filters": [{"field": "action", "operator": "eq", "values": ["deny"]}]}}""",
    name="Denied",
)
_FIELDS = ["src_ip", "action"]
_RULES = owners(*_FIELDS)
_BASE = [c for c in saved_query.BASE_COLUMNS]
_OUT = ", ".join([*_BASE, "f_src_ip AS src_ip", "f_action AS action"])
_PARSED = parsed_sql(_RULES, _FIELDS)
_TIME = "timestamp >= TIMESTAMP '2024-01-02 00:00:00'"


@query(
    "saved_query",
    over_logs(
        f"SELECT id, hostname FROM parsed WHERE {_TIME} AND fromhost_ip IN ('10.0.0.9', '10.0.0.21', '10.0.2.27', '10.0.2.15') AND len(parsers) > 0 AND f_action = 'deny'",
        parsed=_PARSED,
    ),
)
def saved(inp: Inputs) -> DataFrame:
    return filters.apply(parsed_logs(inp, _RULES), saved_query.resolve(_SAVED, LIBRARY)).select("id", "hostname")


@query(
    "saved_query_override",
    over_logs(
        f"SELECT id, hostname FROM parsed WHERE {_TIME} AND fromhost_ip = '10.0.0.21' AND len(parsers) > 0 AND severity = 'info' AND f_action ILIKE 'ACC%'",
        parsed=_PARSED,
    ),
)
def saved_override(inp: Inputs) -> DataFrame:
    """The request narrows to one stored device and replaces the field filters."""
    asked = saved_query.Override(
        severity="info",
        fromhost_ip="10.0.0.21",
        field_filters='[{"field": "action", "operator": "startswith", "values": ["ACC"]}]',
    )
    return filters.apply(parsed_logs(inp, _RULES), saved_query.resolve(_SAVED, LIBRARY, asked)).select("id", "hostname")


@query(
    "saved_query_fields",
    over_logs(f"SELECT {_OUT} FROM parsed WHERE {_TIME} AND len(parsers) > 0 AND f_action <> 'deny'", parsed=_PARSED),
)
def saved_fields(inp: Inputs) -> DataFrame:
    wide = saved_query.SavedQuery(
        fields=tuple(_FIELDS), start="2024-01-02T00:00:00", field_filters=(FieldFilter("action", "neq", ("deny",)),)
    )
    return saved_query.run(parsed_logs(inp, _RULES), wide, LIBRARY)
