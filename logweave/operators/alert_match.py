"""Alert rules over log rows: which rules a row satisfies, and why."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import regex, severity


@dataclass(frozen=True)
class FieldCondition:
    field: str
    operator: str = "equals"
    value: str = ""


@dataclass(frozen=True)
class AlertRule:
    id: int
    name: str
    severity: str = ""
    device_ips: tuple[str, ...] = ()
    parser_names: tuple[str, ...] = ()
    message_pattern: str = ""
    field_conditions: tuple[FieldCondition, ...] = ()
    field_logic: str = "and"
    threshold: int = 1
    window_minutes: int = 5
    cooldown_minutes: int = 0
    fire_on_every_match: bool = False
    rule_type: str = "log_threshold"
    audit_action: str = ""
    is_active: bool = True


def message_matches(pattern: str, value: Column | None = None) -> Column:
    """Empty matches all; with ``*`` an anchored glob, else a substring; never case-sensitive."""
    value = F.col("message") if value is None else value
    if not pattern:
        return F.lit(True)
    if "*" in pattern:
        return value.rlike(regex.alert_glob_to_regex(pattern))
    return F.contains(F.lower(value), F.lit(pattern.lower()))


def device_matches(device_ips: tuple[str, ...]) -> Column:
    return F.coalesce("fromhost_ip", F.lit("")).isin(*device_ips) if device_ips else F.lit(True)


def parsers_match(names: tuple[str, ...]) -> Column:
    if not names:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap("matched_parsers", F.array(*[F.lit(n) for n in names])), F.lit(False))


def _usable_pattern(pattern: str) -> str | None:
    try:
        java = regex.check_user_pattern(pattern)
    except ValueError:
        return None
    return java if regex.compiles(SparkSession.active(), [java])[0] else None


def condition_matches(cond: FieldCondition) -> Column:
    """Present and satisfied. An absent field never matches, an invalid pattern neither."""
    value = F.try_element_at("parsed_fields", F.lit(cond.field))
    if cond.operator == "contains":
        test = F.contains(F.lower(value), F.lit(cond.value.lower()))
    elif cond.operator == "not_equals":
        test = value != cond.value
    elif cond.operator == "regex":
        test = value.rlike(java) if (java := _usable_pattern(cond.value)) else F.lit(False)
    else:
        test = value == cond.value
    return F.coalesce(test, F.lit(False))


def fields_match(rule: AlertRule) -> Column:
    if not rule.field_conditions:
        return F.lit(True)
    join = (lambda a, b: a | b) if rule.field_logic == "or" else (lambda a, b: a & b)
    return reduce(join, [condition_matches(c) for c in rule.field_conditions])


def rule_matches(rule: AlertRule) -> Column:
    """All filters of one rule, cheapest first."""
    tests = [
        severity.meets_floor(F.col("severity"), rule.severity),
        device_matches(rule.device_ips),
        parsers_match(rule.parser_names),
        message_matches(rule.message_pattern),
        fields_match(rule),
    ]
    return reduce(lambda a, b: a & b, tests)


def matched_rows(logs: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """One row per (rule, matching log row).

    All rules are tested in a single pass over the table; rows that match none are gone
    before anything is shuffled.
    """
    active = [r for r in rules if r.is_active]
    if not active:
        return logs.withColumn("rule_id", F.lit(0).cast("long")).filter(F.lit(False))
    tested = F.array_compact(F.array(*[F.when(rule_matches(r), F.lit(r.id).cast("long")) for r in active]))
    return logs.withColumn("rule_id", F.explode(tested))


def _quoted(value: str | Column) -> Column:
    if isinstance(value, str):
        return F.lit('"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"')
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def satisfied_conditions(rule: AlertRule) -> Column:
    """Text of every filter the row satisfied."""
    lines: list[Column] = []
    if rule.severity:
        lines.append(
            F.concat(F.lit(f"Severity {rule.severity} or more severe (log severity: "), F.col("severity"), F.lit(")"))
        )
    if rule.device_ips:
        listed = ", ".join(rule.device_ips)
        lines.append(
            F.concat(
                F.lit(f"Device is one of: {listed} (log device: "), F.coalesce("fromhost_ip", F.lit("")), F.lit(")")
            )
        )
    if rule.parser_names:
        listed = ", ".join(rule.parser_names)
        lines.append(
            F.concat(
                F.lit(f"Parser matches one of: {listed} (log parsers: "),
                F.concat_ws(", ", "matched_parsers"),
                F.lit(")"),
            )
        )
    if rule.message_pattern:
        lines.append(F.concat(F.lit("Message matches pattern: "), _quoted(rule.message_pattern)))
    for cond in rule.field_conditions:
        value = F.try_element_at("parsed_fields", F.lit(cond.field))
        line = F.concat(
            F.lit("Field "),
            _quoted(cond.field),
            F.lit(f" {cond.operator} "),
            _quoted(cond.value),
            F.lit(" (log value: "),
            _quoted(F.coalesce(value, F.lit(""))),
            F.lit(")"),
        )
        lines.append(F.when(condition_matches(cond), line) if rule.field_logic == "or" else line)
    return F.array_compact(F.array(*lines)) if lines else F.array().cast("array<string>")


def by_rule(rules: list[AlertRule], value) -> Column:
    """Pick ``value(rule)`` by the row's ``rule_id``."""
    expr = F
    for rule in rules:
        expr = expr.when(F.col("rule_id") == rule.id, value(rule))
    return expr


def every_match_firings(logs: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """One firing per matching row, for rules that ask for it."""
    asked = [r for r in rules if r.fire_on_every_match]
    rows = matched_rows(logs, asked)
    if not asked:
        return rows
    return rows.withColumns(
        {
            "title": by_rule(asked, lambda r: F.lit(f"Alert: {r.name}")),
            "text": F.concat(F.lit("Matching log entry from "), "hostname", F.lit(": "), "message"),
            "notify_severity": severity.bucket(F.col("severity")),
            "conditions": by_rule(asked, satisfied_conditions),
        }
    )
