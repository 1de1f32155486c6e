"""Where queries and their equivalent SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import parsing
from ..session import ship_package
from ..sources.library import Rule, builtin_rules
from .inputs import LINES_SQL, LOGS_SQL, Inputs, plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, build: Callable[[Inputs], DataFrame], sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return plain(build(Inputs(spark, sf_dir)))

    run.__name__ = name
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def query(name: str, sql: str | None = None):
    def wrap(build: Callable[[Inputs], DataFrame]):
        register(name, build, sql)
        return build

    return wrap


def over_logs(body: str, **ctes: str) -> str:
    """SQL over the log view, with further named subqueries."""
    parts = [f"logs AS ({LOGS_SQL})"] + [f"{name} AS ({text})" for name, text in ctes.items()]
    return "WITH " + ", ".join(parts) + " " + body


def over_lines(body: str, **ctes: str) -> str:
    return over_logs(body, lines=LINES_SQL, **ctes)


# --- equivalent SQL for rule matching, written independently of the library ---


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rule_sql(rule: Rule, row: str = "") -> str:
    """Selector and pattern of a built-in rule as a DuckDB predicate."""
    value = rule.match_value or ""
    if rule.match_type == "hostname":
        chosen = f"starts_with({row}hostname, {text(value.rstrip('*'))})"
    elif rule.match_type == "app_name":
        chosen = f"coalesce({row}app_name, '') = {text(value)}"
    elif rule.match_type == "message":
        chosen = f"contains({row}message, {text(value)})"
    else:
        chosen = "TRUE"
    return f"({chosen} AND regexp_matches({row}message, {text(rule.regex)}))"


def only_group(pattern: str, wanted: int) -> str:
    """The pattern with one capturing group left, as DuckDB addresses few groups."""
    out, seen, i, in_class = [], 0, 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(" and pattern[i + 1 : i + 2] != "?":
            seen += 1
            if seen != wanted:
                ch = "(?:"
        out.append(ch)
        i += 1
    return "".join(out)


def parsed_sql(rules: list[Rule], fields: list[str] | None = None, source: str = "logs") -> str:
    """All columns of ``source`` plus ``parsers`` (list) and one ``f_<name>`` column per field."""
    names = fields if fields is not None else sorted({f for r in rules for f in r.field_names})
    columns = []
    for name in names:
        branches = "".join(
            f" WHEN m{r.id} THEN regexp_extract(message, {text(only_group(r.regex, r.field_names.index(name) + 1))}, 1)"
            for r in rules
            if name in r.field_names
        )
        columns.append(f"CASE{branches} END AS f_{name}")
    hits = ", ".join(f"{rule_sql(r)} AS m{r.id}" for r in rules)
    listed = ", ".join(f"CASE WHEN m{r.id} THEN {text(r.name)} END" for r in rules)
    extra = "".join(", " + c for c in columns)
    drop = ", ".join(f"m{r.id}" for r in rules)
    return (
        f"SELECT * EXCLUDE ({drop}), list_filter([{listed}], lambda x: x IS NOT NULL) AS parsers{extra}"
        f" FROM (SELECT *, {hits} FROM {source}) AS hits"
    )


def fields_text_sql(names: list[str]) -> str:
    return "concat_ws('|', " + ", ".join(f"'{n}=' || f_{n}" for n in sorted(names)) + ")"


def all_fields(rules: list[Rule]) -> list[str]:
    return sorted({f for r in rules for f in r.field_names})


LIBRARY = builtin_rules()


def owners(*fields: str) -> list[Rule]:
    return parsing.owners(LIBRARY, list(fields))


def named(*names: str) -> list[Rule]:
    return [r for r in LIBRARY if r.name in names]


def parsed_logs(inputs: Inputs, rules: list[Rule]) -> DataFrame:
    return parsing.parse(inputs.logs(spread=True), rules)


def library_sql(rules: list[Rule]) -> str:
    """The rule library as a VALUES table: one row per (rule, field)."""
    rows = ", ".join(
        f"({r.id}, {text(r.name)}, {text(r.device_type)}, {text(r.match_type)}, {text(r.match_value or '')}, {i}, {text(n)}, {text(l)}, {text(t)})"
        for r in rules
        for i, (n, l, t) in enumerate(r.fields)
    )
    return (
        f"SELECT * REPLACE (CAST(parser_id AS BIGINT) AS parser_id) FROM (VALUES {rows}) AS v(parser_id, parser_name, device_type, match_type, match_value, pos,"
        " field_name, field_label, field_type)"
    )
