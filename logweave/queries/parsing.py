"""P: field extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import parsing
from ..sources import library
from .inputs import Inputs
from .registry import (
    LIBRARY,
    all_fields,
    fields_text_sql,
    library_sql,
    named,
    over_logs,
    owners,
    parsed_logs,
    parsed_sql,
    query,
    register,
    rule_sql,
)

_SELECTORS = {
    "parser_match_hostname": ("hostname", ["cisco*", "*-?", "srv-1*4", ""]),
    "parser_match_app": ("app_name", ["sshd", "k*l", "", "cron"]),
    "parser_match_message": ("message", ["pam_unix(", "msg=", "", "Started"]),
    "parser_match_all": ("all", [None]),
}


def _selector_sql(kind: str, value: str | None) -> str:
    if kind == "all":
        return "TRUE"
    if not value:
        return "FALSE"
    if kind == "message":
        return f"contains(message, '{value}')"
    glob = value.replace("*", "%").replace("?", "_")
    return f"coalesce({kind}, '') LIKE '{glob}'"


def _add_selector(name: str, kind: str, values: list[str | None]) -> None:
    rules = [library.Rule(i, f"r{i}", kind, v, "", ()) for i, v in enumerate(values)]
    columns = ", ".join(f"{_selector_sql(kind, v)} AS s{i}" for i, v in enumerate(values))

    def build(inp: Inputs) -> DataFrame:
        tests = [F.coalesce(parsing.selector(r), F.lit(False)).alias(f"s{r.id}") for r in rules]
        return inp.logs().select("id", *tests)

    register(name, build, over_logs(f"SELECT id, {columns} FROM logs"))


for _name, (_kind, _values) in _SELECTORS.items():
    _add_selector(_name, _kind, _values)


@query("matched_parsers", over_logs("SELECT id, array_to_string(parsers, ',') AS parsers FROM parsed", parsed=parsed_sql(LIBRARY, [])))
def matched_parsers(inp: Inputs) -> DataFrame:
    return parsed_logs(inp, LIBRARY).select("id", parsing.parsers_text().alias("parsers"))


_THREAT = named("FortiGate Threat")


@query(
    "extract_fields",
    over_logs(
        "SELECT id, f_src_ip AS src_ip, f_dst_ip AS dst_ip, f_action AS action, f_policy_id AS policy_id, f_msg AS msg FROM parsed WHERE len(parsers) > 0",
        parsed=parsed_sql(_THREAT),
    ),
)
def extract_fields(inp: Inputs) -> DataFrame:
    rows = parsed_logs(inp, _THREAT).filter(F.size("matched_parsers") > 0)
    return rows.select("id", *[parsing.field(f).alias(f) for f in ("src_ip", "dst_ip", "action", "policy_id", "msg")])


_FIRST = library.Rule(901, "first", "all", None, r"from[= ](\S+)( to=(\S+))?", (("source", "", ""), ("tail", "", ""), ("target", "", ""), ("none", "", "")))
_SECOND = library.Rule(902, "second", "message", "from", r"(\w+) from", (("word", "", ""), ("source", "", "")))
_THIRD = library.Rule(903, "third", "all", None, r"mac=(\S+)|port (\d+)", (("source", "", ""), ("port", "", "")))


@query(
    "parse_merge",
    over_logs(
        r"""SELECT id, concat_ws(',', CASE WHEN m1 THEN 'first' END, CASE WHEN m2 THEN 'second' END, CASE WHEN m3 THEN 'third' END) AS parsers,
        CASE WHEN m1 THEN regexp_extract(message, 'from[= ](\S+)( to=(\S+))?', 1) WHEN m3 THEN regexp_extract(message, 'mac=(\S+)|port (\d+)', 1) END AS source,
        CASE WHEN m1 THEN regexp_extract(message, 'from[= ](\S+)( to=(\S+))?', 3) END AS target,
        CASE WHEN m2 THEN regexp_extract(message, '(\w+) from', 1) END AS word,
        CASE WHEN m3 THEN regexp_extract(message, 'mac=(\S+)|port (\d+)', 2) END AS port,
        CAST(NULL AS VARCHAR) AS none
        FROM (SELECT id, message, regexp_matches(message, 'from[= ](\S+)( to=(\S+))?') AS m1,
            contains(message, 'from') AND regexp_matches(message, '(\w+) from') AS m2,
            regexp_matches(message, 'mac=(\S+)|port (\d+)') AS m3 FROM logs) AS h"""
    ),
)
def parse_merge(inp: Inputs) -> DataFrame:
    """Overlapping rules: an earlier empty value wins, missing groups leave a field out, a bad rule is skipped."""
    broken = library.Rule(904, "broken", "all", None, "(", (("x", "", ""),))
    rows = parsed_logs(inp, [_THIRD, broken, _SECOND, _FIRST])
    shown = ("source", "target", "word", "port", "none")
    return rows.select("id", parsing.parsers_text().alias("parsers"), *[parsing.field(f).alias(f) for f in shown])


_EVERY = all_fields(LIBRARY)


@query(
    "parse_logs",
    over_logs(
        f"SELECT id, array_to_string(parsers, ',') AS parsers, {fields_text_sql(_EVERY)} AS fields FROM parsed",
        parsed=parsed_sql(LIBRARY),
    ),
)
def parse_logs(inp: Inputs) -> DataFrame:
    return parsed_logs(inp, LIBRARY).select(
        "id", parsing.parsers_text().alias("parsers"), parsing.fields_text().alias("fields")
    )


@query(
    "pattern_test",
    over_logs(
        r"""SELECT id, m AS matched, CASE WHEN m THEN 'group_0=' || regexp_extract(message, '(?:src|from)=(\S+).*(?:dst|to)=(\S+)', 1)
        || '|group_1=' || regexp_extract(message, '(?:src|from)=(\S+).*(?:dst|to)=(\S+)', 2) ELSE '' END AS groups
        FROM (SELECT id, message, regexp_matches(message, '(?:src|from)=(\S+).*(?:dst|to)=(\S+)') AS m FROM logs) AS t"""
    ),
)
def pattern_test(inp: Inputs) -> DataFrame:
    tried = parsing.test_pattern(inp.logs(), r"(?:src|from)=(\S+).*(?:dst|to)=(\S+)")
    return tried.select("id", "matched", parsing.fields_text("groups").alias("groups"))


_EARLY = [r for r in LIBRARY if r.id <= 12]
_EARLY_HIT = "(" + " OR ".join(rule_sql(r) for r in _EARLY) + ")"


def _partly_parsed(inp: Inputs) -> DataFrame:
    return parsed_logs(inp, _EARLY)


@query(
    "reparse_unparsed",
    over_logs(
        f"SELECT id, array_to_string(parsers, ',') AS parsers, {fields_text_sql(_EVERY)} AS fields, len(parsers) > 0 AS updated FROM parsed",
        todo=f"SELECT * FROM logs WHERE NOT {_EARLY_HIT}",
        parsed=parsed_sql(LIBRARY, source="todo"),
    ),
)
def reparse_unparsed(inp: Inputs) -> DataFrame:
    done = parsing.reparse(_partly_parsed(inp), LIBRARY)
    return done.select("id", parsing.parsers_text().alias("parsers"), parsing.fields_text().alias("fields"), "updated")


@query(
    "reparse_counts",
    over_logs(
        "SELECT count(*) AS processed, count(*) FILTER (len(parsers) > 0) AS updated FROM parsed",
        todo=f"SELECT * FROM logs WHERE NOT {_EARLY_HIT}",
        parsed=parsed_sql(LIBRARY, [], source="todo"),
    ),
)
def reparse_counts(inp: Inputs) -> DataFrame:
    return parsing.reparse_counts(parsing.reparse(_partly_parsed(inp), LIBRARY))


_REGISTRY_COLUMNS = ("parser_id", "parser_name", "device_type", "field_name", "field_label", "field_type")


@query(
    "field_registry",
    over_logs(
        f"""SELECT {', '.join('l.' + c for c in _REGISTRY_COLUMNS)}, coalesce(c.n, 0) AS rows_seen FROM lib l
        LEFT JOIN (SELECT p, count(*) AS n FROM (SELECT unnest(parsers) AS p FROM parsed) AS u GROUP BY p) c ON c.p = l.parser_name""",
        lib=library_sql(LIBRARY),
        parsed=parsed_sql(LIBRARY, []),
    ),
)
def field_registry(inp: Inputs) -> DataFrame:
    """Registry listing with how many rows each owning rule has matched, ordered by device type and field."""
    registry = library.field_registry(library.rules_frame(inp.spark, LIBRARY))
    used = parsed_logs(inp, LIBRARY).select(F.explode("matched_parsers").alias("parser_name")).groupBy("parser_name").count()
    joined = registry.join(used, "parser_name", "left")
    return joined.select(*_REGISTRY_COLUMNS, F.coalesce("count", F.lit(0)).alias("rows_seen")).orderBy(
        "device_type", "field_name", "parser_id"
    )


_DEVICES = ["10.0.1.2", "10.0.0.5", "10.0.2.23", ""]
_DEVICES_SQL = ", ".join(f"'{d}'" for d in _DEVICES)


@query(
    "fields_for_devices",
    over_logs(
        f"""SELECT {', '.join('l.' + c for c in _REGISTRY_COLUMNS)} FROM lib l WHERE l.parser_name IN
        (SELECT unnest(parsers) FROM parsed WHERE coalesce(fromhost_ip, '') IN ({_DEVICES_SQL}))""",
        lib=library_sql(LIBRARY),
        parsed=parsed_sql(LIBRARY, []),
    ),
)
def fields_for_devices(inp: Inputs) -> DataFrame:
    registry = library.field_registry(library.rules_frame(inp.spark, LIBRARY))
    return parsing.fields_for_devices(parsed_logs(inp, LIBRARY), registry, _DEVICES).select(*_REGISTRY_COLUMNS)


_WANTED = ["src_ip", "username"]


@query(
    "parsers_for_fields",
    over_logs(
        """SELECT o.parser_name, count(u.p) AS rows_seen FROM (SELECT DISTINCT parser_name FROM lib WHERE field_name IN ('src_ip', 'username')) o
        LEFT JOIN (SELECT unnest(parsers) AS p FROM parsed) u ON u.p = o.parser_name GROUP BY o.parser_name""",
        lib=library_sql(LIBRARY),
        parsed=parsed_sql(owners(*_WANTED), []),
    ),
)
def parsers_for_fields(inp: Inputs) -> DataFrame:
    """Owning rules with the rows each has matched."""
    registry = library.field_registry(library.rules_frame(inp.spark, LIBRARY))
    owning = parsing.parsers_for_fields(registry, _WANTED)
    used = parsed_logs(inp, owners(*_WANTED)).select(F.explode("matched_parsers").alias("parser_name"))
    counts = used.groupBy("parser_name").agg(F.count("*").alias("rows_seen"))
    return owning.join(counts, "parser_name", "left").na.fill(0, ["rows_seen"])


@query(
    "parser_sync_diff",
    over_logs(
        """SELECT coalesce(e.name, l.name) AS name, CASE WHEN e.name IS NULL THEN 'insert' WHEN l.name IS NULL THEN 'delete' ELSE 'update' END AS action
        FROM (SELECT name FROM existing WHERE is_builtin) e FULL OUTER JOIN (SELECT DISTINCT parser_name AS name FROM lib) l ON e.name = l.name""",
        lib=library_sql(LIBRARY),
        parsed=parsed_sql(LIBRARY, []),
        existing="""SELECT DISTINCT CASE WHEN p LIKE '%Generic%' THEN 'Old ' || p ELSE p END AS name, p NOT LIKE 'SSHD%' AS is_builtin
            FROM (SELECT unnest(parsers) AS p FROM parsed) AS u""",
    ),
)
def parser_sync_diff(inp: Inputs) -> DataFrame:
    """Stored rules are those seen in the data: generic ones under an old name, SSH ones custom."""
    seen = parsed_logs(inp, LIBRARY).select(F.explode("matched_parsers").alias("p")).distinct()
    existing = seen.select(
        F.when(F.contains("p", F.lit("Generic")), F.concat(F.lit("Old "), "p")).otherwise(F.col("p")).alias("name"),
        (~F.col("p").startswith("SSHD")).alias("is_builtin"),
    )
    return parsing.sync_diff(existing, library.rules_frame(inp.spark, LIBRARY))


# Rules as a user may write them: repeats, code points, properties, named classes and escapes next to each other.
_USER_RULES = [
    library.Rule(9001, "Counted digits", "all", None, r"(\d{1,3})\.\d{1,3}\.(\d{1,3})", (("first", "First", "string"), ("third", "Third", "string"))),
    library.Rule(9002, "Exact count", "all", None, r"\b(\w{4})\b", (("four", "Four", "string"),)),
    library.Rule(9003, "Code point", "all", None, r"\x66r\x{6F}m (\S+)", (("origin", "Origin", "string"),)),
    library.Rule(9004, "Property", "all", None, r"\p{Lu}(\p{Ll}{2,15})", (("word", "Word", "string"),)),
    library.Rule(9005, "Named class", "all", None, r"[[:digit:]]]?([[:alpha:]]+)", (("tail", "Tail", "string"),)),
    library.Rule(9006, "Escapes", "all", None, r"\(\w+\)\[?(\d*)", (("number", "Number", "string"),)),
    library.Rule(9007, "Zero repeats", "all", None, r"(?:xyz){0}port (\d{2,5})", (("port", "Port", "string"),)),
]
_USER_FIELDS = all_fields(_USER_RULES)


@query(
    "parse_user_rules",
    over_logs(
        f"SELECT id, array_to_string(parsers, ',') AS parsers, {fields_text_sql(_USER_FIELDS)} AS fields FROM parsed",
        parsed=parsed_sql(_USER_RULES),
    ),
)
def parse_user_rules(inp: Inputs) -> DataFrame:
    return parsed_logs(inp, _USER_RULES).select("id", parsing.parsers_text().alias("parsers"), parsing.fields_text().alias("fields"))
