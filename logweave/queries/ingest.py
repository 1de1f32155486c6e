"""S: sources and ingest normalisation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ..functions import clock
from ..operators import ingest, parsing
from ..session import work_dir
from ..sources import library, syslog
from .inputs import AS_OF, AS_OF_SQL, SYSLOG_SQL, Inputs
from .registry import LIBRARY, library_sql, over_lines, over_logs, parsed_logs, parsed_sql, query, text

_OK = "(json_valid(line) AND left(ltrim(line), 1) = '{')"
DECODED = f"""SELECT id, line, CASE WHEN {_OK} THEN line ELSE '{{}}' END AS doc,
    CASE WHEN {_OK} THEN NULL WHEN NOT starts_with(line, '{{') THEN 'partial'
        WHEN starts_with(line, '{{"timestamp":"') AND NOT ends_with(line, '}}') THEN 'truncated' ELSE 'malformed' END AS defect
FROM lines WHERE line <> ''"""


def _first(*keys: str) -> str:
    values = ", ".join(f"""nullif(replace(json_extract_string(doc, '$."{k}"'), chr(0), ''), '')""" for k in keys)
    return f"coalesce({values}, '')"


_COLUMNS = {
    "timestamp": ("timestamp", "@timestamp", "timereported"),
    "fromhost_ip": ("fromhost-ip", "fromhost_ip"),
    "hostname": ("hostname", "fromhost-ip"),
    "severity": ("severity", "severity_text", "syslogseverity-text"),
    "facility": ("facility", "facility_text", "syslogfacility-text"),
    "app_name": ("app_name", "program", "programname"),
    "process_id": ("process_id", "pid", "procid"),
    "message": ("message", "msg"),
    "raw_message": ("raw_message", "message", "msg"),
    "msg_id": ("syslog_tag",),
    "via_relay": ("via_relay",),
}
_SYNTHETIC = {
    "hostname": "'unknown'",
    "severity": "'error'",
    "message": "(CASE WHEN defect = 'truncated' THEN '[TRUNCATED AT SOURCE] ' ELSE '[MALFORMED JSON] ' END) || line",
}
NORMAL = "SELECT id, line, defect, " + ", ".join(
    f"CASE WHEN defect IN ('malformed', 'truncated') THEN {_SYNTHETIC.get(n, chr(39) * 2)} ELSE {_first(*keys)} END AS {n}"
    for n, keys in _COLUMNS.items()
) + " FROM decoded"
_SPLIT = "regexp_matches(app_name, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}$')"
REPAIRED = f"""SELECT * REPLACE (
    CASE WHEN {_SPLIT} THEN (CASE WHEN contains(message, 'CEF:') THEN 'CEF' ELSE '' END) ELSE app_name END AS app_name,
    CASE WHEN {_SPLIT} THEN app_name || ':' || message ELSE message END AS message,
    CASE WHEN {_SPLIT} THEN app_name || ':' || message ELSE raw_message END AS raw_message)
FROM normal WHERE coalesce(defect, '') <> 'partial' AND hostname <> ''"""
# A stamp without a year: the latest one that is not over a day ahead of the ingest time.
_OF_YEAR = "make_timestamp({year}, month(timestamp), day(timestamp), hour(timestamp), minute(timestamp), CAST(second(timestamp) AS DOUBLE))"
_LIMIT = f"({AS_OF_SQL} + INTERVAL 1 DAY)"
YEARLESS = f"""(CASE WHEN {_OF_YEAR.format(year=f'year({_LIMIT})')} <= {_LIMIT} THEN {_OF_YEAR.format(year=f'year({_LIMIT})')} ELSE {_OF_YEAR.format(year=f'year({_LIMIT}) - 1')} END)"""
# What each layout of the fixture stands for.
STAMPS = f"""SELECT id, epoch_us(CASE id % 7 WHEN 0 THEN timestamp WHEN 1 THEN timestamp WHEN 2 THEN timestamp
    WHEN 3 THEN {YEARLESS}
    WHEN 4 THEN date_trunc('second', timestamp) WHEN 5 THEN timestamp - INTERVAL 2 HOUR ELSE NULL END) AS us FROM logs"""
CTES = {"decoded": DECODED, "normal": NORMAL, "repaired": REPAIRED, "stamps": STAMPS}


def _sql(body: str) -> str:
    return over_lines(body, **CTES)


@query("ingest_lines", _sql("SELECT id, line FROM lines WHERE line <> ''"))
def ingest_lines(inp: Inputs) -> DataFrame:
    return inp.lines().filter("line != ''")


_NAMES = ("timestamp", "fromhost_ip", "hostname", "severity", "facility", "app_name", "process_id", "message", "raw_message", "msg_id", "via_relay")


@query("ingest_normalize", _sql(f"SELECT id, {', '.join(f'{n} AS {n}_text' for n in _NAMES)} FROM normal WHERE defect IS NULL"))
def ingest_normalize(inp: Inputs) -> DataFrame:
    rows = ingest.normalize(ingest.decode(inp.lines()))
    return rows.filter("defect IS NULL").select("id", *[F.col(n).alias(f"{n}_text") for n in _NAMES])


@query("ingest_malformed", _sql("SELECT id, hostname, severity, message FROM normal WHERE defect = 'malformed'"))
def ingest_malformed(inp: Inputs) -> DataFrame:
    rows = ingest.normalize(ingest.decode(inp.lines()))
    return rows.filter("defect = 'malformed'").select("id", "hostname", "severity", "message")


@query("ingest_truncated", _sql("SELECT id, hostname, severity, message FROM normal WHERE defect = 'truncated'"))
def ingest_truncated(inp: Inputs) -> DataFrame:
    rows = ingest.normalize(ingest.decode(inp.lines()))
    return rows.filter("defect = 'truncated'").select("id", "hostname", "severity", "message")


@query("ingest_partial_drop", _sql("SELECT id, defect FROM decoded WHERE coalesce(defect, '') <> 'partial'"))
def ingest_partial_drop(inp: Inputs) -> DataFrame:
    return ingest.decode(inp.lines()).filter(F.coalesce("defect", F.lit("")) != "partial").select("id", "defect")


@query("ingest_sanitize", _sql("SELECT id, message, length(message) AS chars FROM normal WHERE defect IS NULL AND contains(line, chr(92) || 'u0000')"))
def ingest_sanitize(inp: Inputs) -> DataFrame:
    rows = ingest.normalize(ingest.decode(inp.lines())).filter("defect IS NULL")
    return rows.filter(F.contains("line", F.lit("\\u0000"))).select("id", "message", F.length("message").cast("long").alias("chars"))


@query("ingest_drop_blank_host", _sql("SELECT id, hostname FROM normal WHERE defect IS DISTINCT FROM 'partial' AND hostname <> ''"))
def ingest_drop_blank_host(inp: Inputs) -> DataFrame:
    kept = ingest.classify(inp.lines()).filter(F.col("outcome").isin("inserted", "parse_error"))
    return kept.select("id", "hostname")


@query("ingest_cef_repair", _sql("SELECT id, app_name, message, raw_message FROM repaired"))
def ingest_cef_repair(inp: Inputs) -> DataFrame:
    return ingest.storable(ingest.classify(inp.lines())).select("id", "app_name", "message", "raw_message")


@query(
    "ingest_timestamp_parse",
    _sql(
        f"""SELECT r.id, make_timestamp(CASE WHEN defect IS NULL THEN coalesce(s.us, epoch_us({AS_OF_SQL})) ELSE epoch_us({AS_OF_SQL}) END) AS timestamp
        FROM repaired r JOIN stamps s ON r.id = s.id"""
    ),
)
def ingest_timestamp_parse(inp: Inputs) -> DataFrame:
    rows = ingest.ingest_lines(inp.lines(), clock.at(AS_OF))
    return rows.select("id", "timestamp")


_NULLABLE = ("fromhost_ip", "app_name", "process_id", "msg_id", "facility", "raw_message", "via_relay")


@query("ingest_nullify", _sql("SELECT id, " + ", ".join(f"nullif({n}, '') AS {n}" for n in _NULLABLE) + " FROM repaired"))
def ingest_nullify(inp: Inputs) -> DataFrame:
    return ingest.ingest_lines(inp.lines(), clock.at(AS_OF)).select("id", *_NULLABLE)


# Widen some columns past their limits, as no given text is that long.
_WIDE = {"hostname": "CASE WHEN id % 13 = 0 THEN repeat(hostname, 60) ELSE hostname END", "facility": "CASE WHEN id % 7 = 0 THEN repeat(facility, 12) ELSE facility END"}


@query(
    "ingest_length_quarantine",
    over_logs(
        f"""SELECT id, CASE WHEN length(h) > 255 THEN 'hostname' WHEN length(f) > 50 THEN 'facility' END AS over_length
        FROM (SELECT id, {_WIDE['hostname']} AS h, {_WIDE['facility']} AS f FROM logs) AS w WHERE length(h) > 255 OR length(f) > 50"""
    ),
)
def ingest_length_quarantine(inp: Inputs) -> DataFrame:
    wide = inp.logs().withColumn("msg_id", F.lit(None).cast("string"))
    wide = wide.withColumns({c: F.expr(e) for c, e in _WIDE.items()})
    return ingest.mark_over_length(wide).filter("over_length IS NOT NULL").select("id", "over_length")


@query(
    "ingest_quality",
    _sql(
        """SELECT CASE WHEN defect = 'partial' THEN 'dropped_partial' WHEN hostname = '' THEN 'dropped_blank_host'
        WHEN defect IS NOT NULL THEN 'parse_error' ELSE 'inserted' END AS outcome, count(*) AS lines FROM normal GROUP BY 1"""
    ),
)
def ingest_quality(inp: Inputs) -> DataFrame:
    return ingest.quality_counts(ingest.classify(inp.lines()))


@query(
    "ingest_resume",
    _sql(
        """SELECT d.id FROM decoded d JOIN stamps s ON d.id = s.id
        WHERE d.defect IS NULL AND s.us > (SELECT epoch_us(max(timestamp)) FROM logs WHERE id < (SELECT max(id) / 2 FROM logs))"""
    ),
)
def ingest_resume(inp: Inputs) -> DataFrame:
    logs = inp.logs()
    half = logs.select(F.max("id") / 2).scalar()
    stored = logs.filter(F.col("id") < half)
    return ingest.resume_after(inp.lines(), stored, clock.at(AS_OF)).select("id")


@query(
    "ingest_rfc3164",
    over_logs(
        f"""SELECT id, hostname, coalesce(app_name, 'app') AS app_name, process_id, {YEARLESS} AS timestamp,
        ['emerg', 'alert', 'crit', 'err', 'warning', 'notice', 'info', 'debug'][id % 8 + 1] AS severity,
        CASE WHEN facility = 'auth' THEN 'auth' ELSE 'local0' END AS facility, message FROM logs WHERE id % 41 <> 0"""
    ),
)
def ingest_rfc3164(inp: Inputs) -> DataFrame:
    rows = syslog.parse_rfc3164(inp.sql(SYSLOG_SQL, with_logs=True), as_of=clock.at(AS_OF))
    return rows.select(
        "id", "hostname", "app_name", "process_id", "timestamp", "severity", "facility", "message"
    )


_FIELD_COUNT = "SELECT parser_id, any_value(parser_name) AS name, any_value(device_type) AS device_type, any_value(match_type) AS match_type, any_value(match_value) AS match_value, count(*) AS n_fields FROM lib GROUP BY parser_id"


@query(
    "parser_library",
    over_logs(
        """SELECT l.parser_id AS id, l.name, l.device_type, l.match_type, nullif(l.match_value, '') AS match_value, l.n_fields, coalesce(c.n, 0) AS matched_rows
        FROM rules l LEFT JOIN (SELECT p, count(*) AS n FROM (SELECT unnest(parsers) AS p FROM parsed) AS u GROUP BY p) c ON c.p = l.name""",
        lib=library_sql(LIBRARY),
        rules=_FIELD_COUNT,
        parsed=parsed_sql(LIBRARY, []),
    ),
)
def parser_library(inp: Inputs) -> DataFrame:
    """The library with the number of rows each rule has matched."""
    rules = library.rules_frame(inp.spark, LIBRARY)
    used = parsed_logs(inp, LIBRARY).select(F.explode("matched_parsers").alias("name")).groupBy("name").count()
    return rules.join(used, "name", "left").select(
        "id",
        "name",
        "device_type",
        "match_type",
        "match_value",
        F.size("fields").cast("long").alias("n_fields"),
        F.coalesce("count", F.lit(0)).alias("matched_rows"),
    )


@query(
    "library_folder",
    over_logs(
        """SELECT l.parser_id AS id, l.name, l.description, l.labels, coalesce(c.n, 0) AS matched_rows, 'broken.json' AS broken_files
        FROM rules l LEFT JOIN (SELECT p, count(*) AS n FROM (SELECT unnest(parsers) AS p FROM parsed) AS u GROUP BY p) c ON c.p = l.name""",
        lib=library_sql(LIBRARY),
        about="SELECT * FROM (VALUES " + ", ".join(f"({r.id}, {text(r.description)})" for r in LIBRARY) + ") AS v(about_id, description)",
        rules="SELECT parser_id, any_value(parser_name) AS name, any_value(description) AS description, string_agg(field_label, ', ' ORDER BY pos) AS labels"
        " FROM lib JOIN about ON about_id = parser_id GROUP BY parser_id",
        parsed=parsed_sql(LIBRARY, []),
    ),
)
def library_folder(inp: Inputs) -> DataFrame:
    """Logs parsed by a library that is read from a folder of rule files, one of them broken."""
    folder = work_dir(inp.spark, "rules")
    library.write_files(inp.spark, folder, {**library.builtin_files(), "broken.json": '[{"name": "cut off'})
    rules, errors = library.read_library(inp.spark, folder)
    broken = ", ".join(r["file"] for r in errors.orderBy("file").collect())  # one row a file
    used = parsed_logs(inp, library.collect_rules(rules)).select(F.explode("matched_parsers").alias("name")).groupBy("name").count()
    return rules.join(used, "name", "left").select(
        "id",
        "name",
        "description",
        F.array_join(F.transform("fields", lambda f: f["label"]), ", ").alias("labels"),
        F.coalesce("count", F.lit(0)).alias("matched_rows"),
        F.lit(broken).alias("broken_files"),
    )


# The first edition has every second rule, under other descriptions; rows before it are not parsed.
_FIRST_EDITION = [replace(r, description=f"As first shipped: {r.name}") for r in LIBRARY if r.id % 2]
_FIRST_FROM, _SECOND_FROM = "2024-01-05 00:00:00", "2024-01-18 06:30:00"


def _edition_sql(number: int, rules: list, source: str) -> str:
    about = ", ".join(f"({text(r.name)}, {text(r.description)}, {len(r.fields)})" for r in rules)
    return (
        f"SELECT {number} AS library_edition, u.name, v.description, v.n_fields, count(*) AS n FROM (SELECT unnest(parsers) AS name FROM ({parsed_sql(rules, [], source)})) AS u"
        f" JOIN (VALUES {about}) AS v(name, description, n_fields) ON v.name = u.name GROUP BY ALL"
    )


@query(
    "library_editions",
    over_logs(
        f"""SELECT library_edition, name, description, CAST(n_fields AS BIGINT) AS n_fields, n AS matched_rows FROM (SELECT * FROM first_matches UNION ALL SELECT * FROM second_matches) AS m
        UNION ALL SELECT NULL, NULL, NULL, NULL, count(*) FROM logs WHERE timestamp < TIMESTAMP '{_FIRST_FROM}'""",
        first_rows=f"SELECT * FROM logs WHERE timestamp >= TIMESTAMP '{_FIRST_FROM}' AND timestamp < TIMESTAMP '{_SECOND_FROM}'",
        second_rows=f"SELECT * FROM logs WHERE timestamp >= TIMESTAMP '{_SECOND_FROM}'",
        first_matches=_edition_sql(0, _FIRST_EDITION, "first_rows"),
        second_matches=_edition_sql(1, LIBRARY, "second_rows"),
    ),
)
def library_editions(inp: Inputs) -> DataFrame:
    """Rows parsed by the library edition of their time, counted by edition and rule with the rule's text of then; and rows older than any edition."""
    path = work_dir(inp.spark, "editions")
    library.record_edition(inp.spark, path, _FIRST_EDITION, _FIRST_FROM)
    library.record_edition(inp.spark, path, LIBRARY, _SECOND_FROM)
    parsed = parsing.parse_as_of(inp.logs(spread=True), library.editions(inp.spark, path))
    matched = parsing.described(parsed, library.edition_history(inp.spark, path))
    counted = matched.groupBy("library_edition", "name", "description", F.size("fields").cast("long").alias("n_fields")).agg(F.count("*").alias("matched_rows"))
    none = F.lit(None)
    older = parsed.filter("library_edition IS NULL").agg(F.count("*").alias("matched_rows"))
    return counted.unionByName(older.select(none.cast("int").alias("library_edition"), none.cast("string").alias("name"), none.cast("string").alias("description"), none.cast("long").alias("n_fields"), "matched_rows"))
