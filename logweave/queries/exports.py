"""O: exports, retention, partitions; T: text functions and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import search, text
from ..functions.stem import STOP_WORDS
from ..operators import export, filters, retention
from .inputs import AS_OF, Inputs
from .registry import over_logs, owners, parsed_logs, parsed_sql, query, register

_FIELDS = ["src_ip", "username"]
_RULES = owners(*_FIELDS)
_PARSED = parsed_sql(_RULES, _FIELDS)


def _local(zone: str) -> str:
    return f"strftime(timezone('{zone}', timezone('UTC', timestamp)), '%Y-%m-%d %H:%M:%S')"


def _guard(column: str) -> str:
    value = f"coalesce({column}, '')"
    return f"CASE WHEN left({value}, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || {value} ELSE {value} END"


_COLUMNS = ("hostname", "app_name", "severity", "message")
_FILTER = filters.LogFilter(start="2024-01-03T00:00:00", severity="info")
_WHERE = "timestamp >= TIMESTAMP '2024-01-03 00:00:00' AND severity = 'info'"


@query(
    "export_csv_rows",
    over_logs(
        f"""SELECT id, {_local('Europe/Warsaw')} AS ts, {', '.join(f'{_guard(c)} AS {c}' for c in _COLUMNS)},
        {', '.join(f'{_guard("f_" + f)} AS {f}' for f in _FIELDS)} FROM parsed WHERE {_WHERE} ORDER BY timestamp DESC, id DESC""",
        parsed=_PARSED,
    ),
)
def export_csv_rows(inp: Inputs) -> DataFrame:
    chosen = filters.apply(parsed_logs(inp, _RULES), _FILTER)
    return export.csv_rows(chosen, "Europe/Warsaw", tuple(_FIELDS))


@query(
    "export_rows_tz",
    over_logs(f"SELECT id, {_local('America/New_York')} AS ts, {', '.join(f'coalesce({c}, {chr(39) * 2}) AS {c}' for c in _COLUMNS)} FROM logs WHERE {_WHERE}"),
)
def export_rows_tz(inp: Inputs) -> DataFrame:
    """Without a limit: every row of the selection."""
    return export.rows(filters.apply(inp.logs(), _FILTER), "America/New_York", limit=0)


def _escaped(column: str) -> str:
    out = f"coalesce({column}, '')"
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("''", "&#39;")):
        out = f"replace({out}, '{raw}', '{entity}')"
    return out


_CELLS = " || ".join(f"'<td>' || {c} || '</td>'" for c in (_local("UTC"), *[_escaped(c) for c in _COLUMNS]))


@query("export_html_rows", over_logs(f"SELECT id, '<tr>' || {_CELLS} || '</tr>' AS html_row FROM logs ORDER BY timestamp DESC, id DESC"))
def export_html_rows(inp: Inputs) -> DataFrame:
    return export.html_rows(inp.logs(), "Nowhere/Unknown")


_JSON = ("hostname", "fromhost_ip", "app_name", "process_id", "severity", "facility", "message", "raw_message")
_PAGE = f"SELECT {_local('UTC')} AS ts, timestamp, id, {', '.join(_JSON)}, TRUE AS has_more"


@query("export_json", over_logs(f"{_PAGE} FROM logs ORDER BY timestamp DESC, id DESC LIMIT 1000"))
def export_json(inp: Inputs) -> DataFrame:
    return export.json_page(inp.logs())


@query(
    "export_parsed_json",
    over_logs(f"{_PAGE} FROM parsed WHERE len(parsers) > 0 AND (timestamp, id) < (TIMESTAMP '2024-01-28 00:00:00', 9) ORDER BY timestamp DESC, id DESC LIMIT 500", parsed=_PARSED),
)
def export_parsed_json(inp: Inputs) -> DataFrame:
    page = export.json_page(parsed_logs(inp, _RULES), limit=500, after=("2024-01-28T00:00:00", 9), parsed_only=True)
    return page.drop("parsed_fields", "matched_parsers")


_CUT = "TIMESTAMP '2024-01-16 06:00:00'"
_CUT_AT = AS_OF.replace(hour=6)


@query("retention_keep", over_logs(f"SELECT id FROM logs WHERE timestamp >= {_CUT}"))
def retention_keep(inp: Inputs) -> DataFrame:
    return retention.keep(inp.logs(), _CUT_AT, 15).select("id")


@query(
    "retention_plan",
    over_logs(
        f"""SELECT name, "rows", start, "end", CASE WHEN "end" <= {_CUT} THEN 'drop' WHEN start < {_CUT} THEN 'rewrite' ELSE 'keep' END AS action
        FROM (SELECT strftime(timestamp, 'syslog_logs_%Y_%m_%d') AS name, count(*) AS "rows", date_trunc('day', min(timestamp)) AS start,
            date_trunc('day', min(timestamp)) + INTERVAL 1 DAY AS "end" FROM logs GROUP BY 1) AS p"""
    ),
)
def retention_plan(inp: Inputs) -> DataFrame:
    return retention.plan(inp.logs(), _CUT_AT, 15)


@query(
    "partition_bounds",
    over_logs(
        """SELECT DISTINCT strftime(timestamp, 'syslog_logs_%Y_%m_%d') AS name, CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS start,
            CAST(date_trunc('day', timestamp) AS TIMESTAMP) + INTERVAL 1 DAY AS "end" FROM logs
        UNION ALL SELECT DISTINCT strftime(timestamp, 'syslog_logs_%Y_%m'), CAST(date_trunc('month', timestamp) AS TIMESTAMP),
            CAST(date_trunc('month', timestamp) AS TIMESTAMP) + INTERVAL 1 MONTH FROM logs
        UNION ALL SELECT DISTINCT 'syslog_logs_' || severity, NULL, NULL FROM logs"""
    ),
)
def partition_bounds(inp: Inputs) -> DataFrame:
    """Day and month partitions of the rows, and names that are no partitions."""
    logs = inp.logs()
    names = [
        retention.partition_name(F.col("timestamp")),
        retention.partition_name(F.col("timestamp"), "month"),
        F.concat(F.lit(retention.PREFIX), F.col("severity")),
    ]
    found = logs.select(F.explode(F.array(*names)).alias("name")).distinct()
    return retention.partition_bounds(found)


@query("csv_safe", f"SELECT doc_id, {_guard('text')} AS safe, {_guard('substring(text, 8)')} AS safe_tail FROM documents")
def csv_safe(inp: Inputs) -> DataFrame:
    guard = lambda c: text.csv_safe(F.coalesce(c, F.lit("")))
    docs = inp.table("documents")
    return docs.select("doc_id", guard(F.col("text")).alias("safe"), guard(F.expr("substring(text, 8)")).alias("safe_tail"))


@query("html_escape", f"SELECT page_id, {_escaped('html')} AS escaped FROM pages")
def html_escape(inp: Inputs) -> DataFrame:
    return inp.table("pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


# --- search ---

_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
_WORDS = "list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), lambda w: TRUE)"


@query(
    "search_tokens",
    f"""SELECT doc_id, array_to_string(list_filter(w, lambda x: x NOT IN ({_STOP})), ' ') AS tokens, len(w) AS n_words
    FROM (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents) AS d""",
)
def search_tokens(inp: Inputs) -> DataFrame:
    # Behind a generator of one element, so that words are extracted once for both columns.
    words = inp.table("documents").select("doc_id", F.explode(F.array(search.tokens(F.col("text"), keep_stop_words=True))).alias("w"))
    return words.select(
        "doc_id",
        F.concat_ws(" ", search.without_stop_words(F.col("w"))).alias("tokens"),
        F.size("w").cast("long").alias("n_words"),
    )


def _search(name: str, asked: str, where: str) -> None:
    def build(inp: Inputs) -> DataFrame:
        line = search.token_line(F.col("text"))
        return inp.table("documents").filter(search.matches(line, asked, stemming=False)).select("doc_id", "lang")

    sql = f"SELECT doc_id, lang FROM (SELECT doc_id, lang, {_WORDS.format(text='text')} AS w FROM documents) AS d WHERE {where}"
    register(name, build, sql)


_PAIR = "list_bool_or(list_transform(range(1, len(w)), lambda i: w[i] = '{}' AND w[i + 1] = '{}'))"
_has = lambda *words: " AND ".join(f"list_contains(w, '{w}')" for w in words)
_search("search_and", "thon ANEA the", _has("thon", "anea"))
_search("search_or", "thon thble or ingen", f"({_has('thon', 'thble')}) OR ({_has('ingen')})")
_search("search_not", "thon -anea -the", f"({_has('thon')}) AND NOT list_contains(w, 'anea')")
_search("search_phrase", '"de la" -"tion thon"', f"{_PAIR.format('de', 'la')} AND NOT {_PAIR.format('tion', 'thon')}")
