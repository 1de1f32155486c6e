"""G3-G8: pages and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import filters, paging
from .inputs import ALIASES_SQL, Inputs
from .registry import over_logs, query

_COLS = "id, timestamp, hostname, fromhost_ip, severity, message"
_NAMES = _COLS.split(", ")
_CURSOR = ("2024-01-15T12:00:00", 4800)
_CURSOR_SQL = "TIMESTAMP '2024-01-15 12:00:00'"


def _page_sql(order: str, size: int, where: str = "TRUE", offset: int = 0) -> str:
    return over_logs(
        f"""SELECT {_COLS}, has_more FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () > {offset + size} AS has_more
        FROM logs WHERE {where}) AS r WHERE rn > {offset} AND rn <= {offset + size}"""
    )


_NEWEST = "timestamp DESC, id DESC"


@query("logs_page", _page_sql(_NEWEST, 50))
def logs_page(inp: Inputs) -> DataFrame:
    return paging.page(inp.logs(), paging.page_size(None)).select(*_NAMES, "has_more")


@query("logs_page_after", _page_sql(_NEWEST, 50, f"(timestamp, id) < ({_CURSOR_SQL}, 4800)"))
def logs_page_after(inp: Inputs) -> DataFrame:
    return paging.page(inp.logs(), 50, after=_CURSOR).select(*_NAMES, "has_more")


@query("logs_page_asc", _page_sql("timestamp, id", 5000, f"(timestamp, id) > ({_CURSOR_SQL}, 4800)"))
def logs_page_asc(inp: Inputs) -> DataFrame:
    return paging.page(inp.logs(), paging.page_size(5000), sort="oldest", after=_CURSOR).select(*_NAMES, "has_more")


@query("logs_by_severity", _page_sql(f"severity, {_NEWEST}", 100, offset=200))
def logs_by_severity(inp: Inputs) -> DataFrame:
    return paging.page(inp.logs(), 100, sort="severity", offset=200).select(*_NAMES, "has_more")


@query("logs_by_hostname", _page_sql(f"hostname, {_NEWEST}", 100, offset=50))
def logs_by_hostname(inp: Inputs) -> DataFrame:
    return paging.page(inp.logs(), 100, sort="hostname", offset=50).select(*_NAMES, "has_more")


@query("logs_by_severity_after", _page_sql(f"severity, {_NEWEST}", 100, f"severity > 'err' OR (severity = 'err' AND (timestamp, id) < ({_CURSOR_SQL}, 4800))"))
def logs_by_severity_after(inp: Inputs) -> DataFrame:
    return paging.page(inp.logs(), 100, sort="severity", after=("err", *_CURSOR)).select(*_NAMES, "has_more")


@query("logs_page_deep", _page_sql(f"hostname, {_NEWEST}", 100, offset=5000))
def logs_page_deep(inp: Inputs) -> DataFrame:
    return paging.page(inp.logs(), 100, sort="hostname", offset=5000, deep=1000).select(*_NAMES, "has_more")


@query(
    "logs_with_alias",
    over_logs(
        "SELECT l.id, l.hostname, coalesce(a.display_name, '') AS display_name FROM logs l LEFT JOIN aliases a ON a.fromhost_ip = coalesce(l.fromhost_ip, '')",
        aliases=ALIASES_SQL,
    ),
)
def logs_with_alias(inp: Inputs) -> DataFrame:
    aliases = inp.sql(ALIASES_SQL, with_logs=True)
    return paging.with_alias(inp.logs(), aliases).select("id", "hostname", "display_name")


@query("logs_count", over_logs("SELECT count(*) AS total FROM logs WHERE severity = 'err' AND app_name ILIKE '%kern%'"))
def logs_count(inp: Inputs) -> DataFrame:
    return paging.count(filters.apply(inp.logs(), filters.LogFilter(severity="err", app_name="kern")))


@query("logs_total", over_logs("SELECT count(*) AS total FROM logs"))
def logs_total(inp: Inputs) -> DataFrame:
    return paging.count(inp.logs())
