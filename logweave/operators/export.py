"""Exports: CSV, HTML and JSON rows, and the line-oriented writers for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock, text
from . import filters, paging, parsing

# The CSV columns.
COLUMNS = ("hostname", "app_name", "severity", "message")
JSON_COLUMNS = (
    "hostname",
    "fromhost_ip",
    "app_name",
    "process_id",
    "msg_id",
    "severity",
    "facility",
    "message",
    "raw_message",
    "parsed_fields",
    "matched_parsers",
)


def newest(logs: DataFrame, limit: int) -> DataFrame:
    """Newest rows first: all of them by a distributed sort, or the first ``limit`` by a top-k."""
    ordered = logs.orderBy(*paging.order("newest"))
    return ordered.limit(limit) if limit else ordered


def rows(logs: DataFrame, zone: str | None, fields: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """Export columns as text; times as shown on a clock in ``zone``, unknown zones as UTC."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return newest(logs, limit).select(
        "id",
        clock.text_in_zone(F.col("timestamp"), clock.known_zone(zone)).alias("ts"),
        *[blank(F.col(c)).alias(c) for c in COLUMNS],
        *[blank(parsing.field(f)).alias(f) for f in fields],
    )


def csv_rows(logs: DataFrame, zone: str | None, fields: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """Export rows with every column but the time made safe for spreadsheets."""
    plain = rows(logs, zone, fields, limit)
    return plain.select("id", "ts", *[text.csv_safe(F.col(c)).alias(c) for c in (*COLUMNS, *fields)])


def csv_lines(csv: DataFrame, name: str) -> DataFrame:
    """The file as lines: export name, header, data in order."""
    columns = [c for c in csv.columns if c != "id"]
    spark = csv.sparkSession
    header = ",".join(["timestamp", *columns[1:]])
    head = spark.createDataFrame([(f"# Export: {name}",), (header,)], "line string").coalesce(1)
    options = {"escape": '"', "emptyValue": ""}
    return head.union(csv.select(F.to_csv(F.struct(*columns), options).alias("line")))


def html_row(zone_text: Column) -> Column:
    """One table row with escaped cells."""
    cells = [zone_text, *[F.coalesce(c, F.lit("")) for c in COLUMNS]]
    cells = [F.concat(F.lit("<td>"), text.html_escape(c), F.lit("</td>")) for c in cells]
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


def html_rows(logs: DataFrame, zone: str | None, limit: int = 0) -> DataFrame:
    when = clock.text_in_zone(F.col("timestamp"), clock.known_zone(zone))
    return newest(logs, limit).select("id", html_row(when).alias("html_row"))


def html_lines(html: DataFrame, logs: DataFrame, name: str) -> DataFrame:
    """A whole report: title, total number of matching rows, the rows shown."""
    spark = html.sparkSession
    title = text.html_escape(F.lit(name))
    columns = "".join(f"<th>{c}</th>" for c in ("timestamp", *COLUMNS))
    total = F.format_string("<p>%d rows</p>", F.count("*"))
    opening = F.concat(
        F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'),
        title,
        F.lit("</title></head><body><h1>"),
        title,
        F.lit("</h1>"),
        total,
        F.lit(f"<table><thead><tr>{columns}</tr></thead><tbody>"),
    )
    closing = spark.createDataFrame([("</tbody></table></body></html>",)], "line string").coalesce(1)
    return logs.agg(opening.alias("line")).union(html.select(F.col("html_row").alias("line"))).union(closing)


def json_page(
    logs: DataFrame,
    zone: str | None = None,
    limit: int | None = None,
    after: tuple | None = None,
    parsed_only: bool = False,
) -> DataFrame:
    """A page for API clients. ``timestamp`` and ``id`` of the last row are the next cursor."""
    if parsed_only:
        logs = filters.apply(logs, filters.LogFilter(has_fields=True))
    page = paging.page(logs, paging.page_size(limit, paging.EXPORT_PAGE), after=after)
    shown = [c for c in JSON_COLUMNS if c in page.columns]
    return page.select(
        clock.text_in_zone(F.col("timestamp"), clock.known_zone(zone)).alias("ts"), "timestamp", "id", "has_more", *shown
    )


def json_lines(logs: DataFrame, zone: str | None = None) -> DataFrame:
    """Every row as one JSON object, for bulk export (``write.text``); row order is not fixed."""
    ts = clock.text_in_zone(F.col("timestamp"), clock.known_zone(zone)).alias("ts")
    shown = [c for c in JSON_COLUMNS if c in logs.columns]
    return logs.select(F.to_json(F.struct(ts, *shown), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files whose concatenation in name order is the export."""
    lines.select(F.col(lines.columns[0]).alias("value")).write.mode("errorifexists").text(path)
