"""Raw line to log row: decode, repair, normalise, classify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema
from ..functions import clock, text

# Accepted keys per column, in order of preference.
ALIASES = {
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

MALFORMED_TAG = "[MALFORMED JSON]"
TRUNCATED_TAG = "[TRUNCATED AT SOURCE]"

_KEYS = sorted({key for keys in ALIASES.values() for key in keys})
_RECORD = "array<struct<" + ",".join(f"`{key}`:string" for key in _KEYS) + ">>"
_SPLIT_HEADER = r"^\d{4}-\d{2}-\d{2}T\d{2}\z"
# Fixed value: how a record written by the standard template starts.
_TEMPLATE_START = '{"timestamp":"'
# A prefix of a flat object once escapes are dropped and every closed string reads S.
_OPEN_PREFIX = (
    r"^\{(?:\s*S\s*:\s*(?:S|[-+.0-9eE]+|true|false|null)\s*,)*+"
    r"\s*(?:S\s*(?::\s*(?:S|[-+.0-9a-zA-Z]*)\s*)?)?(?:\"[^\"]*)?\z"
)


def decode(lines: DataFrame) -> DataFrame:
    """Add ``record`` (NULL when the line is not one JSON object) and ``defect``.

    The line is decoded as the only element of an array, so text after the object counts as
    an error too. Scalars of any type are read as text.
    """
    line = F.make_valid_utf8(F.col("line"))
    items = F.from_json(F.concat(F.lit("["), line, F.lit("]")), _RECORD, {"allowSingleQuotes": "false"})
    objects = F.when(F.ltrim(F.col("line")).startswith("{"), items)
    single = F.filter(F.array(objects), lambda found: F.size(found) == 1)
    # Exactly one output row per line. Filters on the decoded columns stay above the generator,
    # so each line is decoded once however many columns are tested later.
    generated = lines.select("*", F.explode_outer(single).alias("_found"))
    with_record = generated.withColumn("record", F.get("_found", 0)).drop("_found")
    return with_record.withColumn(
        "defect",
        F.when(F.col("record").isNotNull(), F.lit(None).cast("string"))
        .when(~F.col("line").startswith("{"), "partial")
        .when(is_truncated(F.col("line")), "truncated")
        .otherwise("malformed"),
    )


def is_truncated(line: Column) -> Column:
    """A template record that simply stops: no syntax error up to the end of the line."""
    no_escapes = F.regexp_replace(line, r"\\.", "")
    skeleton = F.regexp_replace(no_escapes, r'"[^"]*"', "S")
    return line.startswith(_TEMPLATE_START) & skeleton.rlike(_OPEN_PREFIX)


def normalize(decoded: DataFrame) -> DataFrame:
    """One text column per log attribute, first non-empty alias first."""
    bad = F.col("defect").isin("malformed", "truncated")
    tag = F.when(F.col("defect") == "truncated", TRUNCATED_TAG).otherwise(MALFORMED_TAG)
    synthetic = {
        "hostname": F.lit("unknown"),
        "severity": F.lit("error"),
        "message": F.concat(tag, F.lit(" "), F.col("line")),
    }
    columns = []
    for name, keys in ALIASES.items():
        value = text.first_filled(*[F.col("record").getField(key) for key in keys])
        value = F.when(bad, synthetic.get(name, F.lit(""))).otherwise(value)
        columns.append(text.sanitize(value).alias(name))
    kept = [c for c in decoded.columns if c not in ("record", *ALIASES)]
    return decoded.select(*kept, *columns)


def repair_split_header(rows: DataFrame) -> DataFrame:
    """Undo a timestamp that was cut at its first colon and taken for the program name."""
    split = F.col("app_name").rlike(_SPLIT_HEADER)
    full = F.concat_ws(":", "app_name", "message")
    return rows.withColumns(
        {
            "app_name": F.when(split, F.when(F.contains(full, F.lit("CEF:")), "CEF").otherwise("")).otherwise(
                F.col("app_name")
            ),
            "message": F.when(split, full).otherwise(F.col("message")),
            "raw_message": F.when(split, full).otherwise(F.col("raw_message")),
        }
    )


def outcome() -> Column:
    """What became of a line: ``dropped_partial``, ``dropped_blank_host``, ``parse_error`` or ``inserted``."""
    return (
        F.when(F.col("defect") == "partial", "dropped_partial")
        .when(F.col("hostname") == "", "dropped_blank_host")
        .when(F.col("defect").isNotNull(), "parse_error")
        .otherwise("inserted")
    )


def classify(lines: DataFrame) -> DataFrame:
    """Every line with its normalised columns and its outcome."""
    rows = normalize(decode(lines.filter("line != ''")))
    return rows.withColumn("outcome", outcome())


def storable(classified: DataFrame) -> DataFrame:
    """Rows that go on to the table, repaired."""
    return repair_split_header(classified.filter(F.col("outcome").isin("inserted", "parse_error")))


def finalize(rows: DataFrame, as_of: Column) -> DataFrame:
    """Typed columns as stored: parsed timestamp (else ingest time), blanks as NULL."""
    nullable = ("fromhost_ip", "app_name", "process_id", "msg_id", "facility", "raw_message", "via_relay")
    parsed = F.when(F.col("defect").isNull(), clock.parse_timestamp(F.col("timestamp"), as_of))
    columns = {name: text.blank_to_null(F.col(name)) for name in nullable}
    columns["timestamp"] = F.coalesce(parsed, as_of)
    columns["created_at"] = as_of
    return rows.withColumns(columns)


def ingest_lines(lines: DataFrame, as_of: Column) -> DataFrame:
    """All of the above: raw ``line`` in, unparsed log rows out."""
    return finalize(storable(classify(lines)), as_of)


def over_length() -> Column:
    """Name of the first column that exceeds its stored width, NULL when all fit."""
    checks = [F.when(F.char_length(F.col(c)) > n, c) for c, n in schema.MAX_LENGTHS.items()]
    return F.coalesce(*checks)


def mark_over_length(rows: DataFrame) -> DataFrame:
    """Add ``over_length``: the first column wider than its usual limit. Such rows are kept like any other."""
    return rows.withColumn("over_length", over_length())


def quality_counts(classified: DataFrame) -> DataFrame:
    """Lines per outcome."""
    return classified.groupBy("outcome").agg(F.count("*").alias("lines"))


def quality_metrics() -> list[Column]:
    """The same counts as observable metrics, for streams (``df.observe(name, *metrics)``)."""
    names = ("inserted", "parse_error", "dropped_partial", "dropped_blank_host")
    counts = [F.count_if(F.col("outcome") == n).alias(n) for n in names]
    return [F.count(F.lit(1)).alias("processed"), *counts]


def resume_after(lines: DataFrame, stored: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Lines later than the newest stored row; lines without a readable time are skipped too."""
    decoded = normalize(decode(lines))
    newest = stored.select(F.max("timestamp")).scalar()
    return decoded.withColumn("ts", clock.parse_timestamp(F.col("timestamp"), as_of)).filter(F.col("ts") > newest)


def assign_ids(rows: DataFrame, load_id: str) -> DataFrame:
    """Add ``load_id`` and a positive 64-bit ``id``: a hash of the load and of the row's place in it.

    There is no counter to share and no limit on tasks or rows, so loads and streams can run side
    by side. ``load_id`` must differ between loads; a batch that is run again keeps its own. Ids
    break ties in paging; nothing is ever de-duplicated by them.
    """
    place = F.xxhash64(F.lit(load_id), F.monotonically_increasing_id())
    return rows.withColumns({"id": place.bitwiseAND(F.lit((1 << 63) - 1)), "load_id": F.lit(load_id)})
