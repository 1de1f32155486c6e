"""W: streaming. Each query drains a stream over the given events and returns what it wrote."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions import clock
from ..operators import parsing
from ..plans import jobs
from ..session import work_dir
from ..sources import tables
from ..streaming import aggregates, alerts as stream_alerts, ingest as stream_ingest, runs
from .alerts import PARSED, PARSERS, RULES, SETTINGS, SLOTS, gate_sql
from .ingest import CTES
from .inputs import AS_OF, AS_OF_SQL, Inputs, log_columns, zoned
from .registry import fields_text_sql, named, over_lines, over_logs, parsed_sql, query
from .rollups import SILENCE_APPLIES, SILENCE_RULES, SILENCE_VALUES

_STREAM_RULES = named("Cisco IOS BGP", "MikroTik User Login", "SSHD Auth", "PAM Session", "Generic IP Extraction")
_STREAM_FIELDS = sorted({f for r in _STREAM_RULES for f in r.field_names})
_NOW = {"availableNow": True}
_MIDDLE = "2024-01-16T00:00:00"


def _line_stream(inp: Inputs) -> DataFrame:
    """The landed lines as a stream."""
    landed = inp.lines()
    return inp.spark.readStream.schema(landed.schema).parquet(inp.landed_path())


def _appended(inp: Inputs, stream: DataFrame, purpose: str) -> DataFrame:
    """Drain an append-mode stream into a table and read it back."""
    base = work_dir(inp.spark, purpose)
    runs.drain(runs.to_table(stream, f"{base}/table", f"{base}/checkpoint"))
    return runs.read_table(inp.spark, f"{base}/table", stream)


@query(
    "stream_parse",
    over_lines(
        f"SELECT id, hostname, message, array_to_string(parsers, ',') AS parsers, {fields_text_sql(_STREAM_FIELDS)} AS fields FROM parsed",
        **CTES,
        parsed=parsed_sql(_STREAM_RULES, source="repaired"),
    ),
)
def stream_parse(inp: Inputs) -> DataFrame:
    parsed = stream_ingest.parse_stream(_line_stream(inp), _STREAM_RULES, clock.at(AS_OF))
    shown = parsed.select("id", "hostname", "message", parsing.parsers_text().alias("parsers"), parsing.fields_text().alias("fields"))
    return _appended(inp, shown, "stream-parse")


@query(
    "stream_ingest_sink",
    over_lines(
        f"""SELECT CAST(make_timestamp(coalesce(us, epoch_us({AS_OF_SQL}))) AS DATE) AS log_date, count(*) AS n_rows, count(DISTINCT hostname) AS hosts FROM (
            SELECT r.hostname, CASE WHEN r.defect IS NULL THEN s.us ELSE NULL END AS us FROM repaired r JOIN stamps s ON s.id = r.id) AS x
        GROUP BY 1""",
        **CTES,
    ),
)
def stream_ingest_sink(inp: Inputs) -> DataFrame:
    """Rows per day folder after the stream has been written."""
    base = work_dir(inp.spark, "stream-sink")
    lines = _line_stream(inp).drop("id")
    started = stream_ingest.ingest_to_table(
        lines, f"{base}/logs", f"{base}/checkpoint", _STREAM_RULES, clock.at(AS_OF), _NOW
    )
    runs.drain(started)
    stored = inp.spark.read.parquet(f"{base}/logs")
    per_host = stored.groupBy(F.to_date("timestamp").alias("log_date"), "hostname").agg(F.count("*").alias("n"))
    return per_host.groupBy("log_date").agg(F.sum("n").alias("n_rows"), F.count("*").alias("hosts"))


@query(
    "load_compact",
    over_lines(
        """SELECT 2 * count(*) AS n_rows, 2 * count(*) AS n_ids FROM repaired""",
        **CTES,
    ),
)
def load_compact(inp: Inputs) -> DataFrame:
    """Rows and different ids after two loads of text files and two streams have been brought into one table."""
    spark, base = inp.spark, work_dir(inp.spark, "load-compact")
    for half in (0, 1):
        inp.lines().filter(F.col("id") % 2 == half).select("line").write.text(f"{base}/text-{half}")
        jobs.load(spark, f"{base}/text-{half}", f"{base}/logs", [], AS_OF, index_text=False)
    for half in (0, 1):  # the same lines once more, on two streams
        lines = _line_stream(inp).filter(F.col("id") % 2 == half).drop("id")
        runs.drain(stream_ingest.ingest_to_table(lines, f"{base}/landing-{half}", f"{base}/checkpoint-{half}", [], clock.at(AS_OF), _NOW))
        jobs.compact_stream(spark, f"{base}/landing-{half}", f"{base}/logs", dt.date(9999, 1, 1))
    return tables.read_logs(spark, f"{base}/logs").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"))


@query("stream_timeline", over_logs("SELECT date_trunc('hour', timestamp) AS hour, count(*) AS cnt FROM logs GROUP BY 1"))
def stream_timeline(inp: Inputs) -> DataFrame:
    base = work_dir(inp.spark, "stream-timeline")
    runs.drain(aggregates.hourly_timeline(inp.stream_logs(), base, f"{base}/checkpoint", _NOW))
    return aggregates.read_timeline(inp.spark, base)


@query(
    "stream_log_rate",
    over_logs(
        """SELECT make_timestamp(w * 1000000) AS window_start, count(*) AS events, count(*) / 10.0 AS per_second
        FROM (SELECT unnest(range(epoch_us(timestamp) // 1000000 - 9, epoch_us(timestamp) // 1000000 + 1)) AS w FROM logs) AS s GROUP BY w"""
    ),
)
def stream_log_rate(inp: Inputs) -> DataFrame:
    base = work_dir(inp.spark, "stream-rate")
    runs.drain(aggregates.log_rate(inp.stream_logs(), base, f"{base}/checkpoint", _NOW))
    return aggregates.read_rate(inp.spark, base)


def _halves(inp: Inputs, purpose: str, run, spread: bool = False) -> str:
    """Let the newer half of the events arrive first and the older half in a second run; returns the folder.

    Both halves land as files of their own; the second run resumes from the first one's checkpoint.
    ``spread`` deals the rows to all cores as they are read, for work that costs far more than moving a row.
    """
    tasks = 3 * inp.spark.sparkContext.defaultParallelism
    spark, base = inp.spark, work_dir(inp.spark, purpose)
    events = inp.table("events")
    older = F.col("ts") < F.lit(_MIDDLE).cast("timestamp_ntz")
    for half in (~older, older):
        events.filter(half).write.mode("append").parquet(f"{base}/landing")
        landed = spark.readStream.schema(events.schema).parquet(f"{base}/landing")
        run(zoned(log_columns(landed.repartition(tasks) if spread else landed)), base)
    return base


@query(
    "stream_alert_threshold",
    gate_sql(
        SLOTS,
        SETTINGS,
        "SELECT rule_id, t_us, matches, CAST(acc AS BIGINT) AS accumulated FROM g WHERE fired",
        over_logs,
        parsed=PARSED,
    ),
)
def stream_alert_threshold(inp: Inputs) -> DataFrame:
    """Firings after the older half of the rows has come last."""

    def run(logs: DataFrame, base: str) -> None:
        runs.drain(stream_alerts.threshold_alerts(parsing.parse(logs, PARSERS), RULES, base, f"{base}/checkpoint", _NOW))

    return stream_alerts.read_firings(inp.spark, _halves(inp, "stream-alerts", run, spread=True))


_LEVELS = "(VALUES ('warning', 1), ('error', 2), ('critical', 4)) AS lv(level, factor)"
_SILENCE_SQL = over_logs(
    f"""SELECT rule_id, fromhost_ip, at_us, event, last_us FROM (
        SELECT rule_id, fromhost_ip, t_us + factor * minutes * 60000000 AS at_us, level AS event, t_us AS last_us FROM gaps, {_LEVELS}
        WHERE t_us + factor * minutes * 60000000 <= coalesce(next_us, newest)
        UNION ALL SELECT rule_id, fromhost_ip, next_us, 'recovered', t_us FROM gaps WHERE next_us - t_us >= minutes * 60000000) AS e""",
    seen="""SELECT DISTINCT coalesce(fromhost_ip, '') AS fromhost_ip, epoch_us(timestamp) AS t_us, (SELECT epoch_us(max(timestamp)) FROM logs) AS newest FROM logs""",
    gaps=f"""SELECT *, lead(t_us) OVER (PARTITION BY rule_id, fromhost_ip ORDER BY t_us) AS next_us
        FROM seen, {SILENCE_VALUES} WHERE fromhost_ip <> '' AND {SILENCE_APPLIES}
        UNION ALL SELECT *, lead(t_us) OVER (ORDER BY t_us) AS next_us FROM seen, {SILENCE_VALUES} WHERE fromhost_ip = '' AND rule_id = 1""",
)


@query("stream_device_silence", _SILENCE_SQL)
def stream_device_silence(inp: Inputs) -> DataFrame:
    """Events after the older half of the rows has come last."""

    def run(logs: DataFrame, base: str) -> None:
        runs.drain(stream_alerts.device_silence(logs, SILENCE_RULES, base, f"{base}/checkpoint", _NOW))

    return stream_alerts.read_silence(inp.spark, _halves(inp, "stream-silence", run))


@query("device_silence_events", _SILENCE_SQL)
def device_silence_events(inp: Inputs) -> DataFrame:
    return stream_alerts.silence_events(inp.logs(), SILENCE_RULES)


def _counted(inp: Inputs, keys: list, names: list[str], purpose: str) -> DataFrame:
    base = work_dir(inp.spark, purpose)
    runs.drain(aggregates.running_counts(inp.stream_logs(), keys, f"{base}/deltas", f"{base}/checkpoint", _NOW))
    return aggregates.read_running_counts(inp.spark, f"{base}/deltas", *names)


@query("stream_severity_counts", over_logs("SELECT severity, count(*) AS cnt, max(timestamp) AS last_seen FROM logs GROUP BY 1"))
def stream_severity_counts(inp: Inputs) -> DataFrame:
    return _counted(inp, [F.col("severity")], ["severity"], "stream-severity")


@query(
    "stream_device_counts",
    over_logs("SELECT coalesce(fromhost_ip, '') AS fromhost_ip, severity, count(*) AS cnt, max(timestamp) AS last_seen FROM logs GROUP BY 1, 2"),
)
def stream_device_counts(inp: Inputs) -> DataFrame:
    device = F.coalesce("fromhost_ip", F.lit("")).alias("fromhost_ip")
    return _counted(inp, [device, F.col("severity")], ["fromhost_ip", "severity"], "stream-devices")


@query(
    "stream_late_data",
    over_logs(
        """SELECT hour, n AS ingested, n AS in_timeline, CASE WHEN hour < TIMESTAMP '2024-01-16 00:00:00' THEN n ELSE 0 END AS counted_late
        FROM (SELECT date_trunc('hour', timestamp) AS hour, count(*) AS n FROM logs GROUP BY 1) AS h"""
    ),
)
def stream_late_data(inp: Inputs) -> DataFrame:
    """The newer half of the rows arrives first. The older half is then late: it is stored, counted and reported as late."""

    def run(logs: DataFrame, base: str) -> None:
        only = logs.select("timestamp")
        runs.drain(aggregates.hourly_timeline(only, base, f"{base}/timeline-checkpoint", _NOW))
        runs.drain(runs.to_table(only, f"{base}/rows", f"{base}/rows-checkpoint"))

    base = _halves(inp, "stream-late", run)
    rows = inp.spark.read.schema("timestamp timestamp").parquet(f"{base}/rows")
    kept = rows.groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(F.count("*").alias("ingested"))
    counted = aggregates.read_timeline(inp.spark, base).withColumnRenamed("cnt", "in_timeline")
    late = aggregates.read_changes(inp.spark, base).groupBy(F.col("window_start").alias("hour")).agg(
        F.sum(F.when(F.col("late"), F.col("cnt") - F.col("was")).otherwise(0)).alias("counted_late")
    )
    return kept.join(counted, "hour", "left").join(late, "hour", "left")
