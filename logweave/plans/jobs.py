"""Batch jobs over stored tables: load, reparse, refresh roll-ups, apply retention."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions import clock, search
from ..operators import ingest, parsing, retention, rollups
from ..sources import lines, snapshots, tables, versions
from ..sources.library import Rule

ROLLUP_GRAIN = ("hour", "fromhost_ip", "hostname", "severity", "via_relay")


def load(
    spark: SparkSession,
    lines_path: str,
    table_path: str,
    rules: list[Rule],
    as_of: dt.datetime | str,
    index_text: bool = True,
    load_id: str | None = None,
    edition: int | None = None,
) -> DataFrame:
    """Load raw line files into the log table as one committed piece; returns lines per outcome.

    One pass: lines are read, decoded and parsed once, and counted on the way. Rows wider than
    the usual limits are stored with the column's name in ``over_length``. ``index_text`` stores the
    stemmed token line that search then uses. ``edition`` is kept with the rows as the library edition
    that ``rules`` are.
    """
    counted = Observation()
    classified = ingest.classify(lines.read_lines(spark, lines_path)).observe(counted, *ingest.quality_metrics())
    rows = ingest.mark_over_length(ingest.finalize(ingest.storable(classified), clock.at(as_of)))
    parsed = parsing.parse(ingest.assign_ids(rows, load_id or uuid.uuid4().hex), rules).drop("line", "defect", "outcome")
    if edition is not None:
        parsed = parsed.withColumn("library_edition", F.lit(edition))
    if index_text:
        whole = search.message_text(F.col("message"), F.col("raw_message"))
        parsed = parsed.withColumn("search_line", search.stemmed_line(whole))
    snapshots.commit(spark, table_path, tables.add_piece(parsed, table_path, "load"))
    found = [(name, n) for name, n in counted.get.items() if name != "processed" and n]
    return spark.createDataFrame(found, "outcome string, lines long")


def reparse_table(
    spark: SparkSession, table_path: str, rules: list[Rule], days: list[dt.date] | None = None, edition: int | None = None
) -> int:
    """Parse unparsed rows of the table again and replace the days that change; returns how many.

    Only days that hold unparsed rows a rule now matches are written anew; other days and rows that
    had fields stay as they are, with the edition that gave them; newly parsed ones get ``edition``.
    """
    base = snapshots.current(spark, table_path)
    logs = tables.read_logs(spark, table_path)
    if days:
        logs = logs.filter(F.col("log_date").isin(*days))
    hits = parsing.reparse(logs, rules).filter("updated").select("log_date").distinct()
    changed = {r["log_date"] for r in hits.collect()}  # one row per day
    if not changed:
        return 0
    affected = logs.filter(F.col("log_date").isin(*changed))
    again = parsing.parse(affected.withColumnRenamed("parsed_fields", "_old").withColumnRenamed("matched_parsers", "_oldp"), rules)
    had = F.size("_old") > 0
    merged = again.withColumns(
        {
            "parsed_fields": F.when(had, F.col("_old")).otherwise(F.col("parsed_fields")),
            "matched_parsers": F.when(had, F.col("_oldp")).otherwise(F.col("matched_parsers")),
        }
    )
    if edition is not None:
        before = F.col("library_edition") if "library_edition" in logs.columns else F.lit(None).cast("int")
        newly = ~F.coalesce(had, F.lit(False)) & (F.size("matched_parsers") > 0)
        merged = merged.withColumn("library_edition", F.when(newly, F.lit(edition)).otherwise(before))
    merged = merged.select(*logs.columns, *(["library_edition"] if edition is not None and "library_edition" not in logs.columns else []))
    piece = tables.add_piece(merged, table_path, "reparse")
    snapshots.commit(spark, table_path, piece, lambda e: e.log_date in changed, base)
    return len(changed)


def compact_stream(spark: SparkSession, landing_path: str, table_path: str, before: dt.date) -> list[dt.date]:
    """Move finished days from the per-batch folders of stream ingest into the log table; returns the days.

    The rows become a piece of the table, and only when that is committed do the batch folders go.
    A run that stops in between is repeated safely: batches that the table already holds are not
    added again.
    """
    landed = spark.read.parquet(landing_path).drop("batch").filter(F.col("log_date") < F.lit(before))
    # One row per day.
    days = sorted(r["log_date"] for r in landed.select("log_date").distinct().collect())
    if not days:
        return []
    base = snapshots.current(spark, table_path)
    rows = landed
    held = [e for e in snapshots.entries(spark, table_path, base) if e.log_date in days] if base is not None else []
    stored = snapshots.read(spark, table_path, held)
    if "load_id" in stored.columns:
        rows = landed.join(stored.select("load_id", "log_date").distinct(), ["load_id", "log_date"], "left_anti")
    snapshots.commit(spark, table_path, tables.add_piece(rows, table_path, "stream"), base=base)
    fs, where = versions.file_system(spark, landing_path)
    for batch in fs.listStatus(where):
        if batch.getPath().getName().startswith("batch="):
            drop_days(spark, batch.getPath().toString(), days)
    return days


def rollup_grain(logs: DataFrame) -> DataFrame:
    """Counts at the grain all stored dashboards derive from; fixed-width aggregates only."""
    return logs.groupBy(
        F.to_date("timestamp").alias("log_date"),
        F.date_trunc("hour", "timestamp").alias("hour"),
        F.coalesce("fromhost_ip", F.lit("")).alias("fromhost_ip"),
        "hostname",
        "severity",
        "via_relay",
    ).agg(F.count("*").alias("cnt"), F.max("timestamp").alias("last_seen"))


def _summed(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("log_date", *ROLLUP_GRAIN).agg(F.sum("cnt").alias("cnt"), F.max("last_seen").alias("last_seen"))


@dataclass(frozen=True)
class Rollup:
    """How rows become a stored roll-up (with ``log_date``), and how pieces of it are put together."""

    build: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]


COUNTS = Rollup(rollup_grain, _summed)
UNIQUES = Rollup(rollups.unique_sketches, rollups.merged_sketches)

# A day's roll-up is summed up again when it has come to consist of so many pieces.
ROLLUP_PIECES = 16


def refresh_rollups(spark: SparkSession, table_path: str, rollup_path: str, force: bool = False, kind: Rollup = COUNTS) -> list[dt.date]:
    """Bring the roll-up up to date with the log table; returns the days that changed.

    What was rolled up is kept as a list of (day, piece). Pieces that are new to a day are counted
    and added, without a look at the others. A day that has lost a piece is counted anew, also if
    the number of its rows is the same. The list is written after the roll-up, with a mark of
    the roll-up's version, so a refresh that failed in between starts from what is there. Read with
    :func:`read_rollup`, of the same ``kind``.
    """
    now = {(e.log_date, e.piece): e for e in snapshots.entries(spark, table_path)}
    state_path = f"{rollup_path}_state"
    base = snapshots.current(spark, rollup_path)
    stored = None if force else versions.read(spark, state_path)
    # One row per day and piece.
    seen = [tuple(r) for r in stored.select("log_date", "piece", "version").collect()] if stored is not None else []
    if any(v != base for _, _, v in seen):  # the roll-up has moved on without its list
        seen = []
    then = {(day, piece) for day, piece, _ in seen}
    before = {day for day, _ in then}
    lost = {day for day, piece in then if (day, piece) not in now}
    fresh = {key for key in now if key not in then}
    anew = {day for day, _ in fresh if day not in before} | {day for day in lost if any(d == day for d, _ in now)}
    gone = (before if seen else {e.log_date for e in snapshots.entries(spark, rollup_path, base)} if base is not None else set()) - {d for d, _ in now}
    wanted = [e for key, e in now.items() if key in fresh or e.log_date in anew]
    changed = sorted({e.log_date for e in wanted}, key=str)
    if not wanted and not gone and seen:
        return []
    if not wanted and not gone and not now:
        return []
    add = []
    if wanted:
        piece = snapshots.new_piece("rollup")
        kind.build(snapshots.read(spark, table_path, wanted)).write.partitionBy("log_date").parquet(snapshots.piece_path(rollup_path, piece))
        add = snapshots.written(spark, rollup_path, piece)
    version = snapshots.commit(spark, rollup_path, add, lambda e: e.log_date in anew or e.log_date in gone, base)
    version = _merge_pieces(spark, rollup_path, version, kind)
    rows = [(day, piece, version) for day, piece in now]
    versions.write(spark.createDataFrame(rows, "log_date date, piece string, version int"), state_path)
    return changed


def _merge_pieces(spark: SparkSession, rollup_path: str, version: int, kind: Rollup) -> int:
    """Sum up days of many pieces; returns the version."""
    held = snapshots.entries(spark, rollup_path, version)
    many = {e.log_date for e in held if sum(x.log_date == e.log_date for x in held) > ROLLUP_PIECES}
    if not many:
        return version
    piece = snapshots.new_piece("merged")
    summed = kind.merge(snapshots.read(spark, rollup_path, [e for e in held if e.log_date in many]))
    summed.write.partitionBy("log_date").parquet(snapshots.piece_path(rollup_path, piece))
    return snapshots.commit(spark, rollup_path, snapshots.written(spark, rollup_path, piece), lambda e: e.log_date in many, version)


def read_rollup(spark: SparkSession, rollup_path: str, kind: Rollup = COUNTS) -> DataFrame:
    """The roll-up at its grain, whatever pieces it was made in."""
    return kind.merge(snapshots.read(spark, rollup_path))


def drop_days(spark: SparkSession, path: str, days: list[dt.date]) -> None:
    """Remove whole day folders."""
    for day in days:
        fs, where = versions.file_system(spark, f"{path}/log_date={day.isoformat()}")
        fs.delete(where, True)


def apply_retention(spark: SparkSession, table_path: str, as_of: dt.datetime | str, days: int | None = None) -> dict:
    """Drop expired days and replace the one the cutoff falls into; :func:`snapshots.vacuum` frees the space."""
    base = snapshots.current(spark, table_path)
    held = snapshots.entries(spark, table_path, base)
    limit = retention.cutoff(as_of, days)
    present = {e.log_date for e in held if e.log_date}
    expired = sorted(d for d in present if d < limit.date())
    straddling = [e for e in held if e.log_date == limit.date()] if limit.time() != dt.time(0) else []
    rest = []
    if straddling:
        kept = snapshots.read(spark, table_path, straddling).filter(F.col("timestamp") >= clock.at(limit))
        rest = tables.add_piece(kept, table_path, "retained")
        if not rest:
            expired.append(limit.date())
    replaced = {*expired, *(e.log_date for e in straddling)}
    if replaced:
        snapshots.commit(spark, table_path, rest, lambda e: e.log_date in replaced, base)
    return {"dropped": expired, "rewritten": [limit.date()] if rest else []}
