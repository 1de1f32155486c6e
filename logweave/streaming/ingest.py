"""Continuous ingest: the same column functions as in batch, on a stream of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest, parsing
from ..sources import tables
from ..sources.library import Rule


def parse_stream(lines: DataFrame, rules: list[Rule], as_of: Column | None = None) -> DataFrame:
    """Raw ``line`` stream to parsed log rows. Stateless, so late rows are kept like any other."""
    now = F.current_timestamp() if as_of is None else as_of
    rows = ingest.ingest_lines(lines, now)
    return parsing.parse(rows, rules).drop("line", "defect", "outcome")


def ingest_to_table(
    lines: DataFrame,
    table_path: str,
    checkpoint: str,
    rules: list[Rule],
    as_of: Column | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append micro-batches to the log table.

    Each batch is one write to its own ``batch=`` folder in overwrite mode, so a batch that is run
    again after a failure replaces its own output, and every line is read and counted once.
    The stream's checkpoint and the batch number make the load's name.
    """
    now = F.current_timestamp() if as_of is None else as_of
    observed = ingest.classify(lines).observe("ingest_quality", *ingest.quality_metrics())
    rows = ingest.mark_over_length(ingest.finalize(ingest.storable(observed), now))

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parsing.parse(ingest.assign_ids(batch, f"{checkpoint}#{batch_id}"), rules)
        shaped = tables.with_log_date(parsed.drop("line", "defect", "outcome"))
        shaped.write.mode("overwrite").partitionBy("log_date").parquet(f"{table_path}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
