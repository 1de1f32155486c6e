"""Running counts over a log stream.

Nothing here waits for a watermark, so no row is ever too late. Every micro-batch is counted on
its own and stored as a small delta; totals are sums of deltas, complete at any time, with the
windows that are still open among them. Beside them each batch writes what it changed: a new
total for each window it touched, marked as late if the window had been closed by then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import versions
from . import runs

RATE_SECONDS = 10


def _windows(seconds: DataFrame, *kept: str) -> DataFrame:
    """The sliding windows (``slot``: first second) that each second belongs to."""
    first = F.sequence(F.col("slot") - (RATE_SECONDS - 1), F.col("slot"))
    return seconds.select(F.explode(first).alias("slot"), *kept)


def _revised(logs: DataFrame, seconds: int, sliding: bool, path: str, checkpoint: str, trigger: dict, delay_seconds: int) -> StreamingQuery:
    spark = logs.sparkSession
    length = RATE_SECONDS if sliding else seconds

    def write(batch: DataFrame, batch_id: int) -> None:
        slot = F.floor(F.unix_seconds("timestamp") / seconds).cast("long") * seconds
        counted = batch.filter("timestamp IS NOT NULL").groupBy(slot.alias("slot")).agg(
            F.count("*").alias("n"), F.max("timestamp").alias("newest")
        )
        delta = runs.put(counted, f"{path}/deltas", batch_id)
        earlier = runs.until(spark, f"{path}/deltas", batch_id, counted)
        added = _windows(delta, "n") if sliding else delta
        added = added.groupBy("slot").agg(F.sum("n").alias("n"))
        # Only seconds near the batch are read again.
        edge = delta.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).first()
        low, high = (edge["a"] or 0) - length, (edge["b"] or 0) + length
        near = earlier.filter(F.col("slot").between(low, high))
        had = (_windows(near, "n") if sliding else near).groupBy("slot").agg(F.sum("n").alias("was"))
        newest = earlier.agg(F.max("newest")).first()[0]
        mark = F.unix_seconds(F.lit(newest)) - delay_seconds if newest else F.lit(None).cast("long")
        runs.put(
            added.join(had, "slot", "left").select(
                "slot", (F.col("n") + F.coalesce("was", F.lit(0))).alias("cnt"), F.coalesce("was", F.lit(0)).alias("was"),
                F.coalesce(F.col("slot") + length <= mark, F.lit(False)).alias("late"),
            ),
            f"{path}/changes",
            batch_id,
        )

    return runs.each_batch(logs.select("timestamp"), write, checkpoint, trigger)


def hourly_timeline(logs: DataFrame, path: str, checkpoint: str, trigger: dict, delay_seconds: int = 3600) -> StreamingQuery:
    """Count rows per hour, late ones too. An hour counts as closed ``delay_seconds`` after its end."""
    return _revised(logs, 3600, False, path, checkpoint, trigger, delay_seconds)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """(hour, cnt) of everything read so far."""
    totals = spark.read.parquet(f"{path}/deltas").groupBy("slot").agg(F.sum("n").alias("cnt"))
    return totals.select(F.timestamp_seconds("slot").alias("hour"), "cnt")


def log_rate(logs: DataFrame, path: str, checkpoint: str, trigger: dict, delay_seconds: int = 10) -> StreamingQuery:
    """Rows per second over ten seconds, every second. Rows are stored as one count per second and batch."""
    return _revised(logs, 1, True, path, checkpoint, trigger, delay_seconds)


def read_rate(spark: SparkSession, path: str) -> DataFrame:
    """(window_start, events, per_second) of every window with rows."""
    seconds = spark.read.parquet(f"{path}/deltas").groupBy("slot").agg(F.sum("n").alias("n"))
    sliding = _windows(seconds, "n").groupBy("slot").agg(F.sum("n").alias("events"))
    per_second = (F.col("events") / F.lit(float(RATE_SECONDS))).alias("per_second")
    return sliding.select(F.timestamp_seconds("slot").alias("window_start"), "events", per_second)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """What each batch made of the windows it touched: (window_start, cnt, was, late, batch)."""
    return spark.read.parquet(f"{path}/changes").select(F.timestamp_seconds("slot").alias("window_start"), "cnt", "was", "late", "batch")


def running_counts(logs: DataFrame, keys: Sequence[Column], path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Counts per key, kept as one small delta per micro-batch.

    The delta is counted before anything is stored and a repeated batch overwrites its own, so
    there is no streaming state to grow and nothing is counted twice. Read with
    :func:`read_running_counts`; compact by summing old deltas into one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        delta = batch.groupBy(*keys).agg(F.count("*").alias("cnt"), F.max("timestamp").alias("last_seen"))
        delta.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_running_counts(spark: SparkSession, path: str, *keys: str, base_path: str | None = None) -> DataFrame:
    """Totals per key: the compacted base, if any, plus the deltas that came after it."""
    deltas = spark.read.parquet(path).select(*keys, "cnt", "last_seen", "batch")
    base = versions.read(spark, base_path) if base_path else None
    if base is not None:
        newest = base.select(F.max("batch")).scalar()
        deltas = deltas.filter(F.col("batch") > newest).unionByName(base)
    return deltas.groupBy(*keys).agg(F.sum("cnt").alias("cnt"), F.max("last_seen").alias("last_seen"))


def compact_running_counts(spark: SparkSession, path: str, base_path: str, *keys: str) -> int:
    """Sum everything written so far into a new base and drop the deltas it covers; returns the last batch covered.

    Readers of the new base skip covered deltas, so dropping them late or twice changes nothing.
    """
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    versions.write(
        read_running_counts(spark, path, *keys, base_path=base_path).withColumn("batch", F.lit(last)), base_path
    )
    fs, where = versions.file_system(spark, path)
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        # The newest delta stays, so that the folder keeps its columns.
        if name.startswith("batch=") and int(name[6:]) < last:
            fs.delete(status.getPath(), True)
    return last
