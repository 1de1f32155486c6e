"""Alert gate and silence detection on a stream, with rows in any order.

Both keep what they have seen as small tables in the shared folder, one folder per micro-batch:
counts per rule and half second, sightings per device and minute. A row of any age changes its
slot; what follows from that slot on is derived again, and the difference to what had been
published goes out as retractions (``op`` -1) and additions (``op`` 1). Summed up, the output
always equals the batch result over all rows read so far. A batch that is run again replaces its
own folders and reads only those of earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import alert_gate, silence
from ..operators.alert_match import AlertRule, matched_rows
from . import runs

MINUTE_US = alert_gate.MINUTE_US
FIRING = ("rule_id", "t_us", "matches", "accumulated")
EVENT = ("rule_id", "fromhost_ip", "at_us", "event", "last_us")
NO_FIRING = "gate_key string, slot long, t_us long, matches long, accumulated long, op int"
NO_STATE = "gate_key string, chunk long, count long, window_end long, cooldown_end long"
NO_EVENT = "rule_id long, fromhost_ip string, at_us long, event string, last_us long, op int"


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def net(changes: DataFrame, *columns: str) -> DataFrame:
    """What additions and retractions leave."""
    return changes.groupBy(*columns).agg(F.sum("op").alias("_op")).filter("_op > 0").select(*columns)


def _difference(now: DataFrame, before: DataFrame, columns: list[str]) -> DataFrame:
    """Additions and retractions that turn ``before`` into ``now``."""
    both = now.select(*columns, F.lit(1).alias("op")).unionByName(before.select(*columns, F.lit(-1).alias("op")))
    return both.groupBy(*columns).agg(F.sum("op").cast("int").alias("op")).filter("op <> 0")


def threshold_alerts(logs: DataFrame, rules: list[AlertRule], path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Evaluate the threshold rules as rows arrive; read the result with :func:`read_firings`.

    State is kept by rule and day: the counts of its slots and the gate's three numbers at its end.
    A batch replays each rule it has matches of from the first day it touches, starting with
    the state at the end of the day before.
    """
    spark = logs.sparkSession
    gated = [r for r in rules if not r.fire_on_every_match and r.is_active]

    def write(batch: DataFrame, batch_id: int) -> None:
        matches = matched_rows(batch, gated).select("rule_id", "timestamp")
        day = F.floor(F.col("t_us") / F.lit(alert_gate.CHUNK_US)).cast("long")
        counted = alert_gate.slots(matches, F.col("rule_id").cast("string")).withColumn("chunk", day)
        delta = runs.put(counted, f"{path}/slots", batch_id, "chunk")
        earlier = runs.until(spark, f"{path}/slots", batch_id, counted).drop("batch")
        first = delta.groupBy("gate_key").agg(F.min("chunk").alias("first"))  # a row for each rule
        touched = earlier.join(F.broadcast(first), "gate_key").filter("chunk >= first").drop("first")
        whole = touched.unionByName(delta.select(*touched.columns)).groupBy("gate_key", "slot").agg(
            F.sum("matches").alias("matches"), F.max("t_us").alias("t_us")
        )
        states = runs.until(spark, f"{path}/states", batch_id, _empty(spark, NO_STATE))
        # Of a day the newest state counts, of a rule the last day before the first one touched.
        newest = states.join(F.broadcast(first), "gate_key").filter("chunk < first")
        entry = newest.groupBy("gate_key").agg(F.max_by(F.struct("chunk", *alert_gate.STATE), F.struct("chunk", "batch")).alias("s"))
        with_rule = whole.withColumn("rule_id", F.col("gate_key").cast("long"))
        settings = alert_gate.gate_settings(gated)
        folded = runs.put(alert_gate.fold(with_rule.withColumns(settings), entry.select("gate_key", "s.*")), f"{path}/folded", batch_id)
        runs.put(folded.filter("kind = 'exit'").select("gate_key", "chunk", *alert_gate.STATE), f"{path}/states", batch_id)
        columns = ["gate_key", "slot", "t_us", "matches", "accumulated"]
        published = runs.until(spark, f"{path}/firings", batch_id, _empty(spark, NO_FIRING))
        same = published.join(F.broadcast(first), "gate_key").filter(F.floor(F.col("t_us") / F.lit(alert_gate.CHUNK_US)) >= F.col("first"))
        runs.put(_difference(folded.filter("kind = 'fire'"), net(same, *columns), columns), f"{path}/firings", batch_id)

    return runs.each_batch(logs, write, checkpoint, trigger)


def read_firings(spark: SparkSession, path: str) -> DataFrame:
    """Firings that stand: (rule_id, t_us, matches, accumulated)."""
    changes = spark.read.parquet(f"{path}/firings").select(F.col("gate_key").cast("long").alias("rule_id"), "t_us", "matches", "accumulated", "op")
    return net(changes, *FIRING)


def _events(stretches: DataFrame, rules: list[silence.SilenceRule], now_us: int) -> DataFrame:
    """Levels and recoveries of (fromhost_ip, last_us, next_us); ``next_us`` is null for the newest sighting."""
    watched = silence.applicable(stretches, rules).withColumn("limit_us", F.col("threshold_minutes").cast("long") * MINUTE_US)
    long_enough = watched.filter(F.coalesce("next_us", F.lit(now_us)) - F.col("last_us") >= F.col("limit_us"))
    due = [
        F.when(F.col("last_us") + factor * F.col("limit_us") <= F.coalesce("next_us", F.lit(now_us)),
               F.struct((F.col("last_us") + factor * F.col("limit_us")).alias("at_us"), F.lit(name).alias("event")))
        for name, factor in silence.LEVELS
    ]
    back = F.when(F.col("next_us").isNotNull(), F.struct(F.col("next_us").alias("at_us"), F.lit("recovered").alias("event")))
    each = long_enough.withColumn("_e", F.explode(F.array_compact(F.array(*due, back))))
    return each.select("rule_id", "fromhost_ip", "_e.at_us", "_e.event", "last_us")


def _stretches(sightings: DataFrame) -> DataFrame:
    """Each minute's last sighting with the next minute's first one, per device.

    Rows within a minute cannot be a silence. Minutes are compared day by day; a day's last one is
    followed by the first one of the next day with rows, so no task sorts more than a day of a device.
    """
    day = F.floor(F.col("minute") / 1440)
    minutes = sightings.groupBy("fromhost_ip", "minute").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")).withColumn("day", day)
    within = Window.partitionBy("fromhost_ip", "day").orderBy("minute")
    days = minutes.groupBy("fromhost_ip", "day").agg(F.min("first_us").alias("day_first"))
    after = days.select("fromhost_ip", "day", F.lead("day_first").over(Window.partitionBy("fromhost_ip").orderBy("day")).alias("after_us"))
    following = minutes.withColumn("next_us", F.lead("first_us").over(within)).join(after, ["fromhost_ip", "day"])
    return following.select("fromhost_ip", "last_us", F.coalesce("next_us", "after_us").alias("next_us"))


def _sightings(logs: DataFrame) -> DataFrame:
    us = F.unix_micros("timestamp")
    device = F.coalesce("fromhost_ip", F.lit("")).alias("fromhost_ip")
    minute = F.floor(us / F.lit(MINUTE_US)).cast("long").alias("minute")
    return logs.filter("timestamp IS NOT NULL").groupBy(device, minute).agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"))


def silence_events(logs: DataFrame, rules: list[silence.SilenceRule]) -> DataFrame:
    """The same over a table: silence levels and recoveries up to its newest row."""
    seen = _sightings(logs)
    newest = seen.agg(F.max("last_us")).first()[0]
    return _events(_stretches(seen), rules, newest or 0)


def device_silence(logs: DataFrame, rules: list[silence.SilenceRule], path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Silence levels and recoveries as they are reached; read the result with :func:`read_silence`.

    Time is the newest row of all devices. A batch looks again at the devices it has rows of, from
    the last sighting before its first row on, and at those that reach a level while time moves on. A
    row that falls into a silence takes back what was reported of it.
    """
    spark = logs.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        counted = _sightings(batch)
        delta = runs.put(counted, f"{path}/sightings", batch_id)
        earlier = runs.until(spark, f"{path}/sightings", batch_id, counted).drop("batch")
        was, comes = earlier.agg(F.max("last_us")).first()[0], delta.agg(F.max("last_us")).first()[0]
        if comes is None and was is None:
            return
        now_us = max(x for x in (was, comes) if x is not None)
        # Devices at rest that reach a level now: their silence began at their newest sighting.
        newest = earlier.groupBy("fromhost_ip").agg(F.max("last_us").alias("from_us"))
        limits = sorted({factor * r.minutes * MINUTE_US for r in rules for _, factor in silence.LEVELS})
        reached = F.lit(False)
        for limit in limits:
            reached = reached | ((F.col("from_us") + limit > F.lit(was)) & (F.col("from_us") + limit <= now_us))
        resting = newest.filter(reached) if was is not None else newest.limit(0)
        started = delta.groupBy("fromhost_ip").agg(F.min("first_us").alias("began"))
        # The newest sighting before the batch's first row; rows of its own minute may be on both sides.
        before = earlier.join(started, "fromhost_ip").filter(F.col("last_us") < F.floor(F.col("began") / F.lit(MINUTE_US)) * MINUTE_US)
        before = before.groupBy("fromhost_ip").agg(F.max("last_us").alias("prior"))
        active = started.join(before, "fromhost_ip", "left").select(
            "fromhost_ip", F.coalesce("prior", F.floor(F.col("began") / F.lit(MINUTE_US)) * MINUTE_US).alias("from_us")
        )
        again = active.unionByName(resting.select("fromhost_ip", "from_us")).groupBy("fromhost_ip").agg(F.min("from_us").alias("from_us"))
        again = runs.put(again, f"{path}/again", batch_id)
        part = earlier.unionByName(delta.select(*earlier.columns)).join(again, "fromhost_ip").filter("last_us >= from_us").drop("from_us")
        published = runs.until(spark, f"{path}/events", batch_id, _empty(spark, NO_EVENT))
        same = net(published.join(again, "fromhost_ip").filter("last_us >= from_us"), *EVENT)
        runs.put(_difference(_events(_stretches(part), rules, now_us), same, list(EVENT)), f"{path}/events", batch_id)

    return runs.each_batch(logs.select("fromhost_ip", "timestamp"), write, checkpoint, trigger)


def read_silence(spark: SparkSession, path: str) -> DataFrame:
    """Events that stand: (rule_id, fromhost_ip, at_us, event, last_us)."""
    return net(spark.read.parquet(f"{path}/events"), *EVENT)
