import datetime as dt
import random
from pathlib import Path

from pyspark.sql import functions as F

from logweave.functions import clock
from logweave.operators import alert_gate, ingest, parsing, silence
from logweave.operators.alert_match import AlertRule
from logweave.plans import jobs
from logweave.sources import lines, tables
from logweave.sources.library import Rule
from logweave.streaming import aggregates, alerts as stream_alerts, ingest as stream_ingest, runs

RULES = [Rule(1, "k", "all", None, r"k=(\d+)", (("k", "K", "string"),))]
AS_OF = "2024-05-01T00:00:00"


def write(folder: Path, name: str, day: int, n: int, host: str = "h") -> None:
    folder.mkdir(exist_ok=True)
    text = "".join(f'{{"timestamp":"2024-03-{day:02d}T10:00:{i:02d}Z","hostname":"{host}","severity":"info","message":"k={i}"}}\n' for i in range(n))
    (folder / name).write_text(text)


def drain(spark, base):
    source = lines.stream_lines(spark, str(base / "in"))
    runs.drain(
        stream_ingest.ingest_to_table(source, str(base / "landing"), str(base / "cp"), RULES, clock.at(AS_OF), {"availableNow": True})
    )


def test_stream_ingest_equals_batch_and_compacts(spark, tmp_path):
    write(tmp_path / "in", "a.log", 1, 5)
    write(tmp_path / "in", "b.log", 2, 3, host="x" * 300)
    drain(spark, tmp_path)
    write(tmp_path / "in", "c.log", 1, 4, host="late")
    write(tmp_path / "in", "d.log", 3, 2)
    drain(spark, tmp_path)
    drain(spark, tmp_path)
    landed = spark.read.parquet(str(tmp_path / "landing"))
    batch = parsing.parse(ingest.ingest_lines(lines.read_lines(spark, str(tmp_path / "in")), clock.at(AS_OF)), RULES)
    shown = ["timestamp", "hostname", "message", parsing.fields_text().alias("fields")]
    assert sorted(map(tuple, landed.select(*shown).collect())) == sorted(map(tuple, batch.select(*shown).collect()))
    assert landed.select("id").distinct().count() == 14 and landed.filter("over_length = 'hostname'").count() == 3

    table = str(tmp_path / "table")
    assert jobs.compact_stream(spark, str(tmp_path / "landing"), table, dt.date(2024, 3, 3)) == [dt.date(2024, 3, 1), dt.date(2024, 3, 2)]
    assert tables.read_logs(spark, table).count() == 12
    assert spark.read.parquet(str(tmp_path / "landing")).count() == 2
    assert jobs.compact_stream(spark, str(tmp_path / "landing"), table, dt.date(2024, 3, 3)) == []
    assert jobs.compact_stream(spark, str(tmp_path / "landing"), table, dt.date(2024, 3, 4)) == [dt.date(2024, 3, 3)]
    assert tables.read_logs(spark, table).count() == 14


def test_running_counts_survive_compaction(spark, tmp_path, logs):
    source, deltas, base = tmp_path / "src", str(tmp_path / "deltas"), str(tmp_path / "base")
    table = logs({"severity": "err"}, {"severity": "err"}, {"severity": "info"})

    def step():
        table.write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(table.schema).parquet(str(source))
        runs.drain(aggregates.running_counts(stream, [F.col("severity")], deltas, str(tmp_path / "cp"), {"availableNow": True}))

    def totals():
        return {r["severity"]: r["cnt"] for r in aggregates.read_running_counts(spark, deltas, "severity", base_path=base).collect()}

    step()
    step()
    assert totals() == {"err": 4, "info": 2}
    assert aggregates.compact_running_counts(spark, deltas, base, "severity") == 1
    assert totals() == {"err": 4, "info": 2}
    step()
    assert totals() == {"err": 6, "info": 3}
    assert aggregates.compact_running_counts(spark, deltas, base, "severity") == 2
    assert totals() == {"err": 6, "info": 3}


LOG = "id long, timestamp timestamp, hostname string, fromhost_ip string, app_name string, severity string, message string, parsed_fields map<string,string>, matched_parsers array<string>"
ZERO = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


class Arrivals:
    """A folder of files that arrive one after the other, and a query that is resumed for each."""

    def __init__(self, spark, base, start):
        self.spark, self.base, self.start = spark, str(base), start

    def arrive(self, seconds, devices=None):
        rows = [(i, ZERO + dt.timedelta(seconds=s), "h", d, "a", "err", "m", {}, []) for i, (s, d) in enumerate(zip(seconds, devices or ["10.0.0.1"] * len(seconds)))]
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{self.base}/in")
        stream = self.spark.readStream.schema(LOG).parquet(f"{self.base}/in")
        runs.drain(self.start(stream, f"{self.base}/out", f"{self.base}/cp", {"availableNow": True}))

    def all(self):
        return self.spark.read.schema(LOG).parquet(f"{self.base}/in")


def _gate(rules):
    return lambda stream, *where: stream_alerts.threshold_alerts(stream, rules, *where)


def _fired(df):
    return sorted((r["rule_id"], r["t_us"], r["matches"], r["accumulated"]) for r in df.collect())


def _batch_firings(logs, rules):
    fired = alert_gate.threshold_firings(logs, rules)
    return _fired(fired.select("rule_id", F.unix_micros("fired_at").alias("t_us"), "matches", "accumulated"))


def test_late_rows_change_firings(spark, tmp_path):
    rules = [AlertRule(1, "two", severity="err", threshold=2, window_minutes=10, cooldown_minutes=1)]
    arrivals = Arrivals(spark, tmp_path, _gate(rules))
    seen = []
    for seconds in ([100, 200], [50, 60, 300], [400]):
        arrivals.arrive(seconds)
        got = _fired(stream_alerts.read_firings(spark, arrivals.base + "/out"))
        assert got == _batch_firings(arrivals.all(), rules)
        seen.append([(t // 1_000_000 - int(ZERO.timestamp()), n) for _, t, _, n in got])
    assert seen == [[(200, 2)], [(60, 2), (200, 2)], [(60, 2), (200, 2), (400, 2)]]
    changes = spark.read.parquet(arrivals.base + "/out/firings")
    assert changes.filter("op = -1").count() == 0 and changes.count() == 3
    arrivals.arrive([40])  # everything after it shifts
    assert _fired(stream_alerts.read_firings(spark, arrivals.base + "/out")) == _batch_firings(arrivals.all(), rules)
    assert spark.read.parquet(arrivals.base + "/out/firings").filter("op = -1").count() > 0


def test_gate_in_any_order_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rules = [AlertRule(1, "a", severity="err", threshold=3, window_minutes=90, cooldown_minutes=0), AlertRule(2, "b", severity="err", threshold=2, window_minutes=300, cooldown_minutes=700)]
    arrivals = Arrivals(spark, tmp_path, _gate(rules))
    seconds = [rng.randint(0, 6 * 86_400) + rng.random() for _ in range(260)]
    for part in range(4):
        arrivals.arrive(seconds[part::4])
    assert _fired(stream_alerts.read_firings(spark, arrivals.base + "/out")) == _batch_firings(arrivals.all(), rules)
    # A batch that is run again replaces its own output.
    states = spark.read.parquet(arrivals.base + "/out/states")
    assert states.select("batch").distinct().count() == 4


def slow_silence(rows, rules):
    """Levels and recoveries by walking each device's rows."""
    out, newest = set(), max(t for t, _ in rows)
    for rule in rules:
        limit = rule.minutes * 60_000_000
        for device in {d or "" for _, d in rows}:
            if rule.device_ips and device not in rule.device_ips:
                continue
            times = sorted({t for t, d in rows if (d or "") == device})
            for i, last in enumerate(times):
                end = times[i + 1] if i + 1 < len(times) else newest
                for name, factor in silence.LEVELS:
                    if last + factor * limit <= end:
                        out.add((rule.id, device, last + factor * limit, name, last))
                if i + 1 < len(times) and end - last >= limit:
                    out.add((rule.id, device, end, "recovered", last))
    return out


def test_silence_in_any_order_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rules = [silence.SilenceRule(1, threshold=7), silence.SilenceRule(2, threshold=200, device_ips=("10.0.0.2", "10.0.0.3"))]
    arrivals = Arrivals(spark, tmp_path, lambda stream, *where: stream_alerts.device_silence(stream, rules, *where))
    rows = []
    for part in range(5):
        seconds = [rng.choice([rng.randint(0, 40_000 * (part + 1)), 60 * rng.randint(0, 900), 30_000 + rng.randint(0, 300)]) for _ in range(14)]
        devices = [rng.choice(["10.0.0.1", "10.0.0.2", "10.0.0.3", None][: part + 1]) for _ in seconds]
        if part == 4:
            seconds, devices = [500_000], ["10.0.0.9"]  # time moves on for all others
        rows += [(int((ZERO.timestamp() + s) * 1_000_000), d) for s, d in zip(seconds, devices)]
        arrivals.arrive(seconds, devices)
        got = [tuple(r) for r in stream_alerts.read_silence(spark, arrivals.base + "/out").select(*stream_alerts.EVENT).collect()]
        assert len(got) == len(set(got)) and set(got) == slow_silence(rows, rules)
    once = [tuple(r) for r in stream_alerts.silence_events(arrivals.all(), rules).select(*stream_alerts.EVENT).collect()]
    assert sorted(once) == sorted(got)
    assert spark.read.parquet(arrivals.base + "/out/events").filter("op = -1").count() > 0


def test_late_rows_are_counted_and_reported(spark, tmp_path):
    hours = Arrivals(spark, tmp_path / "a", aggregates.hourly_timeline)
    rate = Arrivals(spark, tmp_path / "b", aggregates.log_rate)
    for seconds in ([10, 20, 3700, 8000], [30, 8001, 90_000], [15, 90_001]):
        hours.arrive(seconds)
        rate.arrive(seconds)
    counted = {int(r["hour"].timestamp()): r["cnt"] for r in aggregates.read_timeline(spark, hours.base + "/out").collect()}
    zero = {k - min(counted): v for k, v in counted.items()}
    assert zero == {0: 4, 3600: 1, 7200: 2, 90_000: 2}
    changes = aggregates.read_changes(spark, hours.base + "/out").orderBy("batch", "window_start").collect()
    shown = [(r["batch"], int(r["window_start"].timestamp()) - min(counted), r["was"], r["cnt"], r["late"]) for r in changes]
    assert shown == [(0, 0, 0, 2, False), (0, 3600, 0, 1, False), (0, 7200, 0, 1, False), (1, 0, 2, 3, True), (1, 7200, 1, 2, False), (1, 90_000, 0, 1, False),
                     (2, 0, 3, 4, True), (2, 90_000, 1, 2, False)]
    windows = {int(r["window_start"].timestamp()) - min(counted): r["events"] for r in aggregates.read_rate(spark, rate.base + "/out").collect()}
    times = [10, 20, 3700, 8000, 30, 8001, 90_000, 15, 90_001]
    assert windows == {w: n for w in range(-10, 90_002) if (n := sum(w <= t < w + 10 for t in times))}
    last = {}
    for r in aggregates.read_changes(spark, rate.base + "/out").orderBy("batch").collect():
        last[int(r["window_start"].timestamp()) - min(counted)] = r["cnt"]
    assert last == windows
