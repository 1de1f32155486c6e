import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logweave.operators import alert_gate, alert_match, fanout, notifications, silence
from logweave.operators.alert_match import AlertRule, FieldCondition

START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize(
    "pattern, value, hit",
    [
        ("", "anything", True), ("Fail", "it FAILED", True), ("fail", "ok", False), ("fail*", "FAILED here", True), ("fail*", "it failed", False),
        ("*a.b*", "xa.bx", True), ("*a.b*", "xaxbx", False), ("a*b", "a\nb", True), ("a?b*", "axb", False), ("a?b*", "a?bc", True), ("(*", "(x", True),
    ],
)
def test_message_pattern(spark, pattern, value, hit):
    df = spark.createDataFrame([(value,)], "message string")
    assert df.select(alert_match.message_matches(pattern).alias("x")).first()["x"] is hit


@pytest.mark.parametrize(
    "logic, conditions, hit",
    [
        ("and", [("user", "equals", "bob"), ("ip", "contains", "10.")], True),
        ("and", [("user", "equals", "bob"), ("gone", "not_equals", "x")], False),
        ("or", [("user", "equals", "ann"), ("ip", "regex", r"^10\.\d+")], True),
        ("or", [("gone", "not_equals", "x")], False),
        ("and", [("user", "", "bob")], True),
        ("and", [("user", "contains", "BO")], True),
        ("and", [("user", "regex", "(")], False),
        ("and", [], True),
    ],
)
def test_field_conditions(spark, logs, logic, conditions, hit):
    rule = AlertRule(1, "r", field_conditions=tuple(FieldCondition(*c) for c in conditions), field_logic=logic)
    df = logs({"parsed_fields": {"user": "bob", "ip": "10.1"}})
    assert df.select(alert_match.fields_match(rule).alias("x")).first()["x"] is hit


def test_matched_rows_need_every_filter(logs):
    rules = [
        AlertRule(1, "dev", device_ips=("1.1.1.1",)),
        AlertRule(2, "par", parser_names=("P",)),
        AlertRule(3, "all", severity="err", device_ips=("1.1.1.1",), parser_names=("P",), message_pattern="boom"),
        AlertRule(4, "off", is_active=False),
    ]
    table = logs(
        {"fromhost_ip": "1.1.1.1", "matched_parsers": ["P"], "severity": "crit", "message": "Boom"},
        {"fromhost_ip": None, "matched_parsers": None, "severity": "crit"},
        {"fromhost_ip": "1.1.1.1", "matched_parsers": ["Q"]},
    )
    got = {(r["rule_id"], r["id"]) for r in alert_match.matched_rows(table, rules).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (1, 3)}


def gate(times, threshold, window, cooldown):
    """Plain statement of the contract, one slot per row."""
    count, window_end, cooldown_end, fired = 0, None, None, []
    for t in times:
        if window_end is None or t >= window_end:
            count, window_end = 0, t + window
        count += 1
        if count >= threshold and (cooldown_end is None or t >= cooldown_end):
            fired.append(t)
            count, window_end, cooldown_end = 0, None, t + cooldown
    return fired


@pytest.mark.parametrize(
    "minutes, threshold, window, cooldown, fired",
    [
        ([0, 1, 2], 3, 5, 0, [2]),
        ([0, 1, 6, 7], 3, 5, 0, []),
        ([0, 1, 2, 3, 4, 5], 2, 10, 3, [1, 4]),
        ([0, 1, 2, 3], 1, 5, 0, [0, 1, 2, 3]),
        ([0, 1, 2, 30, 61], 0, 5, 60, [0, 61]),
        ([0, 5], 2, 5, 0, []),
    ],
)
def test_gate_sequences(logs, minutes, threshold, window, cooldown, fired):
    table = logs(*[{"timestamp": at(m)} for m in minutes])
    rule = AlertRule(9, "g", threshold=threshold, window_minutes=window, cooldown_minutes=cooldown)
    got = alert_gate.threshold_firings(table, [rule]).orderBy("fired_at").collect()
    assert [r["fired_at"] for r in got] == [at(m).replace(tzinfo=None) for m in fired]


def test_gate_against_the_contract(spark):
    random.seed(7)
    rules = [AlertRule(i, f"r{i}", threshold=random.randint(1, 5), window_minutes=random.randint(1, 9), cooldown_minutes=random.randint(0, 12)) for i in range(1, 6)]
    seconds = sorted(random.sample(range(40_000), 1200))
    df = spark.createDataFrame([(i, at(s / 60), "m", "info") for i, s in enumerate(seconds)], "id long, timestamp timestamp, message string, severity string")
    df = df.withColumns({"fromhost_ip": F.lit("x"), "matched_parsers": F.array(F.lit("p")), "parsed_fields": F.create_map(F.lit("a"), F.lit("b"))})
    got = alert_gate.threshold_firings(df, rules).select("rule_id", F.unix_micros("fired_at").alias("t")).collect()
    base = int(START.timestamp())
    for rule in rules:
        wanted = gate([(base + s) for s in seconds], max(rule.threshold, 1), rule.window_minutes * 60, rule.cooldown_minutes * 60)
        assert sorted(r["t"] // 1_000_000 for r in got if r["rule_id"] == rule.id) == wanted


def _folded(spark, slots, threshold, window, cooldown, entry=None):
    rows = [("k", i, t, n, threshold, window, cooldown) for i, (t, n) in enumerate(slots)]
    kinds = "gate_key string, slot long, t_us long, matches long, threshold long, window_us long, cooldown_us long"
    return alert_gate.fold(spark.createDataFrame(rows, kinds), entry).collect()


def _plain(slots, threshold, window, cooldown, state=None):
    state, fired = state or [0, None, None], []
    for t, n in slots:
        accumulated = alert_gate.fold_step(state, t, n, threshold, window, cooldown)
        if accumulated:
            fired.append((t, n, accumulated))
    return fired, state


DAY = alert_gate.CHUNK_US
HOUR = DAY // 24


@pytest.mark.parametrize(
    "seed, step, threshold, window, cooldown",
    [(1, HOUR, 3, 5 * HOUR, 0), (2, HOUR, 4, 3 * HOUR, 9 * HOUR), (3, DAY, 2, 3 * DAY, DAY), (4, HOUR // 9, 40, 2 * HOUR, 60 * HOUR), (5, 3 * HOUR, 1, HOUR, 2 * HOUR), (6, HOUR, 9, 100 * DAY, 0)],
)
def test_days_folded_apart_equal_one_fold(spark, seed, step, threshold, window, cooldown):
    rng = random.Random(seed)
    slots, t = [], 5 * DAY + 17
    for _ in range(700):
        t += rng.choice([1, step // 7, step, step, 2 * step, 4 * step])
        slots.append((t, rng.choice([1, 1, 2, 5])))
    got = _folded(spark, slots, threshold, window, cooldown)
    fired, state = _plain(slots, threshold, window, cooldown)
    assert sorted((r["t_us"], r["matches"], r["accumulated"]) for r in got if r["kind"] == "fire") == fired and fired
    ends = {r["chunk"]: [r["count"], r["window_end"], r["cooldown_end"]] for r in got if r["kind"] == "exit"}
    assert set(ends) == {t // DAY for t, _ in slots} and len(ends) == sum(r["kind"] == "exit" for r in got)
    # Going on from the state of any day gives the rest: what does not matter any more may differ.
    middle = sorted(ends)[len(ends) // 2]
    rest = [s for s in slots if s[0] // DAY > middle]
    entry = spark.createDataFrame([("k", middle, *ends[middle])], "gate_key string, chunk long, count long, window_end long, cooldown_end long")
    again = _folded(spark, rest, threshold, window, cooldown, entry)
    assert sorted(r["t_us"] for r in again if r["kind"] == "fire") == [t for t, _, _ in fired if t // DAY > middle]


def test_a_busy_rule_is_settled_day_by_day():
    """A year of one rule: all but a few slots are decided where they are, without the days before."""
    rng = random.Random(5)
    seconds = sorted(rng.sample(range(365 * 86_400), 60_000))
    columns = ["chunk", *alert_gate.GATE_COLUMNS]
    rows = [(s // 86_400, "k", s * 2, s * 1_000_000, 1, 3, 20 * alert_gate.MINUTE_US, 30 * alert_gate.MINUTE_US) for s in seconds]
    out = pd.concat(alert_gate.fold_chunks([pd.DataFrame(rows, columns=columns)]))
    assert (out["kind"] == "exit").sum() > 355 and (out["kind"] == "head").sum() < len(rows) / 5


@pytest.mark.parametrize("seed", range(20))
def test_many_slots_at_once_equal_single_steps(seed):
    rng = random.Random(seed)
    threshold, window, cooldown = rng.choice([1, 3, 40]), rng.choice([1, 50, 900]), rng.choice([0, 7, 300])
    times = sorted(rng.sample(range(20_000), 3_000))
    slots = [(t, rng.choice([1, 1, 2, 60])) for t in times]
    one = [rng.randint(0, 5), rng.choice([None, 40]), rng.choice([None, 90])]
    many, got = list(one), []
    fired, one = _plain(slots, threshold, window, cooldown, one)
    for part in (slots[:1000], slots[1000:1001], slots[1001:]):
        places = alert_gate.fold_slots(many, [t for t, _ in part], [n for _, n in part], threshold, window, cooldown)
        got += [(*part[i], n) for i, n in places]
    assert got == fired and many == one


def test_a_rule_that_always_fires_late_is_folded_by_windows():
    """A million slots without one that settles: each is handed on, and the fold takes as many turns as windows."""

    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return super().__getitem__(i)

    n = 1_000_000
    state = [0, None, None]
    fired = alert_gate.fold_slots(state, Counted(range(0, 500_000 * n, 500_000)), [1] * n, 5, 60 * alert_gate.MINUTE_US, 120 * alert_gate.MINUTE_US)
    assert len(fired) == 70 and fired[0] == (4, 5) and Counted.reads < n / 100


def test_slots_without_a_time_never_fire(spark):
    kinds = "gate_key string, slot long, t_us long, matches long, threshold long, window_us long, cooldown_us long"
    rows = [("k", None, None, 9, 1, 10, 0), ("k", 1, 500_000, 1, 1, 10, 0)]
    assert [r["t_us"] for r in alert_gate.fire(spark.createDataFrame(rows, kinds)).collect()] == [500_000]


def test_chunks_cross_frames():
    columns = ["chunk", *alert_gate.GATE_COLUMNS]
    rows = [(i // 20, "k", i, i * 10, 1, 3, 15, 0) for i in range(60)]
    whole = pd.concat(alert_gate.fold_chunks([pd.DataFrame(rows, columns=columns)]))
    split = pd.concat(alert_gate.fold_chunks([pd.DataFrame([r], columns=columns) for r in rows]))
    assert whole.astype(str).values.tolist() == split.astype(str).values.tolist()


def test_firings_match_rows_once(logs):
    rule = AlertRule(1, "burst", threshold=2, window_minutes=5, cooldown_minutes=0)
    records = alert_gate.firing_records(logs({}, {}, {}), [rule])
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan  # only the stored slots are read


def test_one_slot_counts_as_one_evaluation(logs):
    table = logs(*[{"timestamp": START + dt.timedelta(milliseconds=10 * i)} for i in range(30)])
    rule = AlertRule(1, "burst", threshold=3, window_minutes=5, cooldown_minutes=0)
    (row,) = alert_gate.threshold_firings(table, [rule]).collect()
    assert (row["matches"], row["accumulated"]) == (30, 30)


def test_window_must_be_positive(logs):
    with pytest.raises(ValueError):
        alert_gate.threshold_firings(logs({}), [AlertRule(1, "w", window_minutes=0)])


def test_firing_record(logs):
    rule = AlertRule(1, "r", severity="err", field_conditions=(FieldCondition("u", "equals", "x"), FieldCondition("v", "not_equals", "y")), field_logic="or", threshold=2)
    table = logs(*[{"severity": "err", "parsed_fields": {"u": "x"}, "message": f"m{i}"} for i in range(2)])
    (row,) = alert_gate.firing_records(table, [rule]).collect()
    assert row["title"] == "Alert: r" and row["text"] == "2 matching log entries in the last 5 minute(s). Latest from h: m1"
    assert row["notify_severity"] == "error" and row["trigger_log"]["message"] == "m1"
    assert row["conditions"] == [
        "Severity err or more severe (log severity: err)",
        'Field "u" equals "x" (log value: "x")',
        "Threshold reached: 2 matching log(s) within 5 minute(s) (required: 2)",
    ]


def devices(spark, **seen):
    rows = [(ip.replace("_", "."), "host", at(-m)) for ip, m in seen.items()]
    return spark.createDataFrame(rows, "fromhost_ip string, hostname string, last_seen timestamp")


def test_silence_levels(spark):
    table = devices(spark, a=9, b=10, c=19, d=20, e=40)
    got = silence.silent_devices(table, [silence.SilenceRule(1, 10)], START).collect()
    assert {r["fromhost_ip"]: r["severity"] for r in got} == {"b": "warning", "c": "warning", "d": "error", "e": "critical"}
    assert silence.SilenceRule(1, 0).minutes == 15


def test_silence_transitions_and_state(spark):
    table = devices(spark, new=11, worse=25, same=12, back=1, quiet=13)
    rule = silence.SilenceRule(1, 10, cooldown_minutes=30)
    state = spark.createDataFrame(
        [
            (1, "worse", at(-25), "warning", at(-5)), (1, "same", at(-12), "warning", at(-31)),
            (1, "back", at(-60), "critical", at(-60)), (1, "quiet", at(-13), "warning", at(-3)), (2, "other", at(-1), "warning", at(-1)),
        ],
        "rule_id long, device_ip string, silent_since timestamp, last_severity string, last_fired timestamp",
    )
    changes = silence.transitions(table, [rule], state, START)
    got = {r["fromhost_ip"]: (r["action"], r["severity"]) for r in changes.collect()}
    assert got == {
        "new": ("silent", "warning"), "worse": ("escalated", "error"), "same": ("repeat", "warning"), "back": ("recovered", "info"), "quiet": ("quiet", "warning"),
    }
    fired = {r["fromhost_ip"]: (r["title"], r["text"], r["notify_severity"]) for r in silence.firings(changes).collect()}
    stamp = lambda m: at(m).strftime("%Y-%m-%dT%H:%M:%SZ")
    assert set(fired) == {"new", "worse", "same", "back"}
    assert fired["worse"] == ("Device silent: host", f"No logs received from host (worse) in over 10 minutes. Last seen: {stamp(-25)}", "error")
    assert fired["back"] == ("Device back online: host", f"host (back) has resumed sending logs (was silent since {stamp(-60)}).", "info")
    after = {r["device_ip"]: r for r in silence.next_state(state, changes, START).collect()}
    assert set(after) == {"new", "worse", "same", "quiet", "other"}
    assert after["worse"]["last_severity"] == "error" and after["worse"]["silent_since"] == at(-25).replace(tzinfo=None)
    assert after["quiet"]["last_fired"] == at(-3).replace(tzinfo=None) and after["new"]["last_fired"] == START.replace(tzinfo=None)


def test_silence_status(spark):
    rules = [silence.SilenceRule(1, 60), silence.SilenceRule(2, 5, device_ips=("a",))]
    got = silence.status(devices(spark, a=10, b=10), rules, START).collect()
    assert {r["fromhost_ip"]: (r["threshold_minutes"], r["silence_status"]) for r in got} == {"a": (5, "silent"), "b": (60, "ok")}
    none = silence.status(devices(spark, b=10), rules[1:], START).first()
    assert none["silence_status"] == "no_rule"


def test_fan_out(spark):
    channels = spark.createDataFrame(
        [(1, "push", True, [1, 2]), (2, "push", True, [2, 3]), (3, "in_app", True, []), (4, "in_app", True, [5]), (5, "email", True, [9]), (6, "email", True, []), (7, "push", False, [])],
        "id long, type string, enabled boolean, user_ids array<long>",
    )
    links = spark.createDataFrame([(1, c) for c in range(1, 8)] + [(2, 7)], "alert_id long, channel_id long")
    firings = spark.createDataFrame([("f1", 1), ("f2", 2), ("f3", 3)], "firing string, rule_id long")
    got = {(r["firing"], r["channel_id"]): (r["channel_type"], r["targets"], r["status"]) for r in fanout.fan_out(firings, links, channels).collect()}
    assert got == {
        ("f1", 1): ("push", [1, 2, 3], "deliver"), ("f1", 3): ("in_app", None, "deliver"), ("f1", 5): ("email", None, "deliver"),
        ("f1", 6): ("email", None, "deliver"), ("f2", None): (None, None, "no_channel"), ("f3", None): (None, None, "no_channel"),
    }


def test_unread_keeps_the_mark_when_nothing_is_new(spark):
    feed = spark.createDataFrame([(1, "log_threshold", None), (2, "audit_log", None), (3, "audit_log", [7])], "id long, alert_rule_type string, target_user_ids array<long>")
    state = spark.createDataFrame([(7, 3)], "user_id long, last_read_id long")
    assert tuple(notifications.unread_counts(feed, state, 7).first()) == (0, 3)
    assert tuple(notifications.unread_counts(feed, state, 8).first()) == (1, 1)
    assert tuple(notifications.unread_counts(feed, state, 8, is_admin=True).first()) == (2, 2)


def test_certificate_days(spark):
    certs = spark.createDataFrame([(1, "issued", at(60 * 36)), (2, "issued", at(60 * 24 * 31)), (3, "revoked", at(0)), (4, "issued", at(-60 * 30)), (5, "issued", None)], "id long, status string, expires_at timestamp")
    got = {r["id"]: r["days_left"] for r in notifications.expiring_certificates(certs, START).collect()}
    assert got == {1: 1, 4: -1}
