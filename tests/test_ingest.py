import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweave.functions import clock
from logweave.operators import ingest
from logweave.sources import lines, syslog

AS_OF = dt.datetime(2024, 5, 1, 12, tzinfo=dt.timezone.utc)


def run(spark, *raw):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, line string")
    return {r["i"]: r.asDict() for r in ingest.ingest_lines(df, clock.at(AS_OF)).collect()}


def classified(spark, *raw):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, line string")
    return {r["i"]: r.asDict() for r in ingest.classify(df).collect()}


@pytest.mark.parametrize(
    "line, column, value",
    [
        ('{"hostname":"h","timestamp":"","@timestamp":"a","timereported":"b"}', "timestamp", "a"),
        ('{"hostname":"h","timereported":"b"}', "timestamp", "b"),
        ('{"fromhost-ip":"1.1.1.1"}', "hostname", "1.1.1.1"),
        ('{"hostname":"h","fromhost_ip":"2.2.2.2"}', "fromhost_ip", "2.2.2.2"),
        ('{"hostname":"h","severity_text":"s","syslogseverity-text":"t"}', "severity", "s"),
        ('{"hostname":"h","syslogfacility-text":"f"}', "facility", "f"),
        ('{"hostname":"h","programname":"p","program":""}', "app_name", "p"),
        ('{"hostname":"h","procid":"9"}', "process_id", "9"),
        ('{"hostname":"h","pid":12}', "process_id", "12"),
        ('{"hostname":"h","msg":"m"}', "raw_message", "m"),
        ('{"hostname":"h","message":"m","raw_message":"r"}', "raw_message", "r"),
        ('{"hostname":"h","msg_id":"x"}', "msg_id", ""),
        ('{"hostname":"h","msg_id":"x","syslog_tag":"t"}', "msg_id", "t"),
        ('{"hostname":"h","via_relay":"edge"}', "via_relay", "edge"),
        ('{"hostname":"h","message":null,"msg":"n"}', "message", "n"),
        ('{"hostname":"h","message":"a\\u0000b"}', "message", "ab"),
    ],
)
def test_aliases(spark, line, column, value):
    assert classified(spark, line)[0][column] == value


def test_outcomes(spark):
    got = classified(
        spark,
        '{"hostname":"h"}', '{"a":', 'tail of a line"}', '{"hostname":""}', "", '{"timestamp":"2024', '{"timestamp":"x", oops}',
        "[1]", '{"hostname":"h"} trailing', '{"hostname":"h"},{"hostname":"i"}', "{'hostname':'h'}", '  {"hostname":"h"}', "{}",
        '{"timestamp":"x","message":"cut at an escape \\', '{"timestamp":"x","n":12', '{"timestamp":"x","n"', '{"timestamp":"x"}}',
    )
    outcomes = {i: (r["outcome"], r["defect"]) for i, r in got.items()}
    assert outcomes == {
        0: ("inserted", None), 1: ("parse_error", "malformed"), 2: ("dropped_partial", "partial"), 3: ("dropped_blank_host", None),
        5: ("parse_error", "truncated"), 6: ("parse_error", "malformed"), 7: ("dropped_partial", "partial"), 8: ("parse_error", "malformed"),
        9: ("parse_error", "malformed"), 10: ("parse_error", "malformed"), 11: ("inserted", None), 12: ("dropped_blank_host", None),
        13: ("parse_error", "truncated"), 14: ("parse_error", "truncated"), 15: ("parse_error", "truncated"), 16: ("parse_error", "malformed"),
    }
    assert got[1]["message"] == '[MALFORMED JSON] {"a":' and got[1]["hostname"] == "unknown" and got[1]["severity"] == "error"
    assert got[5]["message"].startswith("[TRUNCATED AT SOURCE] ")


def test_long_escaped_line_is_decoded(spark):
    body = '\\"' * 200_000
    got = classified(spark, '{"timestamp":"x","hostname":"h","message":"' + body, '{"hostname":"h","message":"' + body + '"}')
    assert got[0]["defect"] == "truncated" and len(got[1]["message"]) == 200_000


def test_header_repair(spark):
    got = run(
        spark,
        '{"hostname":"h","app_name":"2026-01-02T03","message":"04:05 host CEF:0|x"}',
        '{"hostname":"h","app_name":"2026-01-02T03","message":"04:05 host"}',
        '{"hostname":"h","app_name":"2026-01-02","message":"m"}',
    )
    assert (got[0]["app_name"], got[0]["message"]) == ("CEF", "2026-01-02T03:04:05 host CEF:0|x")
    assert got[0]["raw_message"] == got[0]["message"] and got[1]["app_name"] is None and got[2]["app_name"] == "2026-01-02"


def test_stored_columns(spark):
    got = run(spark, '{"hostname":"h","timestamp":"2024-01-02T03:04:05Z"}', '{"hostname":"h","timestamp":"junk"}', "{broken")
    assert got[0]["timestamp"] == dt.datetime(2024, 1, 2, 3, 4, 5) and got[0]["fromhost_ip"] is None and got[0]["raw_message"] is None
    assert got[1]["timestamp"] == got[2]["timestamp"] == AS_OF.replace(tzinfo=None)


def test_invalid_utf8_is_repaired(spark, tmp_path):
    (tmp_path / "in.log").write_bytes(b'{"hostname":"h","message":"a\xff\xfeb"}\n\n{"hostname":"i"}\r\n')
    rows = ingest.classify(lines.read_lines(spark, str(tmp_path))).collect()
    assert {r["hostname"]: r["message"] for r in rows} == {"h": "a��b", "i": ""}


def test_over_long_rows_are_kept_and_marked(spark, logs):
    got = ingest.mark_over_length(logs({"hostname": "x" * 256}, {"severity": "y" * 21}, {"hostname": "x" * 255}))
    assert [r["over_length"] for r in got.orderBy("id").collect()] == ["hostname", "severity", None]


def test_ids_are_unique_across_loads(spark):
    df = spark.range(10_000).repartition(7).select(F.lit("m").alias("m"))
    ids = [r["id"] for load in ("a", "b") for r in ingest.assign_ids(df, load).collect()]
    assert len(set(ids)) == 20_000 and min(ids) >= 0


def test_lone_carriage_returns_and_open_tails(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\rtwo\nsame\nsame")
    (tmp_path / "b.log").write_bytes(b"x\r\n\ny\n")
    (tmp_path / "c.log").write_bytes(b"only open")
    (tmp_path / "d.log").write_bytes(b"")
    (tmp_path / "e.log").write_bytes(b"bytes \xff\xfe\nq" + b"z" * 200_000)
    read = lambda **k: sorted(r["line"] for r in lines.read_lines(spark, str(tmp_path), **k).collect())
    whole = read()
    assert len(whole) == 5 and {"one\rtwo", "same", "x", "y"} < set(whole)
    assert len(read(whole_lines=False)) == 8
    text = spark.read.option("lineSep", "\n").text(str(tmp_path))
    by_blocks = lines._open_tails(spark, text, text.inputFiles())
    assert sorted(by_blocks) == sorted(tuple(r) for r in lines._tails_by_sums(text, text.inputFiles()).collect())
    assert sorted(size for _, size, _ in by_blocks) == [4, 9, 200_001]


def test_tails_of_many_files_and_odd_names(spark, tmp_path):
    folder = tmp_path / "with space é%20"
    folder.mkdir()
    for i in range(30):
        (folder / f"f {i}.log").write_bytes(b"a\n" + (b"open" if i % 3 else b""))
    assert sorted(r["line"] for r in lines.read_lines(spark, str(folder)).collect()) == ["a"] * 30


@pytest.mark.parametrize(
    "stamp, as_of, want",
    [
        ("Oct 11 22:14:15", "2024-12-01", "2024-10-11 22:14:15"), ("Dec 31 23:59:59", "2025-01-01T00:00:05", "2024-12-31 23:59:59"),
        ("Jan  1 00:00:03", "2024-12-31T23:59:59", "2025-01-01 00:00:03"), ("Feb 29 01:02:03", "2027-05-01", "2024-02-29 01:02:03"),
        ("Feb 29 01:02:03", "2103-05-01", "2096-02-29 01:02:03"), ("Feb 30 01:02:03", "2024-05-01", None),
    ],
)
def test_year_of_stamps_without_one(spark, stamp, as_of, want):
    got = spark.range(1).select(clock.parse_timestamp(F.lit(stamp), clock.at(as_of)).cast("string").alias("t")).first()["t"]
    assert got == want


def test_resume_skips_seen_and_unreadable(spark, logs):
    stored = logs({"timestamp": dt.datetime(2024, 1, 1, 10, tzinfo=dt.timezone.utc)})
    raw = ['{"timestamp":"2024-01-01T10:00:00Z"}', '{"timestamp":"2024-01-01T10:00:01Z"}', '{"timestamp":"junk"}', "{bad"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, line string")
    assert [r["i"] for r in ingest.resume_after(df, stored).collect()] == [1]


def test_rfc3164(spark):
    raw = ["<34>Oct 11 22:14:15 box su[12]: 'su root' failed", "<165>Aug  1 05:06:07 host app: x: y", "no header", "<999>Aug  1 05:06:07 host app: z"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, line string")
    got = {r["i"]: r for r in syslog.parse_rfc3164(df).drop("timestamp").collect()}
    assert set(got) == {0, 1, 3}
    assert (got[0]["severity"], got[0]["facility"], got[0]["process_id"], got[0]["message"]) == ("crit", "auth", "12", "'su root' failed")
    assert (got[1]["severity"], got[1]["facility"], got[1]["app_name"], got[1]["message"]) == ("notice", "local4", "app", "x: y")
    assert got[3]["facility"] is None
