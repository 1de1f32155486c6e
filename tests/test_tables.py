import datetime as dt
import ipaddress
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logweave.functions import clock
from logweave.operators import devices, export, filters, paging, parsing, rollups, saved_query, timeline
from logweave.operators.filters import FieldFilter, LogFilter
from logweave.plans import jobs, lookup
from logweave.sources import library, snapshots, tables, term_index, versions
from logweave.sources.library import Rule, builtin_rules

START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize(
    "ff, hits",
    [
        (FieldFilter("u", "eq", ("bob",)), [1]), (FieldFilter("u", "", ("bob",)), [1]), (FieldFilter("u", "odd", ("bob",)), [1]),
        (FieldFilter("u", "neq", ("bob",)), [2]), (FieldFilter("u", "notin", ("bob", "x")), [2]), (FieldFilter("u", "in", ("bob", "ann")), [1, 2]),
        (FieldFilter("u", "contains", ("N",)), [2]), (FieldFilter("u", "not_contains", ("N",)), [1]), (FieldFilter("u", "starts_with", ("B",)), [1]),
        (FieldFilter("u", "ends_with", ("N",)), [2]), (FieldFilter("u", "contains", ("b_b",)), [1]), (FieldFilter("n", "gt", ("5",)), [1]),
        (FieldFilter("n", "gt", ("10",), numeric=True), [2]), (FieldFilter("u", "is_empty"), [3]), (FieldFilter("u", "is_not_empty"), [1, 2]),
        (FieldFilter("u", "regex", ("^(bob|ann)$",)), [1, 2]), (FieldFilter("bad name", "eq", ("x",)), [1, 2, 3]), (FieldFilter("u", "eq"), [1, 2, 3]),
        (FieldFilter("hostname", "eq", ("h",)), [1, 2, 3]), (FieldFilter("u", "contains", (r"b\ob",)), []),
    ],
)
def test_field_filters(logs, ff, hits):
    table = logs({"parsed_fields": {"u": "bob", "n": "9"}}, {"parsed_fields": {"u": "ann", "n": "100"}}, {"parsed_fields": {}})
    assert ids(filters.apply(table, LogFilter(field_filters=(ff,)))) == hits


def test_filters_combine_and_unknown_device(logs):
    table = logs({"fromhost_ip": None}, {"fromhost_ip": "1.1.1.1", "app_name": "SSHd"}, {"fromhost_ip": "1.1.1.1", "app_name": None}, {"severity": "err"})
    assert ids(filters.apply(table, LogFilter())) == [1, 2, 3, 4]
    assert ids(filters.apply(table, LogFilter(fromhost_ip="__unknown__"))) == [1, 4]
    assert ids(filters.apply(table, LogFilter(fromhost_ip="1.1.1.1", app_name="ssh"))) == [2]
    assert ids(filters.apply(table, LogFilter(devices=("", "x"), severity="err"))) == [4]
    assert ids(filters.apply(table, LogFilter(has_fields=True))) == []


def test_allow_list_join_equals_predicate(spark, logs):
    table = logs(*[{"fromhost_ip": ip} for ip in ("10.0.0.1", "10.0.1.1", "11.5.0.0", "bad", None, "10.255.1.1")])
    short = ["10.0.0.0/24", "11.0.0.0/8", "10.255.1.1"]
    long = short + [f"192.168.{i}.{j}" for i in range(20) for j in range(0, 250, 2)]
    assert ids(filters.allowed_addresses(table, short)) == ids(filters.allowed_addresses(table, long)) == [1, 3, 6]
    assert ids(filters.allowed_addresses(table, ["x"])) == []


def test_allow_list_of_both_families(logs):
    texts = [
        "2001:db8::5", "2001:DB8:0:0:0:0:0:6", "2001:db9::1", "::ffff:10.0.0.7", "10.0.0.8", "::1", "::", "fe80::1:2:3:4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3",
        "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "12345::", "1:2:3:4:5:6:1.2.3.4", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "::1.2.3.4.5", "g::1", "1.2.3", "", None, "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7:8:9", ":::", "1:::2",
    ]
    table = logs(*[{"fromhost_ip": t} for t in texts])

    def wanted(entries):
        nets = [ipaddress.ip_network(e, strict=False) for e in entries]
        found = []
        for i, t in enumerate(texts):
            try:
                ip = ipaddress.ip_address(t)
            except ValueError:
                continue
            both = [ip] + ([ip.ipv4_mapped] if ip.version == 6 and ip.ipv4_mapped else []) + ([ipaddress.ip_address(f"::ffff:{ip}")] if ip.version == 4 else [])
            if any(a in n for a in both for n in nets if n.version == a.version):
                found.append(i + 1)
        return found

    many = [f"192.168.{i}.{j}" for i in range(20) for j in range(0, 250, 2)]
    for entries in (["2001:db8::/32"], ["::/0"], ["::/96", "fe80::/10"], ["10.0.0.0/24"], ["::ffff:10.0.0.8"], ["1:2::/32", "::1"], ["0.0.0.0/0"]):
        assert ids(filters.allowed_addresses(table, entries)) == wanted(entries) == ids(filters.allowed_addresses(table, entries + many)), entries


def test_empty_range_on_a_stored_table(spark, logs, tmp_path):
    tables.write_logs(logs({}, {}), str(tmp_path / "t"))
    assert filters.apply(tables.read_logs(spark, str(tmp_path / "t")), LogFilter(start="", end="")).count() == 2


def test_page_walk_covers_every_row_once(logs):
    table = logs(*[{"timestamp": START + dt.timedelta(seconds=i // 3)} for i in range(20)])
    for sort in ("newest", "oldest"):
        seen, after, more = [], None, True
        while more:
            rows = paging.page(table, 6, sort=sort, after=after).collect()
            rows.sort(key=lambda r: (r["timestamp"], r["id"]), reverse=sort == "newest")
            seen += [r["id"] for r in rows]
            after, more = (rows[-1]["timestamp"], rows[-1]["id"]), rows[0]["has_more"]
        assert seen == sorted(seen, reverse=sort == "newest") and len(seen) == 20
    with pytest.raises(ValueError):
        paging.page(table, 5, sort="severity", after=after)
    plan = paging.page(table, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_page_sizes():
    assert [paging.page_size(n) for n in (None, 0, 7, 5000)] == [50, 50, 7, 5000]
    with pytest.raises(ValueError):
        paging.page_size(-1)


def test_saved_query_overrides():
    saved = saved_query.SavedQuery(devices=("a", "b"), severity="err", fields=("src_ip",), field_filters=(FieldFilter("x", "eq", ("1",)),))
    rules = builtin_rules()
    plain = saved_query.resolve(saved, rules)
    assert plain.devices == ("a", "b") and "SSHD Auth" in plain.required_parsers and plain.severity == "err"
    asked = saved_query.Override(severity="info", fromhost_ip="b", field_filters='[{"field":"y","operator":"in","values":["2"]}]')
    merged = saved_query.resolve(saved, rules, asked)
    assert (merged.severity, merged.devices, merged.field_filters) == ("info", ("b",), (FieldFilter("y", "in", ("2",)),))
    kept = saved_query.resolve(saved, rules, saved_query.Override(fromhost_ip="z", field_filters="not json"))
    assert kept.devices == ("a", "b") and kept.field_filters == saved.field_filters


def test_timeline_zone_with_half_hours_uses_rows(logs):
    table = logs(*[{"timestamp": START + dt.timedelta(minutes=17 * i)} for i in range(100)])
    now = START + dt.timedelta(days=2)
    for zone in ("Asia/Kolkata", "Europe/Warsaw", "nowhere"):
        via = timeline.timeline(table, timeline.hourly(table), "day", now, zone)
        raw = timeline.from_rows(table, "day", now, zone, start=START - dt.timedelta(days=30))
        assert sorted(map(tuple, via.collect())) == sorted(map(tuple, raw.collect()))
        assert via.agg(F.sum("cnt")).first()[0] == 100


def test_rollup_sums_equal_rows(logs):
    table = logs(*[{"severity": s, "fromhost_ip": ip} for s in ("err", "info", "error") for ip in ("a", None, "b")])
    assert rollups.severity_counts(table).agg(F.sum("cnt")).first()[0] == 9
    assert devices.device_stats(table).agg(F.sum("total")).first()[0] == 9
    assert {r["severity"] for r in rollups.severity_counts(table, normalize=True).collect()} == {"err", "info"}
    assert rollups.severity_share(rollups.severity_counts(table)).agg(F.round(F.sum("percent"), 2)).first()[0] == 100.0


def test_unique_sketches_merge(spark, logs, tmp_path):
    rows = [{"hostname": f"h{i % 900}", "fromhost_ip": None if i % 5 == 0 else "" if i % 5 == 1 else f"10.0.0.{i % 5}", "message": f"m{i}"} for i in range(3000)]
    table = logs(*rows).withColumn("timestamp", F.col("timestamp") + F.make_dt_interval(hours=F.col("id") % 50))
    sketches = rollups.unique_sketches(table)
    one = rollups.unique_estimates(sketches).first()
    close = lambda got, exact: abs(got - exact) <= 4 * rollups.UNIQUE_ERROR * exact
    # Empty addresses count, nulls do not.
    assert close(one["unique_hosts"], 900) and one["unique_devices"] == 4 and close(one["unique_messages"], 3000)
    exact = {r[0]: r[1] for r in table.groupBy(F.to_date("timestamp")).agg(F.countDistinct("hostname")).collect()}
    per_day = {r["log_date"]: r["unique_hosts"] for r in rollups.unique_estimates(sketches, "log_date").collect()}
    assert len(exact) == 3 and exact.keys() == per_day.keys() and all(close(per_day[d], n) for d, n in exact.items())
    assert tuple(rollups.unique_estimates(sketches.limit(0)).first()) == (0, 0, 0)

    stored, rollup = str(tmp_path / "logs"), str(tmp_path / "uniques")
    for part in (0, 1):
        snapshots.commit(spark, stored, tables.add_piece(table.filter(F.col("id") % 2 == part), stored, "load"))
        assert len(jobs.refresh_rollups(spark, stored, rollup, kind=jobs.UNIQUES)) == 3
    kept = jobs.read_rollup(spark, rollup, jobs.UNIQUES)
    assert kept.count() == kept.select("hour").distinct().count() == 50
    merged = rollups.unique_estimates(kept).first()  # the way of merging may change an estimate a little
    assert close(merged["unique_hosts"], 900) and merged["unique_devices"] == 4 and close(merged["unique_messages"], 3000)


def test_library_editions(spark, logs, tmp_path):
    path = str(tmp_path / "editions")
    old = [Rule(1, "k", "all", None, r"k=(\d)", (("k", "Old", "string"),), description="old"), Rule(2, "off", "all", None, r"(m)", (("m", "M", "string"),), enabled=False)]
    new = [Rule(1, "k", "all", None, r"k=\d+(\d)", (("k", "New", "string"),), description="new")]
    at = lambda s: START + dt.timedelta(seconds=s)
    assert library.record_edition(spark, path, old, at(1)) == 0 and library.record_edition(spark, path, list(reversed(old)), at(2)) == 0
    with pytest.raises(ValueError):
        library.record_edition(spark, path, new, at(1))
    with pytest.raises(ValueError):
        library.record_edition(spark, path, [], at(9))
    assert library.record_edition(spark, path, new, at(3)) == 1
    editions = library.editions(spark, path)
    assert [(e.number, e.valid_from, list(e.rules)) for e in editions] == [(0, at(1), old), (1, at(3), new)]

    table = logs(*[{"message": "m k=12"} for _ in range(5)])
    parsed = parsing.parse_as_of(table, editions)
    got = {r["id"]: (r["library_edition"], r["parsed_fields"].get("k")) for r in parsed.collect()}
    assert got == {1: (None, None), 2: (0, "1"), 3: (0, "1"), 4: (1, "2"), 5: (1, "2")}
    shown = parsing.described(parsed, library.edition_history(spark, path), "id").collect()
    assert {(r["id"], r["description"], r["fields"][0]["label"]) for r in shown} == {(2, "old", "Old"), (3, "old", "Old"), (4, "new", "New"), (5, "new", "New")}
    assert parsing.parse_as_of(table, []).filter("library_edition IS NULL").count() == 5


def test_rows_keep_the_edition_that_parsed_them(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "logs")
    source.mkdir()
    (source / "a.log").write_text(lines_for([1, 2]))
    rule = Rule(1, "k", "all", None, r"k=(\d) day 1", (("k", "K", "string"),))
    jobs.load(spark, str(source), table, [rule], "2024-03-09T00:00:00", index_text=False, edition=3)
    again = Rule(1, "k", "all", None, r"k=([12]) day", (("k", "K", "string"),))
    assert jobs.reparse_table(spark, table, [again], edition=4) == 1
    got = {(r["log_date"].day, r["library_edition"], r["n"]) for r in tables.read_logs(spark, table).groupBy("log_date", "library_edition").agg(F.count("*").alias("n")).collect()}
    # Rows that no edition has parsed keep the one they were loaded with.
    assert got == {(1, 3, 4), (2, 4, 2), (2, 3, 2)}


def test_reports_avoid_sorting_rows(logs):
    """The first aggregation over the table must be a hash aggregation."""
    table = logs({})
    for report in (devices.device_stats(table), rollups.top_devices(table), rollups.top_errors(table, START), rollups.summary(table, START)):
        plan = report._jdf.queryExecution().executedPlan().toString()
        deepest = [line for line in plan.splitlines() if "Aggregate(" in line][-1]
        assert "HashAggregate" in deepest and "SortAggregate" not in deepest


def test_export_lines(spark, logs):
    table = logs({"message": '=cmd,"x"', "parsed_fields": {"f": "+1"}}, {"message": "<b>"})
    csv = export.csv_lines(export.csv_rows(table, "UTC", ("f",)), "My query")
    assert [r["line"] for r in csv.collect()] == [
        "# Export: My query",
        "timestamp,hostname,app_name,severity,message,f",
        "2024-03-01 00:00:01,h,,info,<b>,",
        '2024-03-01 00:00:00,h,,info,"\'=cmd,""x""",\'+1',
    ]
    html = [r["line"] for r in export.html_lines(export.html_rows(table, "UTC"), table, "A & B").collect()]
    assert len(html) == 4 and "A &amp; B" in html[0] and "<p>2 rows</p>" in html[0] and "&lt;b&gt;" in html[1]
    assert export.json_lines(table).count() == 2


def lines_for(days):
    out = []
    for day in days:
        for i in range(4):
            out.append(f'{{"timestamp":"2024-03-{day:02d}T0{i}:00:00Z","hostname":"h{i}","fromhost-ip":"10.0.0.{i}","severity":"info","message":"k={i} day {day}"}}')
    return "\n".join(out) + "\n"


def test_load_reparse_rollup_retention(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "logs")
    Path(source).mkdir()
    (Path(source) / "a.log").write_text(lines_for([1, 2, 3]) + "{broken\n" + '{"hostname":"' + "x" * 300 + '"}\n')
    as_of = "2024-03-04T00:00:00"
    counts = {r["outcome"]: r["lines"] for r in jobs.load(spark, source, table, [], as_of).collect()}
    assert counts == {"inserted": 13, "parse_error": 1}
    stored = tables.read_logs(spark, table)
    assert stored.count() == 14 and stored.filter("over_length IS NOT NULL").count() == 1
    assert stored.select("id").distinct().count() == 14
    assert filters.apply(stored, LogFilter(search="days k")).count() == 12
    pruned = filters.apply(stored, LogFilter(start="2024-03-02T00:00:00", end="2024-03-02T23:00:00"))
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan and pruned.count() == 4

    rule = Rule(1, "k", "all", None, r"k=(\d) day [23]", (("k", "K", "string"),))
    assert jobs.reparse_table(spark, table, [rule]) == 2
    again = tables.read_logs(spark, table)
    assert again.count() == 14 and again.filter("size(matched_parsers) > 0").count() == 8
    assert jobs.reparse_table(spark, table, [rule]) == 0

    rollup = str(tmp_path / "rollup")
    assert len(jobs.refresh_rollups(spark, table, rollup)) == 4
    assert jobs.refresh_rollups(spark, table, rollup) == []
    (Path(source) / "b.log").write_text(lines_for([2]))
    (Path(source) / "a.log").unlink()
    jobs.load(spark, source, table, [rule], as_of)
    assert jobs.refresh_rollups(spark, table, rollup) == [dt.date(2024, 3, 2)]
    assert jobs.read_rollup(spark, rollup).agg(F.sum("cnt")).first()[0] == tables.read_logs(spark, table).count() == 18

    done = jobs.apply_retention(spark, table, "2024-03-04T02:00:00", 2)
    assert done == {"dropped": [dt.date(2024, 3, 1)], "rewritten": [dt.date(2024, 3, 2)]}
    left = tables.read_logs(spark, table)
    assert left.filter(F.col("timestamp") < clock.at("2024-03-02T02:00:00")).count() == 0
    assert left.count() == 18 - 4 - 4
    assert jobs.refresh_rollups(spark, table, rollup) == [dt.date(2024, 3, 2)]
    assert jobs.read_rollup(spark, rollup).agg(F.sum("cnt")).first()[0] == 10


def _loaded(spark, tmp_path, *days):
    source, table = tmp_path / f"in-{'-'.join(map(str, days))}", str(tmp_path / "logs")
    source.mkdir(exist_ok=True)
    (source / "a.log").write_text(lines_for(days))
    jobs.load(spark, str(source), table, [], "2024-03-09T00:00:00", index_text=False)
    return table


def _spoil(table, piece):
    """Make the files of a piece unreadable."""
    for file in (Path(table) / "data" / f"piece={piece}").rglob("*.parquet"):
        file.write_bytes(b"not parquet")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)


def test_refresh_reads_new_pieces_only(spark, tmp_path):
    table, rollup = _loaded(spark, tmp_path, 1, 2), str(tmp_path / "rollup")
    assert len(jobs.refresh_rollups(spark, table, rollup)) == 2
    old = {e.piece for e in snapshots.entries(spark, table)}
    _loaded(spark, tmp_path, 2, 3)
    for piece in old:
        _spoil(table, piece)
    assert jobs.refresh_rollups(spark, table, rollup) == [dt.date(2024, 3, 2), dt.date(2024, 3, 3)]
    per_day = {r["log_date"].day: r["n"] for r in jobs.read_rollup(spark, rollup).groupBy("log_date").agg(F.sum("cnt").alias("n")).collect()}
    assert per_day == {1: 4, 2: 8, 3: 4}
    assert jobs.refresh_rollups(spark, table, rollup) == []


def test_equal_counts_of_other_rows_are_seen(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "ROLLUP_PIECES", 3)
    table, rollup = _loaded(spark, tmp_path, 1, 2), str(tmp_path / "rollup")
    jobs.refresh_rollups(spark, table, rollup)
    other = tables.read_logs(spark, table).filter("log_date = '2024-03-02'").withColumn("hostname", F.lit("other"))
    snapshots.commit(spark, table, tables.add_piece(other, table, "other"), lambda e: e.log_date.day == 2)
    assert jobs.refresh_rollups(spark, table, rollup) == [dt.date(2024, 3, 2)]
    hosts = {r["hostname"] for r in jobs.read_rollup(spark, rollup).filter("log_date = '2024-03-02'").collect()}
    assert hosts == {"other"}
    snapshots.commit(spark, table, [], lambda e: e.log_date.day == 1)
    assert jobs.refresh_rollups(spark, table, rollup) == []
    assert jobs.read_rollup(spark, rollup).agg(F.sum("cnt")).first()[0] == 4
    for _ in range(jobs.ROLLUP_PIECES + 1):
        snapshots.commit(spark, table, tables.add_piece(other, table, "more"))
        jobs.refresh_rollups(spark, table, rollup)
    assert len(snapshots.entries(spark, rollup)) <= jobs.ROLLUP_PIECES
    assert jobs.read_rollup(spark, rollup).agg(F.sum("cnt")).first()[0] == 4 * (jobs.ROLLUP_PIECES + 2)
    assert jobs.refresh_rollups(spark, table, rollup, force=True) == [dt.date(2024, 3, 2)]
    assert jobs.read_rollup(spark, rollup).agg(F.sum("cnt")).first()[0] == 4 * (jobs.ROLLUP_PIECES + 2)


def test_a_failure_before_the_switch_loses_nothing(spark, tmp_path, monkeypatch):
    table = _loaded(spark, tmp_path, 1, 2)
    rule = Rule(1, "k", "all", None, r"k=(\d) day [12]", (("k", "K", "string"),))
    want = sorted(map(str, tables.read_logs(spark, table).collect()))

    def fail(*_, **__):
        raise OSError("lost before the commit")

    with monkeypatch.context() as broken:
        broken.setattr(jobs.snapshots, "commit", fail)
        for job in (lambda: jobs.reparse_table(spark, table, [rule]), lambda: jobs.apply_retention(spark, table, "2024-03-04T02:00:00", 2), lambda: _loaded(spark, tmp_path, 3)):
            with pytest.raises(OSError):
                job()
    assert sorted(map(str, tables.read_logs(spark, table).collect())) == want
    old = snapshots.entries(spark, table)
    assert len(snapshots.vacuum(spark, table)) == 3
    base = snapshots.current(spark, table)
    assert jobs.reparse_table(spark, table, [rule]) == 2
    assert sorted(map(str, snapshots.read(spark, table, old).collect())) == want  # readers of the old version go on
    with pytest.raises(RuntimeError):
        snapshots.commit(spark, table, [], base=base)
    assert len(snapshots.vacuum(spark, table)) == 1 and tables.read_logs(spark, table).filter("size(matched_parsers) = 1").count() == 8


def test_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    assert versions.read(spark, path) is None
    assert versions.write(spark.range(3), path) == 0 and versions.write(spark.range(5), path) == 1
    assert versions.read(spark, path).count() == 5 and versions.read(spark, path, before=1).count() == 3
    versions.write(spark.range(7), path, version=1)
    assert versions.read(spark, path).count() == 7


def test_alias_names(spark, logs):
    aliases = spark.createDataFrame([("1.1.1.1", "Router", "old-h")], "fromhost_ip string, display_name string, old_hostname string")
    table = logs({"fromhost_ip": "1.1.1.1"}, {"hostname": "old-h"}, {"hostname": "x", "fromhost_ip": "2.2.2.2"}, {"hostname": "", "fromhost_ip": "3.3.3.3"}, {"hostname": "", "fromhost_ip": None})
    got = {r["id"]: r["shown_name"] for r in devices.resolve_names(table, aliases).collect()}
    assert got == {1: "Router", 2: "Router", 3: "x", 4: "3.3.3.3", 5: "-"}


_WORDY = [
    ("link connected to core", None), ("the connections were closed", "raw Timeouts"), ("nothing here", None), ("user logged in", None),
    ("users never logged", None), ("connect timeout", "x"), ("", None), ("connecting the dots timeouts", None),
]


_ASKED = ["connection", "connection -timeouts or user", '"user logged"', '"connecting the dot"', "the", "absent or nothing"]


def test_indexed_search_equals_row_search(spark, logs, tmp_path):
    path = str(tmp_path / "t")
    rows = [{"message": m, "raw_message": r, "timestamp": START + dt.timedelta(days=i % 2)} for i, (m, r) in enumerate(_WORDY)]
    table = logs(*rows).coalesce(1)
    snapshots.commit(spark, path, tables.add_piece(table.filter("id % 2 = 0"), path, "load"))
    assert len(term_index.refresh(spark, path)) == 1
    snapshots.commit(spark, path, tables.add_piece(table.filter("id % 2 = 1"), path, "load"))
    want = {q: ids(filters.apply(table, LogFilter(search=q))) for q in [*_ASKED, "-connect"]}
    assert ids(lookup.search_table(spark, path, LogFilter(search="-connect"))) == want["-connect"]  # a piece with word lists, one without
    assert len(term_index.refresh(spark, path)) == 1 and term_index.refresh(spark, path) == []
    for query in _ASKED:
        found = lookup.search_table(spark, path, LogFilter(search=query))
        assert ids(found) == want[query]
        assert "ArrowEvalPython" not in found._jdf.queryExecution().toString()
    bounded = LogFilter(search="connection", start=START + dt.timedelta(days=1))
    assert ids(lookup.search_table(spark, path, bounded)) == ids(filters.apply(table, bounded))
    assert lookup.search_table(spark, path, LogFilter(search="connection", start=START + dt.timedelta(days=90))).count() == 0


def test_indexed_search_skips_files(spark, logs, tmp_path):
    path = str(tmp_path / "t")
    table = logs(*[{"message": f"day {i} " + ("rarely" if i == 7 else "often"), "timestamp": START + dt.timedelta(days=i)} for i in range(20)])
    snapshots.commit(spark, path, tables.add_piece(table, path, "load"))
    term_index.refresh(spark, path)
    found = lookup.search_table(spark, path, LogFilter(search="rare or rarely"))
    assert len(found.inputFiles()) == 1 and found.count() == 1
    assert len(lookup.search_table(spark, path, LogFilter(search="oftenly or often")).inputFiles()) == 19


@pytest.mark.parametrize("sort", ["newest", "oldest", "severity", "hostname"])
def test_deep_pages_equal_plain_offsets(logs, sort):
    rows = [{"hostname": f"h{i % 3}", "severity": ["err", "info"][i % 2], "timestamp": START + dt.timedelta(minutes=(i * 37) % 400)} for i in range(60)]
    table = logs(*rows)
    for offset in (1, 20, 59, 60):
        plain = [(r["id"], r["has_more"]) for r in paging.page(table, 7, sort, offset=offset).collect()]
        assert [(r["id"], r["has_more"]) for r in paging.page(table, 7, sort, offset=offset, deep=0).collect()] == plain


def test_keyset_over_severity_and_host(spark, logs):
    table = logs(*[{"hostname": f"h{i % 3}", "timestamp": START + dt.timedelta(minutes=i % 4)} for i in range(20)])
    table = table.withColumn("hostname", F.when(F.col("id") % 5 != 0, F.col("hostname")))
    everything = [r["id"] for r in paging.page(table, 100, "hostname").collect()]
    seen, cursor = [], None
    while True:
        rows = paging.page(table, 3, "hostname", after=cursor).collect()
        seen += [r["id"] for r in rows]
        if not rows or not rows[-1]["has_more"]:
            break
        cursor = (rows[-1]["hostname"], rows[-1]["timestamp"].astimezone(dt.timezone.utc), rows[-1]["id"])
    assert seen == everything and len(seen) == 20
    with pytest.raises(ValueError):
        paging.page(table, 3, "severity", after=(START, 1))
