import pytest
from pyspark.sql import functions as F

from logweave.operators import parsing
from logweave.sources import library
from logweave.sources.library import Rule, builtin_rules


def rule(i, name, kind, value, pattern, *fields, **more):
    return Rule(i, name, kind, value, pattern, tuple((f, f, "string") for f in fields), **more)


def parsed(spark, rules, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, hostname string, app_name string, message string")
    out = parsing.parse(df, rules).orderBy("i").collect()
    return [(r["matched_parsers"], r["parsed_fields"]) for r in out]


def builtin(name):
    return next(r for r in builtin_rules() if r.name == name)


def test_selector_needs_the_pattern_too(spark):
    rules = [rule(1, "ap", "hostname", "ubnt*", r"AP (\S+)", "mac")]
    got = parsed(spark, rules, ("ubnt1", None, "AP aa"), ("ubnt1", None, "nothing"), ("other", None, "AP aa"))
    assert got == [(["ap"], {"mac": "aa"}), ([], {}), ([], {})]


def test_message_selector(spark):
    rules = [rule(1, "fw", "message", "DESCR=", r'DESCR="([^"]+)"', "description"), rule(2, "never", "message", "NOPE", ".*")]
    assert parsed(spark, rules, ("h", "", '[block] DESCR="a rule" SRC=1')) == [(["fw"], {"description": "a rule"})]


def test_blank_selector_and_blank_app_never_match(spark):
    rules = [rule(1, "a", "app_name", "*", "x"), rule(2, "b", "hostname", "", "x"), rule(3, "c", "message", None, "x"), rule(4, "d", "odd", "x", "x")]
    assert parsed(spark, rules, ("h", "", "x"), ("h", None, "x"), ("h", "app", "x")) == [([], {}), ([], {}), (["a"], {})]


def test_fields_of_several_rules_merge_first_wins(spark):
    rules = [
        rule(2, "second", "all", None, r"k=(\S+) b=(\S+)", "k", "b"),
        rule(1, "first", "all", None, r"k=(\S*)(x)?", "k", "opt"),
        rule(3, "third", "all", None, r"(b)=(\S+)", "other", "k", "surplus"),
    ]
    assert parsed(spark, rules, ("h", "", "k=1 b=2")) == [
        (["first", "second", "third"], {"k": "1", "opt": "", "b": "2", "other": "b"})
    ]


def test_an_empty_value_of_an_earlier_rule_stays(spark):
    rules = [rule(1, "a", "all", None, r"k=(\d*)", "k"), rule(2, "b", "all", None, r"k=(\w+)", "k")]
    assert parsed(spark, rules, ("h", "", "k=abc")) == [(["a", "b"], {"k": ""})]


def test_disabled_and_broken_rules_are_skipped(spark):
    rules = [rule(1, "off", "all", None, "x", enabled=False), rule(2, "bad", "all", None, "("), rule(3, "ok", "all", None, "(x)", "f")]
    assert parsed(spark, rules, ("h", "", "x")) == [(["ok"], {"f": "x"})]


def test_rule_without_fields_and_special_characters(spark):
    rules = [rule(1, r"cost $1 \ rule", "all", None, r"x"), rule(2, "multi", "all", None, r"a\n(b+)", "bs")]
    assert parsed(spark, rules, ("h", "", "x a\nbb\nrest"), ("h", "", "x")) == [
        ([r"cost $1 \ rule", "multi"], {"bs": "bb"}),
        ([r"cost $1 \ rule"], {}),
    ]


def test_value_with_separators(spark):
    rules = [rule(1, "a", "all", None, r"v=(.*)", "v")]
    assert parsed(spark, rules, ("h", "", "v=a\x01b=c,d$1\\")) == [(["a"], {"v": "a\x01b=c,d$1\\"})]


def test_leftmost_match_is_taken(spark):
    rules = [rule(1, "a", "all", None, r"(\d+)|x", "n")]
    assert parsed(spark, rules, ("h", "", "ab 12 x 34"), ("h", "", "x 34")) == [(["a"], {"n": "12"}), (["a"], {"n": ""})]


def test_builtin_samples(spark):
    """One line per device family, written for these tests."""
    samples = {
        "UniFi Network WAN Failover": (
            "0|Ubiquiti|UniFi Network|9.1|105|Temporary Internet Failover|6|UNIFIcategory=Net A UNIFIhost=Box UNIFIdeviceMac=aa:bb UNIFIdeviceName=Gate One"
            " UNIFIdeviceModel=M1 UNIFIdeviceIp=10.9.0.1 UNIFIdeviceVersion=1.2 UNIFIwanName=Line 1 UNIFIwanId=WAN1 UNIFIwanPort=9 UNIFIwanIsp=First ISP"
            " UNIFIwanSubnet=10.1.1.0/30 UNIFIwanSla=Auto UNIFIfailoverWanName=Line 2 UNIFIfailoverWanId=WAN2 UNIFIfailoverWanPort=8"
            " UNIFIfailoverWanIsp=Second UNIFIfailoverWanSubnet=10.2.1.0/28 UNIFIreportedDuration=7s UNIFIutcTime=2026-01-01T00:00:00Z msg=line is back",
            {"category": "Net A", "device_name": "Gate One", "wan_isp": "First ISP", "failover_wan_id": "WAN2", "reported_duration": "7s", "msg": "line is back"},
        ),
        "Windows RDP Session Reconnect": (
            r'"message":"x\\r\\nUżytkownik: LAB\\\\ann\\r\\nIdentyfikator sesji: 4\\r\\nŹródłowy adres sieciowy: 10.7.0.3","eventId":25,'
            r'"providerName":"Microsoft-Windows-TerminalServices-LocalSessionManager"',
            {"rdp_user": r"LAB\\\\ann", "rdp_session_id": "4", "src_ip": "10.7.0.3"},
        ),
        "Windows Event Log (JSON)": (
            '{"message":"ok.","eventId":7,"providerName":"Microsoft-Windows-Test","level":"Info","timeCreated":"t","logName":"L","machineName":"m","userId":"-","activityId":"-"}',
            {"event_message": "ok.", "event_id": "7", "provider_name": "Microsoft-Windows-Test", "machine_name": "m"},
        ),
        "Ubiquiti Firewall Log": (
            '[R-1] DESCR="drop all" IN=eth0 OUT= MAC=aa SRC=10.0.0.1 DST=10.0.0.2 TOS=0 LEN=40 TTL=1 PROTO=TCP SPT=1 DPT=2',
            {"rule_id": "R-1", "description": "drop all", "out_iface": "", "proto": "TCP", "dst_port": "2"},
        ),
        "PAM Session": ("pam_unix(sshd:session): opened for user bob(uid=1000) by root", {"service": "sshd", "user": "bob(uid=1000)", "uid": "", "by_user": "root"}),
    }
    for name, (line, wanted) in samples.items():
        one = builtin(name)
        (names, fields), = parsed(spark, [one], ("h", "", line))
        assert names == [name]
        assert {k: fields[k] for k in wanted} == wanted
        assert len(fields) == len(one.fields)


def test_pattern_test(spark):
    df = spark.createDataFrame([("user=alice action=login",), ("none",)], "message string")
    rows = parsing.test_pattern(df, r"user=(\S+) action=(\S+)").collect()
    assert [(r["matched"], r["groups"]) for r in rows] == [(True, {"group_0": "alice", "group_1": "login"}), (False, {})]
    assert [r["matched"] for r in parsing.test_pattern(df, "user").collect()] == [False, False]
    with pytest.raises(ValueError):
        parsing.test_pattern(df, "(")


def test_each_pattern_runs_once(spark):
    """Filters on extracted fields must not pull the patterns down into a second evaluation."""
    rules = [rule(1, "a", "all", None, r"k=(\S+)", "k"), rule(2, "b", "all", None, r"j=(\S+)", "j")]
    df = spark.createDataFrame([("h", "", "k=1 j=2")], "hostname string, app_name string, message string")
    out = parsing.parse(df, rules).filter((parsing.field("k") == "1") & (F.size("matched_parsers") > 1))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 2
    assert out.count() == 1


def test_reparse_is_idempotent_and_limited(spark, logs):
    rules = [rule(1, "a", "all", None, r"k=(\S+)", "k")]
    table = logs({"message": "k=1"}, {"message": "k=2", "parsed_fields": {"k": "old"}, "matched_parsers": ["z"]}, {"message": "no"}, {"message": "k=4"})
    counts = parsing.reparse_counts(parsing.reparse(table, rules)).first()
    assert (counts["processed"], counts["updated"]) == (3, 2)
    again = parsing.reparse(parsing.reparse(table, rules).drop("updated"), rules)
    assert [r["message"] for r in again.collect()] == ["no"]
    assert [r["id"] for r in parsing.reparse(table, rules, limit=1).collect()] == [1]


def test_library_folder(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"name":"two","device_type":"d","match_type":"all","match_value":"","regex":"x","fields":[{"name":"f","label":"F","type":"ip"}]}]')
    (tmp_path / "a.json").write_text('[{"name":"one","device_type":"d","match_type":"message","match_value":"m","regex":"y","fields":[]},\n{"name":"one b","match_type":"all","regex":"z"}]')
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.txt").write_text("[]")
    rules, errors = library.read_library(spark, str(tmp_path))
    got = library.collect_rules(rules)
    assert [(r.id, r.name, r.match_value) for r in got] == [(1, "one", "m"), (2, "one b", None), (3, "two", None)]
    assert got[2].fields == (("f", "F", "ip"),)
    assert [r["file"] for r in errors.collect()] == ["c.json"]


def test_builtin_library_as_a_folder(spark, tmp_path):
    library.write_files(spark, str(tmp_path), library.builtin_files())
    rules, errors = library.read_library(spark, str(tmp_path))
    assert errors.count() == 0
    plain = lambda r: (r.id, r.name, r.device_type, r.match_type, r.match_value, r.regex, r.fields, r.description)
    assert [plain(r) for r in library.collect_rules(rules)] == [plain(r) for r in builtin_rules()]
    labels = {(r.name, n): l for r in builtin_rules() for n, l, _ in r.fields}
    assert labels["Cisco IOS Interface", "msec"] == "MSEC Code" and labels["PAM Session", "service"] == "PAM Service"
    assert labels["FortiGate Traffic", "dst_ip"] == "Destination IP" and labels["Firewall Drop", "dst_ip"] == "Dest IP"


def test_registry_queries(spark, logs):
    registry = library.field_registry(library.rules_frame(spark, builtin_rules()))
    assert registry.count() == 255
    table = logs({"fromhost_ip": "1.1.1.1", "matched_parsers": ["SSHD Auth"]}, {"fromhost_ip": None, "matched_parsers": ["Cron Job"]})
    names = {r["field_name"] for r in parsing.fields_for_devices(table, registry, ["1.1.1.1"]).collect()}
    assert names == {"auth_method", "username", "src_ip", "src_port"}
    assert {r["parser_name"] for r in parsing.fields_for_devices(table, registry, [""]).collect()} == {"Cron Job"}
    assert parsing.fields_for_devices(table, registry, []).count() == 255
