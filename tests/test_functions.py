import re

import pytest
from pyspark.sql import functions as F

from logweave.functions import clock, net, regex, search, severity, text
from logweave.functions.stem import STOP_WORDS, stem
from logweave.sources.library import builtin_rules


def column(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select(expr.alias("x"), "i").orderBy("i").collect()]


@pytest.mark.parametrize(
    "word, expected",
    [
        ("connections", "connect"), ("connected", "connect"), ("connection", "connect"), ("timeouts", "timeout"),
        ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("conditional", "condit"), ("happiness", "happi"),
        ("generously", "generous"), ("skies", "sky"), ("dying", "die"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"),
        ("gaps", "gap"), ("agreed", "agre"), ("feed", "feed"), ("communication", "communic"), ("yelling", "yell"),
        ("sensibility", "sensibl"), ("ability", "abil"), ("operator", "oper"), ("analogously", "analog"), ("replacement", "replac"),
        ("adjustment", "adjust"), ("adoption", "adopt"), ("controlling", "control"), ("by", "by"), ("succeed", "succeed"),
        ("knightly", "knight"), ("hopefulness", "hope"), ("formative", "format"), ("probate", "probat"), ("rolling", "roll"),
    ],
)
def test_stem_table(word, expected):
    assert stem(word) == expected


def test_stem_keeps_a_prefix_of_the_word():
    """The cheap test before a stemmed search relies on this."""
    words = "rationalization national radically digitizer conformably flies laying said usability hopping".split()
    words += [w + e for w in ("connect", "relate", "sense", "comply", "use", "log", "magic", "act") for e in
              ("", "s", "ed", "ing", "ly", "ness", "ful", "ability", "ization", "ational", "ement", "ology")]
    for word in words:
        assert word.startswith(stem(word)[:-2]), (word, stem(word))


@pytest.mark.parametrize(
    "glob, value, hit",
    [
        ("ubnt*", "ubnt-ap1", True), ("ubnt*", "UBNT-ap1", False), ("ubnt*", "xubnt", False), ("*.example.com", "a.example.com", True),
        ("*.example.com", "a.exampleXcom", False), ("host?", "host1", True), ("host?", "host12", False), ("a*c", "abbc", True),
        ("a+b", "a+b", True), ("a+b", "aab", False), ("x", "x", True), ("x", "xy", False), ("*", "", True), ("h?[1]", "hh[1]", True),
    ],
)
def test_glob(spark, glob, value, hit):
    assert column(spark, regex.glob_match(F.col("v"), glob), value) == [hit]


@pytest.mark.parametrize(
    "pattern, java",
    [
        (r"(?P<user>\w+)$", r"(?d)(\w+)\z"),
        (r"(?<user_id>a)", "(?d)(a)"),
        (r"a\s\S", r"(?d)a[\t\n\f\r ][^\t\n\f\r ]"),
        (r"[a[b]\s]", r"(?d)[a\[b][\t\n\f\r ]]"),
        (r"[\s[&&x]", r"(?d)[\t\n\f\r \[\&\&x]"),
        (r"[]a]", r"(?d)[\]a]"),
        (r"[[:alpha:]]+", r"(?d)[\p{Alpha}]+"),
        (r"(?i)x", "(?d)(?iu)x"),
        (r"(?m)^x$", "(?d)(?m)^x$"),
        (r"\$[$]$", r"(?d)\$[$]\z"),
        (r"\Qa.b\E.", r"(?d)a\.b."),
    ],
)
def test_to_java(pattern, java):
    assert regex.to_java(pattern) == java


def test_group_count_agrees_with_python():
    for rule in builtin_rules():
        assert regex.group_count(rule.regex) == re.compile(rule.regex).groups, rule.name


def test_builtin_patterns_compile(spark):
    assert all(regex.compiles(spark, [regex.to_java(r.regex) for r in builtin_rules()]))
    assert regex.compiles(spark, ["a", "(", "b"]) == [True, False, True]


@pytest.mark.parametrize(
    "pattern, literal",
    [
        ("abc", "abc"), ("a|b", ""), (r"foo\.bar(\d+)?bazzes", "foo.bar"), ("ab?c", "a"), ("(?i)abc", ""), (r"x{2}yz", "yz"),
        (r"(long|longer)end", "end"), (r"[abc]+tail", "tail"), ("ab+cd", "ab"), (r"\[1:\d", "[1:"), (r"[\]]yy", "yy"),
        (r"\d{10} (\w+)", " "), (r"^\d{4}-\d{2}..", "-"), (r"\w{2,15}(x)", ""), (r"\p{Lu}(\d+)", ""), (r"\x41bc(\d+)", "bc"), (r"\x{41}b", "b"),
        (r"[[:alpha:]]]b", "]b"), (r"[^]a]z", "z"), (r"a{0}bc", "bc"), (r"(a|b){2}c", "c"), (r"\\d(\d)", r"\d"), (r"a+?b", "a"), (r"\1x", "x"),
    ],
)
def test_required_literal(pattern, literal):
    assert regex.required_literal(pattern) == literal


@pytest.mark.parametrize("pattern", ["(a+)+", "(?:a*)*b", "(x{2,})+"])
def test_user_patterns_that_backtrack_are_refused(pattern):
    with pytest.raises(ValueError):
        regex.check_user_pattern(pattern)


def test_like_text_doubles_stray_escapes():
    assert regex.like_text(r"a\b%\%\\") == r"a\\b%\%\\"


@pytest.mark.parametrize(
    "value, floor, passes",
    [
        ("err", "err", True), ("warning", "err", False), ("EMERG", "err", True), ("critical", "crit", True), ("debug", "info", False),
        ("error", "Error", True), ("weird", "err", True), ("info", "weird", True), ("info", "", True),
    ],
)
def test_severity_floor(spark, value, floor, passes):
    assert column(spark, severity.meets_floor(F.col("v"), floor), value) == [passes]


def test_severity_bucket_and_fold(spark):
    values = ["emerg", "alert", "Critical", "error", "warn", "notice", "debug", "odd"]
    assert column(spark, severity.bucket(F.col("v")), *values) == ["critical"] * 3 + ["error", "warning", "info", "info", "critical"]
    assert column(spark, severity.normalized(F.col("v")), *values) == ["emerg", "alert", "crit", "err", "warning", "notice", "debug", "odd"]


def test_timestamp_layouts(spark):
    stamps = [
        "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.678901234+02:00", "2024-01-02T03:04:05", "2024-01-02 03:04:05.5",
        "Jan  2 15:04:05", "Tue Jan  2 15:04:05 CET 2024", "2024-01-02", "", "2024-13-02T03:04:05Z", "Jan 32 15:04:05", "2024-01-02T25:00:00",
    ]
    micros = column(spark, F.unix_micros(clock.parse_timestamp(F.col("v"), clock.at("2024-01-03"))), *stamps)
    base = 1704164645_000000
    assert micros[:4] == [base, base - 7200_000000 + 678901, base, base + 500000]
    assert micros[4] == micros[5] == base + 12 * 3600_000000
    assert micros[6:] == [None] * 5


def test_zone_fallback():
    assert clock.known_zone("Europe/Warsaw") == "Europe/Warsaw"
    assert clock.known_zone("Mars/Olympus") == clock.known_zone("") == clock.known_zone("../etc") == "UTC"
    assert clock.unit_for("15m") == "minute" and clock.unit_for("nonsense") == "hour"


def test_csv_and_html(spark):
    values = ["=1+1", "+x", "-x", "@x", "\tx", "\rx", "x=", "", None]
    assert column(spark, text.csv_safe(F.col("v")), *values) == ["'=1+1", "'+x", "'-x", "'@x", "'\tx", "'\rx", "x=", "", None]
    assert column(spark, text.html_escape(F.col("v")), "<a href=\"x\">&'</a>") == ["&lt;a href=&#34;x&#34;&gt;&amp;&#39;&lt;/a&gt;"]


def test_snippet_counts_bytes(spark):
    got = column(spark, text.snippet(F.col("v"), 6), "abcdef", "abcdefg", "żżżż")
    assert got == ["abcdef", "abcdef...", "żżż..."]


def test_address_bytes(spark):
    got = column(spark, net.address_bytes(F.col("v")), "10.0.1.2", "255.255.255.255", "256.0.0.1", "1.2.3", "01.2.3.4", "::1", "")
    four = lambda n: bytes(10) + b"\xff\xff" + n.to_bytes(4, "big")
    assert [bytes(g) if g is not None else None for g in got] == [four(167772418), four(4294967295), None, None, None, bytes(15) + b"\1", None]
    merged = net.merged_ranges(["10.0.0.0/25", "10.0.0.128/25", "bad", "", " 10.0.2.1 ", "::1"])
    assert merged == [(bytes(15) + b"\1",) * 2, (four(167772160), four(167772415)), (four(167772673),) * 2]


@pytest.mark.parametrize(
    "query, hits",
    [
        ("connection", [0, 1]), ("connections failed", [0]), ('"connection failed"', [0]), ("failed or port", [0, 1]), ("connection -failed", [1]),
        ("the", []), ("10.0.0.7", [1]), ('-"connection failed" port', [1]), ("nothing", []), ('"failing over the port"', []),
        ('"port of the switch"', [1]), ("CONNECT or the", [0, 1]),
    ],
)
def test_search(spark, query, hits):
    texts = ["The connection failed twice", "connecting from 10.0.0.7 to the port of a switch"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    line = search.stemmed_line(F.col("v"))
    assert [r["i"] for r in df.filter(search.matches(line, query, stemming=True)).orderBy("i").collect()] == hits
    needed = search.necessary_text(F.col("v"), query)
    if needed is not None:
        assert set(hits) <= {r["i"] for r in df.filter(needed).collect()}


def test_stop_words_keep_positions(spark):
    df = spark.createDataFrame([("state of the art",), ("state art",)], "v string")
    line = search.stemmed_line(F.col("v"))
    assert [r["v"] for r in df.filter(search.matches(line, '"state of the art"', True)).collect()] == ["state of the art"]
    assert "of" in STOP_WORDS and df.select(search.stemmed_tokens(F.col("v")).alias("t")).first()["t"] == ["state", "art"]
