"""Field extraction with a rule library.

Each rule is evaluated in one regex pass: the message is rewritten to its captures, joined by
NUL (which stored text never contains), and only behind the rule's cheap selector. The hits
of a row then give both the ordered rule names and the merged field map.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock, regex
from ..sources import tables
from ..sources.library import Edition, Rule

_SEP = "\0"
# Between a field and its value; values may contain it, names may not.
_IS = "\1"
_MAX_FIELDS = 1_000_000


@dataclass(frozen=True)
class Target:
    """Columns rules look at."""

    hostname: str = "hostname"
    app_name: str = "app_name"
    message: str = "message"


def usable(spark, rules: list[Rule]) -> list[Rule]:
    """Enabled rules in id order whose pattern compiles."""
    ordered = sorted((r for r in rules if r.enabled), key=lambda r: r.id)
    java: list[str | None] = []
    for rule in ordered:
        try:
            java.append(regex.to_java(rule.regex))
        except ValueError:
            java.append(None)
    ok = iter(regex.compiles(spark, [p for p in java if p is not None]))
    return [rule for rule, pattern in zip(ordered, java) if pattern is not None and next(ok)]


def gate(rule: Rule, target: Target = Target()) -> Column:
    """Selector plus a plain test for text the pattern cannot match without."""
    literal = regex.required_literal(rule.regex)
    chosen = selector(rule, target)
    return chosen & F.contains(F.col(target.message), F.lit(literal)) if literal else chosen


def selector(rule: Rule, target: Target = Target()) -> Column:
    """Whether the rule looks at the row at all."""
    value = rule.match_value
    if rule.match_type == "all":
        return F.lit(True)
    if not value:
        return F.lit(False)
    if rule.match_type == "hostname":
        return regex.glob_match(F.col(target.hostname), value)
    if rule.match_type == "app_name":
        return (F.col(target.app_name) != "") & regex.glob_match(F.col(target.app_name), value)
    if rule.match_type == "message":
        return F.contains(F.col(target.message), F.lit(value))
    return F.lit(False)


def rule_matches(rule: Rule, target: Target = Target()) -> Column:
    """Selector and pattern both hit."""
    hit = F.col(target.message).rlike(regex.to_java(rule.regex))
    return F.coalesce(F.when(gate(rule, target), hit), F.lit(False))


def _fields_by_group(rule: Rule) -> list[tuple[int, str]]:
    """(group number, field name); surplus fields are dropped, a repeated name keeps its last group."""
    groups = regex.group_count(rule.regex)
    named = {name: i for i, name in enumerate(rule.field_names, start=1) if i <= groups}
    return [(group, name) for name, group in named.items()]


def capture_all(message: Column, pattern: str, replacement: str) -> Column:
    """The message rewritten to ``replacement`` in one pass, or left as it is when the pattern misses.

    The leading lazy run makes the rewrite land on the leftmost match, as a search would.
    """
    whole = f"(?s:^.*?)(?:{regex.to_java(pattern)})(?s:.*)\\z"
    return F.regexp_replace(message, whole, replacement)


def _quoted(text: str) -> str:
    """Text taken literally in a replacement."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _replacement(rule: Rule) -> str:
    """``NUL rule NUL field \\1 value NUL field \\1 value …``"""
    pairs = [f"{_SEP}{_quoted(name)}{_IS}${group}" for group, name in _fields_by_group(rule)]
    return _SEP + _quoted(rule.name) + "".join(pairs)


def _captures(rules: list[Rule], target: Target) -> Column:
    message = F.col(target.message)
    captures = [
        F.when(
            gate(rule, target),
            capture_all(message, rule.regex, _replacement(rule)),
        )
        for rule in rules
    ]
    return F.filter(F.array(*captures), lambda c: c.startswith(_SEP))


def parse(df: DataFrame, rules: list[Rule], target: Target = Target()) -> DataFrame:
    """Add ``parsed_fields`` (first rule wins per name) and ``matched_parsers`` (id order)."""
    kept = usable(df.sparkSession, rules)
    base = df.drop("parsed_fields", "matched_parsers")
    if not kept:
        return base.withColumns(
            {
                "parsed_fields": F.create_map().cast("map<string,string>"),
                "matched_parsers": F.array().cast("array<string>"),
            }
        )
    # The one-element generator keeps filters on the results above it: every pattern runs once
    # per row even when later conditions mention several extracted fields.
    tried = base.withColumn("_tried", _captures(kept, target)).select("*", F.explode(F.array("_tried")).alias("_hits"))
    merged = tried.withColumn("_text", _merged_text(F.col("_hits")))
    as_map = F.str_to_map("_text", F.lit(_SEP), F.lit(_IS))
    empty = F.create_map().cast("map<string,string>")
    return merged.withColumns(
        {
            "parsed_fields": F.when(F.col("_text") == "", empty).otherwise(as_map),
            "matched_parsers": F.transform("_hits", lambda hit: F.split_part(hit, F.lit(_SEP), F.lit(2))),
        }
    ).drop("_tried", "_hits", "_text")


def _merged_text(hits: Column) -> Column:
    """Field map of a row's hits as text, the earlier rule winning. Values hold no NUL, so this is exact.

    One hit, by far the usual case, cannot repeat a name and is taken as it is.
    """
    pairs = F.flatten(F.transform(hits, lambda hit: F.slice(F.split(hit, _SEP), F.lit(3), F.lit(_MAX_FIELDS))))
    first_of = lambda names: F.filter(
        pairs, lambda pair, i: F.array_position(names, F.substring_index(pair, _IS, 1)) == i + 1
    )
    names = F.transform(pairs, lambda pair: F.substring_index(pair, _IS, 1))
    kept = F.get(F.transform(F.array(names), first_of), 0)
    single = F.get(F.split(F.get(hits, 0), _SEP, 3), 2)
    text = F.when(F.size(hits) == 0, "").when(F.size(hits) == 1, single).otherwise(F.array_join(kept, _SEP))
    return F.coalesce(text, F.lit(""))


def owners(rules: list[Rule], fields: list[str]) -> list[Rule]:
    """Rules that capture any of the named fields."""
    wanted = set(fields)
    return [r for r in rules if wanted & set(r.field_names)]


def field(name: str, column: str = "parsed_fields") -> Column:
    """One extracted value, NULL when absent."""
    return F.try_element_at(F.col(column), F.lit(name))


def fields_text(column: str = "parsed_fields") -> Column:
    """The map as ``k=v`` pairs sorted by key, for output formats without maps."""
    pairs = F.transform(
        F.array_sort(F.map_keys(F.col(column))),
        lambda k: F.concat_ws("=", k, F.element_at(F.col(column), k)),
    )
    return F.concat_ws("|", pairs)


def parsers_text(column: str = "matched_parsers") -> Column:
    return F.concat_ws(",", F.col(column))


def test_pattern(df: DataFrame, pattern: str, column: str = "message") -> DataFrame:
    """Try one pattern over a sample: ``matched`` and the groups as ``group_0`` … in a map.

    A pattern without groups never reports a match. An invalid pattern raises ValueError.
    """
    groups = regex.group_count(pattern)
    if not regex.compiles(df.sparkSession, [regex.to_java(pattern)])[0]:
        raise ValueError("invalid regex")
    empty = F.create_map().cast("map<string,string>")
    if groups == 0:
        return df.withColumns({"matched": F.lit(False), "groups": empty})
    replacement = "".join(f"{_SEP}${i}" for i in range(1, groups + 1))
    tried = df.withColumn("_parts", F.split(capture_all(F.col(column), pattern, replacement), _SEP))
    hit = F.size("_parts") == groups + 1
    named = F.map_from_arrays(
        F.array(*[F.lit(f"group_{i}") for i in range(groups)]), F.slice("_parts", 2, groups)
    )
    return tried.withColumns({"matched": hit, "groups": F.when(hit, named).otherwise(empty)}).drop("_parts")


test_pattern.__test__ = False


def unparsed(logs: DataFrame) -> DataFrame:
    """Rows without extracted fields."""
    return logs.filter(F.col("parsed_fields").isNull() | (F.size("parsed_fields") == 0))


def reparse(
    logs: DataFrame,
    rules: list[Rule],
    device: str | None = None,
    start: Column | None = None,
    end: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Unparsed rows, parsed again; ``updated`` tells which of them now match a rule.

    ``limit`` takes the oldest rows first; without it every unparsed row is processed.
    """
    rows = unparsed(logs)
    if device:
        rows = rows.filter(F.coalesce("fromhost_ip", F.lit("")) == device)
    if start is not None:
        rows = rows.filter(F.col("timestamp") >= start)
    if end is not None:
        rows = rows.filter(F.col("timestamp") <= end)
    if limit:
        rows = rows.orderBy("timestamp", "id").limit(limit)
    return parse(rows, rules).withColumn("updated", F.size("matched_parsers") > 0)


def reparse_counts(reparsed: DataFrame) -> DataFrame:
    return reparsed.agg(F.count("*").alias("processed"), F.count_if("updated").alias("updated"))


def fields_for_devices(logs: DataFrame, registry: DataFrame, devices: list[str]) -> DataFrame:
    """Registry rows of the rules that have matched on the given devices (all rules when none are given)."""
    if not devices:
        return registry
    seen = (
        logs.filter(F.coalesce("fromhost_ip", F.lit("")).isin(*devices))
        .select(F.explode("matched_parsers").alias("parser_name"))
        .distinct()
    )
    return registry.join(seen, "parser_name", "left_semi").dropDuplicates(["parser_name", "field_name"])


def parsers_for_fields(registry: DataFrame, fields: list[str]) -> DataFrame:
    return registry.filter(F.col("field_name").isin(*fields)).select("parser_name").distinct()


def sync_diff(existing: DataFrame, library: DataFrame) -> DataFrame:
    """What a library sync would do: per name ``insert``, ``update`` or ``delete``.

    ``existing`` has (name, is_builtin); custom rules are never touched.
    """
    stored = existing.filter("is_builtin").select("name", F.lit(True).alias("stored"))
    shipped = library.select("name", F.lit(True).alias("shipped"))
    return stored.join(shipped, "name", "full_outer").select(
        "name",
        F.when(F.col("stored").isNull(), "insert").when(F.col("shipped").isNull(), "delete").otherwise("update").alias(
            "action"
        ),
    )


def parse_as_of(df: DataFrame, editions: list[Edition], target: Target = Target(), at: str = "timestamp") -> DataFrame:
    """Parse each row with the library edition that held at its time; adds ``library_edition`` as well.

    Rows before the first edition, or without a time, get no fields and a null edition. Each edition reads its range of
    time only, so on a table by day no file is read for editions that it lies outside of.
    """
    parts = []
    for i, edition in enumerate(editions):
        end = editions[i + 1].valid_from if i + 1 < len(editions) else None
        within = F.col(at) >= clock.at(edition.valid_from)
        if end is not None:
            within = within & (F.col(at) < clock.at(end))
        for bound in tables.day_bounds(df.columns, edition.valid_from, end) if at == "timestamp" else []:
            within = within & bound
        parts.append(parse(df.filter(within), list(edition.rules), target).withColumn("library_edition", F.lit(edition.number)))
    earlier = F.col(at).isNull() | (F.col(at) < clock.at(editions[0].valid_from)) if editions else F.lit(True)
    rest = parse(df.filter(earlier), [], target).withColumn("library_edition", F.lit(None).cast("int"))
    return reduce(DataFrame.unionByName, parts, rest)


def described(parsed: DataFrame, history: DataFrame, *keep: str) -> DataFrame:
    """One row per row and rule that matched it: the ``keep`` columns, edition, rule name, its description and fields as that edition has them.

    ``history`` is small (the rules of all editions); Spark broadcasts it by its size.
    """
    each = parsed.select(*keep, "library_edition", F.explode("matched_parsers").alias("name"))
    rules = history.select("library_edition", "name", "description", "fields").dropDuplicates(["library_edition", "name"])
    return each.join(rules, ["library_edition", "name"], "left")
