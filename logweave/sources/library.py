"""Extraction-rule libraries: folders of JSON files, the built-in one among them.

A file is an array of rules. A field without a label gets one from its name, one without a type is a string.
The files in ``rules`` are fixed values: names, selectors, patterns (RE2 syntax), field names and labels
belong to the stored data format and must not change. Ids follow file names, then positions.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import schema
from ..functions import clock
from . import versions

# Words of field names that a label does not simply capitalise.
LABEL_WORDS = {
    "ap": "AP",
    "dst": "Destination",
    "id": "ID",
    "iface": "Interface",
    "ip": "IP",
    "isp": "ISP",
    "len": "Length",
    "mac": "MAC",
    "msg": "Message",
    "newlogon": "New Logon",
    "proto": "Protocol",
    "rdp": "RDP",
    "rssi": "RSSI",
    "sid": "SID",
    "sla": "SLA",
    "src": "Source",
    "ssid": "SSID",
    "tty": "TTY",
    "uid": "UID",
    "unifi": "UniFi",
    "utc": "UTC",
    "utm": "UTM",
    "ver": "Version",
    "vlan": "VLAN",
    "wan": "WAN",
    "wifi": "WiFi",
}


@dataclass(frozen=True)
class Rule:
    """One extraction rule; ``fields`` are (name, label, type) in group order."""

    id: int
    name: str
    match_type: str
    match_value: str | None
    regex: str
    fields: tuple[tuple[str, str, str], ...]
    device_type: str = "custom"
    enabled: bool = True
    is_builtin: bool = False
    description: str = ""

    @property
    def field_names(self) -> list[str]:
        return [f[0] for f in self.fields]


def label_for(name: str) -> str:
    return " ".join(LABEL_WORDS.get(w, w.capitalize()) for w in name.split("_"))


def label_column(name: Column) -> Column:
    """:func:`label_for` as an expression."""
    words = F.create_map(*[F.lit(x) for pair in LABEL_WORDS.items() for x in pair])
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.coalesce(F.try_element_at(words, w), F.initcap(w))), " ")


def builtin_files() -> dict[str, str]:
    """The built-in library's files by name."""
    folder = resources.files(__package__) / "rules"
    return {f.name: f.read_text("utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".json")}


def builtin_rules() -> list[Rule]:
    """The built-in library."""
    items = [item for content in builtin_files().values() for item in json.loads(content)]
    return [
        Rule(
            id=rule_id,
            name=item["name"],
            device_type=item["device_type"],
            match_type=item["match_type"],
            match_value=item["match_value"] or None,
            regex=item["regex"],
            fields=tuple((f["name"], f.get("label") or label_for(f["name"]), f.get("type") or "string") for f in item["fields"]),
            is_builtin=True,
            description=item["description"],
        )
        for rule_id, item in enumerate(items, start=1)
    ]


def write_files(spark: SparkSession, folder: str, files: dict[str, str]) -> None:
    """Put rule files into a folder of any file system Spark knows."""
    for name, content in files.items():
        fs, where = versions.file_system(spark, f"{folder}/{name}")
        out = fs.create(where, True)
        try:
            out.write(bytearray(content, "utf-8"))
        finally:
            out.close()


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A rule list as a small table."""
    rows = [
        (
            r.id,
            r.name,
            r.device_type,
            r.match_type,
            r.match_value,
            r.regex,
            [{"name": n, "label": l, "type": t} for n, l, t in r.fields],
            r.description,
        )
        for r in rules
    ]
    return spark.createDataFrame(rows, schema.RULE_LIBRARY)


def read_library(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Read ``*.json`` rule files. Returns (rules, files that could not be read).

    Ids follow file-name order, then position in the file's array. A malformed file is
    reported and skipped; the others load.
    """
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    item = "struct<name:string,description:string,device_type:string,match_type:string,match_value:string,regex:string,fields:%s>" % (
        schema.FIELDS.simpleString()
    )
    parsed = files.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"),
        F.from_json("value", f"array<{item}>", {"allowSingleQuotes": "false"}).alias("items"),
    )
    errors = parsed.filter(F.col("items").isNull()).select("file", F.lit("not a JSON array of rules").alias("error"))
    exploded = parsed.select("file", F.posexplode("items").alias("pos", "r"))
    # A rule library is metadata: a few hundred rows, so one global ordering is cheap.
    ordered = Window.orderBy("file", "pos")
    rules = exploded.select(
        F.row_number().over(ordered).cast("long").alias("id"),
        "r.name",
        "r.device_type",
        "r.match_type",
        F.nullif("r.match_value", F.lit("")).alias("match_value"),
        "r.regex",
        F.transform(F.coalesce("r.fields", F.array().cast(schema.FIELDS)), _completed).alias("fields"),
        F.coalesce("r.description", F.lit("")).alias("description"),
    )
    return rules, errors


def _completed(field: Column) -> Column:
    given = lambda part: F.nullif(field[part], F.lit(""))
    return F.struct(
        field["name"].alias("name"),
        F.coalesce(given("label"), label_column(field["name"])).alias("label"),
        F.coalesce(given("type"), F.lit("string")).alias("type"),
    )


def collect_rules(library: DataFrame) -> list[Rule]:
    """Bring a rule table to the driver, where it becomes part of the plan."""
    has = set(library.columns)
    return [
        Rule(
            id=r["id"],
            name=r["name"],
            device_type=r["device_type"],
            match_type=r["match_type"],
            match_value=r["match_value"],
            regex=r["regex"],
            fields=tuple((f["name"], f["label"], f["type"]) for f in r["fields"]),
            enabled=bool(r["enabled"]) if "enabled" in has else True,
            is_builtin=bool(r["is_builtin"]) if "is_builtin" in has else False,
            description=(r["description"] or "") if "description" in has else "",
        )
        for r in library.orderBy("id").collect()
    ]


def field_registry(library: DataFrame) -> DataFrame:
    """One row per (rule, field)."""
    return library.select(
        F.col("id").alias("parser_id"),
        F.col("name").alias("parser_name"),
        "device_type",
        F.posexplode("fields").alias("pos", "f"),
    ).select(
        "parser_id",
        "parser_name",
        "device_type",
        "pos",
        F.col("f.name").alias("field_name"),
        F.col("f.label").alias("field_label"),
        F.col("f.type").alias("field_type"),
    )


@dataclass(frozen=True)
class Edition:
    """A library that holds from a time on, until the next edition does."""

    number: int
    valid_from: dt.datetime
    rules: tuple[Rule, ...]


def record_edition(spark: SparkSession, path: str, rules: list[Rule], valid_from: dt.datetime | str) -> int:
    """Keep a library as the edition that holds from ``valid_from`` on; returns its number.

    A library equal to the newest edition makes none. Editions follow each other in time.
    """
    if not rules:
        raise ValueError("an edition needs a rule")
    known = editions(spark, path)
    start = clock.as_datetime(valid_from)
    if known and list(known[-1].rules) == sorted(rules, key=lambda r: r.id):
        return known[-1].number
    if known and start <= known[-1].valid_from:
        raise ValueError(f"edition {known[-1].number} holds from {known[-1].valid_from} on")
    number = known[-1].number + 1 if known else 0
    flags = spark.createDataFrame([(r.id, r.enabled, r.is_builtin) for r in rules], "id long, enabled boolean, is_builtin boolean")
    table = rules_frame(spark, rules).join(flags, "id").withColumns({"library_edition": F.lit(number), "valid_from": clock.at(start)})
    return versions.write(table.coalesce(1), path, number)


def edition_history(spark: SparkSession, path: str) -> DataFrame:
    """The rules of all editions, with ``library_edition`` and ``valid_from``."""
    return spark.read.parquet(*[f"{path}/v{v}" for v in versions.versions(spark, path)])


def editions(spark: SparkSession, path: str) -> list[Edition]:
    """All editions, oldest first; a few hundred rules each, which become part of plans."""
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    found = []
    for number in versions.versions(spark, path):
        table = spark.read.parquet(f"{path}/v{number}")
        start_us = table.agg(F.unix_micros(F.min("valid_from"))).first()[0]
        # An edition without rules has no row that tells its time; record_edition refuses it.
        found.append(Edition(number, epoch + dt.timedelta(microseconds=start_us), tuple(collect_rules(table))))
    return found
