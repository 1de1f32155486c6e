"""The composable log filter: every set option adds one AND-ed condition."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema
from ..functions import clock, net, regex, search
from ..sources.tables import day_bounds

UNKNOWN_DEVICE = "__unknown__"

_FIELD_NAME = re.compile(r"[a-zA-Z0-9_]+\Z")
# Alternative operator spellings.
_OPERATOR_ALIASES = {"": "eq", "not_in": "notin", "starts_with": "startswith", "ends_with": "endswith"}
# Beyond this many ranges an allow list is joined instead of becoming part of the predicate.
MAX_INLINE_RANGES = 200
MAX_BROADCAST_RANGES = 200_000


@dataclass(frozen=True)
class FieldFilter:
    field: str
    operator: str = "eq"
    values: tuple[str, ...] = ()
    numeric: bool = False


@dataclass(frozen=True)
class LogFilter:
    hostname: str = ""
    fromhost_ip: str = ""
    severity: str = ""
    app_name: str = ""
    search: str = ""
    start: dt.datetime | str | None = None
    end: dt.datetime | str | None = None
    devices: tuple[str, ...] = ()
    has_fields: bool = False
    required_parsers: tuple[str, ...] = ()
    field_filters: tuple[FieldFilter, ...] = ()
    stemming: bool = True


@dataclass(frozen=True)
class Scope:
    """Rows a caller may see at all."""

    hostnames: tuple[str, ...] = ()
    severities: tuple[str, ...] = ()
    match_mode: str = "and"


def _device() -> Column:
    return F.coalesce("fromhost_ip", F.lit(""))


def field_condition(ff: FieldFilter) -> Column | None:
    """One field filter, or None when it is to be ignored."""
    if ff.field in schema.FILTERABLE_COLUMNS:
        value = F.col(ff.field)
    elif _FIELD_NAME.match(ff.field):
        value = F.try_element_at(F.col("parsed_fields"), F.lit(ff.field))
    else:
        return None
    operator = _OPERATOR_ALIASES.get(ff.operator, ff.operator)
    if operator == "is_empty":
        return value.isNull() | (value == "")
    if operator == "is_not_empty":
        return value.isNotNull() & (value != "")
    if not ff.values:
        return None
    first = ff.values[0]
    like = regex.like_text(first)
    if operator in ("gt", "gte", "lt", "lte"):
        left, right = value, F.lit(first)
        if ff.numeric:
            left, right = value.try_cast("double"), F.lit(first).try_cast("double")
        return {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[operator]
    if operator == "neq":
        return value != first
    if operator == "contains":
        return value.ilike(f"%{like}%")
    if operator == "not_contains":
        return ~value.ilike(f"%{like}%")
    if operator == "in":
        return value.isin(*ff.values)
    if operator == "notin":
        return ~value.isin(*ff.values)
    if operator == "startswith":
        return value.ilike(f"{like}%")
    if operator == "endswith":
        return value.ilike(f"%{like}")
    if operator == "regex":
        return value.rlike(regex.check_user_pattern(first))
    return value == first


def conditions(flt: LogFilter, columns: list[str]) -> list[Column]:
    """Cheap, prunable conditions first: Spark keeps their order within a filter."""
    out: list[Column] = day_bounds(columns, flt.start or None, flt.end or None)
    if flt.start is not None and flt.start != "":
        out.append(F.col("timestamp") >= clock.at(flt.start))
    if flt.end is not None and flt.end != "":
        out.append(F.col("timestamp") <= clock.at(flt.end))
    if flt.hostname:
        out.append(F.col("hostname") == flt.hostname)
    if flt.fromhost_ip == UNKNOWN_DEVICE:
        out.append(F.col("fromhost_ip").isNull() | (F.col("fromhost_ip") == ""))
    elif flt.fromhost_ip:
        # Same rows as comparing the coalesced key, in a form parquet can push down.
        out.append(F.col("fromhost_ip") == flt.fromhost_ip)
    if flt.severity:
        out.append(F.col("severity") == flt.severity)
    if flt.devices:
        out.append(_in_devices(flt.devices))
    if flt.has_fields:
        out.append(F.coalesce(F.size("matched_parsers") > 0, F.lit(False)))
    if flt.required_parsers:
        out.append(F.arrays_overlap("matched_parsers", F.array(*[F.lit(p) for p in flt.required_parsers])))
    if flt.app_name:
        out.append(F.col("app_name").ilike(f"%{regex.like_text(flt.app_name)}%"))
    out += [c for c in map(field_condition, flt.field_filters) if c is not None]
    if flt.search:
        out += search_conditions(flt.search, columns, flt.stemming)
    return out


def _in_devices(devices: tuple[str, ...]) -> Column:
    named = F.col("fromhost_ip").isin(*devices)
    return named | F.col("fromhost_ip").isNull() if "" in devices else named


def search_conditions(query: str, columns: list[str], stemming: bool) -> list[Column]:
    """Use the stored ``search_line`` when there is one, else build the line on the fly."""
    if "search_line" in columns:
        return [search.matches(F.col("search_line"), query, stemming=True)]
    raw = F.col("raw_message") if "raw_message" in columns else F.lit("")
    whole = search.message_text(F.col("message"), raw)
    if not stemming:
        return [search.matches(search.token_line(whole), query, stemming=False)]
    needed = search.necessary_text(whole, query)
    stemmed = search.matches(search.stemmed_line(whole), query, stemming=True)
    return ([needed] if needed is not None else []) + [stemmed]


def apply(logs: DataFrame, flt: LogFilter) -> DataFrame:
    conds = conditions(flt, logs.columns)
    return logs.filter(reduce(lambda a, b: a & b, conds)) if conds else logs


def restrict(logs: DataFrame, scope: Scope) -> DataFrame:
    """Apply a caller's scope on top of whatever was filtered before."""
    conds = []
    if scope.hostnames:
        conds.append(F.col("hostname").isin(*scope.hostnames))
    if scope.severities:
        conds.append(F.col("severity").isin(*scope.severities))
    if not conds:
        return logs
    join = (lambda a, b: a | b) if scope.match_mode == "or" else (lambda a, b: a & b)
    return logs.filter(reduce(join, conds))


def allowed_addresses(logs: DataFrame, entries: list[str], column: str = "fromhost_ip") -> DataFrame:
    """Rows whose address lies in the allow list (IPv4 and IPv6 addresses and CIDR ranges).

    Short lists become a predicate. Longer ones become a join: ranges are disjoint, so the only
    one that can hold an address is the last one that starts at or before it. Rows and ranges
    meet by the address's first two bytes that differ between networks (the first half of an IPv4 address, the
    first 16 bits of an IPv6 one), to which every range is first cut.
    """
    ranges = net.merged_ranges(entries)
    address = net.address_bytes(F.col(column))
    if not ranges:
        return logs.filter(F.lit(False))
    if len(ranges) <= MAX_INLINE_RANGES:
        return logs.filter(net.in_ranges(address, ranges))
    spark = logs.sparkSession
    pieces = [(key, lo, hi) for lo, hi in ranges for key in _pieces(lo, hi)]
    spans = spark.createDataFrame(pieces, "_key string, _lo binary, _hi binary")
    if len(pieces) <= MAX_BROADCAST_RANGES:
        spans = F.broadcast(spans)
    key = F.when(F.hex("_ip").startswith(_MAPPED_HEX), F.substring(F.hex("_ip"), 1, 28)).otherwise(F.substring(F.hex("_ip"), 1, 4))
    rows = logs.withColumn("_ip", address).withColumn("_row_key", key)
    hit = (F.col("_row_key") == F.col("_key")) & F.col("_ip").between(F.col("_lo"), F.col("_hi"))
    return rows.join(spans, hit, "left_semi").drop("_ip", "_row_key")


_MAPPED_HEX = "0" * 20 + "FFFF"


def _pieces(lo: bytes, hi: bytes) -> list[str]:
    """Row keys that addresses of a range can have."""
    first, last = lo.hex().upper(), hi.hex().upper()
    if first.startswith(_MAPPED_HEX) and last.startswith(_MAPPED_HEX):
        return [f"{_MAPPED_HEX}{n:04X}" for n in range(int(first[24:28], 16), int(last[24:28], 16) + 1)]
    keys = [f"{n:04X}" for n in range(int(first[:4], 16), int(last[:4], 16) + 1)]
    # A range of IPv6 that spans the place of IPv4 addresses holds all of those it covers.
    if first <= _MAPPED_HEX + "F" * 8 and last >= _MAPPED_HEX + "0" * 8:
        low, high = max(first, _MAPPED_HEX + "0" * 8), min(last, _MAPPED_HEX + "F" * 8)
        keys += [f"{_MAPPED_HEX}{n:04X}" for n in range(int(low[24:28], 16), int(high[24:28], 16) + 1)]
    return keys
