"""Saved queries: a stored filter plus the extracted fields to show."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..sources.library import Rule
from . import filters, parsing

# Columns of a saved-query page.
BASE_COLUMNS = ("id", "timestamp", "hostname", "fromhost_ip", "app_name", "severity", "facility", "message")


@dataclass(frozen=True)
class SavedQuery:
    name: str = ""
    devices: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    severity: str = ""
    start: str | None = None
    end: str | None = None
    search: str = ""
    field_filters: tuple[filters.FieldFilter, ...] = ()

    @classmethod
    def from_json(cls, text: str, name: str = "") -> SavedQuery:
        """Read the stored form: ``{devices, fields, filters: {severity, from, to, search, field_filters}}``."""
        raw = json.loads(text)
        flt = raw.get("filters") or {}
        return cls(
            name=name,
            devices=tuple(raw.get("devices") or ()),
            fields=tuple(raw.get("fields") or ()),
            severity=flt.get("severity") or "",
            start=flt.get("from") or None,
            end=flt.get("to") or None,
            search=flt.get("search") or "",
            field_filters=read_field_filters(flt.get("field_filters") or []),
        )


@dataclass(frozen=True)
class Override:
    """What a request may change about a saved query; empty values change nothing."""

    severity: str = ""
    start: str | None = None
    end: str | None = None
    search: str = ""
    fromhost_ip: str = ""
    field_filters: str = ""


def read_field_filters(items: list[dict]) -> tuple[filters.FieldFilter, ...]:
    return tuple(
        filters.FieldFilter(i.get("field", ""), i.get("operator", ""), tuple(i.get("values") or ())) for i in items
    )


def resolve(saved: SavedQuery, rules: list[Rule], override: Override = Override()) -> filters.LogFilter:
    """Merge request and stored filter into one."""
    chosen = saved.field_filters
    if override.field_filters:
        try:
            chosen = read_field_filters(json.loads(override.field_filters)) or chosen
        except (ValueError, AttributeError, TypeError):
            pass
    devices = saved.devices
    if override.fromhost_ip and (not devices or override.fromhost_ip in devices):
        devices = (override.fromhost_ip,)
    return filters.LogFilter(
        severity=override.severity or saved.severity,
        start=override.start or saved.start,
        end=override.end or saved.end,
        search=override.search or saved.search,
        devices=devices,
        required_parsers=tuple(r.name for r in parsing.owners(rules, list(saved.fields))),
        field_filters=chosen,
    )


def run(logs: DataFrame, saved: SavedQuery, rules: list[Rule], override: Override = Override()) -> DataFrame:
    """Filtered rows with one column per selected field."""
    rows = filters.apply(logs, resolve(saved, rules, override))
    base = [c for c in BASE_COLUMNS if c in rows.columns]
    return rows.select(*base, *[parsing.field(f).alias(f) for f in saved.fields])
