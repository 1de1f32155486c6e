"""Imports every query module, so that all queries are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import paging as paging_ops
from ..operators.filters import LogFilter, apply
from ..operators.parsing import field
from . import registry
from . import alerts, exports, filters, ingest, notifications, paging, parsing, rollups, streams  # noqa: F401
from .inputs import Inputs, plain
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest 100 firewall threat rows of a period with their addresses and action."""
    rules = registry.named("FortiGate Threat")
    wanted = LogFilter(start="2024-01-02T00:00:00", required_parsers=("FortiGate Threat",))
    page = paging_ops.page(apply(registry.parsed_logs(Inputs(spark, sf_dir), rules), wanted), 100)
    fields = [field(f).alias(f) for f in ("src_ip", "dst_ip", "action")]
    return plain(page.select("id", "timestamp", "hostname", "message", *fields))
