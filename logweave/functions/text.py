"""Text clean-up and escaping as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Characters spreadsheets read as the start of a formula.
FORMULA_LEADS = ("=", "+", "-", "@", "\t", "\r")

# HTML entities, ampersand first.
HTML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"))


def sanitize(value: Column) -> Column:
    """Repair invalid UTF-8 and strip NUL characters."""
    return F.replace(F.make_valid_utf8(value), F.lit("\0"), F.lit(""))


def first_filled(*values: Column) -> Column:
    """First value that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def csv_safe(value: Column) -> Column:
    """Defuse values a spreadsheet would run as a formula."""
    return F.when(F.substring(value, 1, 1).isin(*FORMULA_LEADS), F.concat(F.lit("'"), value)).otherwise(value)


def html_escape(value: Column) -> Column:
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), HTML_ENTITIES, value)


def snippet(value: Column, limit: int = 500) -> Column:
    """The first ``limit`` bytes, marked with dots when something was cut.

    A multi-byte character straddling the limit is cut as a whole-character repair mark,
    because text columns hold valid UTF-8 only.
    """
    raw = F.encode(value, "UTF-8")
    cut = F.make_valid_utf8(F.substring(raw, 1, limit).cast("string"))
    return F.when(F.octet_length(value) > limit, F.concat(cut, F.lit("..."))).otherwise(value)
