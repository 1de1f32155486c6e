"""Full-text search: token lines and a compiler for web-style queries.

A *token line* is the text reduced to lower-case words separated, preceded and followed by
single spaces. One term is then a plain substring test and a phrase is a longer one, which
keeps unstemmed search entirely in built-in expressions. With stemming the line is mapped
word by word in an Arrow UDF; tables that are searched often should store that line
(:func:`stemmed_line`) at ingest, as ``search_line``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .stem import STOP_WORDS, stem

_WORD = r"[\p{L}\p{N}]+"
_SEPARATOR = r"[^\p{L}\p{N}]+"
_QUERY_PART = re.compile(r'(-?)(?:"([^"]*)"?|([^\s"]+))')
_GAP = "_"


def token_line(text: Column) -> Column:
    """Lower-case words of the whole text, space-framed."""
    words = F.trim(F.regexp_replace(F.lower(text), _SEPARATOR, " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def tokens(text: Column, keep_stop_words: bool = False) -> Column:
    """Words in order as an array, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    return words if keep_stop_words else without_stop_words(words)


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*sorted(STOP_WORDS)))


@F.pandas_udf(T.StringType())
def _stem_line(lines: pd.Series) -> pd.Series:
    def one(line: str | None) -> str | None:
        if line is None:
            return None
        return " ".join(_GAP if w in STOP_WORDS else stem(w) for w in line.split(" "))

    return lines.map(one)


@F.pandas_udf(T.StringType())
def _stem_word(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def stemmed_word(word: Column) -> Column:
    """The stem of a single lower-case word; meant for distinct words."""
    return _stem_word(word)


def stemmed_line(text: Column) -> Column:
    """Token line with every word stemmed; stop words leave a gap that keeps positions."""
    return _stem_line(token_line(text))


def stemmed_tokens(text: Column) -> Column:
    return F.filter(F.split(F.trim(stemmed_line(text)), " "), lambda w: (w != "") & (w != _GAP))


def message_text(message: Column, raw_message: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(message, F.lit("")), F.coalesce(raw_message, F.lit("")))


def _query_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def parse_query(query: str) -> list[list[tuple[bool, list[str]]]]:
    """OR-ed groups of AND-ed (negated, words) terms. Several words mean adjacency.

    Stop words inside a phrase stay as ``None``-like gaps; terms made of stop words only vanish.
    """
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for sign, phrase, word in _QUERY_PART.findall(query):
        if word.lower() == "or" and not sign and not phrase:
            groups.append([])
            continue
        words = _query_words(phrase or word)
        if any(w not in STOP_WORDS for w in words):
            while words[0] in STOP_WORDS:
                words = words[1:]
            while words[-1] in STOP_WORDS:
                words = words[:-1]
            groups[-1].append((sign == "-", words))
    return [g for g in groups if g]


def _term(line: Column, words: list[str], stemming: bool) -> Column:
    shaped = [None if w in STOP_WORDS else (stem(w) if stemming else w) for w in words]
    if None not in shaped:
        return F.contains(line, F.lit(" " + " ".join(shaped) + " "))
    body = " ".join(r"\S+" if w is None else re.escape(w) for w in shaped)
    return line.rlike(f" {body} ")


def matches(line: Column, query: str, stemming: bool) -> Column:
    """Predicate over a token line (stemmed or not). A query of stop words matches nothing."""
    return _combined(query, lambda words: _term(line, words, stemming))


def matches_forms(line: Column, query: str, forms: dict[str, list[str]]) -> Column:
    """The stemmed search over an unstemmed token line, given all words of the rows that share a stem with the query."""

    def term(words: list[str]) -> Column:
        known = [None if w in STOP_WORDS else sorted(forms.get(stem(w), ())) for w in words]
        if [] in known:
            return F.lit(False)
        body = " ".join(r"\S+" if k is None else "(?:" + "|".join(map(re.escape, k)) + ")" for k in known)
        return line.rlike(f" {body} ")

    return _combined(query, term)


def _combined(query: str, term: Callable[[list[str]], Column]) -> Column:
    groups = parse_query(query)
    if not groups:
        return F.lit(False)
    clauses = []
    for group in groups:
        terms = [~term(words) if neg else term(words) for neg, words in group]
        clauses.append(reduce(lambda a, b: a & b, terms))
    return reduce(lambda a, b: a | b, clauses)


def needed_stems(query: str) -> list[tuple[list[str], list[str]]]:
    """(stems a match has to have, all stems) of each OR-ed group."""
    groups = []
    for group in parse_query(query):
        stems = [(neg, stem(w)) for neg, words in group for w in words if w not in STOP_WORDS]
        groups.append((sorted({s for neg, s in stems if not neg}), sorted({s for _, s in stems})))
    return groups


def necessary_text(text: Column, query: str) -> Column | None:
    """A cheap test every stemmed match passes, evaluated before any row reaches Python.

    No stemming rule changes more than the last two characters it keeps, so a stem without
    them is a prefix of some word of the text. NULL (no test) when nothing can be required.
    """
    lowered = F.lower(text)
    clauses = []
    for group in parse_query(query):
        prefixes = [
            stem(w)[:-2] for neg, words in group if not neg for w in words if w not in STOP_WORDS
        ]
        prefixes = [p for p in prefixes if len(p) >= 2]
        if not prefixes:
            return None
        clauses.append(reduce(lambda a, b: a & b, [F.contains(lowered, F.lit(p)) for p in prefixes]))
    return reduce(lambda a, b: a | b, clauses) if clauses else None
