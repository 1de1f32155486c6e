"""Benchmark decontamination by suffix arrays of the training texts.

Every task builds suffix arrays over shards of its texts, as word sequences, and binary-searches each
suffix of every benchmark item in them, which gives the longest verbatim match of that suffix and
all its places. Matches of at least a window mark the words they cover.

A word no benchmark item has cannot be part of a match. Suffixes start only where enough words of
the benchmark follow one another, so the arrays stay small while the search covers all positions.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import ASCII_LOWER, small_batches, without

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHARD_WORDS = 1 << 18
KEY_WORDS = 64
BLOCK_BYTES = 16 << 20


def words_of(body: bytes) -> list[bytes]:
    return WORDS.findall(body.translate(ASCII_LOWER))


class Searcher:
    """Benchmark items as word numbers. A suffix is an item and a place in it: no suffix is held as text of its own."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.names: list[str] = []
        self.items: list[np.ndarray] = []
        for name, body in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(body)]
            if ids:
                self.names.append(name)
                self.items.append(np.array(ids, np.int32))
        #: A match counts from this many words on: a window, or a whole shorter item.
        self.needed = [min(window, len(i)) for i in self.items]
        self.least = min(self.needed, default=0)
        # Word numbers in byte order, so that bytes compare like words.
        self.raw = [self.key(item) for item in self.items]
        self.key_words = max(KEY_WORDS, window)

    @staticmethod
    def key(ids: np.ndarray) -> bytes:
        return ids.astype(">u4").tobytes()

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, 0) for w in words), np.int32, len(words))

    def shard(self, texts: list[np.ndarray]) -> tuple[list[bytes], list[int], np.ndarray]:
        """Suffix array of concatenated texts: sorted suffixes (their first words), their starts, the words."""
        gap = np.zeros(1, np.int32)  # texts are parted by a word that matches nothing
        stream = np.concatenate([x for t in texts for x in (t, gap)])
        known = np.concatenate([[0], np.cumsum(stream > 0)])
        ends = np.minimum(np.arange(len(stream)) + self.least, len(stream))
        starts = np.flatnonzero(known[ends] - known[:-1] == self.least)
        raw = stream.astype(">u4").tobytes()
        # Each suffix ends before the next unknown word, or after KEY_WORDS words.
        stops = np.flatnonzero(stream == 0)
        until = np.minimum(stops[np.searchsorted(stops, starts)], starts + self.key_words)
        order = sorted(zip((raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), until.tolist())), starts.tolist()))
        return [k for k, _ in order], [s for _, s in order], stream

    def matches(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(start in the shard, words matched, item, start in the item) of the longest match of every test suffix at every place."""
        keys, starts, stream = self.shard(texts)
        if not keys:
            return
        for item, (raw, whole, needed) in enumerate(zip(self.raw, self.items, self.needed)):
            before: dict[int, int] = {}  # matches of the suffix one word longer, by start
            for at in range(len(whole) - needed + 1):
                found: dict[int, int] = {}
                suffix = raw[4 * at : 4 * (at + self.key_words)]
                short = suffix[: 4 * needed]
                first = bisect_left(keys, short)
                while first < len(keys) and keys[first].startswith(short):
                    key, begin = keys[first], starts[first]
                    # What the longer suffix matched from one word earlier is known to match.
                    same = max(needed, before.get(begin - 1, 0) - 1)
                    while 4 * same < min(len(key), len(suffix)) and key[4 * same : 4 * same + 4] == suffix[4 * same : 4 * same + 4]:
                        same += 1
                    if 4 * same >= len(key):
                        while at + same < len(whole) and stream[begin + same] == whole[at + same]:
                            same += 1
                    found[begin] = same
                    yield begin, same, item, at
                    first += 1
                before = found


def _search(searcher: Searcher, bodies: list[bytes]) -> list[tuple]:
    """(words, hit, items, longest, starts, stops) of each text; spans are word positions."""
    out: list[tuple] = []
    held: list[np.ndarray] = []

    def flush() -> None:
        edges = np.cumsum([0, *[len(t) + 1 for t in held]])
        marks = [np.zeros(len(t) + 1, np.int32) for t in held]
        found: list[set[str]] = [set() for _ in held]
        longest = [0] * len(held)
        if searcher.least:
            for start, same, item, _ in searcher.matches(held):
                text = int(np.searchsorted(edges, start, side="right")) - 1
                at = start - int(edges[text])
                marks[text][at] += 1
                marks[text][at + same] -= 1
                found[text].add(searcher.names[item])
                longest[text] = max(longest[text], same)
        for words, mark, names, most in zip(held, marks, found, longest):
            hit = np.concatenate([[0], (np.cumsum(mark[:-1]) > 0).astype(np.int8), [0]])
            turns = np.diff(hit)
            begins, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
            out.append((len(words), int(hit.sum()), sorted(names), most, begins.tolist(), ends.tolist()))
        held.clear()

    size = 0
    for body in bodies:
        numbers = searcher.numbers(words_of(body))
        held.append(numbers)
        size += len(numbers)
        if size > SHARD_WORDS:
            flush()
            size = 0
    if held:
        flush()
    return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of bounded size, whatever its own size; items stream through the driver."""
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).cast("binary").alias("body"))
    for row in rows.filter("body IS NOT NULL").toLocalIterator():
        held.append((row["name"], bytes(row["body"])))
        size += len(held[-1][1]) + 64
        if size > limit:
            yield held
            held, size = [], 0
    if held or size == 0:
        yield held


FOUND = ["n_words", "n_hit", "items", "longest", "hit_starts", "hit_stops"]


_built: list = []  # the items, the window and the searcher this worker made last


def _searcher(items: list[tuple[str, bytes]], window: int) -> Searcher:
    """One searcher for all tasks that a worker runs over the same block."""
    if not (_built and _built[0] is items and _built[1] == window):
        _built[:] = [items, window, Searcher(items, window)]
    return _built[2]


def _first_pass(sent, window: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        searcher = _searcher(sent.value, window)
        for bodies in batches:
            yield pd.DataFrame(_search(searcher, list(bodies)), columns=FOUND)

    return run


def _further_pass(sent, window: int):
    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        searcher = _searcher(sent.value, window)
        for bodies, was in batches:
            now = pd.DataFrame(_search(searcher, list(bodies)), columns=FOUND)
            yield pd.DataFrame([_merge(a, b) for a, b in zip(was.itertuples(index=False), now.itertuples(index=False))], columns=FOUND)

    return run


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_words, n_hit, items (names in order), longest (words), hit_starts, hit_stops and contaminated.

    Words are lower-cased in A-Z only. An item of fewer than ``window`` words counts as a whole; items without
    words and null texts have none. All documents are searched in one pass per block of the
    benchmark (``block_bytes`` of text), without a shuffle; a block's hits are merged into the
    row, so any number of blocks gives the same result. Columns of the added names are replaced.
    """
    small_batches(docs.sparkSession, 512)
    added = [*FOUND, "contaminated"]
    schema = "n_words long, n_hit long, items array<string>, longest long, hit_starts array<long>, hit_stops array<long>"
    kept = without(docs, *added, "_hits", "_was")
    columns = [F.col(f"`{c}`") for c in kept.columns]
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    marked = None
    for block in blocks(benchmark, item_col, item_text, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)  # block_bytes at most

        if marked is None:
            marked = kept.withColumn("_hits", pandas_udf(_first_pass(sent, window), schema)(body))
        else:
            marked = marked.withColumn("_was", F.col("_hits")).withColumn("_hits", pandas_udf(_further_pass(sent, window), schema)(body, F.col("_was"))).drop("_was")
    found = [F.col(f"_hits.{n}").alias(n) for n in FOUND]
    return marked.select(*columns, *found, (F.col("_hits.n_hit") > 0).alias("contaminated"))


def _merge(a, b) -> tuple:
    """Two results of one text as one."""
    edges = sorted([*zip(a.hit_starts, a.hit_stops), *zip(b.hit_starts, b.hit_stops)])
    spans: list[list[int]] = []
    for start, stop in edges:
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
        else:
            spans.append([start, stop])
    names = sorted({*a.items, *b.items})
    return a.n_words, sum(y - x for x, y in spans), names, max(a.longest, b.longest), [x for x, _ in spans], [y for _, y in spans]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` without any hit."""
    return mark(docs, benchmark, window).filter(~F.col("contaminated")).select(*docs.columns)
