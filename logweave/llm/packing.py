"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram.

A document longer than a sequence is cut into whole sequences and a rest. Lengths are then placed
longest first, always into the packs with the most room left, as counts: a pack is a pattern of
lengths and the number of sequences that follow it. The driver sees the histogram only (at most one
count per length), never a document. Patterns come back to the pieces by rank: the r-th piece of a
length takes the r-th place the plan holds for that length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from .byte_bpe import encode, encoding
from .common import small_batches, stored

END_ID = 1
PIECE_COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, _split int, _at long"


@dataclass(frozen=True)
class Plan:
    """Places of all pieces, as runs of ranks.

    Run i holds the pieces of ``length[i]`` whose ranks start at ``rank[i]`` (up to the next run of
    that length); they lie at ``offset[i]`` of the sequences counted up from ``sequence[i]``.
    """

    size: int
    sequences: int
    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces given by length and rank."""
        run = np.searchsorted(self._keys(self.length, self.rank), self._keys(lengths, ranks), side="right") - 1
        return self.sequence[run] + ranks - self.rank[run], self.offset[run]

    @staticmethod
    def _keys(lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        return (lengths.astype(np.int64) << 40) | ranks.astype(np.int64)


def plan(histogram: dict[int, int], size: int) -> Plan:
    """Shortest-pack-first packing of ``histogram`` (length to count) into sequences of ``size``.

    Open packs wait in a heap, most room first. A block of equal packs takes one piece of a length
    at a time and goes back with less room, so all of its sequences keep one pattern; a block that
    is larger than the pieces left is split. Pieces that fit nowhere open as few new packs as can
    hold them. Work depends on the number of different lengths, not on the counts.
    """
    if any(length < 1 or length > size for length in histogram):
        raise ValueError("every length must lie between 1 and the sequence size")
    open_packs: list[tuple[int, int, int]] = []  # (-room, first sequence, number of sequences)
    runs: list[tuple[int, int, int, int]] = []
    sequences = 0
    for length in sorted(histogram, reverse=True):
        left, rank = int(histogram[length]), 0
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, first, count = heapq.heappop(open_packs)
                room = -room
            else:
                room, first, count = size, sequences, -(-left // (size // length))
                sequences += count
            taken = min(left, count)
            runs.append((length, rank, first, size - room))
            rank, left = rank + taken, left - taken
            if room > length:
                heapq.heappush(open_packs, (length - room, first, taken))
            if count > taken:
                heapq.heappush(open_packs, (-room, first + taken, count - taken))
    columns = np.array(sorted(runs), dtype=np.int64).reshape(-1, 4).T
    return Plan(size, sequences, *columns)


def cut(n_tokens: int, size: int) -> Iterator[tuple[int, int]]:
    """Start and length of a document's pieces: whole sequences, then the rest."""
    for start in range(0, n_tokens, size):
        yield start, min(size, n_tokens - start)


def pieces(docs: DataFrame, rank_file: str, pattern: str, size: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Token pieces of all documents, with the task that cut them and their place among that task's pieces of the length."""
    small_batches(docs.sparkSession, 256)
    id_field = docs.schema[id_col]
    out = T.StructType([T.StructField("doc_id", id_field.dataType)])
    for column in T.StructType.fromDDL(PIECE_COLUMNS + (", ids array<int>" if with_ids else "")).fields:
        out.add(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, seen = encoding(rank_file, pattern), np.zeros(size + 1, np.int64)
        split = TaskContext.get().partitionId()
        for batch in batches:
            row_of, rows, kept = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(enc, text) if text else np.zeros(0, np.int32), END_ID).astype("<i4")
                for start, length in cut(len(ids), size):
                    part = ids[start : start + length]
                    row_of.append(row)
                    rows.append((start, length, zlib.crc32(part.tobytes()), len(ids), split, seen[length]))
                    seen[length] += 1
                    if with_ids:
                        kept.append(part)
            if not rows:
                continue
            columns = [np.array(c, dtype=np.int64) for c in zip(*rows)]
            columns[4] = columns[4].astype(np.int32)
            arrays = [batch.column(0).take(pa.array(row_of)), *map(pa.array, columns)]
            if with_ids:
                arrays.append(pa.array(kept, type=pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, out)


def with_ranks(cut_up: DataFrame) -> DataFrame:
    """Add ``_rank``: gapless from 0 within each length.

    Tasks numbered their own pieces; here these numbers are shifted by the counts of the tasks before.
    A length that most pieces share is spread over as many groups as there were tasks.
    """
    counts = cut_up.groupBy("length", "_split").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return cut_up.join(offsets, ["length", "_split"]).withColumn("_rank", F.col("_before") + F.col("_at"))


def pack(
    docs: DataFrame, rank_file: str, pattern: str, size: int = 2048,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and ``END_ID``; a null or empty text is that id alone. Rows are never
    merged: repeated rows and null ids are documents of their own. Other columns are left out. An
    empty table gives no pieces. Sequence ids are gapless from 0, and pieces fill a sequence from
    offset 0 without gaps; what is left of ``size`` is padding. ``with_ids`` keeps each piece's ids.

    Pieces are tokenised once and written to the shared folder. The rank file must exist on every executor.
    """
    cut_up = stored(pieces(docs, rank_file, pattern, size, id_col, text_col, with_ids), "pieces")
    counts = cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``size`` rows
    placed = plan({r["length"]: r["n"] for r in counts}, size)

    @pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, offset = placed.find(lengths.to_numpy(), ranks.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    found = with_ranks(cut_up).withColumn("_place", place("length", "_rank"))
    kept = ["start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    return found.select(F.col("doc_id").alias(id_col), *kept, "_place.sequence_id", "_place.offset")


def assemble(packed: DataFrame, size: int = 2048, pad_id: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Whole training rows of pieces packed ``with_ids``: sequence_id, ids, segments, positions, n_pad.

    ``segments`` numbers the pieces of a sequence from 1 (0: padding) so that attention can stay
    inside a piece; ``positions`` counts within the document. A sequence holds at most ``size`` pieces.
    """
    piece = F.struct("offset", "length", "start", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.sum("length").alias("n"))
    pad = F.array_repeat(F.lit(pad_id), (F.lit(size) - F.col("n")).cast("int"))
    zeros = F.array_repeat(F.lit(0), (F.lit(size) - F.col("n")).cast("int"))
    numbered = F.transform("p", lambda x, i: F.array_repeat(i + 1, x["length"].cast("int")))
    places = F.transform("p", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1).cast("array<int>"))
    return rows.select(
        "sequence_id",
        F.concat(F.flatten(F.transform("p", lambda x: x["ids"])), pad).alias("ids"),
        F.concat(F.flatten(numbered), zeros).alias("segments"),
        F.concat(F.flatten(places), zeros).alias("positions"),
        (F.lit(size) - F.col("n")).cast("int").alias("n_pad"),
    )
