"""Exact removal of repeated byte strings by a sorted suffix index.

A byte goes if some ``length``-byte string over it also starts anywhere else. The suffixes that
can matter are found and sorted like this:

1. Each window of ``length`` bytes has a pivot: the least hash in its first three quarters. Windows
   with one pivot form a context. Equal windows have equal pivots, so a context whose bytes right
   after the pivot occur once in the corpus holds no repeated window; contexts that are equal as
   a whole are settled together. Both are counts of hashes, combined before the shuffle.
2. What is left are suffixes that share a beginning and differ later. Each task sorts its own into
   a run, front-codes it (length of the prefix shared with the entry before, then the rest) and
   sends the pieces of the run to the ranges they belong to. A range is merged by a loser tree
   that keeps the shared prefix of each loser with the last output, so no known prefix is
   compared again, and that yields the shared prefix of neighbours.
3. Neighbour prefixes to the right of the pivot, and those to its left, split the entries of a
   range into classes for each window offset; a window is repeated if its two classes have
   another member.

Groups of suffixes that share a beginning can hold a part of all documents. One with more than
``group_limit`` different members is cut into narrower contexts (with more shared bytes), which
are settled or sorted in the same way, down to single windows, which a count decides.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import small_batches, stored, without

GROUP_LIMIT = 20_000
RANGE_ROWS = 20_000
RUN_ROWS = 60_000
SEGMENT = 1 << 20
WIDTH_STEP = 16
_LOW = np.uint64(0xFFFFFFFF)

ROWS = "kh long, sh long, th long, nb long, pos long"


def _pack(low, width, shift):
    """First window, number of further windows, distance of the pivot: one long."""
    return (low << 32) | (width << 16) | shift


def _unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = pos >> 32
    return low, low + ((pos >> 16) & 0xFFFF), low + (pos & 0xFFFF)


def contexts(body: bytes, length: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pivot, first window, last window) of all contexts of a text, as arrays."""
    windows = len(body) - length + 1
    for begin in range(0, windows, SEGMENT):
        m = min(SEGMENT, windows - begin)
        size = m + reach - 1
        grams = np.ndarray((size,), np.uint64, buffer=body, offset=begin, strides=(1,))
        h = grams * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h &= ~_LOW
        h |= np.arange(size, dtype=np.uint64)
        blocks = np.full(-(-size // reach) * reach, np.uint64(2**64 - 1))
        blocks[:size] = h
        blocks = blocks.reshape(-1, reach)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        pivot = (np.minimum(behind[:m], ahead[reach - 1 : reach - 1 + m]) & _LOW).astype(np.int64)
        low = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]]))
        high = np.concatenate([low[1:], [m]]) - 1
        yield pivot[low] + begin, low + begin, high + begin


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _context_rows(docs: DataFrame, length: int) -> DataFrame:
    """A row for each context: hash of the bytes from the pivot, hash of the context, text key, place."""
    reach = length * 3 // 4
    key = length - reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            kh, sh, th, nb, pos = [], [], [], [], []
            for name, size, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                body = body.as_py()
                for pivots, lows, highs in contexts(body, length, reach):
                    for p, lo, hi in zip(pivots.tolist(), lows.tolist(), highs.tolist()):
                        kh.append(digest(body[p : p + key]))
                        sh.append(digest(body[lo : hi + length], p - lo))
                    pos.append(_pack(lows, highs - lows, pivots - lows))
                    th.append(np.full(len(lows), name, np.int64))
                    nb.append(np.full(len(lows), size, np.int64))
                    if len(kh) > 100_000:
                        yield _batch(kh, sh, th, nb, pos)
                        kh, sh, th, nb, pos = [], [], [], [], []
            if kh:
                yield _batch(kh, sh, th, nb, pos)

    return docs.filter(F.col("_nb") >= length).select("_th", "_nb", "_body").mapInArrow(run, ROWS)


def _batch(kh, sh, th, nb, pos) -> pa.RecordBatch:
    columns = [_signed(kh), _signed(sh), np.concatenate(th), np.concatenate(nb), np.concatenate(pos)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kh", "sh", "th", "nb", "pos"])


def _spans(rows: DataFrame, length: int) -> DataFrame:
    """Byte spans that wholly repeated contexts cover."""
    low = F.shiftright("pos", 32)
    width = F.shiftright("pos", 16).bitwiseAND(0xFFFF)
    return rows.select("th", "nb", low.alias("start"), (low + width + length).alias("stop"))


def _settle(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans of contexts that occur again as a whole, and one row (with ``twin``, ``members``) for each
    different context that shares its pivot bytes with a different one."""
    # Stored, so that both sides of the join are plain exchanges, which a hot beginning can be split in.
    shared = stored(rows.groupBy("kh").agg(F.count("*").alias("_n")).filter("_n > 1").select("kh"), "beginnings")
    likely = stored(rows.join(shared, "kh", "left_semi"), "likely")
    whole = likely.groupBy("kh", "sh").agg(F.count("*").alias("_n"), F.min(F.struct("th", "nb", "pos")).alias("_first"))
    whole = stored(whole.select("kh", "sh", (F.col("_n") > 1).alias("twin"), "_first.*"), "contexts")
    spans = _spans(likely.join(whole.filter("twin").select("kh", "sh"), ["kh", "sh"], "left_semi"), length)
    mixed = whole.groupBy("kh").agg(F.count("*").alias("members"), F.sum(F.when(F.col("twin"), 0).otherwise(1)).alias("_open"))
    mixed = stored(mixed.filter("members > 1 AND _open > 0").select("kh", "members"), "mixed")
    return spans, whole.join(mixed, "kh")


def _texts(docs: DataFrame) -> DataFrame:
    """Packed texts by key; a task gives equal texts once, so a text has at most as many rows here as there are tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, given = zstandard.ZstdCompressor(1), set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            first = [i for i, k in enumerate(keys) if k not in given and not given.add(k)]
            packed = [packer.compress(batch.column(2)[i].as_py()) for i in first]
            at = pa.array(first, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(packed, pa.binary())], names=["th", "nb", "_packed"])

    return docs.select("_th", "_nb", "_body").mapInArrow(run, "th long, nb long, _packed binary")


def _with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of a text collected beside its bytes, once for each text; as many as its length allows."""
    mine = rows.groupBy("th", "nb").agg(F.collect_list(F.struct("kh", "sh", "twin", "pos")).alias("rows"))
    return _texts(docs).join(mine, ["th", "nb"]).dropDuplicates(["th", "nb"])


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, the first ``known`` bytes of which are not looked at."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    odd = int.from_bytes(a[known:end], "big") ^ int.from_bytes(b[known:end], "big")
    return end - (odd.bit_length() + 7) // 8


def neighbour_prefixes(keys: list[bytes]) -> np.ndarray:
    """Common prefix of each sorted key with the one before; the first has none."""
    out = np.zeros(len(keys), np.int64)
    if len(keys) < 2:
        return out
    sizes = np.array([len(k) for k in keys])
    wide = int(sizes.max())
    for at in range(1, len(keys), 20_000):
        part = keys[at - 1 : at + 20_000]
        grid = np.frombuffer(b"".join(k.ljust(wide, b"\0") for k in part), np.uint8).reshape(len(part), wide) if wide else np.zeros((len(part), 0), np.uint8)
        odd = grid[1:] != grid[:-1]
        first = np.where(odd.any(axis=1), odd.argmax(axis=1), wide) if wide else np.zeros(len(part) - 1, np.int64)
        out[at : at + len(part) - 1] = np.minimum(first, np.minimum(sizes[at - 1 : at + len(part) - 2], sizes[at : at + len(part) - 1]))
    return out


def front_code(keys: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Sorted keys as shared prefix lengths and rests."""
    shared = neighbour_prefixes(keys)
    return shared, [k[s:] for k, s in zip(keys, shared.tolist())]


def front_decode(shared: np.ndarray, rests: list[bytes]) -> list[bytes]:
    keys, last = [], b""
    for s, rest in zip(shared.tolist(), rests):
        last = last[:s] + rest
        keys.append(last)
    return keys


def merge_runs(runs: list[tuple[list[bytes], np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge sorted runs (keys, prefixes shared with the key before) by a loser tree.

    Returns run number, place in the run and prefix shared with the output before, for each output.
    All prefixes in the tree are relative to the last output: the longer one belongs to the smaller
    key, and only equal ones make two keys be compared, from that length on.
    """
    total = sum(len(keys) for keys, _ in runs)
    of, at, prefix = np.zeros(total, np.int32), np.zeros(total, np.int64), np.zeros(total, np.int64)
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    keys = [k for k, _ in runs] + [[]] * (leaves - len(runs))
    shared = [s.tolist() for _, s in runs] + [[]] * (leaves - len(runs))
    place = [0] * leaves
    known = [0 if k else -1 for k in keys]  # -1: at its end, behind all others

    def first_of(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser keeps what it shares with the winner."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        x, y = keys[a][place[a]], keys[b][place[b]]
        same = _common(x, y, known[a])
        winner, loser = (a, b) if x[same : same + 1] <= y[same : same + 1] else (b, a)
        known[loser] = same
        return winner, loser

    losers = [0] * leaves
    level = list(range(leaves))
    node = leaves
    while len(level) > 1:
        node //= 2
        following = []
        for i in range(0, len(level), 2):
            winner, losers[node + i // 2] = first_of(level[i], level[i + 1])
            following.append(winner)
        level = following
    winner = level[0]
    for out in range(total):
        of[out], at[out], prefix[out] = winner, place[winner], known[winner]
        place[winner] += 1
        known[winner] = shared[winner][place[winner]] if place[winner] < len(keys[winner]) else -1
        node = (winner + leaves) // 2
        while node:
            rival = losers[node]
            if known[winner] < known[rival]:
                losers[node], winner = winner, rival
            elif known[winner] == known[rival]:
                winner, losers[node] = first_of(winner, rival)
            node //= 2
    return of, at, prefix


def _runs(texts: DataFrame, length: int, ranges: int) -> DataFrame:
    """Front-coded pieces of each task's sorted suffixes, by range."""

    def pieces(entries: list[tuple]) -> pd.DataFrame:
        entries.sort(key=lambda e: e[0])
        unique = [e for i, e in enumerate(entries) if i == 0 or e[0] != entries[i - 1][0] or e[2][1] != entries[i - 1][2][1]]
        ends = np.array([int.from_bytes(e[0][:8], "big") * ranges >> 64 for e in unique])
        out = []
        for part in np.unique(ends).tolist():
            own = [unique[i] for i in np.flatnonzero(ends == part)]
            shared, rests = front_code([e[0] for e in own])
            lefts = [e[1] for e in own]
            meta = np.array([e[2] for e in own], dtype=np.int64)
            sizes = np.array([[len(r), len(x)] for r, x in zip(rests, lefts)], dtype=np.int32)
            held = pickle.dumps((shared.astype(np.int32), sizes, b"".join(rests), b"".join(lefts), meta))
            out.append((part, zstandard.compress(held, 3)))
        return pd.DataFrame(out, columns=["part", "piece"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries: list[tuple] = []
        for batch in batches:
            for th, nb, packed, rows in zip(batch["th"], batch["nb"], batch["_packed"], batch["rows"]):
                body = zstandard.decompress(packed)
                for row in rows:
                    low, high, pivot = (int(x[0]) for x in _unpack(np.array([row["pos"]], np.int64)))
                    start = (row["kh"] & (2**64 - 1)).to_bytes(8, "big")
                    meta = (th, row["sh"], nb, low, high, pivot, row["twin"])
                    entries.append((start + body[pivot : high + length], body[low:pivot][::-1], meta))
                if len(entries) >= RUN_ROWS:
                    yield pieces(entries)
                    entries = []
        if entries:
            yield pieces(entries)

    return texts.mapInPandas(run, "part int, piece binary")


def repeated_windows(right: np.ndarray, left: np.ndarray, left_order: np.ndarray, least: np.ndarray, most: np.ndarray, length: int) -> np.ndarray:
    """For sorted entries, which windows (entry, offset of the pivot in it) another entry has too.

    right: prefix each entry shares with the one before, in order of the bytes after the pivot;
    left: the same for the reversed bytes before it, in left_order. Windows of an entry have
    offsets least to most.
    """
    n = len(right)
    found = np.zeros((n, int(most.max()) + 1 if n else 0), bool)
    for offset in range(found.shape[1]):
        own = np.flatnonzero((least <= offset) & (offset <= most))
        if len(own) < 2:
            continue
        after = np.cumsum(right < length - offset)
        before = np.empty(n, np.int64)
        before[left_order] = np.cumsum(left < offset)
        pair = after[own] * (n + 1) + before[own]
        order = np.argsort(pair, kind="stable")
        same = np.flatnonzero(pair[order][1:] == pair[order][:-1])
        hits = np.zeros(len(own), bool)
        hits[order[same]] = True
        hits[order[same + 1]] = True
        found[own[hits], offset] = True
    return found


def _range_spans(pieces: list[bytes], length: int) -> pd.DataFrame:
    runs, metas, lefts = [], [], []
    for piece in pieces:
        shared, sizes, rests, left, meta = pickle.loads(zstandard.decompress(piece))
        ends = np.cumsum(sizes, axis=0).tolist()
        starts = [[0, 0], *ends[:-1]]
        keys = front_decode(shared, [rests[a[0] : b[0]] for a, b in zip(starts, ends)])
        lefts.append([left[a[1] : b[1]] for a, b in zip(starts, ends)])
        runs.append((keys, shared))
        metas.append(meta)
    of, at, prefix = merge_runs(runs)
    starts = np.cumsum([0, *[len(m) for m in metas]])
    where = starts[of] + at
    meta = np.concatenate(metas)[where]
    # Copies of one context from different tasks are one entry.
    keep = np.ones(len(meta), bool)
    seen: dict[tuple[int, int], int] = {}
    flat = [k for keys, _ in runs for k in keys]
    heads = [flat[i][:8] for i in where.tolist()]
    for i, name in enumerate(zip(heads, meta[:, 1].tolist())):
        if seen.setdefault(name, i) != i:
            keep[i] = False
    del runs, flat
    # A dropped entry hands the shorter prefix on to the next one.
    shared, carried = [], None
    for p, k in zip(prefix.tolist(), keep.tolist()):
        carried = p if carried is None else min(carried, p)
        if k:
            shared.append(carried)
            carried = None
    meta, where = meta[keep], where[keep]
    flat_left = [x for part in lefts for x in part]
    left = [flat_left[i] for i in where.tolist()]
    left_order = np.array(sorted(range(len(left)), key=left.__getitem__), dtype=np.int64)
    left_shared = neighbour_prefixes([left[i] for i in left_order.tolist()])
    low, high, pivot = meta[:, 3], meta[:, 4], meta[:, 5]
    found = repeated_windows(np.array(shared) - 8, left_shared, left_order, pivot - high, pivot - low, length)
    found[meta[:, 6] == 1] = False
    edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    entry, first = np.nonzero(edges == 1)
    _, after = np.nonzero(edges == -1)
    # Offsets first to after - 1 are windows pivot - after + 1 to pivot - first.
    return pd.DataFrame(
        {"th": meta[entry, 0], "nb": meta[entry, 2], "start": pivot[entry] - after + 1, "stop": pivot[entry] - first + length}
    )


def _merged(rows: DataFrame, docs: DataFrame, length: int, count: int) -> DataFrame:
    """Spans of repeated windows among contexts that only share a part: the distributed merge sort."""
    ranges = max(1, -(-count // RANGE_ROWS))
    pieces = _runs(_with_text(rows, docs), length, ranges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = None, []
        for batch in batches:
            for number, piece in zip(batch["part"], batch["piece"]):
                if number != part and held:
                    yield _range_spans(held, length)
                    held = []
                part = number
                held.append(piece)
        if held:
            yield _range_spans(held, length)

    dealt = pieces.repartition(ranges, "part").sortWithinPartitions("part")
    return dealt.mapInPandas(run, "th long, nb long, start long, stop long")


def _narrowed(rows: DataFrame, docs: DataFrame, length: int, width: int) -> DataFrame:
    """The contexts again in parts of ``width`` windows, by the bytes all windows of a part share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for th, nb, packed, own in zip(batch["th"], batch["nb"], batch["_packed"], batch["rows"]):
                body = zstandard.decompress(packed)
                for row in own:
                    low, high, pivot = (int(x[0]) for x in _unpack(np.array([row["pos"]], np.int64)))
                    for part in range((pivot - high) // width, (pivot - low) // width + 1):
                        last = pivot - part * width
                        first = last - width + 1
                        lo, hi = max(first, low), min(last, high)
                        kh = digest(body[last : first + length], part * 2 + 1)
                        sh = digest(body[lo : hi + length], ((last - lo) << 16) + part)
                        twins = 2 if row["twin"] else 1  # a context that occurs again still counts as such
                        out += [(kh, sh, th, nb, _pack(lo, hi - lo, last - lo))] * twins
            frame = pd.DataFrame(out, columns=["kh", "sh", "th", "nb", "pos"])
            for name in ("kh", "sh"):
                frame[name] = _signed(frame[name].tolist())
            yield frame

    return _with_text(rows, docs).mapInPandas(run, ROWS)


def repeated_spans(docs: DataFrame, length: int, group_limit: int) -> DataFrame:
    """Spans (th, nb, start, stop) of all texts; they may overlap."""
    rows = stored(_context_rows(docs, length), "suffixes")
    width = length * 3 // 4
    found = None
    while True:
        spans, open_rows = _settle(rows, length)
        found = spans if found is None else found.unionByName(spans)
        open_rows = stored(open_rows, "open")
        counts = open_rows.groupBy((F.col("members") > group_limit).alias("hot")).count().collect()  # two rows
        sizes = {r["hot"]: r["count"] for r in counts}
        if sizes.get(False):
            found = found.unionByName(_merged(open_rows.filter(F.col("members") <= group_limit), docs, length, sizes[False]))
        if not sizes.get(True) or width == 1:  # single windows that share all their bytes are equal: none stays open
            return found
        width = max(1, width // WIDTH_STEP)
        rows = stored(_narrowed(open_rows.filter(F.col("members") > group_limit), docs, length, width), "narrowed")


def _pack_bodies(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    packer = zstandard.ZstdCompressor(1)
    for part in bodies:
        yield part.map(packer.compress)


def _cut_bodies(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for packed, starts, stops in parts:
        out = []
        for blob, first, last in zip(packed, starts, stops):
            body = zstandard.decompress(blob)
            if first is None or len(first) == 0:
                out.append((body, 0, 0))
                continue
            order = np.argsort(first, kind="stable")
            first, reach = np.asarray(first)[order], np.maximum.accumulate(np.asarray(last)[order])
            new = np.concatenate([[True], first[1:] > reach[:-1]])
            begins, ends = first[new].tolist(), reach[np.concatenate([new[1:], [True]])].tolist()
            kept = b"".join(body[a:b] for a, b in zip([0, *ends], [*begins, len(body)]))
            out.append((kept, len(body) - len(kept), len(begins)))
        yield pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Replace ``text_col`` by n_bytes, n_removed, n_spans and ``kept`` (binary): the bytes no repeated string covers.

    Texts are UTF-8 bytes, matches never cross texts, a null text counts as empty. Repeated rows
    are repeated texts: all of them lose everything of at least ``length`` bytes. Other columns
    stay; columns of the added names are replaced. ``length`` is 32 to 60,000.
    """
    if not 32 <= length <= 60_000:
        raise ValueError("length must be 32 to 60000")
    small_batches(docs.sparkSession, 256)
    kept = without(docs, "n_bytes", "n_removed", "n_spans", "kept", "_body", "_th", "_nb", "_packed")
    body: Column = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    keyed = kept.withColumn("_body", body).withColumns({"_th": F.xxhash64("_body"), "_nb": F.octet_length("_body").cast("long")}).drop(text_col)
    packed, cut_out = pandas_udf(_pack_bodies, "binary"), pandas_udf(_cut_bodies, "kept binary, n_removed long, n_spans long")
    spans = repeated_spans(keyed.select("_th", "_nb", "_body"), length, group_limit)
    mine = spans.groupBy(F.col("th").alias("_th"), F.col("nb").alias("_nb")).agg(F.collect_set(F.struct("start", "stop")).alias("_spans"))
    joined = keyed.withColumn("_packed", packed("_body")).drop("_body").join(mine, ["_th", "_nb"], "left")
    cut = joined.withColumn("_cut", cut_out("_packed", F.col("_spans.start"), F.col("_spans.stop")))
    rest = [F.col(f"`{c}`") for c in keyed.columns if c not in ("_body", "_th", "_nb")]
    return cut.select(*rest, F.col("_nb").alias("n_bytes"), "_cut.n_removed", "_cut.n_spans", "_cut.kept")
