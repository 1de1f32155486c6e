"""Exact Jaccard join of documents on word shingles, with set-relation skipping.

Sets meet by their prefixes: if shingles are ordered from rare to common, linked sets share one of
their first few. How many sets hold a shingle is counted exactly, in buckets of shingles. As most
shingles stand in one text only, a set's prefix seldom reaches those it shares with others, unless
it is largely made of them. Sets that share a prefix shingle form groups, which over-estimate the
classes a little. A group's sets are sent to one task once, or in pairs of blocks if it is large,
and joined there:

* Index skipping: shingles of a group are ordered by frequency; lists of the rare ones (the
  prefixes) hold entries by position in relation to size, and a probe stops in a list where no
  later entry can reach the overlap that is needed. What texts of one template share stands behind
  that place, so templates cost nothing.
* Answer skipping: once the overlaps of a set with all others are known, those of a set that
  differs from it little follow from the lists of the few shingles they differ in.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import ASCII_LOWER, BLANK_WORDS, small_batches, stored
from .components import components

BLOCK_SHINGLES = 250_000
FETCH_BYTES = 4 << 20
# Text for each bucket of shingles, and shingles that a task deals out at once.
BUCKET_BYTES = 8 << 20
DEAL_SHINGLES = 1 << 19
# Shingles of a dealt row before the next set begins a new one, and those of a bucket looked at together.
ROW_SHINGLES = 1 << 11
PART_SHINGLES = 1 << 17
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; remembers the hashes of words."""

    def __init__(self, words: int, remember: int = 30_000):
        self.words, self.remember = words, remember
        self.known: dict[bytes, int] = {}

    def __call__(self, body: bytes) -> np.ndarray:
        words = BLANK_WORDS.findall(body.translate(ASCII_LOWER))
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.remember:
            known.clear()
        for word in set(words):
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.array([known[w] for w in words], np.uint64)
        span = min(self.words, len(hashes))
        count = len(hashes) - span + 1
        total = np.full(count, np.uint64(span))
        for i in range(span):
            total = _mix(total * _A + hashes[i : i + count])
        return np.unique(total)


def deal(sets: list[tuple[int, np.ndarray]], buckets: int) -> Iterator[tuple]:
    """Shingles of (name, shingles) by bucket: bucket, names, shingles of each name (as bytes if they are few), the shingles as 32 bits.

    A bucket gets several rows if they are many, so that a batch of rows stays small; a set stands in one of them.
    Two shingles of a bucket may get the same 32 bits. They then count as one shingle, for every
    set alike, which can only bring sets together that need not meet.
    """
    names = np.array([name for name, _ in sets], np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for _, s in sets])
    h = _mix(np.concatenate([s for _, s in sets]) ^ _A)
    bucket = (h >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, token, owner = bucket[order], (h[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), owner[order]
    begins = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])]))
    cut = (np.diff(bucket[begins]) != 0) | (np.diff(begins // ROW_SHINGLES) != 0)
    edges = np.concatenate([[0], begins[1:][cut], [len(owner)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own = owner[a:b]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts = np.diff(np.append(first, b - a))
        yield int(bucket[a]), names[own[first]].tobytes(), counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes(), token[a:b].tobytes()


def shared_tokens(bucket: int, rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the rows dealt to a bucket: names and tokens of the shingles that several sets hold, in parts.

    A token orders shingles from rare to common: its upper bits are the number of sets (65,535 at most).
    A part has all entries of its shingles.
    """
    names = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
    counts = np.concatenate([np.frombuffer(r[1], np.uint8 if len(r[1]) * 8 == len(r[0]) else np.uint32).astype(np.int64) for r in rows])
    tokens = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
    once = np.zeros(len(names), bool)
    once[np.unique(names, return_index=True)[1]] = True  # several tasks may have given a set
    owner = np.repeat(np.arange(len(names), dtype=np.int32), counts)
    if not once.all():
        mine = once[owner]
        owner, tokens = owner[mine], tokens[mine]
    parts = -(-len(tokens) // PART_SHINGLES)
    limits = [(i << 32) // parts for i in range(parts + 1)]
    for low, high in zip(limits[:-1], limits[1:]):
        own = np.flatnonzero((tokens >= low) & (tokens < high))
        names_of, ordered = _several(bucket, owner[own], tokens[own])
        if len(ordered):
            yield names[names_of], ordered


def _several(bucket: int, owner: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and token of the entries whose shingle has others."""
    order = np.argsort(tokens, kind="stable")
    edges = np.flatnonzero(np.diff(tokens[order], prepend=np.uint32(0)) != 0)
    edges = np.unique(np.concatenate([[0], edges, [len(order)]]))
    runs = np.diff(edges)
    several = np.repeat(runs > 1, runs)
    held, order = np.repeat(runs[runs > 1], runs[runs > 1]), order[several]
    place = _mix((np.uint64(bucket) << np.uint64(32)) ^ tokens[order].astype(np.uint64)) >> np.uint64(17)
    ordered = (np.minimum(held, 65_535).astype(np.uint64) << np.uint64(47)) | place
    by_set = np.argsort(owner[order], kind="stable")
    return owner[order][by_set], ordered[by_set].view(np.int64)


def _set_rows(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """Rows of two kinds: per document its set's size and hash, and per bucket the shingles of a task's sets.

    A task deals out equal sets once, so a set with any number of copies counts as often as there are tasks.
    """
    kind = dict(docs.dtypes)["_doc"]
    blobs = ["names", "counts", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, given, pending, held = Shingler(words), set(), [], 0

        def dealt() -> pa.RecordBatch:
            bucket, *parts = zip(*deal(pending, buckets))
            n = len(bucket)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(bucket, pa.int64()), *(pa.array(p, pa.binary()) for p in parts)],
                names=["_doc", "_th", "n_shingles", "sid", "bucket", *blobs],
            )

        for batch in batches:
            id_type = batch.column(0).type
            sizes, names = [], []
            for body in batch.column("_body"):
                shingles = shingler(body.as_py())
                name = xxhash.xxh3_64_intdigest(shingles.tobytes()) if len(shingles) else 0
                sizes.append(len(shingles))
                names.append(name)
                if len(shingles) and name not in given:
                    given.add(name)
                    pending.append((name, shingles))
                    held += len(shingles)
                if held > DEAL_SHINGLES:
                    yield dealt()
                    pending, held = [], 0
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(np.array(names, np.uint64).view(np.int64)), pa.nulls(n, pa.int64()), *(pa.nulls(n, pa.binary()) for _ in blobs)],
                names=["_doc", "_th", "n_shingles", "sid", "bucket", *blobs],
            )
        if pending:
            yield dealt()

    schema = f"_doc {kind}, _th long, n_shingles long, sid long, bucket long, names binary, counts binary, tokens binary"
    return docs.select("_doc", "_th", "_body").mapInArrow(run, schema)


def _prefix_length(n: Column, percent: int) -> Column:
    """So many of its rarest shingles hold one of any linked set's."""
    low = F.floor((n * percent + 99) / 100)
    return n - F.ceil((n + low) * percent / (100 + percent)) + 1


def _ties(dealt: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(sid, token) for each shingle in the prefix of a set that other sets hold too; ``sizes`` has sid and n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[pd.DataFrame]:
            for names, tokens in shared_tokens(at, held):
                yield pd.DataFrame({"sid": names.view(np.int64), "token": tokens})

        at, held = None, []
        for batch in batches:
            for bucket, *blobs in batch.itertuples(index=False):
                if bucket != at and held:
                    yield from found()
                    held = []
                at = bucket
                held.append(blobs)
        if held:
            yield from found()

    sorted_rows = dealt.repartition("bucket").sortWithinPartitions("bucket")
    shared = sorted_rows.mapInPandas(run, "sid long, token long")
    sets = shared.groupBy("sid").agg(F.collect_list("token").alias("tokens")).join(sizes, "sid")  # n tokens at most
    # Shingles of no other set come first.
    left = (_prefix_length(F.col("n"), percent) - (F.col("n") - F.size("tokens"))).cast("int")
    reached = sets.withColumn("_left", left).filter("_left > 0")
    return reached.select("sid", F.explode(F.slice(F.array_sort("tokens"), F.lit(1), F.col("_left"))).alias("token"))


def needed(a, b, percent: int):
    """Least intersection with which sets of sizes a and b link."""
    return -(-(a + b) * percent // (100 + percent))


def join_sets(sets: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of a group the sets it links with; sets of different sides only, unless all have side 0.

    ``sets`` are sorted arrays in order of size. Yields (set, linked sets) for sets that have any.
    """
    count = len(sets)
    cross = bool(side.any())
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, ids, frequency = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(frequency), np.int64)
    rank[np.argsort(frequency, kind="stable")] = np.arange(len(frequency))
    ids = rank[ids]
    edges = np.cumsum([0, *sizes])
    ordered = [np.sort(ids[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    flat, owner = np.concatenate(ordered), np.repeat(np.arange(count), sizes)
    position = np.arange(len(flat)) - np.repeat(edges[:-1], sizes)
    # Whole lists, by shingle, and those of prefixes with their entries by depth.
    by_shingle = np.argsort(flat, kind="stable")
    lists, starts = owner[by_shingle], np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(frequency)))])
    short = position <= sizes[owner] - needed(sizes[owner], -(-sizes[owner] * percent // 100), percent)
    # An entry whose first shared shingle this is can give a probe of n shingles enough only if depth <= -n * percent.
    depth = position * (100 + percent) - 100 * sizes[owner]
    of_prefix = np.flatnonzero(short)[np.lexsort((depth[short], flat[short]))]
    prefix_owner, prefix_depth = owner[of_prefix], depth[of_prefix]
    prefix_starts = np.concatenate([[0], np.cumsum(np.bincount(flat[of_prefix], minlength=len(frequency)))])

    def candidates(i: int) -> np.ndarray:
        """Sets of which a first shared shingle leaves enough behind it in both."""
        n = sizes[i]
        low, high = -(-n * percent // 100), n * 100 // percent
        found = []
        for at in range(n - needed(n, low, percent) + 1):
            shingle = ordered[i][at]
            a, b = prefix_starts[shingle], prefix_starts[shingle + 1]
            if b - a < 2:
                continue
            b = a + np.searchsorted(prefix_depth[a:b], -n * percent, side="right")
            if a == b:
                continue
            other = prefix_owner[a:b]
            size = sizes[other]
            fits = (size >= low) & (size <= min(high, (100 * n - at * (100 + percent)) // percent)) & (other != i)
            if cross:
                fits &= side[other] != side[i]
            found.append(other[fits])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def tally(shingles: np.ndarray) -> np.ndarray:
        if not len(shingles):
            return np.zeros(count, np.int64)
        return np.bincount(np.concatenate([lists[starts[s] : starts[s + 1]] for s in shingles.tolist()]), minlength=count)

    def verified(i: int, others: np.ndarray) -> np.ndarray:
        """Those of a few candidates that are linked."""
        present[ordered[i]] = True
        overlap = np.array([np.count_nonzero(present[ordered[j]]) for j in others.tolist()])
        present[ordered[i]] = False
        return others[100 * overlap >= percent * (sizes[others] + sizes[i] - overlap)]

    present = np.zeros(len(frequency), bool)
    lengths = np.diff(starts)
    answered = np.zeros(count, bool)
    for begin in range(count):
        if answered[begin]:
            continue
        answered[begin] = True
        found = candidates(begin)
        if not len(found):
            continue
        if sizes[found].sum() < lengths[ordered[begin]].sum():
            answers = verified(begin, found)
            if len(answers):
                yield begin, answers
            continue
        at, overlap = begin, tally(ordered[begin])
        while True:
            linked = 100 * overlap >= percent * (sizes + sizes[at] - overlap)
            linked[at] = False
            near = np.flatnonzero(linked & ~answered)
            answers = np.flatnonzero(linked & (side != side[at])) if cross else np.flatnonzero(linked)
            if len(answers):
                yield at, answers
            if not len(near):
                break
            following = int(near[np.argmax(overlap[near] * 2 - sizes[near])])
            gone = np.setdiff1d(ordered[at], ordered[following], assume_unique=True)
            come = np.setdiff1d(ordered[following], ordered[at], assume_unique=True)
            if len(gone) + len(come) < len(ordered[following]):
                overlap = overlap - tally(gone) + tally(come)
            else:
                overlap = tally(ordered[following])
            at = following
            answered[at] = True


def _group_links(group: list[tuple], percent: int) -> Iterator[tuple[int, int, int]]:
    """(set, least set it is joined to here, weight of its links) for the sets of a group that have links."""
    group = sorted({(g[0], g[3]): g for g in group}.values(), key=lambda g: (len(g[2]), g[0]))  # repeated rows once
    sets, side = [g[2] for g in group], np.array([g[3] for g in group])
    names, weights = [g[0] for g in group], np.array([g[1] for g in group])
    parent = list(range(len(group)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    linked: dict[int, int] = {}
    for i, others in join_sets(sets, side, percent):
        linked[i] = int(weights[others].sum())
        for j in others.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    for i, weight in linked.items():
        yield names[i], names[root(i)], weight


def _worth(key: tuple | None, group: list[tuple]) -> bool:
    """Two sets at least; of two different blocks, both must be there, as each meets its own sets elsewhere."""
    return len(group) > 1 and (key[1] == key[2] or len({g[3] for g in group}) == 2)


def _links(members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links of all sets (sid, n_shingles, weight, _doc, _th, root, blocks) with others of their group."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, names = Shingler(words), ["root", "a", "b", "side", "sid", "weight", "shingles"]
        for batch in batches:
            out, held = [], 0
            for packed, sid, root, blocks, weight in zip(batch["_packed"], batch["sid"], batch["root"], batch["blocks"], batch["weight"]):
                shingles = shingler(zstandard.decompress(packed)).tobytes()
                mine = sid % blocks
                for other in range(blocks):
                    a, b = min(mine, other), max(mine, other)
                    out.append((root, a, b, int(mine == b and a != b), sid, weight, shingles))
                    held += len(shingles)
                    if held > FETCH_BYTES:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group, out = None, [], []
        names = ["u", "v", "links"]
        for batch in batches:
            for root, a, b, side, sid, weight, shingles in batch.itertuples(index=False):
                if (root, a, b) != key:
                    out += _group_links(group, percent) if _worth(key, group) else ()
                    key, group = (root, a, b), []
                    if len(out) > 20_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                group.append((sid, weight, np.frombuffer(shingles, np.uint64), side))
        out += _group_links(group, percent) if _worth(key, group) else ()
        if out:
            yield pd.DataFrame(out, columns=names)

    texts = docs.select("_doc", "_th", "_packed")
    mine = texts.join(members, texts["_doc"].eqNullSafe(members["_doc"]) & (texts["_th"] == members["_th"]))
    once = mine.select("sid", "root", "blocks", "weight", "_packed")
    dealt = once.mapInPandas(fetch, "root long, a long, b long, side int, sid long, weight long, shingles binary")
    grouped = dealt.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")
    return grouped.mapInPandas(join, "u long, v long, links long")


def join(docs: DataFrame, percent: int = 90, words: int = 3, id_col: str = "doc_id", text_col: str = "text",
         block_shingles: int = BLOCK_SHINGLES, key_col: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every row.

    Rows link when 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles;
    a text of fewer words is one shingle, one without words (or null) links with nothing and is
    its own component. component_id is the least id reachable, n_links the number of other rows
    linked. Rows of one id and text are one document. Other columns are ignored;
    ``key_col`` names a column for the hash of each row's text.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    small_batches(docs.sparkSession, 256)
    packer = pandas_udf(_pack_bodies, "binary")
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    light = docs.select(F.col(id_col).alias("_doc"), body.alias("_body")).withColumn("_th", F.xxhash64("_body"))
    volume = light.agg(F.sum(F.octet_length("_body"))).first()[0] or 0
    made = stored(_set_rows(light, words, -(-volume // bucket_bytes) or 1), "sets")
    rows = made.filter("bucket IS NULL").select("_doc", "_th", "n_shingles", "sid")

    # Groups are an over-estimate of the classes: every set with the least one that shares a prefix shingle.
    # Stored, so that both sides of the join are plain exchanges, which a hot shingle can be split in.
    sizes = rows.filter("n_shingles > 0").select("sid", F.col("n_shingles").alias("n")).distinct()
    ties = stored(_ties(made.filter("bucket IS NOT NULL").select("bucket", "names", "counts", "tokens"), sizes, percent), "ties")
    heads = ties.groupBy("token").agg(F.min("sid").alias("head"), F.max("sid").alias("_last")).filter("head < _last")
    edges = ties.join(heads.select("token", "head"), "token").filter("sid <> head")
    edges = edges.select(F.col("sid").alias("u"), F.col("head").alias("v")).distinct()
    groups = components(edges)

    sets = rows.filter("n_shingles > 0").groupBy("sid", "n_shingles").agg(F.count("*").alias("weight"), F.min(F.struct("_doc", "_th")).alias("_one"))
    placed = sets.join(groups, sets["sid"] == groups["node"]).select("sid", "n_shingles", "weight", "_one.*", "root")
    sizes = placed.groupBy("root").agg(F.ceil(F.sum("n_shingles") / F.lit(block_shingles)).cast("long").alias("blocks"))
    members = placed.drop("n_shingles").join(sizes, "root")
    links = stored(_links(members, light.withColumn("_packed", packer("_body")), words, percent), "links")

    classes = components(links.select("u", "v"))
    counts = links.groupBy(F.col("u").alias("sid")).agg(F.sum("links").alias("links"))
    copies = sets.groupBy("sid").agg(F.sum("weight").alias("weight"))
    slim = rows.select("_doc", "_th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("sid")).alias("sid"))
    known = (
        slim.join(classes.withColumnRenamed("node", "sid"), "sid", "left")
        .join(counts, "sid", "left")
        .join(copies, "sid", "left")
        .withColumn("_class", F.coalesce("root", "sid"))
    )
    known = stored(known, "classes")
    # Stored, so that a large class can be split in the join.
    least = stored(known.filter("_class IS NOT NULL").groupBy("_class").agg(F.min("_doc").alias("_least")), "least")
    return known.join(least, "_class", "left").select(
        F.col("_doc").alias(id_col),
        "n_shingles",
        F.when(F.col("_class").isNull(), F.col("_doc")).otherwise(F.col("_least")).alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).cast("long").alias("n_links"),
        *([F.col("_th").alias(key_col)] if key_col else []),
    )


def _pack_bodies(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    packer = zstandard.ZstdCompressor(1)
    for part in bodies:
        yield part.map(packer.compress)
