import collections
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from logweave.llm import byte_bpe, packing

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, length string, sequence_id string, _split string, ids string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def slow_plan(histogram, size):
    """Shortest-pack-first one piece at a time, as sequences of lengths."""
    packs = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((size - sum(p) for p in packs), default=-1)
            fits = [p for p in packs if size - sum(p) == room] if room >= length else []
            if not fits:
                fits = [[] for _ in range(-(-left // (size // length)))]
                packs += fits
            for p in fits[:left]:
                p.append(length)
            left -= min(left, len(fits))
    return collections.Counter(tuple(p) for p in packs)


def plan_patterns(plan, histogram):
    held = collections.defaultdict(list)
    for length, n in histogram.items():
        sequences, offsets = plan.find(np.full(n, length), np.arange(n))
        for s, o in zip(sequences.tolist(), offsets.tolist()):
            held[s].append((o, length))
    assert sorted(held) == list(range(plan.sequences))
    for s, pieces in held.items():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= plan.size
    return collections.Counter(tuple(length for _, length in sorted(p)) for p in held.values())


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=25), st.integers(40, 50))
def test_plan_equals_placing_one_by_one(histogram, size):
    assert plan_patterns(packing.plan(histogram, size), histogram) == slow_plan(histogram, size)


def test_plan_does_not_grow_with_the_counts():
    shape = {length: int(10_000 / length) + 1 for length in range(1, 2049)}
    small, large = packing.plan(shape, 2048), packing.plan({k: v * 1_000_000 for k, v in shape.items()}, 2048)
    assert len(large.rank) < 4 * len(small.rank) + 10_000
    tokens = sum(k * v * 1_000_000 for k, v in shape.items())
    assert tokens <= large.sequences * 2048 < tokens * 1.001
    assert packing.plan({}, 8).sequences == 0
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def texts():
    words = "pack the shortest pack first über 東京 😀 12 345 don't \n\n  <|endoftext|> x".split(" ")
    rng = np.random.default_rng(7)
    out = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 60, 150)]
    return out + ["", None, "word " * 9000, "a" * 50_000, " " * 30_000 + "b", "<|endoftext|>", "same text"] + ["same text"] * 200


def test_pieces_hold_every_id_once(spark, tokenizer):
    rows = [(i, t, "mine", "s", "q", "z") for i, t in enumerate(texts())] + [(None, "nameless", "m", "s", "q", "z")] * 2 + [(3, "again", "m", "s", "q", "z")] * 2
    packed = packing.pack(spark.createDataFrame(rows, DOCS).repartition(5), RANKS, public_tokenizers.PATTERN, 64, with_ids=True)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]
    got = packed.collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        for start in range(0, len(ids), 64):
            part = ids[start : start + 64]
            want[i, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids), tuple(part)] += 1
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], tuple(r["ids"])) for r in got) == want
    filled = collections.defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(filled) == list(range(len(filled)))
    for pieces in filled.values():
        ends = np.cumsum([0] + [length for _, length in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == ends[:-1].tolist() and ends[-1] <= 64
    total = sum(r["length"] for r in got)
    assert total / (len(filled) * 64) > 0.98

    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append(r)
    for row in packing.assemble(packed, 64, pad_id=9).collect():
        pieces = sorted(by_sequence[row["sequence_id"]], key=lambda r: r["offset"])
        ids = [i for p in pieces for i in p["ids"]]
        assert row["ids"] == ids + [9] * (64 - len(ids)) and row["n_pad"] == 64 - len(ids)
        assert row["segments"] == [k + 1 for k, p in enumerate(pieces) for _ in p["ids"]] + [0] * row["n_pad"]
        assert row["positions"] == [p["start"] + k for p in pieces for k in range(p["length"])] + [0] * row["n_pad"]


def test_empty_table_and_ranks(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), RANKS, public_tokenizers.PATTERN).count() == 0
    docs = spark.createDataFrame([(i, "same", *"abcd") for i in range(500)], DOCS).repartition(7)
    packed = packing.pack(docs, RANKS, public_tokenizers.PATTERN, 64)
    assert packed.select("sequence_id", "offset").distinct().count() == 500
    assert packed.agg(F.countDistinct("sequence_id")).head()[0] == -(-500 // 32)


def test_same_ids_as_the_tokenizers_library(spark, tokenizer):
    enc = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    have = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text in [t or "" for t in texts() + have]:
        assert byte_bpe.encode(enc, text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
