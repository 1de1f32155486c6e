import random
import re

import pytest

from logweave.llm import decontaminate
from logweave.llm.common import ASCII_LOWER

DOCS = "doc_id long, text string, items string, n_hit string"


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(ASCII_LOWER))


def brute(text, bench, window):
    own, hit, items = words(text), set(), set()
    for name, body in bench:
        item = words(body)
        size = min(window, len(item))
        grams = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if size else set()
        for i in range(len(own) - size + 1):
            if size and tuple(own[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                items.add(str(name) if name is not None else "")
    return len(own), len(hit), sorted(items)


@pytest.mark.parametrize("seed,block", [(1, 1 << 24), (2, 150)])
def test_equals_brute_force(spark, seed, block):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bb", "Ünï", "cc9", "d", "EE"])
    bench = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12) if i != 0]
    bench = [b for b in bench if len(words(b[1])) >= 3] + [(90, ""), (91, None), (92, "..."), (None, "zz yy xx"), (11, "zz Yy-xx ww")]
    texts = [None, "", "..", "zz yy xx", "zz yy", "zz, YY; xx ww zz yy xx"]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 12)))]
        if rng.random() < 0.6:
            parts += [rng.choice(bench)[1] or "", "q q"]
        rng.shuffle(parts)
        texts.append(rng.choice([" ", "\n", "-"]).join(parts))
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)] + [(3, "zz yy xx", "y", None)], DOCS).repartition(3)
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.mark(docs, table, block_bytes=block).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        n, hits, items = brute(texts[r["doc_id"]], bench, 10)
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (n, hits, items, hits > 0)
        assert sum(b - a for a, b in zip(r["hit_starts"], r["hit_stops"])) == hits


def test_longest_match_and_shards(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 7)
    item = " ".join(f"w{i}" for i in range(40))
    part = " ".join(f"w{i}" for i in range(5, 30))
    searcher = decontaminate.Searcher([("1", item.encode())], 10)
    got = decontaminate._search(searcher, [f"x {part} y".encode(), b"", f"{part} {part}".encode(), b"w1 w2"])
    assert [g[1] for g in got] == [25, 0, 50, 0] and [g[3] for g in got] == [25, 0, 25, 0]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text here", None, None)], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontaminate.mark(docs, none).collect()] == [False]
    assert decontaminate.mark(docs.limit(0), none).count() == 0
    bench = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert decontaminate.remove_contaminated(docs, bench).count() == 0


def test_long_items_hold_no_suffix_texts():
    """A benchmark item of 100,000 words costs four bytes a word, and its matches are followed to their end."""
    item = " ".join(f"w{i * 7919 % 50021}x{i % 13}" for i in range(100_000)).encode()
    searcher = decontaminate.Searcher([("1", item)], 10)
    assert sum(map(len, searcher.raw)) == 400_000 and not hasattr(searcher, "suffixes")
    part = b" ".join(item.split(b" ")[500:60_500])
    got = decontaminate._search(searcher, [b"q " + part + b" q", b"q"])
    assert [(g[1], g[2], g[3]) for g in got] == [(60_000, ["1"], 60_000), (0, [], 0)]
    assert decontaminate._searcher([("2", b"q")], 10) is not searcher


def test_longest_match_beyond_the_keys_by_brute_force():
    rng = random.Random(5)
    items = [" ".join(rng.choice("abc") for _ in range(rng.choice([4, 90, 200]))) for _ in range(6)]
    searcher = decontaminate.Searcher([(str(i), t.encode()) for i, t in enumerate(items)], 10)
    texts = [" ".join([*"zz", *items[i].split()[3:], "z", *items[5].split()]) for i in range(5)]
    got = decontaminate._search(searcher, [t.encode() for t in texts])
    for text, found in zip(texts, got):
        own, best = text.split(), 0
        for item in (t.split() for t in items):
            for a in range(len(own)):
                for b in range(len(item)):
                    n = 0
                    while a + n < len(own) and b + n < len(item) and own[a + n] == item[b + n]:
                        n += 1
                    best = max(best, n if n >= min(10, len(item)) else 0)
        assert found[3] == best
