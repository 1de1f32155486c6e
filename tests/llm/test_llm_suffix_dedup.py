import hashlib
import random
from collections import Counter

import pytest

from logweave.llm import suffix_dedup


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def corpus(seed, docs=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(40), text(60)
    out = [None, "", "short", "a" * 500, "ab" * 300, base, base, passage]
    for i in range(docs):
        kind = i % 5
        if kind == 0:
            out.append(text(30) + passage[rng.randint(0, 50) :] + text(20))
        elif kind == 1:
            words = base.split(" ")
            words[rng.randrange(len(words))] = word()
            out.append(" ".join(words))
        elif kind == 2:
            out.append(text(rng.randint(1, 80)))
        elif kind == 3:
            out.append(passage[: rng.randint(60, 200)] + text(5) + passage[-rng.randint(60, 150) :] + passage[:90])
        else:
            out.append(text(8) + passage + text(8) + passage)
    return out


@pytest.mark.parametrize("seed,limit", [(1, 20_000), (2, 3), (3, 1)])
def test_equals_brute_force(spark, seed, limit):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_spans string").repartition(5)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, 64, group_limit=limit).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts, 64)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) == want, i


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "q" * 40 + "unique " * 9)] * 3 + [(None, None)], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, 64).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 103, 103, 103]
    assert suffix_dedup.remove_repeats(df.limit(0), 64).count() == 0


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 50)
    texts = corpus(4, 20)
    for body in [(t or "").encode() for t in texts]:
        if len(body) >= 64:
            windows = [i for _, lo, hi in suffix_dedup.contexts(body, 64, 48) for a, b in zip(lo, hi) for i in range(a, b + 1)]
            assert windows == list(range(len(body) - 63))


def test_merge_equals_sort():
    rng = random.Random(5)
    runs = []
    for n in (0, 1, 7, 50, 50):
        keys = sorted(bytes(rng.choice(b"\0ab") for _ in range(rng.randint(0, 12))) for _ in range(n))
        runs.append((keys, suffix_dedup.neighbour_prefixes(keys)))
        shared, rests = suffix_dedup.front_code(keys)
        assert suffix_dedup.front_decode(shared, rests) == keys
    of, at, prefix = suffix_dedup.merge_runs(runs)
    merged = [runs[r][0][i] for r, i in zip(of, at)]
    assert merged == sorted(k for keys, _ in runs for k in keys)
    assert prefix.tolist() == suffix_dedup.neighbour_prefixes(merged).tolist()
