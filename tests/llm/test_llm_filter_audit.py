import collections
import itertools
import re

import numpy as np
import pytest

from logweave.llm import filter_audit

DOCS = "doc_id long, text string, source string, part string, fails int, _text string, n string"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    good = {i for i, q, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    least = collections.defaultdict(list)
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""].append(i)
    rows = []
    for i, text, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > min(least[text]),
        }
        rows.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        credit = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for s in range(5):
                before, f = set(order[:s]), order[s]
                gone = [r for r in mine if f in r[1] and not r[1] & before]
                credit[f] += len(gone)
                out[part, "".join(order), s + 1] = [
                    sum(not r[1] & (before | {f}) for r in mine), len(gone), sum(f in r[1] and bool(r[1] & before) for r in mine),
                    sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for (p, order, s), row in out.items():
            if p == part:
                row.append(credit[order[s - 1]])
    return {k: tuple(v) for k, v in out.items()}


def collected(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def test_positional_popcount_equals_counting():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 3, 4, 5, 100, 1001):
        words = rng.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)
        copies = rng.integers(1, 1 << 20, size)
        bits = (words[:, None] >> np.arange(32, dtype=np.uint32)) & 1
        assert filter_audit.positional_popcount(words).tolist() == bits.sum(axis=0).tolist()
        assert filter_audit.positional_popcount(words, copies).tolist() == (bits * copies[:, None]).sum(axis=0).tolist()


def test_survival_words():
    for fails in range(32):
        word = filter_audit.survival_word(fails)
        assert [word >> s & 1 for s in range(32)] == [int(not s & fails) for s in range(32)]


def test_audit_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: " ".join(f"w{rng.integers(0, 9999)}" for _ in range(n))
    texts = ["", None, fresh(250), fresh(250) + " A#", "SHOUT " * 300, "a b " * 150, fresh(199), fresh(200) + "\n\t $", "Ä Ö é 😀 " * 60, "x" * 300_000 + "Q" * 9000]
    docs = [(i, texts[i % len(texts)], [None, "", "s1", "s2"][i // 3 % 4], "own", 9, "mine", "n") for i in range(80)]
    docs += [(None, texts[2], "s1", *"abcd"[:1], 1, "t", "n"), (None, texts[2], "s1", "a", 1, "t", "n"), (None, "only nameless", None, "a", 1, "t", "n")]
    docs += [(0, texts[0], "s9", "a", 1, "t", "n")] * 3 + [(2, texts[2], "s2", "a", 1, "t", "n")] * 4 + [(500 + i, texts[2], "hot", "a", 1, "t", "n") for i in range(200)]
    labels = [(i, i % 2, i % 3 % 2, "x") for i in range(0, 60, 2)] + [(4, 1, 0, "x"), (4, 0, 1, "x"), (None, 1, 1, "x"), (7, None, None, "x")]
    got = collected(filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)))
    assert got == brute([d[:3] for d in docs], labels)


def test_own_rules_and_empty_table(spark):
    empty = filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert empty.count() == 0
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a", "s", None, None, None, None), (2, "bb", "s", None, None, None, None), (3, "bb", "s", None, None, None, None)], DOCS)
    got = collected(filter_audit.audit(docs, spark.createDataFrame([], LABELS), [F.length("text") > 1]))
    assert got == {
        ("s", "AB", 1): (1, 2, 0, 1, 0, 0, 3), ("s", "AB", 2): (1, 0, 1, 0, 0, 0, 1),
        ("s", "BA", 1): (2, 1, 0, 0, 0, 0, 1), ("s", "BA", 2): (1, 1, 1, 1, 0, 0, 3),
    }
    with pytest.raises(ValueError):
        filter_audit.audit(docs, docs, [F.lit(True)] * 5)
