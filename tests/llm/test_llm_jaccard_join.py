import random
import re
import time

import numpy as np
import pytest

from logweave.llm import components, jaccard_join


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(jaccard_join.ASCII_LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} or {tuple(words)}


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)], links[i]) for i, (d, _) in enumerate(rows)}


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    bases = [[word() for _ in range(k)] for k in (1, 2, 3, 4, 12, 13, 30, 60, 120, 300)]
    out = [None, "", " \t\n", "ONE two", "one TWO", "a a a a a a a a", "é É", "É É"]
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(words) // 30))):
            at = rng.randrange(len(words))
            how = rng.random()
            if how < 0.4:
                words[at] = word()
            elif how < 0.7:
                words.insert(at, word())
            elif len(words) > 1:
                del words[at]
        out.append(rng.choice([" ", "\n", "  "]).join(words))
    return list(enumerate(out))


@pytest.mark.parametrize("seed,block", [(1, 1_000_000), (2, 200)])
def test_equals_brute_force(spark, seed, block):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", None) for d, t in rows], "doc_id long, text string, sid string, parts string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.join(df, block_shingles=block).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("percent", [50, 60, 65, 80, 100])
def test_any_similarity_equals_brute_force(spark, percent):
    rows = corpus(percent, 110)
    rng = random.Random(percent)
    for i in range(60):  # prefixes of one text: all sizes around each other
        rows.append((1000 + i, " ".join(f"p{k}" for k in range(rng.randint(1, 40)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.join(df, percent, block_shingles=500, bucket_bytes=2000).collect()}
    assert got == brute(rows, percent)


def slow_links(sets, side, percent):
    out = {}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if i != j and (side[i] != side[j] or not side.any()) and 100 * both >= percent * (len(a) + len(b) - both):
                out.setdefault(i, set()).add(j)
    return out


@pytest.mark.parametrize("percent", [50, 66, 80, 90, 100])
def test_group_join_equals_all_pairs(percent):
    rng = np.random.default_rng(percent)
    for round in range(12):
        base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
        sets = []
        for _ in range(60):
            kept = base[rng.random(40) < rng.choice([0.3, 0.8, 0.97])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 62, int(rng.integers(0, 5)), dtype=np.uint64), base[:1]])))
        sets.sort(key=len)
        side = rng.integers(0, 2, 60) if round % 2 else np.zeros(60, int)
        got = {i: set(js.tolist()) for i, js in jaccard_join.join_sets(sets, side, percent)}
        assert got == slow_links(sets, side, percent)


def test_a_template_is_not_compared_pair_by_pair():
    """Many texts of one template that do not link: 7 of 8 shingles, then 40 of 50, are common to all."""
    for fixed, own, count in ((7, 1, 30_000), (40, 10, 4_000)):
        rng = np.random.default_rng(1)
        common = rng.integers(0, 1 << 62, fixed, dtype=np.uint64)
        sets = [np.sort(np.concatenate([common, rng.integers(0, 1 << 62, own, dtype=np.uint64)])) for _ in range(count)]
        sets += [sets[5]]
        start = time.process_time()
        got = dict(jaccard_join.join_sets(sets, np.zeros(len(sets), int), 80))
        assert set(got) == {5, count} and time.process_time() - start < 20


def test_prefixes_of_linked_sets_share_a_token(spark):
    """Counting in buckets, by several tasks, with copies: the ties of linked sets meet."""
    rng = np.random.default_rng(3)
    sets = []
    passage = rng.integers(0, 2**63, 30, dtype=np.uint64)
    for size in list(range(1, 40)) + [100, 333]:
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        for _ in range(4):
            kept = base[rng.random(size) < rng.choice([0.85, 0.95, 1.0])]
            own = rng.integers(0, 2**63, int(rng.integers(0, size // 10 + 2)), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([kept, own, passage[: rng.integers(0, 30)]])))
    named = [(i + 1, s) for i, s in enumerate(sets) if len(s)]
    dealt = [row for part in (named[::2], named[1::2], named[:50]) for row in jaccard_join.deal(part, 7)]
    df = spark.createDataFrame([(b, *map(bytearray, rest)) for b, *rest in dealt], "bucket long, names binary, counts binary, tokens binary")
    sizes = spark.createDataFrame([(i, len(s)) for i, s in named], "sid long, n long")
    holders = {}
    for s in sets:
        for x in s.tolist():
            holders[x] = holders.get(x, 0) + 1
    for percent in (50, 80, 90, 100):
        ties = {}
        for r in jaccard_join._ties(df, sizes, percent).collect():
            ties.setdefault(r["sid"], set()).add(r["token"])
        met = 0
        for i, a in named:
            for j, b in named:
                both = len(np.intersect1d(a, b))
                if i < j and 100 * both >= percent * (len(a) + len(b) - both):
                    met += 1
                    assert ties[i] & ties[j]
        assert met
        for i, a in named:
            alone = sum(holders[x] == 1 for x in a.tolist())
            prefix = len(a) - -(-(len(a) + -(-len(a) * percent // 100)) * percent // (100 + percent)) + 1
            assert len(ties.get(i, ())) == max(0, prefix - alone)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 101), (7, 7), (200, 300), (300, -5)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, 101: 50, 200: -5, 300: -5, -5: -5}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(3, "same words here"), (3, "same words here"), (1, "same words here"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["n_links"]) for r in jaccard_join.join(df).collect())
    assert got == [(-1, None, 0), (1, 1, 2), (3, 1, 2), (3, 1, 2)]
    assert jaccard_join.join(df.limit(0)).count() == 0


def test_buckets_are_dealt_and_looked_at_in_parts(monkeypatch):
    monkeypatch.setattr(jaccard_join, "ROW_SHINGLES", 64)
    monkeypatch.setattr(jaccard_join, "PART_SHINGLES", 100)
    rng = np.random.default_rng(5)
    common = rng.integers(0, 2**63, 300, dtype=np.uint64)
    named = [(i + 1, np.unique(rng.choice(common, int(rng.integers(1, 60))))) for i in range(80)]
    dealt = list(jaccard_join.deal(named, 3))
    assert all(len(tokens) // 4 < 64 + 60 for _, _, _, tokens in dealt)
    for bucket in range(3):
        rows = [r[1:] for r in dealt if r[0] == bucket]
        names = [n for r in rows for n in np.frombuffer(r[0], np.uint64).tolist()]
        assert len(rows) > 1 and len(names) == len(set(names))
        owners = np.repeat(names, np.concatenate([np.frombuffer(r[1], np.uint8) for r in rows]))
        holders = {}
        for name, token in zip(owners.tolist(), np.frombuffer(b"".join(r[2] for r in rows), np.uint32).tolist()):
            holders.setdefault(token, []).append(name)
        parts = list(jaccard_join.shared_tokens(bucket, rows + rows[:2]))  # rows that come twice count once
        assert len(parts) > 1
        found = {}
        for part_names, tokens in parts:
            part = {}
            for name, token in zip(part_names.tolist(), tokens.tolist()):
                part.setdefault(token, []).append(name)
            assert not part.keys() & found.keys()
            found |= part
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in holders.values() if len(v) > 1)
        assert all(token >> 47 == len(v) for token, v in found.items())
