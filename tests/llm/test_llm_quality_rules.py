import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from logweave.llm import quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_words string, kept string"


def brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop\u00e9") for _ in range(rng.randint(2, 9)))
    out = []
    for i in range(400):
        lines = [" ".join(word() for _ in range(rng.randint(3, 20))) for _ in range(rng.randint(3, 12))]
        if i % 40 == 7:
            lines = [" ".join(w + "#$%&" for w in x.split()) for x in lines]
        out.append((i, "\n".join(lines), "en" if i % 2 else "de", "big" if i % 5 else None))
    a = "one two three four five six"
    odd = [None, "", " \t\n", f"{a} {a} {a}", "x\n\nx\n \nx", "a a a a a a a a a a a", "\x0b".join("abcdefghijkl"), "w" * 300_000, "\u00a0 \u3000", "line\r\nline\r\n" * 20, a + " " + " ".join(word() for _ in range(60)) + " " + a]
    return out + [(1000 + i, t, None, "rare") for i, t in enumerate(odd)]


def test_base_statistics_equal_brute_force(spark):
    rows = corpus(1)
    got = quality_rules.judge(spark.createDataFrame([(*r, None, None) for r in rows], DOCS)).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r for r in got}
    for i, text, _, _ in rows:
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(text), i
        assert not (r["base_failed"] and r["kept"])
    marked = [i for i in range(400) if i % 40 == 7 and not found[i]["base_failed"]]
    assert marked and all(not found[i]["kept"] for i in marked)
    clean = [i for i in range(400) if i % 40 != 7 and not found[i]["base_failed"]]
    assert np.mean([found[i]["kept"] for i in clean]) > 0.98


def test_distances_equal_a_plain_estimate(spark):
    rng = np.random.default_rng(2)
    n = 500
    table = [
        (i, "en", "s", int(w), int(w * c), int(k), int(d), int(r), False)
        for i, (w, c, k, d, r) in enumerate(zip(np.exp(rng.normal(5, 0.7, n)) + 10, np.exp(rng.normal(1.6, 0.1, n)), rng.poisson(0.3, n), rng.poisson(0.1, n), rng.poisson(0.5, n)))
    ]
    rows = spark.createDataFrame(table, "i long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    got = {r["i"]: r["distance"] for r in quality_rules.outliers(rows).collect()}
    w, ch, k, dl, rp = (np.array([t[j] for t in table], float) for j in (3, 4, 5, 6, 7))
    x = np.stack([np.log(1 + w), np.log(ch / w), np.log(1 + 100 * k / ch), np.log(1 + dl), np.log(1 + 100 * rp / w)])
    z = np.floor(np.abs(x) * 256 + 0.5) * np.sign(x)
    floor = np.array([v[2] for v in quality_rules.VECTOR]) * 256
    q = np.percentile(z, [25, 50, 75], axis=1)
    dist = (((z - q[1][:, None]) / np.maximum((q[2] - q[0]) / 1.349, floor)[:, None]) ** 2).sum(axis=0)
    for _ in range(quality_rules.STEPS + 1):
        level = np.floor(np.log2(dist + 2.0**-20) * 64)
        values, counts = np.unique(level, return_counts=True)
        before = np.cumsum(counts) - counts
        near = z[:, np.isin(level, values[before < 0.75 * n])]
        mean, cov = near.mean(axis=1), np.cov(near, bias=True) + np.diag(floor**2)
        dist = np.einsum("in,ij,jn->n", z - mean[:, None], np.linalg.inv(cov), z - mean[:, None])
    scale = max(0.25, 2 ** (np.percentile(np.floor(np.log2(dist + 2.0**-20) * 64), 50) / 64) / quality_rules.CHI_MEDIAN)
    assert np.allclose([got[i] for i in range(n)], dist / scale, rtol=1e-6)


def test_empty_table(spark):
    assert quality_rules.judge(spark.createDataFrame([], DOCS)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(*r, None, None) for r in corpus(3)[:50]], DOCS)
    plan = quality_rules.base_statistics(df, ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_small_sources_and_rare_languages_are_judged_too(spark):
    words = "the river ran past an old mill where several people worked each day until dark and then walked home".split()
    rng = random.Random(3)
    text = lambda i: " ".join(rng.choice(words) for _ in range(30 + i % 7))
    odd = " ".join("#|<>%$&*" * 30 + w for w in words)
    rows = [(i, text(i), "en", "hot") for i in range(300)] + [(1000 + i, text(i), "en", "small") for i in range(20)]
    rows += [(2000 + i, text(i), f"x{i}", "rare") for i in range(10)]
    rows += [(3000, odd, "en", "small"), (3001, odd, "x1", "rare")]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows)
    assert all(r["distance"] is not None for r in got.values() if not r["base_failed"])
    assert not got[3000]["base_failed"] and not got[3000]["kept"] and not got[3001]["kept"]
