import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from logweave.llm import language_id
from logweave.llm.common import id_remainder

DOCS = "doc_id long, text string, lang string, lang_pred string, score string"
SYLLABLES = {"aa": "ba be bi bo tion the", "bb": "sch ung ei ch zu ba", "cc": "\u00e9a ou eau \u00e7e que ion", "ja": "\u65e5 \u672c \u8a9e \u304b \u306a \u3059"}


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(6, 40))]
        rows.append((i, " ".join(words).title() + ". 12", lang, "x", None))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(1, 800) + [(9000, None, "aa", None, None), (9001, "some text", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(docs, id_remainder("doc_id", 4) != 2)
    assert model.langs == sorted(SYLLABLES)
    got = {r["doc_id"]: r for r in model.label(docs).collect()}
    held = [r["doc_id"] for r in docs.filter(id_remainder("doc_id", 4) == 2).select("doc_id").collect() if r["doc_id"] < 9000]
    assert len(held) > 100 and np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.98
    odd = [None, "", "123 !? \u00b2", "\U0001f600", "a", "qqq xxx www jjj qqq xxx", "ba be tion " * 900_000]
    more = model.label(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(odd)], DOCS)).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in more[:4]] == ["und"] * 4 and more[4]["lang_pred"] in SYLLABLES
    assert more[5]["rejected"] and not more[6]["rejected"] and more[6]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in more)
    empty = language_id.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in empty.label(docs).collect()} == {"und"}


def test_counts_cover_all_texts(spark):
    rows = [("a", " abab ab "), ("a", " abab "), ("b", " abc "), ("b", "x")]
    got = {(r["lang"], r["gram"]): r["n"] for r in language_id.count_grams(spark.createDataFrame(rows, "lang string, text string"), 3).collect()}
    want: dict = {}
    for lang, text in rows:
        plain = language_id.normalised(text)
        for i in range(len(plain) - 2):
            want[lang, plain[i : i + 3]] = want.get((lang, plain[i : i + 3]), 0) + 1
    assert got == want


def test_probabilities_sum_to_one_and_follow_the_formula():
    texts = {"a": " abracadabra abba ", "b": " cabbage baa "}
    counts: dict = {}
    for lang, text in texts.items():
        for i in range(len(text) - 2):
            counts[lang, text[i : i + 3]] = counts.get((lang, text[i : i + 3]), 0) + 1
    model = language_id.build(pd.DataFrame([(a, g, n) for (a, g), n in counts.items()], columns=["lang", "gram", "n"]), 3)
    letters = sorted({c for t in texts.values() for c in t})
    known = {g for _, g in counts}
    letters = sorted({g[2] for g in known})
    for context in ("ab", "zz", "ca", "qa"):
        logs = model.logs(language_id.codes("".join(context + c for c in letters)))[::3]
        total = np.exp(logs).sum(axis=0)
        # One share of the uniform floor belongs to characters never seen.
        assert np.all(total <= 1 + 1e-5) and np.all(total > 0.8)
    assert math.isclose(float(model.floor[0]), -math.log(len(letters) + 1), rel_tol=1e-6)


def test_chunks_do_not_change_results(monkeypatch):
    rows = corpus(3, 60)
    counts: dict = {}
    for _, text, lang, _, _ in rows:
        plain = language_id.normalised(text)
        for i in range(len(plain) - 4):
            counts[lang, plain[i : i + 5]] = counts.get((lang, plain[i : i + 5]), 0) + 1
    model = language_id.build(pd.DataFrame([(a, g, n) for (a, g), n in counts.items()], columns=["lang", "gram", "n"]))
    texts = [language_id.normalised(r[1]) for r in rows]
    whole = model.entropies(texts)
    monkeypatch.setattr(language_id, "CHUNK", 17)
    assert np.allclose(model.entropies(texts), whole, atol=1e-4)


def test_model_keeps_every_gram_and_discounts_come_from_all_counts(spark):
    # Two languages of 55,000 different 5-grams each, most of them seen once, are more than a fixed number of kept grams would hold.
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(lang, "".join(rng.choice(letters) for _ in range(11_000))) for lang in ("aa", "bb") for _ in range(10)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    counts = language_id.count_grams(frame, 5)
    kinds = counts.select("gram").distinct().count()
    assert kinds > 200_000
    model = language_id.fit(frame.withColumn("doc_id", F.xxhash64("text")), F.lit(True))
    assert len(model.grams[5][0]) == kinds
    some = counts.filter("abs(xxhash64(gram)) % 50 = 0 OR n > 1").toPandas()
    small, whole = language_id.build(some), language_id.build_distributed(spark.createDataFrame(some))
    assert small.langs == whole.langs and np.array_equal(small.floor, whole.floor)
    for n in range(1, 6):
        for a, b in ((small.grams[n], whole.grams[n]), (small.contexts[n], whole.contexts[n])):
            assert np.array_equal(a[0], b[0]) and np.allclose(a[1], b[1], atol=1e-5)


def test_limits_come_from_all_training_rows_and_every_language_has_one(spark):
    rows = corpus(7, 4600)
    # One language is rare: seven training texts of it.
    rare = [i for i, r in enumerate(rows) if r[2] == "ja"]
    gone = set(rare[7:])
    frame = spark.createDataFrame([r for i, r in enumerate(rows) if i not in gone] + [(9000, "qqq xxx www jjj qqq", None, "x", None)], DOCS)
    got = language_id.identify(frame, F.lit(True)).join(frame.select("doc_id", "lang", "text"), "doc_id").toPandas()
    right = got[got["lang"] == got["lang_pred"]]
    assert 0.0002 <= right["rejected"].mean() <= 0.0015 + 7 / len(right)
    assert bool(got[got["doc_id"] == 9000]["rejected"].iloc[0])
    scored = spark.createDataFrame([("aa", "aa", 1 + i / 10_000) for i in range(10_000)] + [("bb", "bb", 1.5)] * 3, "lang string, lang_pred string, entropy double")
    model = language_id.Model(["aa", "bb"], 5, [], [], np.zeros(2, np.float32), {})
    language_id.calibrated(model, scored, 0.999)
    assert model.limits.keys() == {"aa"} and abs(model.limits["aa"] - 1.999) < 0.0021
    assert math.isfinite(model.limit_else) and abs(model.limit_else - 1.999) < 0.0021


def test_a_model_too_large_for_workers_gives_the_same_results(spark):
    odd = [None, "", "123 !?", "a", "b\u00e9", "qqq xxx www", "ba be tion " * 300, "\u65e5\u672c \U0001f600 x"]
    rows = [(i, t, lang, None, None) for i, t, lang, *_ in corpus(3, 120)] + [(900 + i, t, None, None, None) for i, t in enumerate(odd)]
    docs = spark.createDataFrame([*rows, rows[0]], DOCS)
    learn = F.col("doc_id") % 4 != 2
    arrays = language_id.fit(docs, learn)
    tables = language_id.fit(docs, learn, model_bytes=1000)
    assert isinstance(arrays, language_id.Model) and isinstance(tables, language_id.TableModel)
    assert tables.langs == arrays.langs and tables.limits.keys() == arrays.limits.keys()
    got = [m.label(docs).orderBy("doc_id").collect() for m in (arrays, tables)]
    assert len(got[0]) == len(got[1]) == len(rows) + 1
    for a, b in zip(*got):
        assert (a["doc_id"], a["text"], a["lang_pred"]) == (b["doc_id"], b["text"], b["lang_pred"])
        assert math.isclose(a["score"], b["score"], abs_tol=1e-3) and (a["entropy"] is None) == (b["entropy"] is None)
        assert a["entropy"] is None or math.isclose(a["entropy"], b["entropy"], abs_tol=1e-4)
    assert tables.label(docs.limit(0)).count() == 0
