import random

import numpy as np
from pyspark.sql import functions as F

from logweave.llm import quality_ordinal, toxicity
from logweave.llm.common import id_remainder

DOCS = "doc_id long, text string, score string, predicted string, kept string"


def sentences(seed, n):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdeghiklmnoprst") for _ in range(rng.randint(3, 7))) for _ in range(120)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(4, 40))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilefool", "scumbag", "dimwit"])
        # The group is named in most toxic rows and few others: a tempting, wrong cue.
        if rng.random() < (0.9 if toxic else 0.03):
            words.insert(0, "women")
        rows.append((i, " ".join(words), int(toxic)))
    return rows, plain


def test_counterfactual_penalty_frees_identity_terms(spark):
    rows, plain = sentences(1, 600)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    learn = id_remainder("_id", 5) != 0
    neutral = spark.createDataFrame([(i, f"women {plain[i]} {plain[i + 1]} {plain[i + 2]}", None, None, None) for i in range(50)], DOCS)
    fair = toxicity.fit(docs, labels, learn, penalty=1.0)
    free = toxicity.fit(docs, labels, learn, penalty=0.0)
    score = lambda m: m.score(neutral).agg(F.avg("score")).first()[0]
    assert score(fair) < 0.5 * score(free) and fair.score(neutral).agg(F.sum("predicted")).first()[0] <= free.score(neutral).agg(F.sum("predicted")).first()[0]
    got = {r["doc_id"]: r for r in fair.score(docs).collect()}
    assert np.mean([got[i]["predicted"] == x for i, _, x in rows]) > 0.97


def test_edge_rows(spark):
    rows, _ = sentences(2, 200)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    odd = spark.createDataFrame([(1, None, "x", "y", "z"), (1, "", None, None, None), (None, "word " * 200_000, None, None, None), (2, "\U0001f600", None, None, None)], DOCS)
    got = model.score(odd).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert model.score(odd.limit(0)).count() == 0
    none = toxicity.fit(docs, labels.limit(0), F.lit(True)).score(odd).collect()
    assert all(r["score"] == 0.5 for r in none)
    assert quality_ordinal.fit(docs, labels.limit(0), F.col("toxic"), F.lit(True)).score(odd, 0).count() == 4


def test_ordinal_grades(spark):
    rng = random.Random(7)
    marks = ["#spam", "meh", "fine", "superb"]
    rows = [(i, " ".join([marks[i % 4]] * rng.randint(1, 3) + [rng.choice("abcdef") * 3 for _ in range(20)]), i % 4) for i in range(800)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")
    model = quality_ordinal.fit(docs, labels, F.col("grade"), id_remainder("_id", 5) != 0)
    assert model.grades == [0, 1, 2, 3] and model.thresholds == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in model.score(docs, keep_grade=2).filter(id_remainder("doc_id", 5) == 0).collect()}
    assert np.mean([abs(r["expected_grade"] - i % 4) < 0.5 for i, r in got.items()]) > 0.95
    assert np.mean([r["kept"] == (i % 4 >= 2) for i, r in got.items()]) > 0.95
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None)], DOCS)
    assert all(0 <= r["tail_probability"] <= 1 for r in model.score(odd, keep_grade=2).collect())


def test_slope_of_the_ordinal_fit_raises_the_likelihood():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(200, 10, replace=False)) for _ in range(400)]
    label = np.array([float(min(2, (r < 60).sum() // 2)) for r in rows])
    model = quality_ordinal.fit_rows(rows, label, np.arange(200))
    s = np.array([sum(model.weights.get(int(f), 0) for f in r) for r in rows])
    reach = 1 / (1 + np.exp(-(s[:, None] - np.array(model.thresholds))))
    assert np.mean((reach >= 0.5).sum(axis=1) == label) > 0.9


def dense(rows, columns):
    out = np.zeros((len(rows), columns))
    for i, r in enumerate(rows):
        np.add.at(out[i], r, 1.0)
    return out


def test_toxicity_fit_equals_a_dense_one():
    rng = np.random.default_rng(3)
    n, d, penalty, sparsity = 200, 40, 0.7, 1e-3
    rows = [np.sort(rng.choice(d, 8, replace=False)).astype(np.int32) for _ in range(n)]
    label = np.array([float(rng.random() < (0.85 if (r < 6).sum() >= 2 else 0.1)) for r in rows])
    gone = [rng.choice(6, 1).astype(np.int32) for _ in range(50)]
    come = [rng.choice(np.arange(6, 12), 1).astype(np.int32) for _ in range(50)]
    x, change = np.hstack([dense(rows, d), np.ones((n, 1))]), np.hstack([dense(come, d) - dense(gone, d), np.zeros((50, 1))])
    share = np.where(label > 0.5, 0.5 / label.sum(), 0.5 / (1 - label).sum())

    def loss(p):
        s = x @ p
        return (share * (np.logaddexp(0, s) - label * s)).sum() + penalty * ((change @ p) ** 2).mean() + sparsity * np.abs(p[:-1]).sum()

    # Plain proximal gradients with the step of the exact largest curvature.
    step = 1 / np.linalg.eigvalsh(0.25 * x.T @ (share[:, None] * x) + 2 * penalty / 50 * change.T @ change)[-1]
    p = np.zeros(d + 1)
    for _ in range(20_000):
        p = p - step * (x.T @ (share * (1 / (1 + np.exp(-x @ p)) - label)) + 2 * penalty / 50 * change.T @ (change @ p))
        p[:-1] = np.sign(p[:-1]) * np.maximum(np.abs(p[:-1]) - step * sparsity, 0)
    model = toxicity.fit_rows(rows, label, gone, come, np.arange(d), sparsity, penalty)
    got = np.append([model.weights.get(i, 0.0) for i in range(d)], model.bias)
    assert loss(got) <= loss(p) + 1e-5 and np.abs(got - p).max() < 0.02


def test_ordinal_fit_equals_a_dense_one():
    rng = np.random.default_rng(4)
    n, d, decay = 200, 30, 1e-2
    rows = [np.sort(rng.choice(d, 6, replace=False)).astype(np.int32) for _ in range(n)]
    label = np.array([float(np.clip((r < 10).sum() - 1 + rng.integers(0, 2), 0, 2)) for r in rows])
    x, place = dense(rows, d), label.astype(int)

    def chances(w, cuts):
        reach = 1 / (1 + np.exp(-((x @ w)[:, None] - cuts[None, :])))
        full = np.hstack([np.ones((n, 1)), reach, np.zeros((n, 1))])
        return full, full[np.arange(n), place] - full[np.arange(n), place + 1]

    def loss(w, cuts):
        return -np.log(chances(w, cuts)[1]).mean() + decay / 2 * (w**2).sum()

    # Gradient descent on weights and plain thresholds.
    w, cuts = np.zeros(d), np.array([-1.0, 1.0])
    for _ in range(20_000):
        full, p = chances(w, cuts)
        slope, at = full * (1 - full), np.arange(n)
        w_slope = -x.T @ ((slope[at, place] - slope[at, place + 1]) / p) / n + decay * w
        cut_slope = [((place == k + 1) * slope[:, k + 1] / p).mean() - ((place == k) * slope[:, k + 1] / p).mean() for k in range(2)]
        w, cuts = w - 0.3 * w_slope, cuts - 0.3 * np.array(cut_slope)
    model = quality_ordinal.fit_rows(rows, label, np.arange(d), decay=decay)
    got = np.array([model.weights.get(i, 0.0) for i in range(d)])
    assert loss(got, np.array(model.thresholds)) <= loss(w, cuts) + 1e-4
    assert np.abs(got - w).max() < 0.05 and np.abs(np.array(model.thresholds) - cuts).max() < 0.05
