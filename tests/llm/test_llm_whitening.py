import math

import numpy as np
import pytest

from logweave.llm import whitening

VECTORS = "vec_id long, embedding array<float>, x string, n string, component string, deviation string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "mine", "n", "c", "d") for i, v in vectors], VECTORS)


def check(rows, vectors, usable=4):
    """Against a dense decomposition of the distinct vectors."""
    x = {}
    for i, v in vectors:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            x.setdefault(i, []).append([math.floor(256 * float(np.float32(c))) for c in v])
    every = [tuple(r) for group in x.values() for r in group]
    fit = np.array(sorted(set(every)))
    n, sums = len(fit), fit.sum(axis=0)
    away = fit - sums / n
    values, axes = np.linalg.eigh(away.T @ away / n)
    values, axes = values[::-1], axes[:, ::-1]
    width = min(4, fit.shape[1])
    assert len(rows) == len(every) * width
    signs = {}
    seen = {}
    for r in rows:
        seen.setdefault(r["vec_id"], []).append(r)
    for i, group in x.items():
        for c in range(1, width + 1):
            mine = [r for r in seen[i] if r["component"] == c]
            assert len(mine) == len(group) and {r["n"] for r in mine} == {n}
            want = sorted(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in group)
            assert sorted(r["deviation"] for r in mine) == want
            if len(group) > 1 or c > usable:
                assert c <= usable or all(r["whitened"] is None for r in mine)
                continue
            assert mine[0]["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
            want = (np.array(group[0]) - sums / n) @ axes[:, c - 1] / math.sqrt(values[c - 1])
            got = mine[0]["whitened"]
            if abs(want) > 1e-3:
                sign = signs.setdefault(c, math.copysign(1, got * want))
                assert got == pytest.approx(sign * want, rel=1e-6)
            assert mine[0]["identity_error"] < 1e-9


def test_whitening_equals_dense(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, (400, 12)) * np.geomspace(4, 0.05, 12)
    vectors = [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(base)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(300)]
    vectors += [(2000, None), (2001, [None] + [0.0] * 11), (2002, [math.nan] + [0.0] * 11), (2003, [-math.inf] * 12), (None, vectors[5][1]), (7, vectors[9][1])]
    check(whitening.whiten(frame(spark, vectors)).collect(), vectors)


def test_ill_conditioned_and_flat_directions(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(-400_000, 400_000, (300, 1)).astype(float)
    b = rng.integers(-3, 4, (300, 1)).astype(float)
    rows = np.hstack([a, a * 3 + b, b * 2 + 900_000, np.full((300, 1), 5.0), -a]) / 256
    vectors = [(i, [float(c) for c in r]) for i, r in enumerate(rows.astype(np.float32))]
    got = whitening.whiten(frame(spark, vectors)).collect()
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in vectors])
    x = np.unique(x, axis=0)
    s = np.linalg.svd(x - x.mean(axis=0))[1]
    check(got, vectors, usable=int((s[:4] > s[0] * 5e-13).sum()))


def test_odd_tables(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, []), (2, None)])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in one)
    mixed = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.5]), (3, [1.0])])).collect()
    assert {r["vec_id"] for r in mixed} == {1, 2} and {r["component"] for r in mixed} == {1, 2}
    huge = whitening.whiten(frame(spark, [(1, [3e30, 1.0]), (2, [-3e30, 1.0])])).collect()
    assert all(r["deviation"] is None for r in huge)


def test_cholesky_qr_is_orthogonal_for_any_condition(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(500, 6)) * np.array([1e9, 1e6, 1e3, 1e2, 10, 1])).astype(np.int64)
    x[:, 5] += x[:, 0]
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>")
    n, sums, top = whitening.exact_sums(fit, 6)
    assert (n, sums, top) == (500, x.sum(axis=0).tolist(), np.abs(x).max())
    mean = np.array([s / n for s in sums])
    r = whitening.shifted_cholesky_qr(fit, 6, mean, n)
    q = np.linalg.solve(r.T, (x - mean).T).T
    assert np.abs(q.T @ q - np.eye(6)).max() < 1e-6  # the condition (1e9) times the rounding
