"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= k) = logistic(s - threshold_k) with one score s, linear in hashed text features, for all grades and
ordered thresholds. It gives the expected grade and the probability of reaching a grade.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches, stored, without
from .linear_text import BITS, WORD, Sparse, collected, contrast, hashed, label_counts, labelled_sample, row_scores

MAX_ROWS = 20_000
MAX_FEATURES = 6000
_MARKS = re.compile(r"[^\w\s]+|\s+")


def features(text: str) -> set[int]:
    """Feature numbers of a text: words, word beginnings, shapes of what surrounds them, and levels of whole-text measures."""
    words = WORD.findall(text)
    out = {hashed("w", w.lower()) for w in set(words)}
    out |= {hashed("4", w[:4].lower()) for w in set(words) if len(w) > 4}
    out |= {hashed("s", s) for s in {token[:8] for token in set(_MARKS.findall(text))}}
    n = max(1, len(text))
    letters = Counter(text)
    share = lambda test: sum(k for c, k in letters.items() if test(c)) / n
    lines = [x for x in text.split("\n") if x.strip()]
    levels = {
        "length": math.log2(n + 1),
        "upper": 10 * share(str.isupper),
        "digits": 20 * share(str.isdigit),
        "marks": 20 * share(lambda c: not c.isalnum() and not c.isspace()),
        "distinct": 10 * len(set(words)) / max(1, len(words)),
        "lines": 10 * len(set(lines)) / max(1, len(lines)),
        "word": len("".join(words)) / max(1, len(words)),
    }
    return out | {hashed("l", f"{name} {int(level)}") for name, level in levels.items()}


@dataclass
class Model:
    weights: dict[int, float]
    thresholds: list[float]
    grades: list[float]

    def score(self, df: DataFrame, keep_grade: float, text_col: str = "text", least: float = 0.5) -> DataFrame:
        """Add ``expected_grade``, ``tail_probability`` (of ``keep_grade`` or more) and ``kept`` (tail from ``least`` on).

        One pass without a shuffle; an empty or null text is scored as such. Columns of these names are replaced.
        """
        weights, grades = self.weights, np.array(self.grades)
        thresholds = np.array(self.thresholds)
        kept = without(df, "expected_grade", "tail_probability", "kept", "_quality")

        def score(_, text: str) -> tuple[float, float]:
            s = sum(weights.get(f, 0.0) for f in features(text))
            reach = np.concatenate([[1.0], 1 / (1 + np.exp(-np.clip(s - thresholds, -60, 60))), [0.0]])
            tail = reach[int(np.searchsorted(grades, keep_grade))]
            return float(((reach[:-1] - reach[1:]) * grades).sum()), float(tail)

        scored = kept.withColumn("_quality", row_scores(kept, text_col, score, ["expected", "tail"], lambda: None))
        return scored.select(
            *[F.col(f"`{c}`") for c in kept.columns], F.col("_quality.expected").alias("expected_grade"),
            F.col("_quality.tail").alias("tail_probability"), (F.col("_quality.tail") >= least).alias("kept"),
        )


def fit_rows(rows: list[np.ndarray], label: np.ndarray, kept: np.ndarray, decay: float = 1e-4, rounds: int = 400, rate: float = 0.1) -> Model:
    """Fit weights and thresholds by Adam on the likelihood; thresholds stay ordered as sums of exponentials.

    Rows hold places in ``kept``; at least two grades are there.
    """
    grades = np.unique(label)
    place = np.searchsorted(grades, label)
    x = Sparse(rows, len(kept))
    k = len(grades) - 1
    reached = np.array([(place >= i + 1).mean() for i in range(k)])
    start = np.log((1 - reached) / reached)
    theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    params = np.concatenate([np.zeros(len(kept)), theta])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for i in range(1, rounds + 1):
        w, theta = params[: len(kept)], params[len(kept) :]
        gaps = np.exp(theta[1:])
        thresholds = theta[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = x.dot(w)
        reach = 1 / (1 + np.exp(-np.clip(s[:, None] - thresholds[None, :], -60, 60)))
        full = np.concatenate([np.ones((len(s), 1)), reach, np.zeros((len(s), 1))], axis=1)
        slopes = np.pad(reach * (1 - reach), ((0, 0), (1, 1)))  # of reach in s
        at = np.arange(len(s))
        p = np.maximum(full[at, place] - full[at, place + 1], 1e-12)
        ds = -(slopes[at, place] - slopes[at, place + 1]) / p / len(s)
        dt = np.zeros(k)
        np.add.at(dt, place[place > 0] - 1, (slopes[at, place] / p)[place > 0] / len(s))
        np.add.at(dt, place[place < k], -(slopes[at, place + 1] / p)[place < k] / len(s))
        dtheta = np.concatenate([[dt.sum()], gaps * np.cumsum(dt[::-1])[::-1][1:]])
        slope = np.concatenate([x.back(ds) + decay * w, dtheta])
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        params = params - rate * (1 - i / (rounds + 1)) * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8)
    theta = params[len(kept) :]
    thresholds = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])
    return Model({int(f): float(v) for f, v in zip(kept, params) if v}, thresholds.tolist(), grades.tolist())


def fit(docs: DataFrame, labels: DataFrame, grade: Column, learn: Column, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` rated rows for which ``learn`` (over ``_id``) holds; the driver gets feature numbers only."""
    small_batches(docs.sparkSession, 512)
    sample = labelled_sample(docs, labels, grade.cast("double"), learn, max_rows, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "own": [sorted(features(t)) for t in batch["text"]]})

    made = stored(sample.mapInPandas(run, "label double, own array<int>"), "features")  # at most max_rows
    rows, counts = label_counts(made)
    grades = sorted(rows)
    if len(grades) < 2:
        return Model({}, [], grades or [0.0])
    picked = []
    for cut in grades[1:]:
        ones, zeros = (sum((c for k, c in counts.items() if (k >= cut) == side), np.zeros(1 << BITS, np.int64)) for side in (True, False))
        n1 = sum(n for k, n in rows.items() if k >= cut)
        picked.append(contrast(ones, zeros, n1, sum(rows.values()) - n1, MAX_FEATURES // (len(grades) - 1)))
    kept = np.unique(np.concatenate(picked))
    label, lists = collected(made, kept, ["own"])
    return fit_rows(lists["own"], label, kept)
