"""Toxicity by a counterfactually regularised linear classifier on hashed words.

For every labelled sentence a counterfactual is made: an identity term in it is swapped for
another one, or, where it has none, one is put in. The fit minimises the logistic loss plus a penalty on the squared
change of the score over these pairs, so terms that merely name a group cannot carry
weight however their labels are distributed.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches, stored, without
from .linear_text import BITS, WORD, Sparse, collected, contrast, hashed, label_counts, labelled_sample, row_scores

# Words that name a group, by language; pass others for other data.
IDENTITY_TERMS = (
    "women men muslims christians jews hindus atheists gay lesbian straight transgender black white asian latino immigrants refugees disabled deaf blind "
    "frauen männer muslime christen juden schwule lesben einwanderer flüchtlinge behinderte "
    "femmes hommes musulmans chrétiens juifs gais lesbiennes immigrés réfugiés handicapés "
    "mujeres hombres musulmanes cristianos judíos gais lesbianas inmigrantes refugiados discapacitados"
).split()

MAX_ROWS = 20_000
MAX_FEATURES = 6000


def word_features(word: str) -> tuple[int, ...]:
    """Feature numbers of a word: itself and its beginnings."""
    if len(word) < 4:
        return (hashed("w", word),)
    if len(word) < 5:
        return hashed("w", word), hashed("4", word[:4])
    return hashed("w", word), hashed("4", word[:4]), hashed("5", word[:5])


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def counterfactual(words: set[str], terms: list[str]) -> tuple[list[str], list[str]]:
    """(words that go, words that come) when the identity term of a text is swapped, or one is added."""
    pick = sum(map(len, words)) + len(words)  # decided by the text alone
    found = sorted(words.intersection(terms))
    if not found:
        return [], [terms[pick % len(terms)]]
    old = found[pick % len(found)]
    others = [t for t in terms if t not in words] or [old]
    return [old], [others[pick % len(others)]]


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def score(self, df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
        """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to every row, in one pass without a shuffle.

        An empty or null text gets the score of no words. Columns of these names are replaced.
        """
        weights, bias = self.weights, self.bias
        kept = without(df, "score", "predicted", "_toxicity")

        def prepare() -> dict[str, float]:
            return {}

        def score(known: dict[str, float], text: str) -> tuple[float]:
            if len(known) > 100_000:
                known.clear()
            total = bias
            for word in words_of(text):
                value = known.get(word)
                if value is None:
                    value = known[word] = sum(weights.get(f, 0.0) for f in word_features(word))
                total += value
            return (1 / (1 + float(np.exp(-min(60.0, max(-60.0, total))))),)

        scored = kept.withColumn("_toxicity", row_scores(kept, text_col, score, ["score"], prepare))
        return scored.select(
            *[F.col(f"`{c}`") for c in kept.columns], F.col("_toxicity.score").alias("score"),
            (F.col("_toxicity.score") >= threshold).cast("int").alias("predicted"),
        )


def constant(positive: int, rows: int) -> Model:
    rate = (positive + 0.5) / (rows + 1)
    return Model({}, float(np.log(rate / (1 - rate))))


def fit_rows(rows: list[np.ndarray], label: np.ndarray, minus: list[np.ndarray], plus: list[np.ndarray], kept: np.ndarray,
             sparsity: float = 1e-4, penalty: float = 1.0, rounds: int = 400) -> Model:
    """Fit by accelerated proximal gradients: logistic loss + ``penalty`` * mean squared score change + l1.

    Rows hold places in ``kept``; ``minus`` and ``plus`` are what each row's counterfactual loses and gains.
    """
    n, m = len(rows), len(minus)
    x, gone, come = Sparse(rows, len(kept)), Sparse(minus, len(kept)), Sparse(plus, len(kept))
    target = label > 0.5
    share = np.where(target, 0.5 / target.sum(), 0.5 / (~target).sum())  # both classes weigh the same
    # Step: by the largest curvature, from a few power iterations.
    probe, curvature = np.ones(len(kept) + 1), 1.0
    for _ in range(30):
        probe /= np.linalg.norm(probe)
        bend = 0.25 * share * (x.dot(probe[:-1]) + probe[-1])
        turned = np.append(x.back(bend), bend.sum())
        if m:
            change = come.dot(probe[:-1]) - gone.dot(probe[:-1])
            turned[:-1] += 2 * penalty / m * (come.back(change) - gone.back(change))
        curvature = float(np.linalg.norm(turned))
        probe = turned
    step = 0.9 / curvature
    w, b = np.zeros(len(kept)), 0.0
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        error = share * (1 / (1 + np.exp(-np.clip(x.dot(v) + c, -60, 60))) - target)
        slope = x.back(error)
        if m:
            change = come.dot(v) - gone.dot(v)
            slope += 2 * penalty / m * (come.back(change) - gone.back(change))
        moved_w = v - step * slope
        moved_w = np.sign(moved_w) * np.maximum(np.abs(moved_w) - step * sparsity, 0)
        moved_b = c - step * error.sum()
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = moved_w + (t - 1) / following * (moved_w - w)
        c = moved_b + (t - 1) / following * (moved_b - b)
        w, b, t = moved_w, moved_b, following
    return Model({int(k): float(x) for k, x in zip(kept, w) if x}, float(b))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = MAX_ROWS, terms: list[str] | None = None, penalty: float = 1.0) -> Model:
    """Fit on at most ``max_rows`` labelled rows for which ``learn`` (over ``_id``) holds.

    Features are made on the executors; the driver gets feature numbers only, so its share is
    bounded by ``max_rows``. Without labels, or with one class only, the score is a constant.
    """
    small_batches(docs.sparkSession, 512)
    swaps = [t.lower() for t in (IDENTITY_TERMS if terms is None else terms)]
    sample = labelled_sample(docs, labels, F.col(label_col).cast("double"), learn, max_rows, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, label in zip(batch["text"], batch["label"]):
                words = words_of(text)
                gone, come = counterfactual(words, swaps) if swaps else ([], [])
                own = sorted({f for w in words for f in word_features(w)})
                out.append((label, own, [f for w in gone for f in word_features(w)], [f for w in come for f in word_features(w)]))
            yield pd.DataFrame(out, columns=["label", "own", "gone", "come"])

    made = stored(sample.mapInPandas(run, "label double, own array<int>, gone array<int>, come array<int>"), "features")  # at most max_rows
    rows, counts = label_counts(made)
    ones, zeros = (sum((c for k, c in counts.items() if (k > 0.5) == side), np.zeros(1 << BITS, np.int64)) for side in (True, False))
    n1 = sum(n for k, n in rows.items() if k > 0.5)
    total = sum(rows.values())
    if n1 in (0, total):
        return constant(n1, total)
    named = np.unique([f for t in swaps for f in word_features(t)]).astype(np.int64)
    kept = contrast(ones, zeros, n1, total - n1, MAX_FEATURES, named)
    label, lists = collected(made, kept, ["own", "gone", "come"])
    return fit_rows(lists["own"], label, lists["gone"], lists["come"], kept, penalty=penalty)
