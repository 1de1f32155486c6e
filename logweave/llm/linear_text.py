"""What the linear text classifiers share: labelled samples, hashed features, sparse sums."""

import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import small_batches

BITS = 18
WORD = re.compile(r"\w+")


@functools.lru_cache(maxsize=1 << 15)
def hashed(kind: str, token: str) -> int:
    return zlib.crc32(f"{kind} {token}".encode("utf-8", "surrogatepass")) >> (32 - BITS)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, learn: Column, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled rows, taken in order of a hash of the id.

    Ids and labels alone are ranked; the texts of the chosen ids follow by a join with a table of
    at most ``max_rows`` numbers.
    """
    named = labels.select(F.col(id_col).alias("_id"), label.alias("label")).filter("_id IS NOT NULL AND label IS NOT NULL").filter(learn)
    once = named.groupBy("_id").agg(F.max("label").alias("label"))
    chosen = once.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "_id").select("text", "label")


class Sparse:
    """Rows of feature numbers with the value 1 each."""

    def __init__(self, rows: list[np.ndarray], columns: int):
        self.size, self.columns = len(rows), columns
        self.row = np.repeat(np.arange(self.size, dtype=np.int32), [len(r) for r in rows])
        self.col = np.concatenate(rows).astype(np.int32) if len(rows) else np.zeros(0, np.int32)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.col], minlength=self.size)

    def back(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, per_row[self.row], minlength=self.columns)


def contrast(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int, most: int, always: np.ndarray | None = None) -> np.ndarray:
    """The ``most`` features whose presence differs most between two kinds of rows, by rows that have them."""
    n1, n0 = max(1, n1), max(1, n0)
    pooled = (ones + zeros) / (n1 + n0)
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n1 + 1 / n0))
    z = np.where(ones + zeros >= 3, np.abs(ones / n1 - zeros / n0) / spread, 0.0)
    best = np.argsort(-z, kind="stable")[:most]
    best = best[z[best] > 0]
    return np.unique(np.concatenate([best, always])) if always is not None else np.sort(best)


def label_counts(features: DataFrame) -> tuple[dict[float, int], dict[float, np.ndarray]]:
    """Rows of each label, and for each label the rows that have each feature (at most 2^18 numbers)."""
    rows = {r["label"]: r["count"] for r in features.groupBy("label").count().collect()}  # one row per label
    table = features.select("label", F.explode("own").alias("feature")).groupBy("label", "feature").count().toPandas()
    counts = {label: np.zeros(1 << BITS, np.int64) for label in rows}
    for label, part in table.groupby("label"):
        counts[label][part["feature"].to_numpy()] = part["count"].to_numpy()
    return rows, counts


def collected(features: DataFrame, kept: np.ndarray, lists: list[str]) -> tuple[np.ndarray, dict[str, list[np.ndarray]]]:
    """Labels and, for each list column, the places in ``kept`` of every row's features; as many rows as the sample has."""
    sent = features.sparkSession.sparkContext.broadcast(kept.astype(np.int32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.full(1 << BITS, -1, np.int32)
        place[sent.value] = np.arange(len(sent.value), dtype=np.int32)
        for batch in batches:
            out = {"label": batch["label"]}
            for name in lists:
                found = [place[np.asarray(r, np.int64)] for r in batch[name]]
                out[name] = [p[p >= 0].tobytes() for p in found]
            yield pd.DataFrame(out)

    got = features.mapInPandas(run, "label double, " + ", ".join(f"{n} binary" for n in lists)).toPandas()
    got = got.sort_values(["label", *lists], kind="stable")  # whatever order the rows came in
    return got["label"].to_numpy(float), {n: [np.frombuffer(r, np.int32) for r in got[n]] for n in lists}


def row_scores(df: DataFrame, text_col: str, score: Callable[[str], tuple], names: list[str], prepare: Callable[[], object]) -> Column:
    """A struct of doubles for each text, by ``score(prepared, text)``; a null text counts as empty."""
    small_batches(df.sparkSession, 512)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ready = prepare()
        for texts in batches:
            yield pd.DataFrame([score(ready, t or "") for t in texts], columns=names, dtype=float)
        hashed.cache_clear()  # workers live on in later stages

    return pandas_udf(run, ", ".join(f"{n} double" for n in names))(F.col(text_col))
