"""Embedding whitening by shifted Cholesky QR.

Vectors are centred and never gathered: each pass multiplies the Gram matrix of the rows, task by
task, and its Cholesky factor orthogonalises the rows of the next pass through triangular solves.
A shift keeps the first factor positive definite whatever the condition of the data; further
passes remove what the shift left. The composed factors hold the whole geometry of the rows in one
small triangle, whose singular vectors are the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

SCALE = 256
MAX_PASSES = 6
BATCH_ROWS = 2048


def finite(vector: Column) -> Column:
    """True if the vector is there and every entry is a finite number."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def rows_of(batch: pa.RecordBatch, column: int, dims: int) -> np.ndarray:
    """A column of equally long arrays as an int64 matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _in_batches(df: DataFrame):
    """Arrow batches of at most so many rows while ``df`` runs; the session's own setting may be smaller."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return df


def exact_sums(fit: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """Number of vectors, exact sum of each dimension and the largest absolute entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch, 0, dims)
            # Halves are summed apart, so that no sum can overflow.
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dims)), pa.array(high), pa.array(low), pa.array(np.full(dims, len(x))), pa.array(np.abs(x.astype(np.float64)).max(axis=0))],
                names=["d", "high", "low", "n", "top"],
            )

    partial = _in_batches(fit.select("x")).mapInArrow(run, "d long, high long, low long, n long, top double")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = sorted(partial.groupBy("d").agg(whole("high"), whole("low"), F.sum("n").alias("n"), F.max("top").alias("top")).collect())
    if not found:
        return 0, [], 0
    return found[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in found], int(max(r["top"] for r in found))


def centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) - mean


def solve_right(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows @ inverse(upper) by substitution, column by column for all rows at once."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def gram(fit: DataFrame, dims: int, transform) -> np.ndarray:
    """Sum over all vectors of the outer product of ``transform(rows)``; one partial matrix per task goes into the shuffle."""
    width = transform(np.zeros((1, dims), np.int64)).shape[1]
    above = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            q = transform(rows_of(batch, 0, dims))
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(above[0]), pa.array(above[1]), pa.array(total[above])], names=["i", "j", "v"])

    partial = _in_batches(fit.select("x")).mapInArrow(run, "i long, j long, v double")
    out = np.zeros((width, width))
    for r in partial.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # width * (width + 1) / 2 rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def shift(g: np.ndarray, n: int) -> float:
    """Enough to keep the factor of a rounded Gram matrix positive definite."""
    d = len(g)
    return 11.0 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * max(np.linalg.norm(g, 2), np.finfo(float).tiny)


def shifted_cholesky_qr(fit: DataFrame, dims: int, mean: np.ndarray, n: int, tolerance: float = 1e-13) -> np.ndarray:
    """A matrix R with R'R equal to the Gram matrix of the centred rows, however ill-conditioned they are.

    Passes go on until the rows are orthonormal; directions in which the rows do not extend at all
    can never become so, and are told by an eigenvalue near zero. What then differs from the
    identity is put into the result, so it is right after the last pass even if it came early.
    """
    factors: list[np.ndarray] = []
    for _ in range(MAX_PASSES):
        done = list(factors)

        def orthogonalise(x: np.ndarray) -> np.ndarray:
            rows = centred(x, mean)
            for factor in done:
                rows = solve_right(rows, factor)
            return rows

        g = gram(fit, dims, orthogonalise)
        values, vectors = np.linalg.eigh(g)
        off = np.where(values > 0.5, np.abs(values - 1), np.abs(values))
        if factors and off.max() <= max(tolerance, 4 * dims * np.finfo(float).eps):
            break
        if len(factors) == MAX_PASSES - 1:
            break
        try:
            if not factors:
                raise np.linalg.LinAlgError  # the first factor is always shifted
            factors.append(np.linalg.cholesky(g).T)
        except np.linalg.LinAlgError:
            factors.append(np.linalg.cholesky(g + shift(g, n) * np.eye(dims)).T)
    composed = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    for factor in reversed(factors):
        composed = composed @ factor
    return composed


@dataclass(frozen=True)
class Model:
    """Whitening of quantised vectors: row i of ``components`` is the unit vector of the i-th largest eigenvalue."""

    n: int
    sums: list[int]
    top: int
    mean: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    usable: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; nan along components without extent."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = centred(x, self.mean) @ self.components.T / np.sqrt(self.eigenvalues)
        return np.where(self.usable, scaled, np.nan)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2, exactly."""
        reach = self.n * max(int(np.abs(x).max(initial=0)), self.top) + max(map(abs, self.sums), default=0)
        if reach * reach * max(len(self.sums), 1) < 1 << 62:
            return ((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]


def prepare(vectors: DataFrame, vector_col: str, id_col: str, scale: int) -> tuple[DataFrame, int]:
    """Stored rows (id, x) of usable vectors, and their number of dimensions."""
    whole = vectors.filter(finite(F.col(vector_col))).select(F.col(id_col), quantised(F.col(vector_col), scale).alias("x"))
    rows = stored(whole, "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(2).collect()
    dims = sizes[0]["d"] if sizes else 0
    return (rows if len(sizes) < 2 else rows.filter(F.size("x") == dims)), dims


def fit(rows: DataFrame, dims: int, components: int) -> tuple[Model, DataFrame]:
    """The model, and the stored list of distinct vectors it was fitted on."""
    distinct = stored(rows.select("x").distinct(), "distinct-vectors")
    n, sums, top = exact_sums(distinct, dims) if dims else (0, [], 0)
    if not n:
        none = np.zeros(0)
        return Model(0, sums, 0, none, np.zeros((0, dims)), none, none, none.astype(bool)), distinct
    mean = np.array([s / n for s in sums])
    r = shifted_cholesky_qr(distinct, dims, mean, n)
    _, singular, directions = np.linalg.svd(r)
    values = singular**2 / n
    kept = min(components, dims)
    usable = singular[:kept] > singular[0] * dims * 1e-13
    explained = values[:kept] / values.sum() if values.sum() > 0 else np.full(kept, np.nan)
    return Model(n, sums, top, mean, directions[:kept], values[:kept], explained, usable & (singular[0] > 0)), distinct


def identity_error(model: Model, distinct: DataFrame, dims: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, over components with extent."""
    used = int(model.usable.sum())
    if not used:
        return None

    def with_one(x: np.ndarray) -> np.ndarray:
        w = model.project(x)[:, model.usable]
        return np.hstack([w, np.ones((len(w), 1))])

    g = gram(distinct, dims, with_one) / model.n
    return float(np.abs(g[:used, :used] - np.outer(g[:used, used], g[:used, used]) - np.eye(used)).max())


def whiten(
    vectors: DataFrame, components: int = 4, vector_col: str = "embedding", id_col: str = "vec_id", scale: int = SCALE,
) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error) for each usable vector and component.

    Vectors that are null or hold a null or non-finite entry are dropped; of several lengths the
    commonest is taken (the longer one if they tie) and rows of another length are dropped too, as
    they have no place in the space. Entries become floor(``scale`` * c). The components come from
    the distinct vectors, so a vector with any number of copies weighs as one; every row, copies
    and null ids included, is returned. Component and eigenvector signs are arbitrary. Where the
    vectors have no extent along a component its ``whitened`` is null, as is ``explained`` if they
    have none at all. ``deviation`` is null where it exceeds a long. An empty table, or vectors without
    entries, give no rows. Other columns are left out.
    """
    rows, dims = prepare(vectors, vector_col, id_col, scale)
    model, distinct = fit(rows, dims, components)
    error = identity_error(model, distinct, dims)
    width = len(model.eigenvalues)
    name = rows.schema[id_col]
    limit = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch, 1, dims)
            each = np.repeat(np.arange(len(x)), width)
            far = [d if d <= limit else None for d in model.deviation(x)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), model.n)),
                    pa.array(far, type=pa.int64()).take(pa.array(each)),
                    pa.array(model.project(x).ravel(), from_pandas=True),
                    pa.array(np.tile(model.explained, len(x)), from_pandas=True),
                    pa.array([error] * len(each), type=pa.float64()),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = name.dataType.simpleString()
    out = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return _in_batches(rows.filter(F.lit(width > 0))).mapInArrow(run, out)
