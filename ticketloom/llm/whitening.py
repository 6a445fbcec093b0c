"""Embedding whitening (operator 12): Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries become whole numbers, x = floor(``SCALE`` c) + ``SHIFT``, so sums and means are exact. For the centred
rows X, the bidiagonalisation X V = U B takes in turn u = X v and v = X^T u, each made orthogonal to all
earlier ones, twice. A step is one Spark job: tasks form X v and X^T u block by block, and only sums as long
as the dimension come back. The right vectors V stay on the driver. A left vector has an entry per row, so none is
stored: each is X p for a short vector p, and a task forms the entries of its own rows again when it needs them.
The singular vectors of the small bidiagonal B give the components, its singular values the deviations.

A step whose remainder vanishes (relative to ``BREAKDOWN``) begins again at a random direction orthogonal to V, so equal
eigenvalues are found as often as they occur. At most as many steps are made as there are dimensions; before that
it ends only if the leading components have converged to ``CONVERGED``, and have been confirmed by a fresh direction
whose own largest value has converged below them.

Rows are kept as blocks of whole numbers, packed, in a stored table that every step reads.

Defined cases: rows whose vector is null, or has a null or non-finite entry, are left out; so are rows with an entry of
2^51 or more, whose x is no long, and rows of another length than the commonest (of equally common ones the
longest). Where all remaining rows are equal, or only one remains, no component has a deviation and there is no row; a
component without a deviation is left out in the same way. ``deviation`` is null where its exact value is no long;
``distance`` has it over n^2 as a double. Rows that repeat count each; a null key is a row like any other; an empty
table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
BREAKDOWN = 1e-12
CONVERGED = 1e-15
SEED = 11
_LARGEST = float(1 << 51)
_BLOCK_BYTES = 1 << 21
_LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """The fit: n rows, exact sums by dimension, components as columns, their eigenvalues and shares."""
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0
    steps: int = 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean. The whole part is taken off exactly, so that one rounding remains."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """For each row the sum of (n x - S)^2, exactly, None beyond a long; and the same over n^2."""
        distance = (self.centred(x) ** 2).sum(axis=1)
        whole, rest = (np.array([f(s, self.n) for s in self.sums], dtype=np.int64) for f in (lambda s, n: s // n, lambda s, n: s % n))
        # Whole-number arithmetic wraps at 64 bits and is right wherever the result has 63.
        wrapped = (((x - whole) * np.int64(self.n) - rest) ** 2).sum(axis=1).tolist()
        rough = distance * float(self.n) ** 2
        found: list[int | None] = []
        for row, (value, size) in enumerate(zip(wrapped, rough.tolist())):
            if size > 0.99 * _LONG:
                value = sum((self.n * int(a) - s) ** 2 for a, s in zip(x[row].tolist(), self.sums)) if size < 1.01 * _LONG else None
                value = None if value is None or value > _LONG else value
            found.append(value)
        return found, distance


def usable(vector: Column, dimension: int) -> Column:
    bad = F.exists(vector, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= _LARGEST))
    return vector.isNotNull() & (F.size(vector) == dimension) & ~bad


def blocks_of(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(keys, x): rows in blocks of bounded size, x as 64-bit numbers row by row; and the dimension."""
    rows = df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vector"))
    fine = rows.filter(usable(F.col("_vector"), F.size("_vector")))
    lengths = fine.groupBy(F.size("_vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d"))
    first = lengths.first()
    dimension = first["d"] if first else 0
    whole = F.transform("_vector", lambda e: F.floor(e * F.lit(float(SCALE))) + F.lit(SHIFT))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, _BLOCK_BYTES // (8 * max(dimension, 1)))
        for batch in (b.slice(k, most) for b in batches for k in range(0, b.num_rows, most)):
            keys, x = batch.column("_key"), batch.column("x").flatten().to_numpy().astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                                              pa.array([x.tobytes()], pa.binary())], names=["keys", "x"])

    schema = T.StructType([T.StructField("keys", T.ArrayType(df.schema[key].dataType)), T.StructField("x", T.BinaryType())])
    kept = fine.filter(F.size("_vector") == dimension).filter(F.lit(dimension > 0))
    return kept.select("_key", whole.alias("x")).mapInArrow(gather, schema), dimension


def _sums(blocks: DataFrame, dimension: int, compute: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all blocks of a short vector each, added up in tasks and then in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("x"):
                found = compute(np.frombuffer(data.as_buffer(), dtype="<i8").reshape(-1, dimension))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["place", "value"])

    rows = blocks.select("x").mapInArrow(run, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value"))
    return np.array([r["value"] for r in sorted(rows.collect(), key=lambda r: r["place"])])


def _random_direction(rng: np.random.Generator, v: np.ndarray) -> np.ndarray:
    """A unit vector orthogonal to the columns of v."""
    fresh = rng.normal(size=v.shape[0])
    for _ in range(3):
        fresh -= v @ (v.T @ fresh)
        fresh /= np.linalg.norm(fresh)
    return fresh


def bidiagonalise(product: Callable, dimension: int, wanted: int, size: float, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """V (orthonormal columns) and B (upper bidiagonal) with X V = U B.

    ``product(v, p, g)`` returns, for u = X v - (X p) g, the vector X^T u, the vector (X p)^T u and the number u^T u.
    ``size`` is the Frobenius norm of X.
    """
    rng, none = np.random.default_rng(seed), np.zeros((dimension, 0))
    v, p, z = none, none, none  # right vectors; u = X p; z = X^T u
    b, start, least, confirming = np.zeros((dimension, dimension)), 0, BREAKDOWN * size, False
    new = _random_direction(rng, none)
    for j in range(dimension):
        v = np.column_stack((v, new))
        g = z.T @ new
        back, again, square = product(new, p, g)
        # What is left of the earlier left vectors is taken off once more.
        alpha = float(np.sqrt(max(0.0, square - again @ again)))
        b[j, j] = alpha if alpha > least else 0.0
        if b[j, j]:
            p = np.column_stack((p, (new - p @ (g + again)) / alpha))
            z = np.column_stack((z, (back - z @ again) / alpha))
        else:
            p, z = (np.column_stack((m, np.zeros(dimension))) for m in (p, z))
        rest = z[:, j] - b[j, j] * new
        for _ in range(2):
            rest = rest - v @ (v.T @ rest)
        beta = float(np.linalg.norm(rest))
        if j + 1 == dimension:
            break
        state = _state(b[:j + 1, :j + 1], beta, start, wanted)
        if state == "done" and confirming:
            return v, b[:j + 1, :j + 1]
        if beta <= least or (state == "done" and not confirming) or state == "more":
            confirming = state in ("done", "more")
            start, new = j + 1, _random_direction(rng, v)
        else:
            b[j, j + 1], new = beta, rest / beta
    return v, b[:j + 1, :j + 1]


def _state(b: np.ndarray, beta: float, start: int, wanted: int) -> str:
    """"done" if the leading components have converged and the run that began at ``start`` says so by its own
    largest value, "more" if that run has converged to a value among the leading ones, else "open"."""
    left, values, _ = np.linalg.svd(b)
    if len(b) < wanted or not values[0] or (beta * np.abs(left[-1, :wanted]) > CONVERGED * values[0]).any():
        return "open"
    if not start:
        return "done"
    own_left, own, _ = np.linalg.svd(b[start:, start:])
    if beta * abs(own_left[-1, 0]) > 1e-6 * max(own[0], BREAKDOWN * values[0]):
        return "open"
    return "done" if own[0] < values[wanted - 1] * (1 - 1e-6) else "more"


def fit(blocks: DataFrame, dimension: int, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of stored ``blocks``; None if there are none with a deviation."""
    if not dimension:
        return None
    counted = _sums(blocks, dimension, lambda x: np.concatenate(([len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))), "long")
    if not len(counted):
        return None
    n = int(counted[0])
    sums = [(int(high) << 32) + int(low) for high, low in zip(counted[1:1 + dimension], counted[1 + dimension:])]
    shape = Whitening(n, sums, np.zeros((dimension, 0)), np.zeros(0), np.zeros(0))
    total = float(_sums(blocks, dimension, lambda x: np.array([(shape.centred(x) ** 2).sum()]))[0])
    if total == 0:
        return None

    def product(v: np.ndarray, p: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def step(x: np.ndarray) -> np.ndarray:
            rows = shape.centred(x)
            earlier = rows @ p
            u = rows @ v - earlier @ g
            return np.concatenate((rows.T @ u, earlier.T @ u, [u @ u]))

        sent = _sums(blocks, dimension, step)
        return sent[:dimension], sent[dimension:-1], float(sent[-1])

    v, b = bidiagonalise(product, dimension, min(components, dimension), float(np.sqrt(total)))
    _, deviations, turned = np.linalg.svd(b)
    kept = deviations[:components] > BREAKDOWN * np.sqrt(total)
    right = np.linalg.qr(v @ turned[:components][kept].T)[0]
    eigenvalues = deviations[:components][kept] ** 2 / n
    model = Whitening(n, sums, right, eigenvalues, eigenvalues / (total / n), steps=len(b))
    mean = _sums(blocks, dimension, lambda x: model.whitened(x).sum(axis=0)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        apart = model.whitened(x) - mean
        return (apart.T @ apart).ravel()

    covariance = _sums(blocks, dimension, spread).reshape(len(mean), -1) / n
    model.identity_error = float(np.abs(covariance - np.eye(len(mean))).max())
    return model


def whiten(df: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error and distance: a row for
    each row and component."""
    blocks, dimension = blocks_of(df, key, vector)
    blocks = stored(blocks, "vectors")
    model = fit(blocks, dimension, components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, data in zip(batch.column("keys"), batch.column("x") if model else ()):
                x = np.frombuffer(data.as_buffer(), dtype="<i8").reshape(-1, dimension)
                values, (exact, distance) = model.whitened(x), model.deviations(x)
                rows, number = values.shape
                at = pa.array(np.repeat(np.arange(rows), number))
                yield pa.RecordBatch.from_arrays(
                    [keys.values.take(at), pa.array(np.tile(np.arange(1, number + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * number, model.n, dtype=np.int64)), pa.array(exact, pa.int64()).take(at), pa.array(values.ravel()),
                     pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * number, model.identity_error)),
                     pa.array(np.repeat(distance, number))], names=schema.names)

    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", long),
                           T.StructField("deviation", long), T.StructField("whitened", double), T.StructField("explained", double),
                           T.StructField("identity_error", double), T.StructField("distance", double)])
    return blocks.mapInArrow(project, schema)
