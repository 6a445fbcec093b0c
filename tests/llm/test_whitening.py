"""Whitening against numpy's eigenvectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.llm import whitening
from ticketloom.llm.common import table
from ticketloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def by_numpy(vectors, components=8):
    x = np.floor(1024 * np.array(vectors, dtype=float)).astype(np.int64) + 100_000
    n = len(x)
    centred = x - x.sum(axis=0) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    return centred @ directions / np.sqrt(values), values / (centred ** 2).sum() * n, ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)


def check(rows, ids, vectors, components=8):
    whitened, explained, deviation = by_numpy(vectors, components)
    found = {(r.vec_id, r.component): r for r in rows}
    number = min(components, len(vectors[0]))
    assert len(rows) == len(found) == len(ids) * number
    mine = np.array([[found[i, c].whitened for c in range(1, number + 1)] for i in ids])
    signs = np.sign((mine * whitened).sum(axis=0))
    assert np.abs(mine * signs - whitened).max() < 1e-9
    assert np.allclose([found[ids[0], c].explained for c in range(1, number + 1)], explained, rtol=1e-10)
    assert [found[i, 1].deviation for i in ids] == deviation.tolist()
    assert all(r.n == len(ids) and r.identity_error < 1e-9 for r in rows)


def test_query(spark):
    vectors = {r.vec_id: r.embedding for r in table(spark, SF_DIR, "embeddings").collect()}
    check(QUERIES["op12_embedding_whitening"](spark, SF_DIR).collect(), list(vectors), list(vectors.values()))


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    good += [(100, good[0][1]), (101, good[0][1]), (102, [0.0] * 5)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [0.0, float("inf"), 0.0, 0.0, 0.0]), (204, []),
           (205, [1.0] * 4), (206, [1.0] * 6), (207, [1e30, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("x", "keys", "n", "_key")})
    check(whitening.whiten(df.repartition(3), "vec_id", "embedding").collect(), [i for i, _ in good], [v for _, v in good])


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(df, "vec_id", "embedding").collect() == []


def test_repeated_and_null_keys_and_equal_eigenvalues(spark):
    corners = [(k, [s if i == j else 0.0 for j in range(6)]) for k, (i, s) in enumerate((i, s) for i in range(6) for s in (-1.0, 1.0))]
    rows = [(None, v) for _, v in corners] + [(7, v) for _, v in corners]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
    assert len(found) == 24 * 6 and {r.component for r in found} == set(range(1, 7))
    assert max(r.identity_error for r in found) < 1e-9 and np.allclose([r.explained for r in found], 1 / 6)


def test_components_without_deviation_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding").collect()
    assert {r.component for r in found} == {1} and abs(found[0].explained - 1) < 1e-12


def test_deviations_beyond_a_long(spark):
    rows = [(0, [2.0 ** 40, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])]
    found = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
             if r.component == 1}
    assert all(r.deviation is None for r in found.values()) and found[0].distance == pytest.approx((2.0 ** 51 / 3) ** 2)
    model = whitening.Whitening(3, [3, 6], np.zeros((2, 0)), np.zeros(0), np.zeros(0))
    largest = int((2 ** 63 - 1) ** 0.5) // 3
    exact, _ = model.deviations(np.array([[largest, 2], [largest + 2, 2], [1, 2]]))
    assert exact == [(3 * largest - 3) ** 2, None, 0]


@pytest.mark.parametrize("values", [np.linspace(9, 1, 60), np.array([9.0, 9, 9, 5, 5, 4, 3, 2, 1, 1] + [0.01] * 50), np.array([5.0] * 12 + [1e-3] * 48),
                                    np.geomspace(1, 1e-7, 60), np.array([3.0, 2.0, 1.0] + [0.0] * 57)])
def test_bidiagonalisation(values):
    """Leading values with their multiplicity, in fewer steps than dimensions where they converge."""
    rng = np.random.default_rng(5)
    left, right = (np.linalg.qr(rng.normal(size=(m, 60)))[0] for m in (300, 60))
    x = left @ np.diag(values) @ right.T

    def product(v, p, g):
        u = x @ v - (x @ p) @ g
        return x.T @ u, (x @ p).T @ u, u @ u

    v, b = whitening.bidiagonalise(product, 60, 8, np.linalg.norm(x))
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-12 and not np.triu(b, 2).any() and not np.tril(b, -1).any()
    assert np.allclose(np.linalg.svd(b)[1][:8], values[:8], rtol=1e-9, atol=1e-9)
    turned = v @ np.linalg.svd(b)[2][:8].T
    assert np.allclose(np.linalg.norm(x @ turned, axis=0), values[:8], rtol=1e-9, atol=1e-9)
