from __future__ import annotations

import math

import numpy as np
import pytest

from parleystat.llm import feast, queries, whitening
from parleystat.llm.common import table

RNG = np.random.default_rng(5)


def turned(values):
    q, _ = np.linalg.qr(RNG.normal(size=(len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "matrix",
    [
        np.array([[3.0]]),
        turned([4.0, 1.0, 0.25]),
        turned(np.arange(1.0, 41)),
        turned([1e6, 17000.1, 17000.0, *range(16000, 15960, -1)]),
        turned([5.0, 5, 5, 4, 4, 3, 3, 3, 3, 3, 3, 2, 1]),
        np.eye(20) * 3,
        turned([9.0, 4.0, 1.0] + [0.0] * 12),
        (lambda a: a.T @ a)(RNG.normal(size=(300, 64)) * 130),
    ],
)
def test_leading_against_the_library(matrix):
    values, vectors = feast.leading(matrix, 8)
    want = np.linalg.eigvalsh(matrix)[::-1]
    rank = min(8, int((want > len(matrix) * 1e-15 * want[0]).sum()))
    assert len(values) == rank
    assert values == pytest.approx(want[:rank], rel=1e-12)
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-13 * want[0] * len(matrix)
    assert np.abs(vectors.T @ vectors - np.eye(rank)).max() < 1e-13


def test_inertia_counts():
    matrix = turned([-2.0, -1, 0.5, 3, 3, 7])
    diagonal, side = feast.tridiagonal(matrix)
    assert [feast.below(diagonal, side, s) for s in (-3, -1.5, 0, 1, 3.1, 8)] == [0, 1, 2, 3, 5, 6]


def test_a_zero_matrix_has_no_components():
    assert feast.leading(np.zeros((4, 4)), 8)[0].size == 0


def brute(rows, most=8):
    """All columns but the sign from plain numpy and whole numbers."""
    rows = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    x = [[math.floor(1024 * float(e)) + 100000 for e in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float((e * n - s)) / n for e, s in zip(v, sums)] for v in x])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    z = centred @ vectors[:, ::-1][:, :most] / np.sqrt(values[::-1][:most])
    return [i for i, _ in rows], n, [sum((e * n - s) ** 2 for e, s in zip(v, sums)) for v in x], z, values[::-1][:most] / values.sum()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, folder):
    rows = [tuple(r) for r in table(spark, folder, "embeddings").select("vec_id", "embedding").collect()]
    ids, n, deviation, z, explained = brute(rows)
    found = queries.op12_whitening(spark, folder).collect()
    assert len(found) == 8 * len(ids) and {r.n for r in found} == {n}
    assert {r.vec_id: r.deviation for r in found} == dict(zip(ids, deviation))
    got = {(r.vec_id, r.component): r.whitened for r in found}
    got = np.array([[got[i, c] for c in range(1, 9)] for i in ids])
    signs = np.sign((got * z).sum(axis=0))
    assert np.abs(got * signs - z).max() < 1e-9
    assert {r.component: r.explained for r in found} == pytest.approx(dict(enumerate(explained.tolist(), 1)), rel=1e-9)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


SCHEMA = "vec_id long, embedding array<float>, n int, component string, _where string"


def made(spark, vectors):
    return spark.createDataFrame([(k, v, None, "x", "") for k, v in enumerate(vectors)], SCHEMA)


def whitened(spark, vectors):
    frame = made(spark, vectors)
    model = whitening.fit(frame, "embedding")
    return model, whitening.identity_error(frame, "embedding", model), whitening.whiten(frame, "vec_id", "embedding", model).collect()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    kept = [[0.1, 0.2, 0.3], [0.1, 0.2, 0.3], [0.4, -0.2, 1.3], [2.0, 0.0, 0.1], [-1.0, 0.6, 0.2]]
    odd = [None, [], [None, 1.0, 2.0], [nan, 1.0, 2.0], [inf, 1.0, 2.0], [1.0, 2.0], [3e38, 1.0, 1.0], [1.0] * 4]
    model, error, rows = whitened(spark, kept + odd)
    ids, n, deviation, z, explained = brute([(k, [np.float32(e) for e in v]) for k, v in enumerate(kept)], 3)
    assert model.count == n == 5 and error < 1e-12 and len(rows) == 15 and {r.vec_id for r in rows} == set(ids)
    assert {r.vec_id: r.deviation for r in rows} == dict(enumerate(deviation))
    assert [r.explained for r in rows if r.vec_id == 0] == pytest.approx(explained.tolist())
    assert [r.whitened for r in rows[:3]] == pytest.approx([r.whitened for r in rows[3:6]])  # equal rows, equal results
    for few in ([], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 4):
        model, error, rows = whitened(spark, few)
        assert (len(model.values), error, rows) == (0, 0.0, [])


def test_a_line_of_points_has_one_component(spark):
    model, error, rows = whitened(spark, [[float(k), 2.0 * k, 0.0] for k in range(6)])
    assert len(model.values) == 1 and error < 1e-12
    assert [r.explained for r in rows] == pytest.approx([1.0] * 6)


def test_deviations_beyond_a_long_are_null():
    whole = np.array([[1 << 40, 0], [5, 7]], np.int64)
    got = whitening.deviations(whole, 4, (10, 20)).to_pylist()
    assert got == [None, (5 * 4 - 10) ** 2 + (7 * 4 - 20) ** 2]
