"""Operator 11 against NumPy and exact integers."""

import math

import numpy as np
import pytest

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, n long, component string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 0, 7, "x") for i, v in zip(ids, vectors, strict=True)], SCHEMA).repartition(3)


def check(spark, vectors, kept):
    """The result for the rows of ``vectors``, of which those named take part."""
    got = {}
    for r in whitening.whiten(frame(spark, vectors)).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(kept)
    x = [[math.floor(1024 * float(c)) + 100_000 for c in vectors[i]] for i in kept]
    n, width = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(width)]
    c = np.array(x, float) - np.array(sums) / n
    covariance = c.T @ c / n
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    for i, row in zip(kept, x, strict=True):
        assert set(got[i]) == set(range(1, min(8, width) + 1))
        exact = sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))
        assert all(r.deviation == (exact if exact < 2**63 else None) and r.n == n for r in got[i].values())
    for k in range(min(8, width)):
        column = np.array([np.nan if got[i][k + 1].whitened is None else got[i][k + 1].whitened for i in kept])
        assert abs(got[kept[0]][k + 1].explained - values[k] / values.sum()) < 1e-9
        if values[k] > 1e-6:
            want = c @ vectors_[:, k] / math.sqrt(values[k])
            assert min(np.abs(column - want).max(), np.abs(column + want).max()) < 1e-7
        else:
            assert np.isnan(column).all()
    errors = {r.identity_error for rows in got.values() for r in rows.values()}
    assert len(errors) == 1 and errors.pop() < 1e-4


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    good = (rng.standard_normal((60, 11)) @ rng.standard_normal((11, 11)) * 0.3).tolist()
    odd = [None, [], [None] * 11, [math.nan] + [0.0] * 10, [math.inf] + [0.0] * 10, [1.0] * 10, good[3], good[3]]
    check(spark, good + odd, [*range(60), 66, 67])


def test_whitening_of_few_and_constant_dimensions(spark):
    check(spark, [[1.0, 2.0, 3.0], [1.0, 2.5, 3.0], [1.0, 2.5, 1.0]], [0, 1, 2])


def test_deviations_beyond_a_long_are_null(spark):
    rng = np.random.default_rng(6)
    wide = (rng.standard_normal((9, 3)) * 3e6).tolist()
    check(spark, [*wide, [1e3, 2e3, -1e3]], list(range(10)))


def test_one_row_copies_and_no_rows(spark):
    one = whitening.whiten(frame(spark, [[0.5, 0.25]])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    same = whitening.whiten(frame(spark, [[0.5, 0.25]] * 3, [1, 1, None])).collect()
    assert len(same) == 6 and {r.vec_id for r in same} == {1, None}
    empty = whitening.whiten(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(frame(spark, [None, []])).collect() == []


@pytest.mark.parametrize("width", [1, 9])
def test_upper_triangle_names_every_pair_once(width):
    names = [f"d{i}" for i in range(width)]
    assert len(set(whitening.upper_triangle(names))) == width * (width + 1) // 2
