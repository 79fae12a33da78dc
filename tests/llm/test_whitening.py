import math
from fractions import Fraction

import numpy as np
import pytest

from clustervitals.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, id int"


def leverrier(matrix):
    """det(x - matrix), lowest power first, by traces of powers in integers."""
    d = len(matrix)
    a, out = np.array(matrix, object), [0] * d + [1]
    m = np.zeros((d, d), object)
    for k in range(1, d + 1):
        m = a @ m + np.array([[out[d - k + 1] * (i == j) for j in range(d)] for i in range(d)], object)
        out[d - k] = -int((a @ m).trace()) // k
    return out


def positive_matrix(rng, d, size=50, rank=None):
    x = rng.integers(-size, size, (rank or d + 3, d)).astype(object)
    return (x.T @ x).tolist()


def test_sums_of_products_are_exact():
    rng = np.random.default_rng(3)
    for top in (10, 1 << 19, 1 << 40, 1 << 62):
        y = rng.integers(-top, top, (300, 3))
        assert (whitening.exact_products(y) == y.astype(object).T @ y.astype(object)).all()
    for v in (0, -1, 1 << 100, -(1 << 100) + 12345):
        assert sum(x << (40 * k) for k, x in enumerate(whitening._limbs(v))) == v


@pytest.mark.parametrize("d, rank", [(1, None), (2, None), (5, None), (9, None), (6, 2), (4, 1)])
def test_polynomial_equals_the_one_by_traces(spark, d, rank):
    matrix = positive_matrix(np.random.default_rng(d), d, rank=rank)
    assert whitening.characteristic_polynomial(spark, matrix) == leverrier(matrix)
    holes = [[x if (i + j) % 2 == 0 else 0 for j, x in enumerate(row)] for i, row in enumerate(matrix)]
    for p in (2_147_483_647, 1_000_003):
        found = whitening.polynomial_modulo((np.array(holes, object) % p).astype(np.int64), p)
        assert found == [c % p for c in leverrier(holes)]


def product(roots):
    poly = [1]
    for r in roots:
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
    return poly


def test_roots_are_counted_isolated_and_narrowed():
    roots = [0, 0, 3, 7, 7, 7, 1000, 10**30, 10**30 + 1]
    poly = product(roots)
    for t in (0, 2, 3, 6, 7, 999, 10**30 - 1, 10**30, 10**30 + 1):
        assert whitening.roots_beyond(poly, t) == sum(r > t for r in roots)
    found = whitening.largest_roots(poly, 9)
    assert [r.count for r in found] == [1, 1, 1, 3, 1]
    for r, true in zip(found, [10**30 + 1, 10**30, 1000, 7, 3]):
        assert abs(r.value() - true) <= Fraction(true, 1 << 100)
    assert [r.count for r in whitening.largest_roots(poly, 2)] == [1, 1]
    assert whitening.largest_roots(product([0, 0]), 3) == []
    # 2 - sqrt(2) and 2 + sqrt(2)
    high, low = whitening.largest_roots([2, -4, 1], 2)
    assert abs(float(high.value()) - 2 - math.sqrt(2)) < 1e-15 and abs(float(low.value()) - 2 + math.sqrt(2)) < 1e-15


def test_components_of_nearly_equal_roots(spark):
    """Eigenvalues that differ by one in 10^24 still get their own components."""
    rotation = [[2, 1, 2], [-2, 2, 1], [1, 2, -2]]  # orthogonal rows of length 3
    values = [10**24 + 1, 10**24, 5]
    matrix = [[sum(values[k] * rotation[k][i] * rotation[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    roots = whitening.largest_roots(whitening.characteristic_polynomial(spark, matrix), 3)
    for axis, row in zip(whitening._axes(spark, matrix, roots), rotation):
        assert abs(abs(np.dot(axis, row)) / 3 - 1) < 1e-15


def expected(rows, components):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} by floating-point eigenvectors."""
    kept = [(k, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for dim in {len(x) for _, x in kept}:
        x = np.array([x for _, x in kept if len(x) == dim], np.int64)
        n, s = len(x), x.sum(axis=0)
        centred = x - s / n
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        for (key, _), own, c in zip([r for r in kept if len(r[1]) == dim], x, centred):
            for k in range(min(components, dim)):
                e = values[-1 - k]
                if e > 1e-6:
                    dev = sum((n * int(a) - int(b)) ** 2 for a, b in zip(own, s))
                    out[key, k + 1] = (n, dev, abs(c @ vectors[:, -1 - k]) / math.sqrt(e), e / values.sum())
    return out


def check(found, want):
    assert {(r.vec_id, r.component) for r in found} == set(want)
    for r in found:
        n, dev, z, share = want[r.vec_id, r.component]
        assert r.n == n and r.deviation == dev and abs(abs(r.whitened) - z) < 1e-6 and abs(r.explained / share - 1) < 1e-9
        assert r.identity_error < 1e-9


def test_rows_equal_floating_point_eigenvectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=5).round(3).tolist()) for k in range(300)]
    rows += [(1000 + k, rng.normal(size=2).round(3).tolist()) for k in range(20)]  # another length
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0]), (2003, [math.nan] * 5), (2004, [math.inf, 0.0, 0.0, 0.0, 0.0]), (2005, [1e30, 0.0])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    check(whitening.whiten(df, components=3).collect(), expected(rows[:-1], 3))


def test_equal_directions_repeated_rows_null_keys_and_little_data(spark):
    square = [(k, [float(a), float(b)]) for k, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]

    def whitened(rows):
        return whitening.whiten(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)).collect()

    # Both eigenvalues are equal: any basis, but an orthonormal one.
    found = whitened(square + square + [(None, [1.0, 0.0]), (None, [-1.0, 0.0]), (None, [0.0, 1.0]), (None, [0.0, -1.0])])
    assert len(found) == 24 and all(r.identity_error < 1e-12 and r.n == 12 and abs(r.explained - 0.5) < 1e-12 for r in found)
    assert whitened([]) == [] == whitened([(1, [1.0, 2.0])]) == whitened([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    # One direction only: one component.
    assert sorted((r.vec_id, r.component, abs(r.whitened)) for r in whitened([(1, [0.0, 1.0]), (2, [0.0, 3.0])])) == [(1, 1, 1.0), (2, 1, 1.0)]


def test_large_components_stay_exact(spark):
    rows = [(1, [2.0**40, 1.0]), (2, [-(2.0**40), 2.0]), (3, [0.0, 2.0**51])]
    found = whitening.whiten(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)).collect()
    whole = {k: [math.floor(1024 * c) for c in v] for k, v in rows}
    sums = [sum(v[i] for v in whole.values()) for i in range(2)]
    assert {(r.vec_id, int(r.deviation)) for r in found} == {(k, sum((3 * a - b) ** 2 for a, b in zip(v, sums))) for k, v in whole.items()}
    assert all(r.identity_error < 1e-9 for r in found)


def test_query_equals_floating_point_on_given_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, sf_dir, "embeddings").collect()]
    found = queries.QUERIES["op12_whitening"](spark, sf_dir)
    assert dict(found.dtypes)["deviation"] == "bigint"
    check(found.collect(), expected(rows, 8))
