import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from raremill.llm import catalog, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 7) for i, v in vectors], SCHEMA)


def exact_covariance(x):
    n = len(x)
    s = [sum(c) for c in zip(*x, strict=True)]
    off = [[n * a - b for a, b in zip(row, s, strict=True)] for row in x]
    d = len(s)
    return np.array([[float(Fraction(sum(o[i] * o[j] for o in off), n**3)) for j in range(d)] for i in range(d)])


def spectra():
    """Matrices with wide, equal, zero and clustered eigenvalues."""
    draw = np.random.default_rng(3)
    for d in (1, 2, 3, 9, 40):
        for values in (
            draw.random(d), np.ones(d), 10.0 ** -np.arange(d), np.r_[5.0, np.zeros(d - 1)],
            1 + 1e-12 * np.arange(d), 1e9 * draw.random(d) ** 6, np.repeat([3.0, 2.0], [d // 2, d - d // 2]),
        ):
            q, _ = np.linalg.qr(draw.standard_normal((d, d)))
            yield (q * values) @ q.T
        yield np.diag(draw.random(d))


def test_eigenpairs_match_numpy():
    for a in spectra():
        a = (a + a.T) / 2
        k = min(8, len(a))
        values, vectors = whitening.leading_eigenpairs(a, 8)
        want = np.linalg.eigvalsh(a)[::-1][:k]
        size = np.abs(a).max()
        assert np.abs(values - want).max() <= 1e-13 * len(a) * size
        assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-12
        assert np.abs(vectors @ a - values[:, None] * vectors).max() <= 2e-13 * len(a) * size


def test_sturm_counts():
    main, off = np.array([2.0, 2.0, 2.0]), np.array([1.0, 1.0])
    x = np.array([0.5, 1.0, 2.5, 4.0])
    want = [(np.linalg.eigvalsh(np.diag(main) + np.diag(off, 1) + np.diag(off, -1)) < v).sum() for v in x]
    assert whitening.sturm_count(main, off, x).tolist() == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**39), 2**39), min_size=3, max_size=3), min_size=1, max_size=6))
def test_products_are_exact(rows):
    want = [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]
    assert whitening._products(np.array(rows, np.int64)).tolist() == want


def check(rows, vectors):
    """Rows of the operator against exact sums and numpy's eigenvectors."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    cov = exact_covariance(x)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:8], axes[:, ::-1].T[:8]
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and errors.pop() <= 1e-4
    signs = None
    for (i, _), row in zip(vectors, x, strict=True):
        got = by[i]
        assert sorted(got) == list(range(1, len(values) + 1))
        off = [n * a - s for a, s in zip(row, sums, strict=True)]
        assert {r.deviation for r in got.values()} == {sum(o * o for o in off)} and got[1].n == n
        want = axes @ (np.array(off) / n) / np.sqrt(values)
        have = np.array([got[c].whitened for c in sorted(got)])
        if signs is None:
            signs = np.sign(want * have)
        assert np.allclose(have, want * signs, rtol=1e-7, atol=1e-8)
        assert np.allclose([got[c].explained for c in sorted(got)], values / np.trace(cov), rtol=1e-9)


def test_query_equals_brute_force(spark, folder):
    rows = catalog.QUERIES["op12_whitening"](spark, folder).collect()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    check(rows, [(r.vec_id, list(r.embedding)) for r in table])


def test_rows_that_do_not_count(spark):
    draw = np.random.default_rng(5)
    good = [(i, draw.standard_normal(4).astype(np.float32).tolist()) for i in range(30)]
    bad = [(50, None), (51, []), (52, [1.0, None, 1.0, 1.0]), (53, [1.0, float("nan"), 1.0, 1.0]),
           (54, [float("inf"), 1.0, 1.0, 1.0]), (55, [1.0, 2.0]), (56, [1.0] * 9)]
    rows = whitening.whitened(frame(spark, good + bad)).collect()
    assert {r.vec_id for r in rows} == set(range(30)) and {r.component for r in rows} == {1, 2, 3, 4}
    check(rows, good)


def test_repeated_rows_null_ids_and_ties(spark):
    twin = [0.5, -0.25, 3.0]
    made = [(None, twin), (None, twin), (1, twin), (1, [1.0, 2.0, 3.0]), (2, [4.0, 0.0, 3.0])]
    rows = whitening.whitened(frame(spark, made)).collect()
    assert len(rows) == 15
    flat = [r for r in rows if r.component == 3]
    assert all(r.whitened is None and abs(r.explained) < 1e-12 for r in flat)
    assert all(r.identity_error < 1e-9 for r in rows)
    alone = whitening.whitened(frame(spark, [(1, twin), (2, twin)])).collect()
    assert len(alone) == 6
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in alone} == {(0, None, None, None)}


def test_empty_tables(spark):
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(frame(spark, [(1, None)])).collect() == []


def test_large_numbers(spark):
    made = [(i, [float(1 << 28) * (i % 2), float(i)]) for i in range(4)]
    rows = whitening.whitened(frame(spark, made)).collect()
    assert {r.deviation for r in rows} == {None} and {abs(round(r.whitened, 9)) for r in rows if r.component == 1} == {1.0}
    with pytest.raises(Exception, match="2\\*\\*40"):
        whitening.whitened(frame(spark, [(1, [1e30, 0.0])])).collect()
