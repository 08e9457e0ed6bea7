from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import queries as Q
from plumbline.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors):
    """x by exact fractions, their covariance by big integers."""
    x = [[Fraction(c) * 64 // 1 + 1_000_000 for c in map(float, v)] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[n * a - b for a, b in zip(row, s, strict=True)] for row in x], object)
    return y, np.array(y.T.dot(y) / Fraction(n) ** 3, float), n


def check(rows, ids, vectors, components=32):
    y, v, n = brute(vectors)
    e = np.sort(np.linalg.eigvalsh(v))[::-1]
    k = min(components, int((e > 1e-14 * e[0]).sum()))
    assert len(rows) == k * len(ids) and {r.n for r in rows} == {n}
    got = {(r.vec_id, r.component): r for r in rows}
    w = np.array([[got[i, c].whitened for c in range(1, k + 1)] for i in ids])
    assert [got[i, 1].deviation for i in ids] == [d if (d := int((row**2).sum())) < 1 << 63 else None for row in y]
    assert np.allclose([got[ids[0], c].explained for c in range(1, k + 1)], e[:k] / np.trace(v), rtol=1e-9)
    # Undone, the projections are the centred vectors' own: each is an eigenvector's, of length one.
    direction = np.array(y, float).T @ w / n / n / np.sqrt(e[:k])
    assert np.allclose((direction**2).sum(0), 1, atol=1e-9)
    assert np.allclose(v @ direction, direction * e[:k], atol=1e-9 * e[0])
    assert np.abs(np.cov(w.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-7
    assert max(r.identity_error for r in rows) < 1e-7


@pytest.mark.parametrize("size", [300, 1 << 20, 1 << 41, (1 << 62) - 1])
def test_products_of_limbs_are_exact(size):
    y = np.random.default_rng(size % 97).integers(-size, size, (2 * W.BLOCK + 5 if size < 1 << 30 else 40, 4))
    y[0], y[1] = size, -size
    parts = W.limbs(y)
    assert max(np.abs(p).max() for p in parts) <= 1 << (W.BITS - 1)
    assert (sum(p.astype(object).astype(int) * (1 << (W.BITS * i)) for i, p in enumerate(parts)) == y).all()
    big = y.astype(object)
    assert (W.gram(y) == big.T.dot(big)).all()
    sums = W.exact_sums(y)
    assert sums == [int(c) for c in big.sum(0)]
    far = W.centred(y, 10**9, sums)
    want = big * 10**9 - np.array(sums, object)
    assert (far.astype(object) == want).all() and (W.gram(far) == want.T.dot(want)).all()


def test_digits_carry_any_integer():
    values = np.array([0, -1, 1 << 40, -(1 << 200) + 12345, (1 << 119) - 1], object)
    back = sum(np.array(d, object) * (1 << (W.DIGIT * p)) for _, p, d in W.digit_rows(0, values))
    assert (back == values).all()


def test_given_vectors(spark):
    sf = "/root/testdata/sf0.01"
    rows = Q.op13_embedding_whitening(spark, sf).collect()
    given = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(rows, [r.vec_id for r in given], [r.embedding for r in given])


def test_far_means_and_unlike_scales(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * [1, 10, 1e3, 1e5, 3, 1] + [1e6, 0, -1e6, 0, 5, 9]).astype(np.float32).tolist()
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA).repartition(7)
    check(W.whiten(df).collect(), list(range(300)), vectors)


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 3)).astype(np.float32).tolist()
    odd = [(100, None, 1), (101, [], 1), (102, [1.0, None, 2.0], 1), (103, [float("nan"), 0.0, 0.0], 1), (104, [float("inf"), 0.0, 0.0], 1), (105, [1.0, 2.0], 1), (106, [1.0] * 5, 1)]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)] + odd, SCHEMA).repartition(5)
    rows = W.whiten(df.withColumnRenamed("label", "component")).collect()
    check(rows, list(range(40)), vectors)


def test_repeated_rows_ids_and_nulls(spark):
    base = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [0.0, 1.0], 0), (2, [3.0, 5.0], 0)]
    rows = W.whiten(spark.createDataFrame(base, SCHEMA)).collect()
    assert sorted(((r.vec_id, r.component) for r in rows), key=repr) == sorted([(1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (None, 1), (None, 2)], key=repr)
    assert {r.n for r in rows} == {4}


def test_no_variance_no_rows(spark):
    for rows in ([], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 3, [(1, None, 0)]):
        assert W.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0
    flat = [(i, [float(i), 7.0, float(2 * i)], 0) for i in range(10)]
    assert {r.component for r in W.whiten(spark.createDataFrame(flat, SCHEMA)).collect()} == {1}


def test_huge_entries_are_held_and_deviations_beyond_64_bits_null(spark):
    rows = [(i, [float(10.0 ** (i * 2)), float(i)], 0) for i in range(19)]
    out = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.deviation for r in out} == {None} and all(np.isfinite(r.whitened) for r in out)
    doubles = spark.createDataFrame([(i, [i / 3, -i * 1.5]) for i in range(9)], "vec_id long, embedding array<double>")
    check(W.whiten(doubles).collect(), list(range(9)), [[i / 3, -i * 1.5] for i in range(9)])
