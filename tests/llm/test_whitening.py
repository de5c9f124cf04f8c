"""Whitening: the qd solver, and rows against dense linear algebra on exact sums."""

import math

import numpy as np
import pytest

from weirgauge.llm import bidiagonal, whitening

RNG = np.random.default_rng(5)
Q, _ = np.linalg.qr(RNG.normal(size=(40, 40)))
P, _ = np.linalg.qr(RNG.normal(size=(40, 40)))
MATRICES = {
    "one": np.array([[3.0]]),
    "triangle": np.triu(RNG.normal(size=(64, 64))),
    "graded": np.linalg.qr(RNG.normal(size=(500, 48)) * np.logspace(0, -8, 48), mode="r"),
    "graded_up": np.linalg.qr(RNG.normal(size=(500, 48)) * np.logspace(-8, 0, 48), mode="r"),
    "identity": np.eye(12),
    "zero": np.zeros((4, 4)),
    "multiple": (Q * np.array([3.0] * 5 + [2.0] * 10 + [1.0] * 25)) @ P,
    "tight": (Q * (3 + 1e-14 * np.arange(40))) @ P,
    "close": (Q * (3 + 1e-9 * np.arange(40))) @ P,
    "rank_five": np.linalg.qr(RNG.normal(size=(90, 5)) @ RNG.normal(size=(5, 30)), mode="r"),
    "glued": np.diag(np.abs(np.arange(21) - 10) + 0.1) + np.diag(np.ones(20), 1),
    "wild": np.diag(np.exp(RNG.normal(size=40) * 8)) + np.diag(np.exp(RNG.normal(size=39) * 8), 1),
    "zero_column": np.triu(RNG.normal(size=(20, 20))) * (np.arange(20) != 7),
}


@pytest.mark.parametrize("name", MATRICES)
def test_singular_values_and_vectors(name):
    m = MATRICES[name]
    values, vectors = bidiagonal.singular(m, 16)
    want = np.linalg.svd(m, compute_uv=False) ** 2
    rank = min(16, int((want > want[0] * (len(m) * 2.3e-16) ** 2 * 4).sum()))
    assert rank <= len(values) <= 16
    if not rank:
        return
    assert np.allclose(values[:rank], want[:rank], rtol=1e-7 if name.startswith("graded") else 1e-11, atol=0)
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-11
    assert np.abs(m.T @ (m @ vectors.T) - vectors.T * values).max() < 1e-12 * want[0]


def test_small_values_keep_their_digits():
    a, b = np.array([1.0, 1e-9, 1e-3, 1e-12]), np.array([1e-1, 1e-10, 1e-4])
    exact = bidiagonal.squares(a, b)
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    product = Decimal(1)  # the product of the squares is that of the diagonal, squared
    for x in exact:
        product *= Decimal(float(x))
    assert abs(product / Decimal(1e-24) ** 2 - 1) < Decimal("1e-12")


def expected(vectors, components=16):
    """(n, x of each vector, eigenvalues, directions, deviations, trace) by dense algebra."""
    x = [tuple(math.floor(float(c) * 64) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in fit])
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    own = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    return n, own, values[order], turned[:, order], deviation, values.sum()


def check(rows, ids, vectors, components=16):
    n, own, values, turned, deviation, trace = expected(vectors, components)
    by_id = dict(zip(ids, range(len(ids)), strict=True))
    many = int((values > values[0] * 1e-12).sum())
    assert len(rows) == len(ids) * many
    got = np.zeros((len(ids), many))
    for r in rows:
        i, k = by_id[r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation[i])
        assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-9)
        assert r["identity_error"] < 1e-9
        got[i, k] = r["whitened"]
    want = own @ turned[:, :many] / np.sqrt(values[:many])
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * signs, atol=1e-8)


def test_rows_against_dense_algebra(spark):
    base = RNG.normal(size=(300, 20)) * np.linspace(1, 5, 20)
    base[100:200] = base[0]  # a frequent vector
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(base)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, x string").repartition(9)
    vectors = [np.array(v, dtype=np.float32) for v in base]
    check(whitening.whitened(table).collect(), range(300), vectors)
    check(whitening.whitened(table, components=3).collect(), range(300), vectors, 3)


def test_query_on_the_small_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [r for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(whitening.op13_whitening(spark, path).collect(), [r[0] for r in rows], [np.array(r[1], dtype=np.float32) for r in rows])


def test_rows_of_any_kind(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 0.0]), (2, [3.0, -1.0, 0.0]), (2, [3.0, -1.0, 0.0]), (None, [0.5, 0.25, 0.0])]
    bad = [(5, None), (6, []), (7, [1.0, None, 2.0]), (8, [nan, 1.0, 2.0]), (9, [inf, 1.0, 2.0]), (10, [1.0]), (11, [1e300, 0.0, 0.0])]
    schema = "vec_id bigint, embedding array<double>, component string, x int"
    table = spark.createDataFrame([(i, v, "c", 1) for i, v in good + bad], schema)
    got = whitening.whitened(table).collect()
    assert sorted(map(str, (r["vec_id"] for r in got))) == sorted(str(i) for i, _ in good for _ in range(2))  # two directions have spread
    assert {r["n"] for r in got} == {3}
    assert len({r[2:5] for r in got if r["vec_id"] == 2}) == 2
    for empty in (table.limit(0), table.where("vec_id > 4"), table.where("vec_id = 1")):
        assert whitening.whitened(empty).count() == 0
    wide = spark.createDataFrame([(i, [float(x) for x in RNG.normal(size=700)]) for i in range(9)], "vec_id bigint, embedding array<double>")
    assert whitening.whitened(wide).count() == 9 * 8  # nine points have spread in eight directions
    large = spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.0, 5e15])], "vec_id bigint, embedding array<double>")
    assert [r["deviation"] for r in whitening.whitened(large).collect()] == [None] * 6
