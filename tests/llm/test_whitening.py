import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickerloom.llm import whitening
from tickerloom.llm.whitening import Spectra


def times(*matrices):
    """Products without the linear algebra library's threads."""
    out = matrices[0]
    for m in matrices[1:]:
        out = np.einsum("ij,jk->ik", out, m)
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(0, 60), st.integers(1, 6), st.integers(0, 10**6), st.sampled_from(["any", "whole", "flat", "equal"]))
def test_spectra_equal_the_scatter(d, n, c, seed, kind):
    """Random vectors, small whole numbers with many equal eigenvalues, vectors in a plane, and equal vectors."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * 100
    if kind == "whole":
        x = rng.integers(-1, 2, (n, d)).astype(float)
    elif kind == "flat":
        x = x[:, :1] * np.ones(d) + rng.integers(0, 2, (n, 1)) * np.arange(d)
    elif kind == "equal":
        x = np.tile(rng.normal(size=d), (n, 1))
    spectra = Spectra.empty(c, d)
    for at in range(0, n, c):
        spectra.add(x[at : at + c])
    one = spectra.one()
    y = x - x.mean(axis=0) if n else np.zeros((1, d))
    scatter, q = times(y.T, y), one.vectors[0]
    size = max(np.abs(x).max(initial=0) ** 2 * max(n, 1), 1e-9)
    assert one.count[0] == n
    assert np.abs(times(q.T, q) - np.eye(d)).max() < 1e-12
    assert np.abs(times(q * one.values[0], q.T) - scatter).max() < 1e-12 * size
    if n:
        assert np.allclose(one.mean[0], x.mean(axis=0))


def test_roots_and_deflation():
    """Equal values and untouched ones keep their place; the others interlace."""
    values = np.array([[0.0, 1, 1, 1, 2, 5]])
    v = np.array([[1.0, 1, 1, 1, 0, 2]])
    new, q = whitening.rank_one(values.copy(), np.eye(6)[None], v)
    want = np.sort(np.linalg.eigvalsh(np.diag(values[0]) + np.outer(v[0], v[0])))
    assert np.allclose(np.sort(new[0]), want, atol=1e-13)
    assert (np.abs(np.sort(new[0])[:, None] - [1, 1, 2]).min(axis=0) < 1e-13).all()
    assert np.allclose(times(q[0] * new[0], q[0].T), np.diag(values[0]) + np.outer(v[0], v[0]), atol=1e-13)


def test_rotations():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(9, 9))
    a = a + a.T
    values, q = whitening.diagonal(a)
    assert np.allclose(times(q * values, q.T), a) and (np.diff(values) <= 0).all()
    assert np.allclose(whitening.diagonal(np.zeros((3, 3)))[1], np.eye(3))


def table(spark, x, parts=5):
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").repartition(parts)


@pytest.mark.parametrize("parts", [1, 40])
def test_equals_an_eigendecomposition(spark, parts):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(700, 12)) * np.linspace(0.1, 3, 12)).astype(np.float32)
    got = whitening.whitened(table(spark, x, parts)).toPandas()
    whole = np.floor(1024 * x.astype(float)).astype(int) + 100_000
    n, sums = len(whole), whole.sum(axis=0)
    y = whole - sums / n
    values, axes = np.linalg.eigh(times(y.T, y) / n)
    assert len(got) == 700 * 8 and set(got["n"]) == {n}
    assert got["identity_error"].max() < 1e-9
    for k in range(8):
        mine = got[got["component"] == k + 1].sort_values("vec_id")
        want = (y * axes[:, -1 - k]).sum(axis=1) / np.sqrt(values[-1 - k])
        sign = np.sign((want * mine["whitened"]).sum())
        assert np.allclose(sign * mine["whitened"], want, atol=1e-9)
        assert np.allclose(mine["explained"], values[-1 - k] / values.sum(), rtol=1e-10)
        assert mine["deviation"].tolist() == ((n * whole - sums) ** 2).sum(axis=1).tolist()


def test_rows_that_take_no_part_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [1.0, inf]), (5, []), (6, [1.0, 2.0, 3.0])]
    good = [(7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [3.0, -1.0]), (9, [0.5, 0.25])]
    schema = "vec_id long, embedding array<double>"
    got = whitening.whitened(spark.createDataFrame(bad + good, schema).selectExpr("*", "1 as component", "'a' as x", "2 as whitened")).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted((i or 0, k) for i, _ in good for k in (1, 2))
    assert {r["n"] for r in got} == {4} and got[0]["identity_error"] < 1e-9
    for rows in (bad[:4], []):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).count() == 0
    for rows in ([(1, [2.0, 3.0])], [(1, [2.0, 3.0])] * 3):
        got = whitening.whitened(spark.createDataFrame(rows, schema)).collect()
        assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(0, 0.0, 0.0, 0.0)}


def test_very_large_entries_are_exact(spark):
    schema = "vec_id long, embedding array<double>"
    got = whitening.whitened(spark.createDataFrame([(1, [2.0**40, 1.0]), (2, [-(2.0**40), 2.0])], schema)).collect()
    assert all(r["deviation"] is None and np.isfinite(r["whitened"]) for r in got)
    got = whitening.whitened(spark.createDataFrame([(i, [float(2**20 * (i % 2)), 1.0]) for i in range(4)], schema)).collect()
    assert {r["deviation"] for r in got} == {(2 * 1024 * 2**20) ** 2}
