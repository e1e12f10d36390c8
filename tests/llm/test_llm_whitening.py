"""Whitening (11): the eigenpairs against numpy's, the rows against their definition."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlens.llm import spectrum, whitening

SF = "/root/testdata/sf0.01"


def brute(vectors, components=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    v = y.T @ y / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    return ((n * x - s) ** 2).sum(1), (y @ w) / np.sqrt(e), e / np.trace(v)


def table(df):
    rows = df.orderBy("vec_id", "component").toPandas()
    k = int(rows.component.max())
    return rows, rows.whitened.to_numpy().reshape(-1, k)


def test_query_equals_numpy(spark):
    docs = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows, z = table(whitening.whiten(docs))
    own = docs.orderBy("vec_id").toPandas()
    deviation, want, explained = brute(np.stack(own.embedding.to_list()))
    sign = np.sign((z * want).sum(0))
    assert np.abs(z * sign - want).max() < 1e-8
    assert rows.deviation.to_numpy()[::8].tolist() == deviation.tolist()
    assert np.allclose(rows.explained.to_numpy()[:8], explained, rtol=1e-12)
    assert rows.identity_error.max() < 1e-9 and rows.identity_error.nunique() == 1
    assert rows.component.to_numpy().reshape(-1, 8).tolist() == [list(range(1, 9))] * len(own) and set(rows.n) == {len(own)}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 24), st.integers(0, 10_000), st.sampled_from(["plain", "twins", "rank", "graded", "identity"]))
def test_spectrum_equals_eigh(d, seed, kind):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = np.abs(rng.standard_normal(d))
    if kind == "twins":
        e = np.repeat(e, 2)[:d]
    elif kind == "rank":
        e[d // 2:] = 0
    elif kind == "graded":
        e = 10.0 ** -np.arange(d)
    elif kind == "identity":
        e[:] = 1
    a = (q * e) @ q.T
    values, vectors = spectrum.leading(a, 8)
    want = np.sort(e)[::-1][:8]
    assert len(values) == len(want) or (want[len(values):] < 1e-13 * max(1, e.sum())).all()
    assert np.allclose(values, want[:len(values)], atol=1e-12 * max(1e-300, e.max()))
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-9)
    assert np.abs(a @ vectors.T - vectors.T * values).max(initial=0) < 1e-11 * max(1, e.max())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10_000), st.booleans())
def test_inertia_and_solutions(d, seed, whole):
    rng = np.random.default_rng(seed)
    a = rng.integers(-2, 3, (d, d)).astype(float) if whole else rng.standard_normal((d, d))
    a = a + a.T
    e = np.linalg.eigvalsh(a)
    factors = spectrum.Factors(a)
    if np.abs(e).min() > 1e-9:
        assert factors.positive() == (e > 0).sum()
        b = rng.standard_normal(d)
        assert np.allclose(a @ factors.solve(b), b, atol=1e-6 / min(1, np.abs(e).min()))


SCHEMA = "vec_id long, embedding array<double>, label int, z string, n string, component string"


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = rng.standard_normal((40, 5)).round(3).tolist()
    rows = [(i, v) for i, v in enumerate(good)]
    rows += [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [1.0, float("inf"), 0.0, 0.0, 0.0]),
             (105, [1.0, 2.0]), (106, [1e300] * 5), (3, good[7]), (None, good[9]), (8, good[8])]
    df = spark.createDataFrame([(i, v, 1, "x", "y", "w") for i, v in rows], SCHEMA).repartition(5)
    out = whitening.whiten(df).toPandas()
    kept = good + [good[7], good[9], good[8]]
    assert len(out) == len(kept) * 5 and set(out.n) == {len(kept)} and out.identity_error.max() < 1e-9
    deviation, want, _ = brute(kept)
    assert sorted(out[out.component == 1].deviation.tolist()) == sorted(deviation.tolist())
    for c in range(1, 6):
        own = np.sort(np.abs(out[out.component == c].whitened.to_numpy()))
        assert np.allclose(own, np.sort(np.abs(want[:, c - 1])), atol=1e-8)
    assert out.vec_id.isna().sum() == 5 and (out.vec_id == 8).sum() == 10


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_without_variance(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_deviation_is_exact_or_null():
    x = np.array([[2**40, 0], [0, 1]], np.int64)
    got = whitening._squares(x, 3, [2**40, 1]).to_pylist()
    assert got == [None, None]
    assert whitening._squares(np.array([[2**29, 5]], np.int64), 2, [7, 2]).to_pylist() == [(2**30 - 7) ** 2 + 64]
