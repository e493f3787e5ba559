"""Whitening: inertia counts and components against a dense solver, rows against exact integer arithmetic."""

import math

import numpy as np
import pytest

from ripplewatch.llm import whitening


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    m = (q * np.array(values, float)) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        list(range(1, 41)),
        [5.0] * 4 + [3.0] * 3 + [1.0, 0.5],  # repeated eigenvalues
        [1 + 1e-9 * k for k in range(12)],  # closer than a Rayleigh step tells apart
        [9, 4, 1, 0, 0, 0],  # without full rank
        [2.0],
        [1e12, 1e6, 1.0],
    ],
)
def test_components(values):
    m = symmetric(values)
    want = np.linalg.eigvalsh(m)[::-1]
    for shift in np.r_[want[:-1] / 2 + want[1:] / 2, want[0] + 1, want[-1] - 1]:
        if np.abs(want - shift).min() > 1e-10 * abs(want).max():
            assert whitening.count_above(m, shift) == (want > shift).sum()
    got, vectors = whitening.leading_components(m, 32)
    rank = int((want > 1e-12 * want[0]).sum())
    assert len(got) == min(rank, 32)
    scale = np.abs(want).max()
    assert np.allclose(got, want[: len(got)], rtol=0, atol=2e-14 * scale)
    assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-6)
    assert np.abs(m @ vectors - vectors * got).max() <= 1e-13 * scale


def test_count_needs_double_pivots():
    m = np.array([[0.0, 1.0, 0], [1.0, 0.0, 0], [0, 0, 0.0]])
    assert whitening.count_above(m, 0.0) == 1 and whitening.count_above(m, -0.5) == 2


def test_rows(spark):
    r = np.random.default_rng(3)
    x = (r.standard_normal((300, 40)) @ r.standard_normal((40, 40)) / 8).astype(np.float32)
    table = [(k, v.tolist(), "e", 1) for k, v in enumerate(x)]
    bad = [None, [], [1.0], x[0].tolist()[:39] + [None], x[0].tolist()[:39] + [float("nan")], [float("inf")] * 40, [3e38] * 40]
    table += [(1000 + k, v, None, 2) for k, v in enumerate(bad)]
    table += [(None, x[5].tolist(), "null id", 3), (7, x[7].tolist(), "again", 4)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, component string, n int").repartition(4)
    found = whitening.fit(df)
    got = whitening.whiten(df, found).collect()
    kept = [(k, [math.floor(64 * c) + 1_000_000 for c in v]) for k, v, *_ in table if k is None or k < 1000]
    n, sums = len(kept), [sum(c) for c in zip(*(v for _, v in kept))]
    whole = np.array([v for _, v in kept], float)
    centred = whole - whole.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    z = centred @ vectors / np.sqrt(values)
    assert len(got) == n * 32 and {row.n for row in got} == {n}
    want = {}
    for (k, v), white in zip(kept, z):
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        want.setdefault(k, []).append((deviation, white))
    signs = np.sign([found.vectors[:, c] @ vectors[:, c] for c in range(32)])
    for row in got:
        deviation, white = want[row.vec_id][0]
        assert row.deviation == deviation
        assert abs(row.whitened - signs[row.component - 1] * white[row.component - 1]) < 1e-8
        assert abs(row.explained / (values[row.component - 1] / np.trace(centred.T @ centred / n)) - 1) < 1e-10
        assert row.identity_error < 1e-9


def test_no_rows_and_too_large_sums(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None), (2, []), (3, [float("nan")])], [(1, [0.5, 2.0])] * 5):
        df = spark.createDataFrame(rows, kind)
        assert whitening.whiten(df, whitening.fit(df)).collect() == []
    df = spark.createDataFrame([(1, [1e9]), (2, [-1e9])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert [(row.deviation, abs(row.whitened)) for row in got] == [(None, 1.0)] * 2
