"""Whitening against plain numpy and whole-number arithmetic."""

import math

import numpy as np
import pytest

from dupstream.llm import whitening
from dupstream.llm.common import table
from dupstream.llm.queries import REGISTRY
from tests.conftest import SF0001

SCHEMA = "vec_id long, embedding array<float>, component int, x string"


def brute(rows, most=16):
    """(rows by id and component, identity of the components' scale) by numpy."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows]
    listed = sorted({tuple(x) for _, x in whole})
    n, d = len(listed), len(listed[0])
    sums = [sum(x[j] for x in listed) for j in range(d)]
    centred = np.array([[n * x[j] - sums[j] for j in range(d)] for x in listed], float) / n
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, x in whole:
        dev = [n * x[j] - sums[j] for j in range(d)]
        z = (np.array(dev, float) / n) @ axes / np.sqrt(np.maximum(values, 1e-300))
        for k in range(min(most, d)):
            out.setdefault((i, k + 1), []).append((n, sum(t * t for t in dev), z[k], values[k] / values.sum()))
    return out


def compare(df, want):
    got = {}
    for r in df.collect():
        assert r.identity_error <= 1e-9
        got.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, r.whitened, r.explained))
    assert set(got) == set(want)
    signs = {}
    for key, mine in got.items():
        assert len(mine) == len(want[key])
        for a, b in zip(sorted(mine, key=lambda t: t[1]), sorted(want[key], key=lambda t: t[1])):
            assert a[:2] == b[:2] and a[3] == pytest.approx(b[3], rel=1e-9)
            if abs(b[2]) > 1e-3:
                sign = signs.setdefault(key[1], np.sign(a[2] * b[2]))
                assert a[2] == pytest.approx(sign * b[2], rel=1e-7, abs=1e-7)


def vectors(n=400, d=20):
    rng = np.random.default_rng(7)
    v = (rng.standard_normal((n, d)) * np.linspace(0.2, 3, d) + rng.uniform(-5, 5, d)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    return rows + [(1000 + i, rows[3][1]) for i in range(50)] + [(5, rows[6][1]), (None, rows[9][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)


def test_whitened_rows_as_numpy(spark):
    rows = vectors()
    odd = [(2000, None), (2001, []), (2002, [None] * 20), (2003, [float("nan")] + [0.0] * 19), (2004, [float("-inf")] * 20),
           (2005, [1.0] * 19)]
    compare(whitening.whiten(frame(spark, rows + odd)), brute(rows))


def test_few_dimensions_and_components(spark):
    rows = [(i, v[:3]) for i, v in vectors()]
    compare(whitening.whiten(frame(spark, rows)), brute(rows))
    compare(whitening.whiten(frame(spark, vectors()), components=2), brute(vectors(), 2))


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, x.tolist()) for i, x in enumerate((rng.standard_normal((60, 3)) * [3e3, 1e4, 5e4] + 1e4).astype(np.float32))]
    compare(whitening.whiten(frame(spark, rows)), brute(rows))


def test_deviations_past_64_bits_are_null(spark):
    rows = [(i, [float(i), float(1 << (30 + i % 8))]) for i in range(40)]
    assert {r.deviation for r in whitening.whiten(frame(spark, rows)).collect() if r.vec_id % 8 == 7} == {None}


def test_without_variance_or_rows(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(9)])).collect() == []
    flat = whitening.whiten(frame(spark, [(i, [float(i), 2.0, float(-i)]) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1} and {r.explained for r in flat} == {1.0}


def householder(rng, d):
    q = np.eye(d, dtype=np.longdouble)
    for _ in range(d):
        u = rng.standard_normal(d).astype(np.longdouble)
        q = q - 2 * np.outer(q @ u, u) / (u @ u)
    return q


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 24), np.concatenate([1 + 1e-9 * np.arange(8), 2 + 1e-12 * np.arange(8), [5, 6, 7, 1e-3]]),
    np.concatenate([np.full(6, 3.0), 1 + 1e-6 * np.arange(10)])])
def test_clustered_eigenvalues_are_told_apart(values):
    rng = np.random.default_rng(2)
    values = np.sort(values.astype(np.longdouble))[::-1]
    q = householder(rng, len(values))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigenvectors(a)
    assert np.abs(found - values).max() < 1e-17
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-16
    assert np.abs(a @ x - x * found).max() < 1e-16
    for i, v in enumerate(values):                # as far as the gap to the next one allows
        gap = np.abs(np.delete(values, i) - v).min()
        if gap > 1e-13:
            miss = x[:, i] * np.sign(q[:, i] @ x[:, i]) - q[:, i]
            assert np.abs(miss).max() < 2e-18 * len(values) / gap


def test_fractions_in_extended_precision():
    for a, b in [(1, 3), (-10**40 + 7, 10**20 + 3), (0, 5), (2**200 + 1, 2**100), (7, 2**300)]:
        got = whitening.extended(a, b)
        assert abs(float(got) - a / b) <= 1e-16 * abs(a / b)


def test_query_on_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF0001, "embeddings").collect()]
    out = REGISTRY["op11_whitening"](spark, SF0001)
    want = brute(rows)
    if len({tuple(v) for _, v in rows if v}) > 64:
        compare(out, want)
    else:                                     # rank below the dimension
        assert {r.deviation for r in out.collect()} == {w[0][1] for w in want.values()}
