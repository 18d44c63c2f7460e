"""Operator 12 against numpy's eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from docketry.llm import queries as q
from docketry.llm import whitening
from docketry.llm.common import read_table


def brute(rows, scale=256):
    """By length: the grid vectors of good rows, the distinct ones, eigenvalues falling and eigenvectors."""
    good = [(v, [math.floor(scale * c) for c in e]) for v, e in rows if e and all(c is not None and math.isfinite(c) and abs(scale * c) < 2**63 for c in e)]
    out = {}
    for d in {len(x) for _, x in good}:
        some = [(v, x) for v, x in good if len(x) == d]
        fit = sorted({tuple(x) for _, x in some})
        sums = [sum(c) for c in zip(*fit)]
        y = np.array([[c - s / len(fit) for c, s in zip(x, sums)] for x in fit])
        values, axes = np.linalg.eigh(y.T @ y / len(fit))
        out[d] = (some, len(fit), sums, values[::-1], axes[:, ::-1])
    return out


def compare(rows, got, components=4):
    want, seen = brute(rows), {}
    for r in got:
        seen.setdefault((r.vec_id, r.component), []).append(r)
    total = 0
    for some, n, sums, values, axes in want.values():
        k = [c for c in range(min(components, len(values))) if values[c] > 1e-12 * values.sum()]
        signs = {}
        for v, x in some:
            for c in k:
                z = float(np.dot([a - s / n for a, s in zip(x, sums)], axes[:, c]) / math.sqrt(values[c]))
                total += 1
                close = [r for r in seen[v, c + 1] if r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums)) and abs(abs(r.whitened) - abs(z)) < 1e-8]
                assert close
                r = close[0]
                if abs(z) > 1e-6:
                    assert signs.setdefault(c, r.whitened * z > 0) == (r.whitened * z > 0)
                assert abs(r.explained - values[c] / values.sum()) <= 1e-10 * r.explained and r.identity_error < 1e-6
    assert total == len(got)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in read_table(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    compare(rows, q.op12_whitening(spark, sf).collect())


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    basis = np.linalg.qr(rng.normal(size=(d, d)))[0]
    # widely spread eigenvalues in graded form: the small ones must be accurate relative to their own size
    scales = 10.0 ** -np.arange(d)
    matrix = np.diag(scales) @ (np.eye(d) + 0.1 * (basis + basis.T)) @ np.diag(scales)
    values, axes = whitening.jacobi(matrix)
    assert np.all(np.diff(values) <= 0) and np.allclose(axes.T @ axes, np.eye(d), atol=1e-13)
    inner = np.diag(1 / scales) @ matrix @ np.diag(1 / scales)
    for value, axis in zip(values, axes.T):
        scaled = (np.diag(1 / np.sqrt(np.diag(matrix))) @ axis)
        assert abs((matrix @ axis - value * axis) / np.sqrt(np.diag(matrix))).max() <= 1e-12 * math.sqrt(value) * np.linalg.norm(inner) * max(1, abs(scaled).max() * math.sqrt(value))
    values, _ = whitening.jacobi(basis @ np.diag(np.arange(1.0, d + 1)) @ basis.T)
    assert np.allclose(values, np.arange(d, 0, -1.0), rtol=1e-13)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=5).tolist()) for k in range(40)]
    rows += [(50, None), (51, []), (52, [1.0, None, 0.0, 0.0, 0.0]), (53, [float("nan")] * 5), (54, [float("inf")] + [0.0] * 4), (55, [1e300] + [0.0] * 4), (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(60 + k, rng.normal(size=2).tolist()) for k in range(6)] + [(70, [1.0, 2.0, 3.0])] + [(80 + k, [0.1, 0.1, 0.1, float(k)]) for k in range(3)] + [(90, [-0.0, 0.0, -0.001, 1.0, 2.0])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n int, component string")
    got = whitening.whiten(table).collect()
    compare(rows, got)
    assert not [r for r in got if r.vec_id in (50, 51, 52, 53, 54, 55, 70)] and len([r for r in got if r.vec_id == 3]) == 12 and len([r for r in got if r.vec_id is None]) == 4
    assert len([r for r in got if r.vec_id == 80]) == 1  # these vary along one direction alone
    assert whitening.whiten(table.limit(0)).collect() == []


def test_large_entries_are_exact(spark):
    rows = [(k, [float(2**45 + 2**20 * k * k), float(-(2**44) + k)]) for k in range(9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(table).collect()}
    x = {v: [math.floor(256 * c) for c in e] for v, e in rows}
    sums = [sum(c) for c in zip(*x.values())]
    assert {v: int(s) for v, s in got.items()} == {v: sum((9 * c - s) ** 2 for c, s in zip(e, sums)) for v, e in x.items()}
