import numpy as np
import pytest

from readloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string, line int"


def table(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "x", "y", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute(vectors):
    """{row: (deviation, whitened up to sign)}, explained: by numpy's own eigenvectors of exact sums."""
    good = [i for i, v in enumerate(vectors) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in vectors[i]] for i in good], object)
    n, s = len(good), x.sum(0)
    z = x * n - s
    y = z.astype(float) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)
    e, q = e[order], q[:, order]
    return {i: (int((z[k] ** 2).sum()), (y[k] @ q) / np.sqrt(np.maximum(e, 1e-300))) for k, i in enumerate(good)}, e / e.sum(), n


def test_rotations_keep_small_eigenvalues():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 16, 33):
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        e = 10.0 ** -np.arange(d) if d < 9 else rng.uniform(0.1, 9, d)
        e = np.sort(e)[::-1]
        got, vectors = whitening.rotated((q * e) @ q.T)
        assert np.allclose(got, e, rtol=1e-7) and np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12)
        assert np.allclose(np.abs((vectors * q).sum(0)), 1, atol=1e-6)
    graded = np.diag(10.0 ** -np.arange(0, 20, 2)) + 0.0
    for i in range(9):
        graded[i, i + 1] = graded[i + 1, i] = 0.3 * np.sqrt(graded[i, i] * graded[i + 1, i + 1])
    got, _ = whitening.rotated(graded)
    exact = [float(v) for v in got]
    assert exact[-1] > 0 and abs(np.prod(exact) / np.prod(np.diag(np.linalg.cholesky(graded)) ** 2) - 1) < 1e-12


def test_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 40)).astype(np.float32) @ rng.normal(size=(40, 40)).astype(np.float32)
    vectors = [v.tolist() for v in base] + [None, [None] * 40, [float("nan")] + [0.0] * 39, [float("inf")] * 40, base[0].tolist(), base[0].tolist()]
    got = whitening.whiten(table(spark, vectors)).collect()
    want, explained, n = brute(vectors)
    assert len(got) == 32 * len(want) == 32 * n
    by = {(r.vec_id, r.component): r for r in got}
    signs = {c: np.sign(by[0, c].whitened * want[0][1][c - 1]) for c in range(1, 33)}
    for (i, c), r in by.items():
        assert (r.n, r.deviation) == (n, want[i][0])
        assert abs(r.whitened - signs[c] * want[i][1][c - 1]) < 1e-6 and abs(r.explained / explained[c - 1] - 1) < 1e-9
        assert r.identity_error < 1e-9
    assert all(by[300 + 4, c].whitened == by[0, c].whitened == by[305, c].whitened for c in range(1, 33))
    assert len({r.identity_error for r in got}) == 1
    assert {(r.vec_id, r.component) for r in whitening.whiten(table(spark, vectors, 1)).collect()} == set(by)


def test_odd_tables(spark):
    assert whitening.whiten(table(spark, [None, []])).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    (one,) = whitening.whiten(table(spark, [[3.0]])).collect()
    assert (one.component, one.n, one.deviation, one.whitened, one.explained) == (1, 1, 0, 0.0, 0.0)
    # a dimension without variance, and one that repeats another
    rows = whitening.whiten(table(spark, [[i, 5.0, i] for i in range(10)])).collect()
    first = [r for r in rows if r.component == 1]
    assert len(rows) == 30 and all(r.explained == 1 for r in first) and all(r.whitened == r.explained == 0 for r in rows if r.component > 1)
    assert max(r.identity_error for r in rows) < 1e-12 and abs(sum(r.whitened**2 for r in first) / 10 - 1) < 1e-12
    # lengths are whitened apart
    rows = whitening.whiten(table(spark, [[1.0, 2.0], [2.0, 0.5], [5.0], [7.0], [9.5]])).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in rows) == [(0, 1, 2), (0, 2, 2), (1, 1, 2), (1, 2, 2), (2, 1, 3), (3, 1, 3), (4, 1, 3)]


def test_large_entries_stay_exact(spark):
    vectors = [[1e10, -3e9], [2e10, 5.0], [-1e12, 7.5], [3e38, 1.0]]
    rows = {r.vec_id: r for r in whitening.whiten(table(spark, vectors)).collect()}
    assert set(rows) == {0, 1, 2}
    want, _, n = brute(vectors[:3])
    for i, r in rows.items():
        assert r.deviation == (want[i][0] if want[i][0] < 1 << 63 else None) and r.n == 3


@pytest.mark.parametrize("dim", [64])
def test_query(spark, tmp_path, dim):
    rng = np.random.default_rng(3)
    table(spark, rng.normal(size=(100, dim)).tolist()).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op13_whitening(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 3200
