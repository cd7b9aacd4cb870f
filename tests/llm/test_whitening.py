import math

import numpy as np
import pytest

from tallyscope.llm import whitening
from tallyscope.llm.common import table
from tallyscope.llm.queries import PLANS


def plain(vectors, k=8):
    """(kept places, n, sums, deviations, eigenvalues falling, trace) by plain Python integers and numpy's solver."""
    kept = [i for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100000 for c in vectors[i]] for i in kept]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array(x, float) - np.array([s / n for s in sums])
    v = centred.T @ centred / n
    values = np.linalg.eigvalsh(v)[::-1]
    return kept, n, sums, dev, values[:k], np.trace(v), centred


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_eigenpairs_of_dense_and_clustered_matrices(n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    for values in (np.arange(n, 0, -1.0), np.ones(n), 1 + 1e-13 * np.arange(n), 10.0 ** -np.arange(n), np.r_[np.full(n - n // 2, 5.0), np.full(n // 2, 2.0)]):
        m = (q * values) @ q.T
        m = (m + m.T) / 2
        got, vectors = whitening.eigenpairs(m, 8)
        want = np.linalg.eigvalsh(m)[::-1][: len(got)]
        top = np.abs(values).max()
        assert len(got) == min(8, n) and np.abs(got - want).max() < 1e-13 * top
        assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12
        assert np.abs(m @ vectors - vectors * got).max() < 1e-12 * top


def test_eigenpairs_of_diagonal_split_and_singular_matrices():
    for m in (np.diag([3.0, 3.0, 1.0, 0.0]), np.kron(np.eye(3), [[2.0, 1.0], [1.0, 2.0]]), np.ones((5, 5)), np.zeros((3, 3))):
        values, vectors = whitening.eigenpairs(m, 8)
        want = np.linalg.eigvalsh(m)[::-1]
        assert len(values) == (want > 1e-12).sum() and np.allclose(values, want[: len(values)])
        assert np.allclose(m @ vectors, vectors * values) and np.allclose(vectors.T @ vectors, np.eye(len(values)))


def test_op11_against_plain_version(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").collect()
    kept, n, _, dev, values, trace, centred = plain([r["embedding"] for r in rows])
    got = PLANS["op11_whitening"](spark, sf_dir).collect()
    assert len(got) == 8 * len(kept) and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-9
    want = dict(zip((rows[i]["vec_id"] for i in kept), dev))
    assert all(r["deviation"] == want[r["vec_id"]] for r in got)
    assert np.allclose([r["explained"] for r in got], [values[r["component"] - 1] / trace for r in got], rtol=1e-10)
    w = np.zeros((n, 8))
    at = {rows[i]["vec_id"]: x for x, i in enumerate(kept)}
    for r in got:
        w[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    assert np.abs(w.T @ w / n - np.eye(8)).max() < 1e-9
    # the components behind the rows are eigenvectors
    c = np.linalg.lstsq(centred, w * np.sqrt(values), rcond=None)[0]
    v = centred.T @ centred / n
    assert np.abs(v @ c - c * values).max() < 1e-7 * values[0]


def test_op11_cases(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.standard_normal(5)] for _ in range(60)]
    vectors += [None, [1.0, None, 2.0, 3.0, 4.0], [math.nan] * 5, [math.inf] * 5, [1e30] * 5, [1.0, 2.0], [], vectors[0], vectors[0]]
    rows = [(i if i != 3 else None, v, 1, "x", 2.0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "key long, v array<double>, id int, vector string, whitened double").repartition(4)
    got = whitening.whiten(df, "key", "v").collect()
    good = [v for v in vectors if v and len(v) == 5 and all(c is not None and math.isfinite(c) and abs(c) < 1e20 for c in v)]
    _, n, _, dev, values, trace, _ = plain(good)
    assert n == 62 and len(got) == 5 * n and sorted(int(r["deviation"]) for r in got if r["component"] == 1) == sorted(dev)
    assert sum(r["key"] is None for r in got) == 5 and got[0]["identity_error"] < 1e-9
    assert abs(sum(r["explained"] for r in got) / n - 1) < 1e-9
    few = df.filter("key = 1")
    for none in (df.limit(0), few, df.filter("v IS NULL")):
        assert whitening.whiten(none, "key", "v").count() == 0
    assert whitening.whiten(few, "key", "v").columns == whitening.whiten(df, "key", "v").columns


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in rng.standard_normal(3) * 1e12] for _ in range(40)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"), components=1).collect()
    dev = plain(vectors)[3]
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == dict(enumerate(dev)) and max(dev) > 2**63
