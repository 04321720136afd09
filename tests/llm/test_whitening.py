import math
import random

import numpy as np
import pytest

from auxoline.llm import whitening as W

WIDE = "vec_id long, embedding array<{}>, label int, x string, `N` string, component string"


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v, 0, None, "n", "c") for i, v in vectors], WIDE.format(kind)).repartition(3)


def plain(vectors):
    """n, S, x and the exact sums by multiplying centred values in whole numbers."""
    x = {i: [math.floor(1024 * c) + 100_000 for c in v] for i, v in vectors}
    rows = list(x.values())
    n, d = len(rows), len(rows[0])
    s = [sum(r[k] for r in rows) for k in range(d)]
    z = [[n * r[k] - s[k] for k in range(d)] for r in rows]
    v = [[sum(r[a] * r[b] for r in z) for b in range(d)] for a in range(d)]
    return x, n, s, v


def gaussian(rng, n, d):
    mixing = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(d)]
    out = []
    for i in range(n):
        g = [rng.gauss(0, 1) * (k + 1) / d for k in range(d)]
        out.append((i, [float(np.float32(sum(m * e for m, e in zip(row, g, strict=True)) + k)) for k, row in enumerate(mixing)]))
    return out


@pytest.mark.parametrize(("d", "scale"), [(3, 1.0), (12, 1.0), (12, 1e7), (5, 1e14)])
def test_matches_plain_whole_numbers(spark, d, scale):
    vectors = [(i, [c * scale for c in v]) for i, v in gaussian(random.Random(d), 150, d)]
    x, n, s, exact = plain(vectors)
    rows, size, length = W.fit_list(frame(spark, vectors, "double"), "vec_id", "embedding")
    assert (size, length) == (n, d) and {r.vec_id: r.x for r in rows.collect()} == x
    assert W.dimension_sums(rows, d) == s
    squares = W.squared_sums(rows, n, s)
    for i in range(d):
        for j in range(i, d):
            # Polarisation gives the products exactly: both sides are n times whole numbers.
            cross = squares[i, i] * 2 if i == j else squares[i, j] - squares[i, i] - squares[j, j]
            assert cross == 2 * exact[i][j]
    v = W.covariance(squares, n, d)
    assert np.array_equal(v, np.array([[e / n**3 for e in row] for row in exact]))
    out = W.whiten(frame(spark, vectors, "double")).collect()
    k = min(8, d)
    assert len(out) == n * k and {r.component for r in out} == set(range(1, k + 1))
    values, directions = np.linalg.eigh(np.array(v))
    values, directions = values[::-1], directions[:, ::-1]
    mean = np.array([t / n for t in s])
    got = np.full((n, k), np.nan)
    for r in out:
        got[r.vec_id, r.component - 1] = r.whitened
        z = [n * a - t for a, t in zip(x[r.vec_id], s, strict=True)]
        total = sum(e * e for e in z)
        assert r.n == n and r.deviation == (total if total < 10**38 else None)
        assert abs(r.explained - values[r.component - 1] / np.trace(v)) <= 1e-10 * abs(r.explained) + 1e-300
        assert r.identity_error < 1e-4
    want = (np.array([x[i] for i in range(n)], float) - mean) @ directions[:, :k] / np.sqrt(values[:k])
    signs = np.sign((got * want).sum(0))
    assert np.allclose(got, want * signs, atol=1e-6)
    assert np.allclose(got.T @ got / n, np.eye(k), atol=1e-6)


def test_dropped_repeated_and_odd_rows(spark):
    rng = random.Random(1)
    good = gaussian(rng, 40, 4)
    good += [good[0], good[1], (None, good[2][1]), (None, good[2][1])]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan"), 0.0, 0.0, 0.0]), (903, [0.0, float("inf"), 0.0, 0.0]), (904, [0.0, 0.0, float("-inf"), 0.0]), (905, [1.0, 2.0]), (906, []), (907, [1e300, 0.0, 0.0, 0.0])]
    out = W.whiten(frame(spark, good + bad, "double"))
    assert out.count() == 44 * 4 and out.filter("n <> 44").count() == 0
    assert {r.vec_id for r in out.collect()} == {i for i, _ in good}
    alone = W.whiten(frame(spark, good, "double"))
    key = lambda r: (str(r.vec_id), r.component, r.deviation)
    for a, b in zip(sorted(out.collect(), key=key), sorted(alone.collect(), key=key), strict=True):
        assert a[:4] == b[:4] and abs(a.whitened) == pytest.approx(abs(b.whitened), abs=1e-9)


def test_directions_without_variance(spark):
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]
    out = W.whiten(frame(spark, line)).collect()
    assert {r.component for r in out if r.whitened is not None} == {1}
    assert all(r.identity_error < 1e-9 for r in out) and abs(out[0].explained + out[1].explained + out[2].explained - 1) < 1e-9
    same = W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)


def test_empty(spark):
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, [(1, None)])).count() == 0
    assert W.whiten(frame(spark, [(1, []), (2, [])])).count() == 0


def test_query(spark, sf):
    out = W.op11_whitening(spark, sf)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = out.collect()
    vectors = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x, n, s, exact = plain(vectors)
    assert len(rows) == 8 * n
    for r in rows[:: 97]:
        assert r.deviation == sum((n * a - t) ** 2 for a, t in zip(x[r.vec_id], s, strict=True)) and r.identity_error < 1e-9
    values = np.sort(np.linalg.eigvalsh(np.array([[e / n**3 for e in row] for row in exact])))[::-1]
    assert {r.component: r.explained for r in rows} == pytest.approx({k + 1: values[k] / values.sum() for k in range(8)}, rel=1e-9)
