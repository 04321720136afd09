import numpy as np
import pytest

from auxoline.operators import quantiles as Q


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    data = {0: rng.normal(size=20_000), 1: np.round(rng.exponential(size=30_000), 1), 2: np.full(5000, 7.0)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [(0, None)]
    df = spark.createDataFrame(rows, "k int, x double")
    probs = [0.1, 0.5, 0.9]
    got = {(r.k, r.p): (r.n, r.q) for r in Q.exact_quantiles(df, ["k"], "x", probs).collect()}
    for k, vs in data.items():
        for p in probs:
            assert got[(k, p)][0] == len(vs)
            assert got[(k, p)][1] == pytest.approx(np.quantile(vs, p), abs=1e-12)


def test_tiny_groups_without_keys(spark):
    for values in ([3.0], [1.0, 2.0], [5.0, 1.0, 4.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        rows = Q.exact_quantiles(df, [], "x", [0.1, 0.5, 0.9]).collect()
        assert {r.p: pytest.approx(r.q) for r in rows} == {p: np.quantile(values, p) for p in (0.1, 0.5, 0.9)}


def test_group_above_a_million_rows_and_small_ones(spark):
    big = spark.range(1_200_000).selectExpr("'big' AS g", "CAST(pmod(id * 7919, 1200000) AS DOUBLE) AS v")
    small = spark.createDataFrame([("small", float(v)) for v in (3, 1, 2)] + [("one", 5.0)], "g string, v double")
    got = {(r.g, r.p): r.q for r in Q.exact_quantiles(big.unionByName(small), ["g"], "v", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    for p in (0.0, 0.1, 0.5, 0.99, 1.0):
        assert got["big", p] == pytest.approx(p * 1_199_999)
        assert got["small", p] == pytest.approx(1 + 2 * p) and got["one", p] == 5.0
