"""Likelihood and conditioning over every age of every subject, against dense matrices over the rows and against SQL."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from auxoline.operators import process as P
from auxoline.plans import process_queries as Q
from check import TABLES, rows_of

FITS = {(g,): P.ProcessFit(np.array([20.0 + g]), np.array([1.1, 1.4, -0.3 + 0.1 * g])) for g in (0, 1)}


@pytest.fixture(scope="module")
def rows():
    """Subjects with up to 60 ages, some of them seen three times."""
    rng, out = np.random.default_rng(4), []
    for i, n in enumerate((1, 2, 7, 30, 60, 45)):
        for t in np.round(rng.uniform(1, 10, n), 3):
            out += [(i % 2, i, len(out) + k, float(t), float(20 + t + rng.normal())) for k in range(rng.choice([1, 1, 3]))]
    return out


def dense(rows, i, at=None):
    """Covariance of all rows of a subject, their residuals, and what the process and the rows have in common."""
    own = [r for r in rows if r[1] == i]
    beta, (a, g, e) = FITS[own[0][0],].beta[0], FITS[own[0][0],].theta
    t, s2, u = np.array([r[3] for r in own]), np.exp(2 * a), np.exp(g)
    cov = lambda x, y: s2 * np.exp(-((x[:, None] - y) ** 2) / (2 * u))
    return cov(t, t) + np.exp(2 * e) * np.eye(len(t)), np.array([r[4] for r in own]) - beta, beta, s2, cov(np.arange(1.0, 11), t)


def test_whole_likelihood_is_the_dense_one(spark, rows):
    obs = spark.createDataFrame(rows, "Female long, ID long, visit_id long, Age double, HT double")
    got = {r.Female: r for r in Q.likelihoods(obs, FITS).collect()}
    for g in (0, 1):
        want = 0.0
        for i in {r[1] for r in rows if r[0] == g}:
            k, r, *_ = dense(rows, i)
            want -= 0.5 * (r @ np.linalg.solve(k, r) + np.linalg.slogdet(k)[1] + len(r) * np.log(2 * np.pi))
        assert got[g].llf == pytest.approx(want, abs=1e-3)
        assert (got[g].n_subj, got[g].n_obs) == (3, sum(r[0] == g for r in rows))


def test_whole_conditional_is_the_dense_one(spark, rows):
    obs = spark.createDataFrame(rows, "Female long, ID long, visit_id long, Age double, HT double")
    got = {(r.ID, r.age): r for r in Q.conditional_means(obs, FITS).collect()}
    assert len(got) == 60
    for i in range(6):
        k, r, beta, s2, c = dense(rows, i)
        mean, var = beta + c @ np.linalg.solve(k, r), s2 - np.einsum("at,ta->a", c, np.linalg.solve(k, c.T))
        for a in range(10):
            assert got[i, a + 1].mean == pytest.approx(mean[a], abs=0.0051)
            assert got[i, a + 1].sd == pytest.approx(np.sqrt(var[a]), abs=0.0051)


@pytest.mark.parametrize("name", ["gp_llf_all_ages", "gp_conditional_mean_all_ages"])
def test_whole_table_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = rows_of(con.sql(entry.oracle_sql()[name]).project(", ".join(f'"{c}"' for c in cols)).fetchall(), cols)
    assert want and rows_of([tuple(r) for r in df.select(cols).collect()], cols) == want
    if name == "gp_llf_all_ages":
        assert sum(r.n_obs for r in df.collect()) == con.sql("select count(*) from events").fetchall()[0][0]


def test_two_ages_have_a_closed_form(spark):
    """Without noise: the likelihood of a first and last height, and heights given the first."""
    rng = np.random.default_rng(9)
    model, fit = P.ProcessModel(mean=(), scale=(), smooth=()), P.ProcessFit(np.array([60.0]), np.array([np.log(7.0), np.log(4.0)]))
    rows = [(0, i, float(t), float(60 + 5 * rng.normal())) for i in range(6) for t in ((2.0 + i, 2.5 + 1.5 * i) if i else (3.0,))]
    obs = spark.createDataFrame(rows, "Female long, ID long, Age double, HT double")
    s2, u = 49.0, 4.0
    d, want = s2 * (1 + 1e-8), 0.0
    for i in range(6):
        t, r = np.array([x[2] for x in rows if x[1] == i]), np.array([x[3] - 60 for x in rows if x[1] == i])
        if len(t) == 1:
            want += -0.5 * (r[0] ** 2 / d + np.log(d) + np.log(2 * np.pi))
        else:
            c = s2 * np.exp(-((t[0] - t[1]) ** 2) / (2 * u))
            want += -0.5 * ((d * r[0] ** 2 - 2 * c * r[0] * r[1] + d * r[1] ** 2) / (d * d - c * c) + np.log(d * d - c * c) + 2 * np.log(2 * np.pi))
    sums = P.likelihood_sums(P.subject_series(obs, ["Female"], model, "HT"), ["Female"], model, {(0,): [fit]})
    assert float(sums[0, 0][0]) == pytest.approx(want, abs=1e-6)
