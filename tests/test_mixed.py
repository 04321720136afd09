import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auxoline.operators import design as D
from auxoline.operators import linear as L
from auxoline.operators import mixed as X


def family_data(seed=0, mothers=12, big=False):
    """Visits of subjects of mothers; with ``big``, one mother holds a third of the rows."""
    rng = np.random.default_rng(seed)
    rows, subject = [], 0
    for m in range(mothers):
        am = rng.normal()
        for _ in range(20 if big and m == 0 else rng.integers(1, 4)):
            b0, b1 = rng.normal(scale=0.8), rng.normal(scale=0.3)
            for _ in range(rng.integers(2, 7)):
                t, x = rng.normal(), rng.normal()
                y = 1 + 0.5 * x + 0.2 * t + am + b0 + b1 * t + 0.5 * rng.normal()
                rows.append((0, m, subject, float(t), float(x), float(y)))
            subject += 1
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "imp long, mom long, ID long, age_cen double, x double, y double")


def dense_llf(rows, psi, treatment=True):
    """The same likelihood from the full covariance matrix of each mother."""
    data = np.array(rows)
    n = len(data)
    v = np.zeros((n, n))
    for m in np.unique(data[:, 1]):
        at = np.flatnonzero(data[:, 1] == m)
        ids, t = data[at, 2], data[at, 3]
        z = (ids[:, None] == np.unique(ids)[None, :]).astype(float)
        if treatment:
            w = np.column_stack([z, t, z[:, 1:] * t[:, None]])
        else:
            w = z * t[:, None]
        v[np.ix_(at, at)] = np.eye(len(at)) + psi[0] + psi[1] * z @ z.T + psi[2] * w @ w.T
    x, y = np.column_stack([np.ones(n), data[:, 4], data[:, 3]]), data[:, 5]
    inv = np.linalg.inv(v)
    b = np.linalg.solve(x.T @ inv @ x, x.T @ inv @ y)
    r = y - x @ b
    s = r @ inv @ r / n
    return -0.5 * (n * (np.log(2 * np.pi * s) + 1) + np.linalg.slogdet(v)[1]), b, s * np.linalg.inv(x.T @ inv @ x), s


TERMS = ("x", "age_cen")


def terms():
    return D.intercept() | D.linear(*TERMS)


@pytest.mark.parametrize("coding", ["treatment", "symmetric"])
@pytest.mark.parametrize("big", [False, True])
def test_fit_matches_the_dense_likelihood(spark, coding, big):
    rows = family_data(big=big)
    r = X.fit_mixed(frame(spark, rows), ["imp"], terms(), F.col("y"), slope_coding=coding).first()
    psi = (r.psi_mother, r.psi_subject, r.psi_slope)
    llf, b, cov, scale = dense_llf(rows, psi, coding == "treatment")
    assert r.llf == pytest.approx(llf, abs=1e-7)
    assert r.est == pytest.approx(list(b), abs=1e-7)
    assert np.array(r.cov) == pytest.approx(cov, abs=1e-8)
    assert r.scale == pytest.approx(scale)
    assert (r.n, r.n_subj, r.n_groups) == (len(rows), len({x[2] for x in rows}), 12)
    for i in range(3):
        for f in (0.9, 1.1):
            other = list(psi)
            other[i] *= f
            assert dense_llf(rows, other, coding == "treatment")[0] <= llf + 1e-4


def test_no_variance_components_is_least_squares(spark):
    df = frame(spark, family_data(1))
    part = X.fit_mixed(df, ["imp"], terms(), F.col("y"), fixed={0: -60.0, 2: -60.0}, start=(-60.0, -14.0, -60.0), max_steps=1).first()
    ols = L.fit_linear(df, ["imp"], terms(), F.col("y")).first()
    assert part.est == pytest.approx(ols.est, abs=1e-4)
    assert part.llf == pytest.approx(ols.llf, abs=1e-3)


def test_balanced_random_intercept_has_a_closed_form(spark):
    """One subject per mother, equal visits, intercept only: the analysis-of-variance solution."""
    rng = np.random.default_rng(7)
    m, k = 30, 4
    y = 3 + rng.normal(size=(m, 1)) + rng.normal(size=(m, k))
    rows = [(0, i, i, float(j), 0.0, float(y[i, j])) for i in range(m) for j in range(k)]
    r = X.fit_mixed(frame(spark, rows), ["imp"], D.intercept(), F.col("y"), fixed={1: -60.0, 2: -60.0}).first()
    within = ((y - y.mean(axis=1, keepdims=True)) ** 2).sum() / (m * (k - 1))
    between = k * ((y.mean(axis=1) - y.mean()) ** 2).sum() / m
    assert r.est[0] == pytest.approx(y.mean())
    assert r.scale == pytest.approx(within, rel=1e-3)
    assert r.psi_mother == pytest.approx((between - within) / k / within, rel=1e-2)


def test_all_replicates_advance_in_the_same_jobs_whatever_the_row_order(spark):
    rows = family_data(3)
    both = rows + [(1, *r[1:5], r[5] + 0.3 * r[3]) for r in rows]
    a = {r.imp: r for r in X.fit_mixed(frame(spark, both), ["imp"], terms(), F.col("y")).collect()}
    b = {r.imp: r for r in X.fit_mixed(frame(spark, both[::-1]).repartition(5), ["imp"], terms(), F.col("y")).collect()}
    for k in (0, 1):
        assert a[k].llf == pytest.approx(b[k].llf, abs=1e-6)
    alone = X.fit_mixed(frame(spark, rows), ["imp"], terms(), F.col("y")).first()
    assert a[0].llf == pytest.approx(alone.llf, abs=1e-6)


def test_mothers_split_over_partitions_and_batches(spark):
    """Subject sums placed in many small partitions, read in batches of two rows, give the same fit."""
    rows = family_data(9, big=True) + [(1, *r[1:5], r[5] - 0.2 * r[4]) for r in family_data(9, big=True)]
    df = frame(spark, rows)
    want = {r.imp: r for r in X.fit_mixed(df, ["imp"], terms(), F.col("y")).collect()}
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 13)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
        got = {r.imp: r for r in X.fit_mixed(df, ["imp"], terms(), F.col("y")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, r in want.items():
        assert got[k].llf == pytest.approx(r.llf, abs=1e-8) and got[k].est == pytest.approx(r.est, abs=1e-8)
        assert r.converged and not r.boundary


def test_factors_as_cells_equal_dummy_columns(spark):
    df = frame(spark, family_data(4, mothers=30)).withColumn("g", F.col("ID") % 4)
    g = D.factor(df, "g", 2)
    assert g.levels == (0, 1, 2, 3) and g.reference == 2
    a = X.fit_mixed(df, ["imp"], terms(), F.col("y"), factors=[g]).first()
    b = X.fit_mixed(df, ["imp"], terms() | g.terms(), F.col("y")).first()
    assert a.terms == b.terms and a.llf == pytest.approx(b.llf, abs=1e-8) and a.est == pytest.approx(b.est, abs=1e-8)


def test_unknown_mothers_are_mothers_of_one(spark):
    rows = family_data(5)
    lone = [r if r[1] % 3 else (*r[:1], None, *r[2:]) for r in rows]
    named = [r if r[1] % 3 else (*r[:1], 1000 + r[2], *r[2:]) for r in rows]
    a, b = (X.fit_mixed(frame(spark, x), ["imp"], terms(), F.col("y")).first() for x in (lone, named))
    assert a.llf == pytest.approx(b.llf, abs=1e-7) and a.n_groups == b.n_groups and a.n == len(rows)


def test_boundary_and_unfinished_fits_are_told(spark):
    rng = np.random.default_rng(3)
    rows = [(0, m, 2 * m + i, float(j), float(rng.normal()), 0.0) for m in range(25) for i in range(2) for j in range(4)]
    rows = [(*r[:5], float(r[4] + (1 if r[2] % 2 else -1) + (1 if r[3] % 2 else -1) + 0.1 * rng.normal())) for r in rows]
    r = X.fit_mixed(frame(spark, rows), ["imp"], terms(), F.col("y")).first()
    assert r.boundary and 0.0 in (r.psi_mother, r.psi_slope)
    early = X.fit_mixed(frame(spark, family_data(0)), ["imp"], terms(), F.col("y"), max_steps=2).first()
    assert not early.converged


def nested_scores(rows, keys=2):
    rng = np.random.default_rng(11)
    ids = sorted({r[2] for r in rows})
    return [(k, i, float(rng.normal()), float(rng.normal())) for k in range(keys) for i in ids]


def test_nested_designs_share_subject_sums_and_jobs(spark):
    """Every column subset fitted from shared sums equals its own fit, in as many jobs as the largest alone."""
    rows, scores = family_data(5), nested_scores(family_data(5))
    df, s = frame(spark, rows).drop("imp"), spark.createDataFrame(scores, "imp long, ID long, pc0 double, pc1 double")
    specs = {"one": ["Intercept", "x", "pc0"], "two": ["Intercept", "x", "pc0", "pc1"], "none": ["Intercept"]}
    tracker = spark.sparkContext.statusTracker()

    def fitted(name, some, **options):
        spark.sparkContext.setJobGroup(name, name)
        out = X.fit_scored(df, s, ["imp"], D.intercept() | D.linear("x"), F.col("y"), ["pc0", "pc1"], some, **options).collect()
        return {(r.imp, r.spec): r for r in out}, len(tracker.getJobIdsForGroup(name))

    got, _ = fitted("all", specs)
    assert set(got) == {(k, n) for k in (0, 1) for n in specs}
    _, few = fitted("three steps", {"two": specs["two"]}, max_steps=3)
    _, many = fitted("three steps of all", specs, max_steps=3)
    assert few == many
    spark.sparkContext.setJobGroup("other", "other")
    pcs = {(k, i): (p, q) for k, i, p, q in scores}
    for (k, name), r in got.items():
        flat = spark.createDataFrame([(k, *x[1:], *pcs[k, x[2]]) for x in rows], "imp long, mom long, ID long, age_cen double, x double, y double, pc0 double, pc1 double")
        every = D.intercept() | D.linear("x", "pc0", "pc1")
        alone = X.fit_mixed(flat, ["imp"], {t: every[t] for t in specs[name]}, F.col("y")).first()
        assert r.terms == specs[name] and r.llf == pytest.approx(alone.llf, abs=1e-5) and r.est == pytest.approx(alone.est, abs=1e-3)


def test_intercept_likelihood_is_the_dense_one(spark):
    rows = [(0, m, i, 0.0, x, y) for _, m, i, _, x, y in family_data(6, big=True)]
    s = spark.createDataFrame([(k, i, p) for k, i, p, _ in nested_scores(rows)], "imp long, ID long, pc0 double")
    stats = X.scored_stats(frame(spark, rows).drop("imp"), s, ["imp"], D.intercept() | D.linear("x"), F.col("y"), ["pc0"])
    ratios = [(0.0, 0.3), (0.7, 0.2), (2.0, 1.0)]
    out = X.intercept_likelihood(stats, ["imp"], spark.createDataFrame(ratios, "psi_mother double, psi_subject double"), 4).collect()
    assert len(out) == 6
    pcs = {(r.imp, r.ID): r.pc0 for r in s.collect()}
    for r in out:
        dense = [(0, m, i, pcs[r.imp, i], x, y) for _, m, i, _, x, y in rows]
        llf, b, _, scale = dense_llf(dense, (r.psi_mother, r.psi_subject, 0.0))
        assert r.llf == pytest.approx(llf, abs=1e-7) and r.scale == pytest.approx(scale) and r.n == len(rows)
        assert [r.est[0], r.est[1], r.est[2]] == pytest.approx(list(b), abs=1e-8)
        flat = spark.createDataFrame([(0, m, i, 0.0, x, y, pcs[r.imp, i]) for _, m, i, _, x, y in rows], "imp long, mom long, ID long, age_cen double, x double, y double, pc0 double")
        if r.psi_mother:
            same = X.fit_mixed(flat, ["imp"], D.intercept() | D.linear("x", "pc0"), F.col("y"), fixed={0: np.log(r.psi_mother), 1: np.log(r.psi_subject), 2: -60.0}, max_steps=1).first()
            assert r.llf == pytest.approx(same.llf, abs=1e-6)


def test_subject_sums_are_unpacked_once_a_step(spark, monkeypatch):
    """A step's cost must not hold a conversion of all subjects per candidate."""
    rows = [(0, i // 3, i, 2, 0.5, 1.25, [2.0, 1.0 + i], [0.5, 0.3], i % 3 == 0) for i in range(30)]
    stats = spark.createDataFrame(rows, "k long, mom long, ID long, n long, a double, aa double, u array<double>, w array<double>, is_first boolean")
    thetas = np.array([[-2.0, -2.0, -4.0 + 0.1 * c] for c in range(10)])
    count, original = [], np.stack

    class Frame:
        def mapInPandas(self, run, schema):
            monkeypatch.setattr(np, "stack", lambda *a, **k: count.append(1) or original(*a, **k))
            out = pd.concat(list(run([stats.toPandas()])), ignore_index=True)
            monkeypatch.setattr(np, "stack", original)
            return spark.createDataFrame(out.astype({"mom": "float"}).replace({np.nan: None}), "k long, cand int, mom double, pos int, v double")

        dtypes = stats.dtypes

    parts = X.likelihood_parts(Frame(), ["k"], 2, {(0,): thetas}, True)
    assert len(parts) == 10 and len(count) == 2


def test_packed_sums_of_split_mothers_and_missing_keys(spark):
    """One row a subject, in many small partitions and batches of two rows, gives the sums of a row per subject and key; keys may lack subjects."""
    rows, by, terms = family_data(9, big=True), ["var", "imp"], D.intercept() | D.linear("x")
    scores = [(v, *s) for v in "ab" for s in nested_scores(rows) if (s[1] + s[0] + (v == "a")) % 5]
    df, s = frame(spark, rows).drop("imp"), spark.createDataFrame(scores, "var string, imp long, ID long, pc0 double, pc1 double")
    thetas = {(v, k): X._stencil(np.array([-1.0 + 0.1 * k, -2.0, -1.5])) for v in "ab" for k in (0, 1)}
    stats = X.scored_stats(df, s, by, terms, F.col("y"), ["pc0", "pc1"])
    totals = {(r["var"], r["imp"]): (r["n"], r["s"], r["m"]) for r in stats.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("s"), F.countDistinct("mom").alias("m")).collect()}
    crossed = {(r["var"], r["imp"]): r["z"] for r in stats.groupBy(*by).agg(F.array(*[F.sum(F.col("zz")[i]) for i in range(15)]).alias("z")).collect()}
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 13)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
        packed = X.packed_sums(df, s, by, terms, F.col("y"), ["pc0", "pc1"])
        known, zz, opened = X.survey(packed, by, ["pc0", "pc1"], 2)
        got = {t: X.packed_parts(packed, by, ["pc0", "pc1"], opened, 5, thetas, t) for t in (True, False)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert known == totals and any(opened.values())
    for key, z in zz.items():
        assert z[np.triu_indices(5)] == pytest.approx(crossed[key])
    placed = X.placed(stats.drop("zz"), by)
    for t, parts in got.items():
        want = X.likelihood_parts(placed, by, 5, thetas, t)
        assert set(parts) == set(want)
        for name, v in want.items():
            assert parts[name] == pytest.approx(v, rel=1e-9, abs=1e-9)


def test_a_step_solves_the_systems_of_all_keys_at_once(spark, monkeypatch):
    """The driver's work a step must not be one small system per key and candidate."""
    rows = family_data(5)
    s = spark.createDataFrame(nested_scores(rows, keys=5), "imp long, ID long, pc0 double, pc1 double")
    specs, calls, original = {"one": ["Intercept", "pc0"], "two": ["Intercept", "pc0", "pc1"]}, [], np.linalg.pinv
    monkeypatch.setattr(np.linalg, "pinv", lambda *a, **k: calls.append(1) or original(*a, **k))
    out = X.fit_scored(frame(spark, rows).drop("imp"), s, ["imp"], D.intercept(), F.col("y"), ["pc0", "pc1"], specs, max_steps=3)
    assert out.count() == 10 and len(calls) <= 6
