import numpy as np
import pytest
from pyspark.sql import functions as F

from auxoline.operators import process as P

PLAIN = P.ProcessModel(mean=("x",), scale=("t1",), smooth=("t1",))
NOISY = P.ProcessModel(mean=("x",), scale=("t1",), smooth=(), noise=True)


def simulate(n_subjects=40, noise=0.0, seed=0, repeats=False):
    rng = np.random.default_rng(seed)
    rows = []
    v = 0
    for i in range(n_subjects):
        t = np.sort(np.round(rng.uniform(1, 10, size=rng.integers(4, 8)), 3))
        s, u = np.exp(0.2 + 0.05 * t), np.exp(0.4 + 0.02 * t)
        k = P.kernel(t, t, s, s, u, u) + 1e-8 * np.eye(len(t))
        f = np.linalg.cholesky(k) @ rng.normal(size=len(t))
        for j in range(len(t)):
            for _ in range(rng.integers(1, 4) if repeats else 1):
                x = float(rng.normal()) if noise else float(t[j])
                rows.append((0, i, v, float(t[j]), x, float(t[j]), float(2 + 0.7 * x + f[j] + noise * rng.normal())))
                v += 1
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "g long, ID long, visit_id long, Age double, x double, t1 double, y double")


def row_llf(rows, fit, model, shrink=1.0):
    """Likelihood from the covariance of every row, replicates included."""
    total = 0.0
    gamma, delta, noise = fit.split(model)
    for i in {r[1] for r in rows}:
        sub = np.array([r[3:] for r in rows if r[1] == i])
        t = sub[:, 0]
        one = np.ones(len(t))
        s = np.exp(np.column_stack([one, sub[:, 2]]) @ gamma)
        u = np.exp((np.column_stack([one, sub[:, 2]]) if len(delta) == 2 else one[:, None]) @ delta)
        k = P.kernel(t, t, s, s, u, u) + (noise * np.eye(len(t)) if model.noise else np.diag(P.JITTER * s * s))
        r = sub[:, 3] - np.column_stack([one, sub[:, 1]]) @ fit.beta
        total += -0.5 * (r @ np.linalg.solve(k, r) + np.linalg.slogdet(k)[1] + len(t) * np.log(2 * np.pi))
    return total


def evaluate(spark, rows, fit, model):
    df = frame(spark, rows)
    series = P.subject_series(df, ["g"], model, "y")
    extra = P.within_age(df, ["g"], model, "y")
    v = P.likelihood_sums(series, ["g"], model, {(0,): [fit]})[(0, 0)]
    return P._unpack(v, model, fit, extra[(0,)])


@pytest.mark.parametrize("model,noise,repeats", [(PLAIN, 0.0, False), (NOISY, 0.5, True)])
def test_value_and_gradient(spark, model, noise, repeats):
    """The reduced form equals the row-level likelihood; gradients equal finite differences of it."""
    rows = simulate(12, noise, 3, repeats)
    theta = np.array([0.1, 0.03, 0.2, 0.01]) if not noise else np.array([0.1, 0.03, 0.2, np.log(0.4)])
    fit = P.ProcessFit(np.array([1.8, 0.6]), theta)
    value, gb, _, gt, it = evaluate(spark, rows, fit, model)
    assert value == pytest.approx(row_llf(rows, fit, model), abs=1e-5)
    h = 1e-5
    for i in range(2):
        e = h * np.eye(2)[i]
        num = (row_llf(rows, P.ProcessFit(fit.beta + e, theta), model) - row_llf(rows, P.ProcessFit(fit.beta - e, theta), model)) / (2 * h)
        assert gb[i] == pytest.approx(num, rel=1e-4, abs=1e-3)
    for i in range(len(theta)):
        e = h * np.eye(len(theta))[i]
        num = (row_llf(rows, P.ProcessFit(fit.beta, theta + e), model) - row_llf(rows, P.ProcessFit(fit.beta, theta - e), model)) / (2 * h)
        assert gt[i] == pytest.approx(num, rel=2e-3, abs=2e-2)
    assert np.linalg.eigvalsh(it).min() > 0


def test_fit_finds_a_maximum_and_the_parameters(spark):
    rows = simulate(250, 0.3, 5, True)
    df = frame(spark, rows)
    series, extra = P.subject_series(df, ["g"], NOISY, "y"), P.within_age(df, ["g"], NOISY, "y")
    fit = P.fit_process(series, ["g"], NOISY, extra)[(0,)]
    assert fit.converged and fit.llf == fit.trace[-1] and all(np.diff(fit.trace) > 0)
    assert fit.llf == pytest.approx(row_llf(rows, fit, NOISY), abs=1e-4)
    for i in range(len(fit.theta)):
        for e in (-0.05, 0.05):
            assert row_llf(rows, P.ProcessFit(fit.beta, fit.theta + e * np.eye(4)[i]), NOISY) < fit.llf
    assert fit.beta[1] == pytest.approx(0.7, abs=0.05)
    assert np.exp(fit.theta[-1]) == pytest.approx(0.3, abs=0.05)


def grid_frame(spark, ages):
    rows = [(0, 0, 0, float(a), float(a), float(a), 0.0) for a in ages]
    return P.subject_series(frame(spark, rows), ["g"], PLAIN, "y").drop("ID")


FIT = {(0,): P.ProcessFit(np.array([2.0, 0.7]), np.array([0.2, 0.05, 0.4, 0.02]))}


def test_draws_go_through_the_observations(spark):
    rows = [(0, 5, k, float(a), float(a), float(a), v) for k, (a, v) in enumerate([(2.0, 4.0), (5.0, 6.5), (8.0, 7.0)])]
    series = P.subject_series(frame(spark, rows), ["g"], PLAIN, "y")
    out = P.impute_grid(series, grid_frame(spark, range(1, 11)), ["g"], PLAIN, FIT, 20, "T").collect()
    assert len(out) == 200
    for r in out:
        if r.age in (2, 5, 8):
            assert r.value == pytest.approx({2: 4.0, 5: 6.5, 8: 7.0}[r.age], abs=2e-3)
        assert r["mean"] == pytest.approx(2 + 0.7 * r.age, abs=1e-3)
    assert len({r.value for r in out if r.age == 10}) == 20


def test_draw_moments_and_partition_independence(spark):
    rows = [(0, 5, 0, 3.0, 3.0, 3.0, 5.0), (0, 5, 1, 6.0, 6.0, 6.0, 5.0), (0, 6, 2, 4.5, 4.5, 4.5, 4.0)]
    series = P.subject_series(frame(spark, rows), ["g"], PLAIN, "y")
    grid = grid_frame(spark, (2, 4, 9))
    a = P.impute_grid(series, grid, ["g"], PLAIN, FIT, 1500, "T")
    got = {(r.imp, r.ID, r.age): r.value for r in a.collect()}
    b = P.impute_grid(series.repartition(7), grid, ["g"], PLAIN, FIT, 1500, "T")
    assert got == {(r.imp, r.ID, r.age): r.value for r in b.collect()}
    x = np.array([[got[(k, 5, age)] for age in (2, 4, 9)] for k in range(1500)])
    pts, at = np.array([3.0, 6.0]), np.array([2.0, 4.0, 9.0])
    s, u = (lambda t: np.exp(0.2 + 0.05 * t)), (lambda t: np.exp(0.4 + 0.02 * t))
    k11, k01, k00 = (P.kernel(p, q, s(p), s(q), u(p), u(q)) for p, q in ((pts, pts), (at, pts), (at, at)))
    mean = 2 + 0.7 * at + k01 @ np.linalg.solve(k11, np.array([5.0, 5.0]) - 2 - 0.7 * pts)
    cov = k00 - k01 @ np.linalg.solve(k11, k01.T)
    assert x.mean(axis=0) == pytest.approx(mean, abs=5 * np.sqrt(np.diag(cov).max() / 1500))
    assert np.cov(x.T) == pytest.approx(cov, abs=0.15 * np.diag(cov).max())


def test_missing_visits(spark):
    """Fully observed subjects emit nothing; unobserved ones get unconditional draws; visits keep their own mean."""
    fit = {(0,): P.ProcessFit(np.array([1.0, 2.0]), np.array([0.0, 0.0, 0.5, np.log(0.2)]))}
    rows = [
        (0, 1, 1, 3.0, 0.0, 3.0, 1.0), (0, 1, 2, 4.0, 0.0, 4.0, 1.5),
        (0, 2, 3, 3.0, 0.0, 3.0, 4.0), (0, 2, 4, 3.0, 10.0, 3.0, None), (0, 2, 5, 9.0, 0.0, 9.0, None),
        (0, 3, 6, 5.0, 1.0, 5.0, None),
    ]
    out = P.impute_missing(frame(spark, rows), ["g"], NOISY, "y", fit, 400, "y").collect()
    assert {(r.ID, r.visit_id) for r in out} == {(2, 4), (2, 5), (3, 6)} and len(out) == 1200
    mean = {v: np.mean([r.value for r in out if r.visit_id == v]) for v in (4, 5, 6)}
    noise = 0.04 / 10
    assert mean[4] == pytest.approx(1 + 20 + 3.0 / (1 + noise), abs=0.1)
    assert mean[6] == pytest.approx(3.0, abs=0.2)
    assert np.std([r.value for r in out if r.visit_id == 6]) == pytest.approx(np.sqrt(1 + noise), rel=0.15)


def test_column_kernel_is_the_same(spark):
    df = spark.createDataFrame([(1.0, 2.5, 0.7, 1.1, 0.9, 1.4)], "t1 double, t2 double, s1 double, s2 double, u1 double, u2 double")
    got = df.select(P.kernel_column(*[F.col(c) for c in ("t1", "t2", "s1", "s2", "u1", "u2")])).first()[0]
    a = [np.array([v]) for v in (1.0, 2.5, 0.7, 1.1, 0.9, 1.4)]
    assert got == pytest.approx(P.kernel(*a)[0, 0])


@pytest.mark.parametrize("name", ["gp_fit", "gp_fit_visits", "gp_impute_grid", "gp_impute_missing"])
def test_process_queries(spark, sf, name):
    """The iterative queries run, and what they fit is a fit: converged, with a finite likelihood."""
    import __spark_entry__ as entry

    rows = entry.queries()[name](spark, sf).collect()
    assert rows
    if "fit" in name:
        assert all(r.converged and np.isfinite(r.llf) and r.steps < 100 for r in rows)
        assert {r.Female for r in rows} == {0, 1}
    else:
        assert len({r.imp for r in rows}) == 20 and all(np.isfinite(r.value) for r in rows)


def test_fit_of_the_body_model_is_a_maximum(spark, sf):
    """Nugget-free splines: no small change of any parameter raises the likelihood."""
    from auxoline.plans import process_queries as Q

    series, _ = Q.body_series(spark, sf)
    fits = P.fit_process(series, ["Female"], Q.BODY)
    for key, fit in fits.items():
        assert fit.converged and all(np.diff(fit.trace) > 0)
        moved = [P.ProcessFit(fit.beta, fit.theta + e * np.eye(len(fit.theta))[i]) for i in range(len(fit.theta)) for e in (-0.05, 0.05)]
        moved += [P.ProcessFit(fit.beta + e * np.eye(5)[i], fit.theta) for i in range(5) for e in (-0.5, 0.5)]
        sums = P.likelihood_sums(series, ["Female"], Q.BODY, {key: moved})
        assert all(v[0] < fit.llf for v in sums.values())


def test_unusable_parameters_have_no_likelihood(spark):
    """Lengths far beyond the ages or overflowing scales are refused, not clipped."""
    rows = simulate(6, 0.0, 3)
    series = P.subject_series(frame(spark, rows), ["g"], PLAIN, "y")
    beta = np.array([1.8, 0.6])
    sums = P.likelihood_sums(series, ["g"], PLAIN, {(0,): [P.ProcessFit(beta, np.array(t)) for t in ([800.0, 0, 0, 0], [0, 0, 900.0, 0], [0, 0, -40.0, 0])]})
    assert sums[0, 0][0] == sums[0, 1][0] == -np.inf
    # A vanishing length is a proper kernel: independent observations.
    assert np.isfinite(sums[0, 2][0])


def test_draws_need_converged_fits(spark):
    rows = simulate(30, 0.3, 5, True)
    df = frame(spark, rows)
    fits = P.fit_process(P.subject_series(df, ["g"], NOISY, "y"), ["g"], NOISY, P.within_age(df, ["g"], NOISY, "y"), max_steps=2)
    assert not fits[(0,)].converged
    with pytest.raises(ValueError, match="converge"):
        P.usable(fits)


def test_flat_likelihoods_are_told():
    assert P._identified(np.diag([1.0, 2.0])) and not P._identified(np.array([[1.0, 1.0], [1.0, 1.0]])) and not P._identified(np.diag([1.0, 0.0]))


def test_draws_feed_the_decomposition(spark, sf):
    """The loadings of drawn trajectories, written and read back, are those of the draws themselves."""
    import __spark_entry__ as entry
    from auxoline.operators import growth as G

    got = {(r.female, r.age): r.loading for r in entry.queries()["fpca_from_draws"](spark, sf).collect()}
    drawn = entry.queries()["gp_impute_grid"](spark, sf).withColumnRenamed("Female", "female").toPandas()
    assert len(got) == 20
    for f, part in drawn.groupby("female"):
        wide = part.pivot_table(index=["imp", "ID"], columns="age", values="value")
        cov = np.mean([np.cov(w.to_numpy().T) for _, w in wide.groupby("imp")], axis=0)
        load = G.smooth_components(cov, 1)[1][:, 0]
        assert [got[f, a] for a in range(1, 11)] == pytest.approx(list(load), rel=1e-6)


@pytest.mark.parametrize("model", [PLAIN, NOISY])
def test_sums_of_whole_stacks_equal_traces_of_each_derivative(model):
    """Gradient and information from two matrix products against one matrix per parameter."""
    rng = np.random.default_rng(11)
    k, m = 3, 9
    t, n, y = np.sort(rng.uniform(1, 10, (k, m)), 1), rng.integers(1, 4, (k, m)).astype(float), rng.normal(size=(k, m))
    x, sd = np.stack([np.ones((k, m)), t], -1), np.stack([np.ones((k, m)), t / 10], -1)
    ud = sd[:, :, : model.sizes[2]]
    fit = P.ProcessFit(np.array([0.1, 0.2]), np.array([0.2, 0.4, -1.5, *([0.6] if model.sizes[2] == 2 else []), *([-1.0] if model.noise else [])]))

    def cov(i, theta):
        g, d, noise = P.ProcessFit(fit.beta, theta).split(model)
        s, u = np.exp(sd[i] @ g), np.exp(ud[i] @ d)
        return P.kernel(t[i], t[i], s, s, u, u) + np.diag(noise / n[i] if model.noise else P.JITTER * s * s)

    got = P._sums(t, n, y, x, sd, ud, fit, model)
    q, h = model.n_cov, 1e-5
    grad, info = np.zeros(q), np.zeros((q, q))
    for i in range(k):
        inv = np.linalg.inv(cov(i, fit.theta))
        a = inv @ (y[i] - x[i] @ fit.beta)
        d = [inv @ (cov(i, fit.theta + h * e) - cov(i, fit.theta - h * e)) / (2 * h) for e in np.eye(q)]
        grad += [0.5 * (a @ np.linalg.solve(inv, w) @ a - np.trace(w)) for w in d]
        info += [[0.5 * np.trace(v @ w) for w in d] for v in d]
    assert got[7 : 7 + q] == pytest.approx(grad, rel=1e-4, abs=1e-4)
    assert got[7 + q :].reshape(q, q) == pytest.approx(info, rel=1e-4, abs=1e-4)


def test_steps_read_arrays_of_numbers_and_small_stacks(spark):
    """Memory of a task: no object per point, and a stack's matrices are bounded however many subjects have equally many ages."""
    series = P.subject_series(frame(spark, simulate(30)), ["g"], PLAIN, "y")
    flat = P.flat_series(series, ["g"], PLAIN)
    assert dict(flat.dtypes) == {"g": "bigint", "flat": "array<double>"}
    m, subjects = 50, 400
    numbers = np.arange(subjects * m * 5, dtype=float)
    stacks = list(P._stacks(np.arange(subjects + 1) * m * 5, numbers, PLAIN))
    assert max(z["t"].size * m for z in stacks) <= P.CELLS
    assert np.concatenate([z["t"].ravel() for z in stacks]).tolist() == numbers[::5].tolist()


@pytest.mark.parametrize("model", [PLAIN, NOISY])
def test_values_alone_are_those_of_the_whole_sums(model):
    rng = np.random.default_rng(4)
    k, m = 4, 8
    t, n, y = np.arange(1.0, m + 1) + rng.uniform(0, 0.5, (k, m)), rng.integers(1, 4, (k, m)).astype(float), rng.normal(size=(k, m))
    x, sd = np.stack([np.ones((k, m)), t], -1), np.stack([np.ones((k, m)), t / 10], -1)
    ud = sd[:, :, : model.sizes[2]]
    fit = P.ProcessFit(np.array([0.1, 0.2]), np.array([0.2, 0.4, -1.0, *([0.6] if model.sizes[2] == 2 else []), *([-1.0] if model.noise else [])]))
    args = t, n, y, x, sd, ud
    assert P._value(*args, fit, model) == pytest.approx(P._likelihood(*args, fit, model)[:1], rel=1e-9)
    for bad in (800.0, np.nan):
        assert P._value(*args, P.ProcessFit(fit.beta, np.append(bad, fit.theta[1:])), model)[0] == -np.inf


def test_only_trials_that_are_taken_have_gradients(spark, monkeypatch):
    """Several trials of a step are compared by their values; gradient and information are worked out for the best alone, and for none that is refused."""
    rows = simulate(60, 0.3, 5, True)
    df = frame(spark, rows)
    series, extra = P.subject_series(df, ["g"], NOISY, "y"), P.within_age(df, ["g"], NOISY, "y")
    asked, original = [], P.likelihood_sums

    def recorded(series, by, model, fits, whole=None):
        asked.extend((len(f), whole is None or whole[k]) for k, f in fits.items())
        return original(series, by, model, fits, whole)

    monkeypatch.setattr(P, "likelihood_sums", recorded)
    fit = P.fit_process(series, ["g"], NOISY, extra)[(0,)]
    assert fit.converged and fit.llf == pytest.approx(row_llf(rows, fit, NOISY), abs=1e-4)
    assert any(n > 1 for n, _ in asked) and all(n == 1 for n, whole in asked if whole)
    assert sum(whole for _, whole in asked) == len(fit.trace)
