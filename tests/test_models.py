import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from auxoline.operators import contrasts as K
from auxoline.operators import design as D
from auxoline.operators import growth as G
from auxoline.operators import linear as L
from auxoline.operators import mediation as M
from auxoline.functions.patterns import growth_patterns


def regression_data(spark, n=300, reps=2, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for imp in range(reps):
        x, g = rng.normal(size=n), rng.integers(0, 4, size=n)
        y = 1 + 2 * x + 0.5 * g + rng.normal(size=n)
        rows += [(imp, float(a), int(b), float(c)) for a, b, c in zip(x, g, y)]
    return rows, spark.createDataFrame(rows, "imp long, x double, g int, y double")


def test_least_squares_with_a_factor(spark):
    rows, df = regression_data(spark)
    village = D.factor(df, "g", 2)
    fits = L.fit_linear(df, ["imp"], D.intercept() | D.linear("x"), F.col("y"), [village])
    for r in fits.collect():
        data = np.array([row[1:] for row in rows if row[0] == r.imp])
        x = np.column_stack([np.ones(len(data)), data[:, 0], *[(data[:, 1] == v) for v in (0, 1, 3)]])
        est, rss, *_ = np.linalg.lstsq(x, data[:, 2], rcond=None)
        scale = rss[0] / (len(data) - 5)
        assert r.terms == ["Intercept", "x", "g[0]", "g[1]", "g[3]"]
        assert r.est == pytest.approx(list(est), abs=1e-8)
        assert np.array(r.cov) == pytest.approx(scale * np.linalg.inv(x.T @ x), abs=1e-8)
        assert (r.n, r.scale) == (300, pytest.approx(scale))


def test_custom_estimator_works_from_cross_products(spark):
    def ridge(names, xx, xy, yy, n):
        est = np.linalg.solve(xx + np.eye(len(xy)), xy)
        return {"terms": names, "est": est, "cov": np.eye(len(xy)), "scale": 1.0, "n": n, "llf": 0.0}

    _, df = regression_data(spark, reps=1)
    a = L.fit_linear(df, ["imp"], D.intercept() | D.linear("x"), F.col("y")).first()
    b = L.fit_linear(df, ["imp"], D.intercept() | D.linear("x"), F.col("y"), estimator=ridge).first()
    assert abs(b.est[1]) < abs(a.est[1])


def fits_frame(spark, rows):
    return spark.createDataFrame(rows, "spec string, imp long, terms array<string>, est array<double>, cov array<array<double>>, scale double, n long, llf double")


def test_pooling_by_hand(spark):
    rows = [("m", 0, ["a", "b"], [1.0, 4.0], [[1.0, 0.1], [0.1, 2.0]], 1.0, 10, -5.0), ("m", 1, ["a", "b"], [3.0, 4.0], [[3.0, 0.3], [0.3, 2.0]], 2.0, 10, -7.0)]
    out = {(r.term_i, r.term_j): r for r in L.pool(fits_frame(spark, rows), ["spec"]).collect()}
    assert (out[("a", "a")].est_i, out[("a", "a")].within, out[("a", "a")].between) == (2.0, 2.0, 2.0)
    assert out[("a", "a")].total == 2.0 + 1.5 * 2.0 and out[("a", "a")].lost == pytest.approx(3.0 / 5.0)
    assert (out[("b", "b")].between, out[("b", "b")].total, out[("a", "b")].total) == (0.0, 2.0, pytest.approx(0.2))
    packed = L.pooled_matrix(L.pool(fits_frame(spark, rows), ["spec"]), ["spec"]).first()
    assert (packed.terms, packed.est) == (["a", "b"], [2.0, 4.0])
    stats = L.pooled_fit_stats(fits_frame(spark, rows), ["spec"]).first()
    assert (stats.m, stats.llf, stats.scale) == (2, -6.0, 1.5)


def test_pooled_matrix_takes_averages_that_differ_in_the_last_bits(spark):
    # Pairs average the same estimates each for itself; added up in another order they differ in the last bits.
    terms, est = ["a", "b", "c"], [0.3, 1.0, -2.5]
    rows = [("m", i, j, a, b, est[i] if i == j else np.nextafter(est[i], 9.0 * (j - i)).item(), 10.0 * i + j) for i, a in enumerate(terms) for j, b in enumerate(terms)]
    pooled = spark.createDataFrame(rows, "spec string, i int, j int, term_i string, term_j string, est_i double, total double")
    packed = L.pooled_matrix(pooled, ["spec"]).first()
    assert (packed.terms, packed.est) == (terms, est)
    assert packed["cov"] == [[0.0, 1.0, 2.0], [10.0, 11.0, 12.0], [20.0, 21.0, 22.0]]
    assert L.slice_terms(L.pooled_matrix(pooled, ["spec"]), ["c", "a"]).first()["cov"] == [[22.0, 20.0], [2.0, 0.0]]


def test_equal_imputations_have_no_between_variance(spark):
    rows = [("m", k, ["a"], [1.0], [[2.0]], 1.0, 5, 0.0) for k in range(20)]
    r = L.pool(fits_frame(spark, rows), ["spec"]).first()
    assert (r.between, r.total, r.lost) == (0.0, 2.0, 0.0)


def test_dimension_choice_first_wins_ties(spark):
    df = spark.createDataFrame([("a", 1, -10.0), ("a", 2, -7.0), ("b", 1, -10.0), ("b", 2, -6.0), ("c", 1, -10.0), ("c", 2, -9.0)], "spec string, ndim int, llf double")
    out = {r.spec: (r.ndim, r.score) for r in L.select_dimension(df, ["spec"]).collect()}
    assert out == {"a": (1, -10.0), "b": (2, -9.0), "c": (1, -10.0)}


def test_components_match_numpy(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 1)) * np.linspace(1, 2, 10) + 0.5 * rng.normal(size=(40, 1)) * np.linspace(-1, 1, 10)
    rows, stacks = [], []
    for imp in range(3):
        x = base + 0.1 * rng.normal(size=base.shape) + 100
        stacks.append(x)
        rows += [(imp, i, a + 1, float(x[i, a])) for i in range(40) for a in range(10)]
    rows.append((0, 99, 1, 5.0))  # incomplete: ignored
    df = spark.createDataFrame(rows, "imp long, ID long, age int, value double")
    basis = G.fpca(G.pooled_moments(df, []), [], 2).first()
    cov = np.mean([np.cov(x.T) for x in stacks], axis=0)
    assert np.array(basis.cov) == pytest.approx(cov, abs=1e-10)
    sd = np.sqrt(np.diag(cov))
    second = np.array([[{0: 1, 1: -2, 2: 1}.get(j - i, 0) for j in range(10)] for i in range(8)])
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd) - 0.2 * second.T @ second)
    for k in range(2):
        v = vectors[:, -1 - k] / sd
        got = np.array(basis.loadings[k])
        assert got == pytest.approx(v, abs=1e-8) or got == pytest.approx(-v, abs=1e-8)
        assert (got > 0).sum() >= (got < 0).sum()
        assert basis.eigenvalues[k] == pytest.approx(values[-1 - k])
    scores = G.pc_scores(df, G.fpca(G.pooled_moments(df, []), [], 2), [], 2)
    want = (stacks[1][7] - np.mean([x.mean(axis=0) for x in stacks], axis=0)) @ np.array(basis.loadings).T
    r = scores.where("imp = 1 AND ID = 7").first()
    assert [r.pc0, r.pc1] == pytest.approx(list(want), abs=1e-9)


def test_negative_component_is_refused():
    with pytest.raises(ValueError):
        G.smooth_components(np.eye(10), 10)


def model_row(spark, seed=2):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(5, 5))
    cov, est, load = a @ a.T, rng.normal(size=5), rng.normal(size=3)
    basis = spark.createDataFrame(
        [("m", [1, 2, 3], [[4.0, 0.0, 0.0], [0.0, 9.0, 0.0], [0.0, 0.0, 1.0]], [load.tolist()], est.tolist(), cov.tolist())],
        "spec string, ages array<int>, cov array<array<double>>, loadings array<array<double>>, e array<double>, v array<array<double>>",
    )
    return basis, est, cov, load


def test_pattern_contrasts_by_hand(spark):
    basis, est, cov, load = model_row(spark)
    pats = growth_patterns(basis, []).select(F.struct("pat", "label", "short", "scores").alias("p")).agg(F.sort_array(F.collect_list("p")).alias("pats"))
    fit = basis.select("spec", F.col("e").alias("est"), F.col("v").alias("cov")).withColumn("pats", pats.scalar())
    out = {(r["size"], r["shift"], r["pat"]): r for r in K.pattern_contrasts(fit, ["spec"], "zm", reference=1).collect()}
    assert len(out) == 42
    sd = np.array([2.0, 3.0, 1.0])
    score = {0: load @ sd, 1: load @ (np.linspace(0, 1, 3) * sd), 4: load @ (np.linspace(-1, 0, 3) * sd), 6: -(load @ sd)}
    for size, h, pat in (("Ht", 7.1, 4), ("BMI", -1.8, 6), ("Ht", 0.0, 0)):
        s = score[pat]
        u = np.array([h, 0, s - score[1], h * s, 0]) if size == "Ht" else np.array([0, h, s - score[1], 0, h * s])
        r = out[(size, h, pat)]
        se = math.sqrt(u @ cov @ u)
        assert (r.est, r.se) == (pytest.approx(u @ est), pytest.approx(se))
        assert r.p == pytest.approx(math.erfc(abs(u @ est / se) / math.sqrt(2)), abs=3e-7)
    ref = out[("Ht", 0.0, 1)]
    assert (ref.est, ref.se, ref.z, ref.p) == (0.0, 0.0, None, None)


def test_contrasts_need_one_component(spark):
    basis, *_ = model_row(spark)
    two = basis.withColumn("loadings", F.concat("loadings", "loadings"))
    pats = growth_patterns(two, []).select(F.struct("pat", "label", "short", "scores").alias("p")).agg(F.sort_array(F.collect_list("p")).alias("pats"))
    fit = two.select("spec", F.col("e").alias("est"), F.col("v").alias("cov")).withColumn("pats", pats.scalar())
    with pytest.raises(Exception, match="one component"):
        K.pattern_contrasts(fit, ["spec"]).collect()


def test_two_component_trajectory(spark):
    rng = np.random.default_rng(4)
    w, est, a = rng.normal(size=(2, 4)), rng.normal(size=2), rng.normal(size=(2, 2))
    cov = a @ a.T
    df = spark.createDataFrame(
        [("m", est.tolist(), cov.tolist(), [1, 2, 3, 4], w.tolist())],
        "spec string, est array<double>, cov array<array<double>>, ages array<int>, loadings array<array<double>>",
    )
    out = {r.age: r for r in K.coefficient_trajectory(df, ["spec"], 2).collect()}
    for i in range(4):
        se = math.sqrt(w[:, i] @ cov @ w[:, i])
        assert (out[i + 1].est, out[i + 1].se, out[i + 1].upper) == (pytest.approx(w[:, i] @ est), pytest.approx(se), pytest.approx(w[:, i] @ est + 2 * se))


def test_effects_add_up(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(5, 5))
    df = spark.createDataFrame(
        [("m", rng.normal(size=5).tolist(), (a @ a.T).tolist(), *rng.normal(size=8).tolist())],
        "spec string, est array<double>, cov array<array<double>>, p0 double, p1 double, h0 double, h1 double, dh double, b0 double, b1 double, db double",
    )
    e = {r.effect: r.est for r in M.mediation_effects(df, ["spec"]).collect()}
    assert e["total"] == pytest.approx(e["direct"] + e["overall indirect"])
    assert e["overall indirect"] == pytest.approx(e["indirect through height"] + e["indirect through BMI"])


def simulation_frame(spark):
    rng = np.random.default_rng(11)
    rows = []
    for imp in range(4):
        for i in range(60):
            pc = float(rng.normal())
            for v in range(3):
                age, w = float(rng.uniform(0, 1)), float(rng.normal())
                rows.append(("f", imp, i, v, f"2020-01-{v + 1:02d}", age, pc, w, 2 + age - 0.5 * pc + 0.3 * w + 0.1 * float(rng.normal())))
    cols = "sex string, imp long, ID long, visit_id long, datecomb string, age_x double, pc0 double, w double, HT_cen double"
    return rows, spark.createDataFrame(rows, cols)


TERMS = ("age_x", "pc0", "w")


def test_simulation_without_draws_is_the_plain_prediction(spark):
    rows, df = simulation_frame(spark)
    terms = D.intercept() | D.linear(*TERMS)
    out = M.simulate_mediator(df, ["sex"], "HT_cen", terms, F.array(F.lit(-1.0), F.lit(2.0)), draw=False).orderBy("imp").collect()
    fits = L.fit_linear(df, ["sex", "imp"], terms, F.col("HT_cen")).orderBy("imp").collect()
    b = np.mean([r.est for r in fits], axis=0)
    scale = np.mean([r.scale for r in fits])
    for r in out:
        first = np.array([[1, 1.1, 0.0, x[7]] for x in rows if x[1] == r.imp and x[3] == 0])
        y = [first @ b + b[2] * p for p in (-1.0, 2.0)]
        assert (r.m1, r.m2) == (pytest.approx(y[0].mean()), pytest.approx(y[1].mean()))
        assert (r.v1, r.v2) == (pytest.approx(y[0].var() + scale), pytest.approx(y[1].var() + scale))
        assert (r.dm, r.dv) == (pytest.approx((y[1] - y[0]).mean()), pytest.approx(0.0, abs=1e-12))


def test_draws_do_not_depend_on_partitions(spark):
    _, df = simulation_frame(spark)
    terms = D.intercept() | D.linear(*TERMS)
    pair = F.array(F.lit(-1.0), F.lit(2.0))
    a = M.simulate_mediator(df.repartition(1), ["sex"], "HT_cen", terms, pair).orderBy("imp").collect()
    b = M.simulate_mediator(df.repartition(7), ["sex"], "HT_cen", terms, pair).orderBy("imp").collect()
    assert [r.dm for r in a] == pytest.approx([r.dm for r in b], abs=1e-9)
    assert len({round(r.dm, 6) for r in a}) == 4
    c = M.simulate_mediator(df, ["sex"], "HT_cen", terms, pair, common_draws=True).collect()
    assert all(r.dv == pytest.approx(0.0, abs=1e-12) for r in c)


def test_merged_fills(spark):
    frame = spark.createDataFrame([(0, 1, 1, 1, 2.0), (0, 1, 2, 1, None), (1, 1, 2, 1, None), (0, 2, 3, 0, None), (0, 3, 4, 1, None)], "imp long, ID long, visit_id long, Female int, b double")
    fills = spark.createDataFrame([(0, 1, 2, 5.0), (1, 1, 2, 6.0), (0, 2, 3, 7.0)], "imp long, ID long, visit_id long, value double")
    out = {(r.imp, r.visit_id): r.b for r in G.merge_fills(frame, fills, "b", 0).collect()}
    assert out == {(0, 1): 2.0, (0, 2): 5.0, (1, 2): 6.0, (0, 3): 0.0, (0, 4): None}
