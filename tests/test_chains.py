"""Fitted models carried through pooling, storage and rereading, against plain matrix algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from auxoline.operators import contrasts as K
from auxoline.operators import linear as L
from auxoline.operators import mixed as X
from auxoline.plans import growth_queries as G
from auxoline.plans import model_queries as Q
from auxoline.sources import results as R


@pytest.fixture(scope="module")
def study(spark, sf):
    basis = G.written_basis(spark, sf)
    return basis, G.frame(spark, sf, reused=True, basis=basis)


def dense_pool(pdf, columns, y):
    """Rubin's rules over imputations from plain least squares."""
    est, cov = [], []
    for _, part in pdf.groupby("imp"):
        x, v = part[columns].to_numpy(dtype=float), part[y].to_numpy(dtype=float)
        inv = np.linalg.pinv(x.T @ x)
        b = inv @ x.T @ v
        est.append(b)
        cov.append(inv * ((v - x @ b) ** 2).sum() / (len(v) - len(columns)))
    est = np.array(est)
    return est.mean(0), np.mean(cov, 0) + (1 + 1 / len(est)) * np.cov(est.T)


def exposures(study):
    basis, df = study
    columns = ["one", "age_x", *K.EXPOSURE_TERMS]
    pdf = df.toPandas().assign(one=1.0)
    pdf["HT_cen"], pdf["BMI_cen"] = pdf["ht_cen"], pdf["bmi_cen"]
    pdf["HT_cen:pc0"], pdf["BMI_cen:pc0"] = pdf["ht_cen"] * pdf["pc0"], pdf["bmi_cen"] * pdf["pc0"]
    return {f: dense_pool(part, columns, "sbp") for f, part in pdf.groupby("female")}


def test_contrasts_from_a_stored_model(spark, study):
    basis, df = study
    model = Q.fitted_exposures(spark, df, basis, L.fit_linear)
    out = K.pattern_contrasts(model.withColumn("pats", Q.pattern_structs(basis).scalar()), ["female"]).collect()
    scores = {p.pat: p.scores[0] for p in Q.pattern_structs(basis).first()[0]}
    dense = exposures(study)
    assert len(out) == 2 * 6 * 7
    for r in out:
        s, ref, h = scores[r.pat], scores[K.REFERENCE_PATTERN], r.shift
        u = np.array([0, 0, h, 0, s - ref, h * s, 0] if r["size"] == "Ht" else [0, 0, 0, h, s - ref, 0, h * s], dtype=float)
        est, cov = dense[r.female]
        assert r.est == pytest.approx(u @ est, rel=1e-5, abs=1e-6)
        assert r.se == pytest.approx(np.sqrt(u @ cov @ u), rel=1e-5, abs=1e-6)


def test_effects_add_up_and_use_the_fitted_model(spark, sf):
    rows = {(r.female, r.effect): r for r in entry.queries()["mediation_effects_fitted"](spark, sf).collect()}
    assert len(rows) == 10
    for f in (0, 1):
        assert rows[f, "total"].est == pytest.approx(rows[f, "direct"].est + rows[f, "overall indirect"].est, abs=3e-4)
        assert rows[f, "overall indirect"].est == pytest.approx(rows[f, "indirect through height"].est + rows[f, "indirect through BMI"].est, abs=3e-4)
        assert all(rows[f, e].se > 0 for e in ("direct", "total"))


def test_mixed_pool_follows_from_the_fits(spark, sf, study):
    fits = X.fit_mixed(study[1], ["imp"], Q.two_slopes(), F.col("sbp")).collect()
    est = np.array([r.est for r in fits])
    total = np.mean([np.diag(np.array(r["cov"])) for r in fits], 0) + (1 + 1 / len(fits)) * est.var(0, ddof=1)
    got = {r.term: r for r in entry.queries()["mixed_pool"](spark, sf).collect()}
    for k, term in enumerate(fits[0].terms):
        assert got[term].est == pytest.approx(est[:, k].mean(), rel=1e-3, abs=1e-4)
        assert got[term].se == pytest.approx(np.sqrt(total[k]), rel=1e-2)
        assert got[term].converged == all(r.converged for r in fits)


def test_contrasts_from_mixed_models(spark, sf):
    rows = entry.queries()["growth_contrast_fitted"](spark, sf).collect()
    assert len(rows) == 84 and all(np.isfinite(r.est) and r.lower <= r.est <= r.upper for r in rows)


def test_full_outcome_model(spark):
    """Some fifty columns need more rows than the smallest scale has complete."""
    rows = entry.queries()["mixed_fit_full"](spark, "/root/testdata/sf0.01").collect()
    terms = {r.term for r in rows}
    assert len(terms) >= 40 and len(rows) == 20 * len(terms)
    assert all(r.converged for r in rows) and any(t.startswith("Year[") for t in terms) and any(t.startswith("Village[") for t in terms)


def test_writing_imputations_again_leaves_the_same_rows(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, a, float(k + i + a), 0.0) for k in range(3) for i in range(4) for a in range(1, 4)], "imp long, ID long, age int, value double, mean double")
    for _ in range(2):
        R.write_imputed(rows, str(tmp_path), "HT")
    R.write_imputed(rows.where("imp = 1"), str(tmp_path), "WT")
    assert R.read_imputed(spark, str(tmp_path), "HT").count() == 36
    assert R.read_imputed(spark, str(tmp_path)).count() == 48


def test_several_models_are_not_mixed_up(spark):
    fit = spark.createDataFrame([(["a"], [1.0]), (["a"], [2.0])], "terms array<string>, est array<double>")
    design = spark.createDataFrame([(1, 2.0)], "ID long, a double")
    with pytest.raises(Exception, match="one row is expected"):
        L.linear_predictor(design, ["ID"], {"a": F.col("a")}, fit).collect()
    assert L.linear_predictor(design, ["ID"], {"a": F.col("a")}, fit.limit(1)).first().fitted == 2.0


def test_grid_models_are_those_of_their_own_formula_and_rows(spark):
    """One sex and level of the mediation grid against plain least squares on the same rows."""
    df, basis, village = Q.grid_frame(spark, "/root/testdata/sf0.01")
    pooled, terms = Q.grid_fits(df, village, True)
    means = {(r.female, r.adj, r.mediator): r for r in Q.grid_means(df, village, basis, pooled, terms).collect()}
    assert len(means) == 2 * 4 * 2
    got = {(r.female, r.adj, r.model): dict(zip(r.terms, r.est)) for r in pooled.collect()}
    wanted = Q.grid_terms("BMI_cen", 1, 2)
    pdf = df.where("female = 1 AND adj = 2").select("imp", "ID", "datecomb", "visit_id", "Village", "BMI_cen", *[c.alias(t) for t, c in wanted.items()]).toPandas()
    columns = list(wanted)
    for v in village.levels:
        if v != village.reference:
            pdf[f"Village[{v}]"] = (pdf["Village"] == v).astype(float)
            columns.append(f"Village[{v}]")
    est = []
    for _, part in pdf.groupby("imp"):
        x = part[columns].to_numpy(dtype=float)
        est.append(np.linalg.lstsq(x, part["BMI_cen"].to_numpy(dtype=float), rcond=1e-8)[0])
        fit = x @ np.array([np.nan_to_num(e) for e in est[-1]])
        assert np.isfinite(fit).all()
    dense, model = np.mean(est, 0), got[1, 2, "BMI_cen"]
    assert list(model) == columns or set(model) == set(columns)
    first = pdf.sort_values(["datecomb", "visit_id"]).groupby(["imp", "ID"]).first().reset_index()
    at = first.groupby("imp")[columns].mean().mean()
    for k, t in enumerate(("age_x", "age_x^2", "age_x^3"), start=1):
        at[t] = 1.1**k
    cell = means[1, 2, "bmi_cen"]
    for p, m in ((cell.p0, cell.m1), (cell.p1, cell.m2)):
        at["pc0"] = p
        assert m == pytest.approx(sum(at[c] * e for c, e in zip(columns, dense)), rel=1e-3, abs=1e-3)
    effects = {(r.female, r.adj): r.est for r in entry.queries()["mediation_grid"](spark, "/root/testdata/sf0.01").where("effect = 'total'").collect()}
    assert len(effects) == 8 and len(set(effects.values())) == 8
