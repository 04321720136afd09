"""Design rows, least squares by imputation, pooling, contrasts, curves and mediation."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from auxoline.functions.normal import erfc_sql, normal_cdf, two_sided_p
from auxoline.functions.patterns import patterns
from auxoline.operators import clean as C
from auxoline.operators import contrasts as K
from auxoline.operators import design as D
from auxoline.operators import growth as G
from auxoline.operators import linear as L
from auxoline.operators import mediation as M
from auxoline.operators import mixed as X
from auxoline.plans.cohort_queries import cleaned, r6
from auxoline.plans.growth_queries import FRAME, MOMENTS, PATTERN_SQL, flat_basis, frame, scores, written_basis
from auxoline.plans.registry import query
from auxoline.plans.study_sql import CLEAN
from auxoline.session import checkpoint_dir, durable
from auxoline.sources import study_tables as T
from auxoline.sources.results import read_model, write_model


def r4(col):
    return F.round(col, 4)


# Design rows ---------------------------------------------------------------------------------

VILLAGES = (1, 4, 7, 10, 13, 16, 19, 22, 25)

DESIGN_SQL = {
    "intercept": "1.0::DOUBLE", "female": "Female::DOUBLE", "age_x": "age_x", "age_x2": "age_x*age_x", "age_x3": "age_x*age_x*age_x",
    "lognummeas": "lognummeas", "female_age_x": "Female*age_x", "female_age_x2": "Female*(age_x*age_x)",
    "female_age_x3": "Female*(age_x*age_x*age_x)", "female_lognummeas": "Female*lognummeas",
    "temp_cen": "Temp - m_temp", "school": "School::DOUBLE", "wealth_z": "Wealth_Z", "female_breast": "Female*Breast_Stage_Use_Z",
    "male_log2t": "Male*log2T_use_Z", "pregmo": "preg - m_preg", "pregmo2": "(preg - m_preg)*(preg - m_preg)",
    "lactmo": "lact - m_lact", **{f"village_{v}": f"CASE WHEN vil = {v} THEN 1.0::DOUBLE ELSE 0 END" for v in VILLAGES},
    "mom_ht": "Mom_Ht_Ave::DOUBLE", "mom_sbp": "Mom_SBP_Z_Res_USE", "dad_ht": "Dad_Ht_Ave::DOUBLE", "dad_sbp": "Dad_SBP_Z_Res_USE",
    "ht_cen": "HT - m_ht", "bmi_cen": "BMI - m_bmi",
}


@query(
    "design_terms",
    f"""WITH {CLEAN},
    d0 AS (SELECT *, (Age - 10)/10.0::DOUBLE AS age_x, CASE WHEN Female = 0 THEN coalesce(PregMo_Use, 0) ELSE PregMo_Use END AS preg,
      coalesce(lactMo_Use, 0) AS lact, CASE WHEN Bamako = 1 THEN 50 ELSE Village END AS vil FROM clean),
    m AS (SELECT avg(Temp) AS m_temp, avg(preg) AS m_preg, avg(lact) AS m_lact, avg(HT) AS m_ht, avg(BMI) AS m_bmi FROM d0)
    SELECT ID, visit_id, """ + ", ".join(f"round({e}, 6) + 0.0 AS {k}" for k, e in DESIGN_SQL.items()) + " FROM d0, m",
)
def design_terms(spark, sf_dir):
    df = C.recode_village(cleaned(spark, sf_dir)).withColumns(
        {"preg": C.fill_males_zero("PregMo_Use"), "lact": F.coalesce("lactMo_Use", F.lit(0))}
    )
    df = C.with_centering(df, {"preg": F.col("preg"), "lact": F.col("lact")})
    df = df.withColumns({"PregMo_Use_cen": F.col("preg") - F.col("c.preg_mean"), "lactMo_Use_cen": F.col("lact") - F.col("c.lact_mean")})
    village = D.factor(T.cohort(spark, sf_dir, ["Bamako", "Village"]).transform(C.recode_village).where("Bamako < 2"), "Village", 50)
    terms = D.outcome_terms([], False, True, village) | D.linear("HT_cen", "BMI_cen")
    return df.select("ID", "visit_id", *[r6(c).alias(n) for n, c in zip(DESIGN_SQL, terms.values(), strict=True)])


# Least squares by imputation -----------------------------------------------------------------

SLOPES = {"age_x": "age_x", "pc0": "pc0"}


def two_slopes() -> dict:
    return D.intercept() | D.linear("age_x", "pc0")


def ols2(name: str, y: str, x: str, z: str, src: str, keys: str) -> str:
    """Closed-form regression on two predictors as CTEs; columns b0..b2, v00..v22, scale, llf, n."""
    return f"""{name}_m AS (SELECT {keys}, count(*) AS n, avg({x}) AS xm, avg({z}) AS zm, avg({y}) AS ym, var_pop({x}) AS sxx,
      var_pop({z}) AS szz, covar_pop({x}, {z}) AS sxz, covar_pop({x}, {y}) AS sxy, covar_pop({z}, {y}) AS szy, var_pop({y}) AS syy
      FROM {src} GROUP BY {keys}),
    {name}_b AS (SELECT *, (szz*sxy - sxz*szy)/(sxx*szz - sxz*sxz) AS b1, (sxx*szy - sxz*sxy)/(sxx*szz - sxz*sxz) AS b2,
      sxx*szz - sxz*sxz AS det FROM {name}_m),
    {name}_s AS (SELECT *, ym - b1*xm - b2*zm AS b0, n*(syy - b1*sxy - b2*szy) AS rss FROM {name}_b),
    {name}_v AS (SELECT *, rss/(n - 3) AS scale, rss/(n - 3)*szz/(n*det) AS v11, rss/(n - 3)*sxx/(n*det) AS v22,
      -rss/(n - 3)*sxz/(n*det) AS v12, -n/2.0::DOUBLE*(ln(2*pi()*rss/n) + 1) AS llf FROM {name}_s),
    {name} AS (SELECT *, scale/n + xm*xm*v11 + zm*zm*v22 + 2*xm*zm*v12 AS v00, -(xm*v11 + zm*v12) AS v01,
      -(xm*v12 + zm*v22) AS v02 FROM {name}_v)"""


@query(
    "normal_equations",
    f"WITH {FRAME}, u AS (SELECT imp, 1.0::DOUBLE AS a, age_x AS b, pc0 AS c, wealth_z AS d, sbp AS y FROM frame) "
    + " UNION ALL ".join(
        f"SELECT imp, count(*) AS n, '{names[0]}' AS term_i, '{names[1]}' AS term_j, round(sum({a}*{b}), 6) + 0.0 AS v FROM u GROUP BY imp"
        for a, b, names in [
            (p, q, (m, n))
            for i, (p, m) in enumerate(zip("abcdy", ("Intercept", "age_x", "pc0", "wealth_z", "y")))
            for q, n in list(zip("abcdy", ("Intercept", "age_x", "pc0", "wealth_z", "y")))[i:]
        ]
    ),
)
def normal_equations(spark, sf_dir):
    terms = two_slopes() | D.linear("wealth_z")
    cross = L.cross_products(frame(spark, sf_dir), ["imp"], terms, F.col("sbp"))
    return L.normal_equation_rows(cross, ["imp"], list(terms)).select("imp", "n", "term_i", "term_j", r6("v").alias("v"))


TERM_SQL = (("Intercept", "b0", "v00"), ("age_x", "b1", "v11"), ("pc0", "b2", "v22"))


@query(
    "ols_by_imp",
    f"WITH {FRAME}, {ols2('o', 'ht_cen', 'age_x', 'pc0', 'frame', 'female, imp')} "
    + " UNION ALL ".join(
        f"SELECT female, imp, '{t}' AS term, round({b}, 6) + 0.0 AS est, round(sqrt({v}), 6) AS se, round(scale, 6) AS scale FROM o"
        for t, b, v in TERM_SQL
    ),
)
def ols_by_imp(spark, sf_dir):
    fits = L.fit_linear(frame(spark, sf_dir), ["female", "imp"], two_slopes(), F.col("ht_cen"))
    return L.coef_rows(fits, ["female", "imp"]).select(
        "female", "imp", "term", r6("est").alias("est"), r6("se").alias("se"), r6("scale").alias("scale")
    )


PAIRS = [(i, j) for i in range(3) for j in range(3)]


def pooled_sql(src: str, keys: str, out: str = "pool_") -> str:
    """Pooled pairs of an ols2 result."""
    rows = " UNION ALL ".join(
        f"""SELECT {keys}, '{TERM_SQL[i][0]}' AS term_i, '{TERM_SQL[j][0]}' AS term_j, count(*) AS m, avg(b{i}) AS est_i,
        avg(v{min(i, j)}{max(i, j)}) AS within, covar_samp(b{i}, b{j}) AS between_ FROM {src} GROUP BY {keys}"""
        for i, j in PAIRS
    )
    return f"{out} AS (SELECT *, within + (1 + 1.0::DOUBLE/m)*between_ AS total FROM ({rows}))"


@query(
    "rubin_pool",
    f"""WITH {FRAME}, {ols2('o', 'ht_cen', 'age_x', 'pc0', 'frame', 'female, imp')}, {pooled_sql('o', 'female')}
    SELECT female, term_i, term_j, m, round(est_i, 6) + 0.0 AS est_i, round(within, 8) + 0.0 AS within,
    round(between_, 8) + 0.0 AS between, round(total, 8) + 0.0 AS total, round((1 + 1.0::DOUBLE/m)*between_/total, 6) + 0.0 AS lost
    FROM pool_""",
)
def rubin_pool(spark, sf_dir):
    fits = L.fit_linear(frame(spark, sf_dir), ["female", "imp"], two_slopes(), F.col("ht_cen"))
    out = L.pool(fits, ["female"])
    return out.select(
        "female", "term_i", "term_j", "m", r6("est_i").alias("est_i"), F.round("within", 8).alias("within"),
        F.round("between", 8).alias("between"), F.round("total", 8).alias("total"), r6("lost").alias("lost"),
    )


@query(
    "pooled_fit_stats",
    f"""WITH {FRAME}, {ols2('o', 'ht_cen', 'age_x', 'pc0', 'frame', 'female, imp')}
    SELECT female, count(*) AS m, round(avg(llf), 4) AS llf, round(avg(scale), 6) AS scale FROM o GROUP BY female""",
)
def pooled_fit_stats(spark, sf_dir):
    fits = L.fit_linear(frame(spark, sf_dir), ["female", "imp"], two_slopes(), F.col("ht_cen"))
    return L.pooled_fit_stats(fits, ["female"]).select("female", "m", r4("llf").alias("llf"), r6("scale").alias("scale"))


@query(
    "coef_slice",
    f"""WITH {FRAME}, {ols2('o', 'sbp', 'age_x', 'pc0', 'frame', 'female, imp')}, {pooled_sql('o', 'female')}
    SELECT p.female, term_i, term_j, round(est_i, 6) + 0.0 AS est_i, round(total, 8) + 0.0 AS vcov FROM pool_ p
    WHERE term_i IN ('pc0', 'age_x') AND term_j IN ('pc0', 'age_x')""",
)
def coef_slice(spark, sf_dir):
    fits = L.fit_linear(frame(spark, sf_dir), ["female", "imp"], two_slopes(), F.col("sbp"))
    kept = L.slice_terms(L.pooled_matrix(L.pool(fits, ["female"]), ["female"]), ["pc0", "age_x"])
    rows = kept.select("female", "terms", F.inline(F.arrays_zip(F.col("terms").alias("term_i"), F.col("est").alias("est_i"), "cov")))
    cells = rows.select("female", "term_i", "est_i", F.inline(F.arrays_zip(F.col("terms").alias("term_j"), F.col("cov").alias("vcov"))))
    return cells.select("female", "term_i", "term_j", r6("est_i").alias("est_i"), F.round("vcov", 8).alias("vcov"))


@query(
    "linear_predictor",
    f"""WITH {FRAME}, {ols2('o', 'sbp', 'age_x', 'pc0', 'frame', 'imp')},
    p AS (SELECT avg(b0) AS b0, avg(b1) AS b1, avg(b2) AS b2 FROM o)
    SELECT imp, ID, visit_id, round(b0 + b1*age_x + b2*pc0, 6) AS fitted, round(sbp - (b0 + b1*age_x + b2*pc0), 6) + 0.0 AS resid
    FROM frame, p""",
)
def linear_predictor(spark, sf_dir):
    df = frame(spark, sf_dir, reused=True)
    fits = L.fit_linear(df, ["imp"], two_slopes(), F.col("sbp")).withColumn("model", F.lit("sbp"))
    pooled = durable(L.pooled_matrix(L.pool(fits, ["model"]), ["model"]))
    out = L.linear_predictor(df, ["imp", "ID", "visit_id", "sbp"], two_slopes(), pooled)
    return out.select("imp", "ID", "visit_id", r6("fitted").alias("fitted"), r6(F.col("sbp") - F.col("fitted")).alias("resid"))


@query(
    "select_dim",
    f"""WITH {MOMENTS}, w AS (SELECT a.imp, a.ID, t.age AS target, t.value AS y, a.value AS x, b.value AS z
      FROM full_ a JOIN full_ b ON b.imp = a.imp AND b.ID = a.ID AND b.age = 2
      JOIN full_ t ON t.imp = a.imp AND t.ID = a.ID AND t.age >= 6 WHERE a.age = 1),
    {ols2('o', 'y', 'x', 'z', 'w', 'target, imp')},
    l AS (SELECT target, 2 AS ndim, avg(llf) AS llf FROM o GROUP BY target UNION ALL
      SELECT target, 1, avg(-n/2.0::DOUBLE*(ln(2*pi()*(syy - sxy*sxy/sxx)) + 1)) FROM o GROUP BY target)
    SELECT target, arg_max(ndim, (llf - 3*(ndim - 1), -ndim)) AS ndim, round(max(llf - 3*(ndim - 1)), 4) AS score FROM l GROUP BY target""",
)
def select_dim(spark, sf_dir):
    """Early growth as one or two components, judged for each later age."""
    wide = G.trajectories(T.growth(spark, sf_dir), [])
    targets = F.inline(F.array(*[F.struct(F.lit(a).alias("target"), F.col(f"a{a}").alias("y")) for a in G.AGES if a >= 6]))
    by, terms = ["target", "imp"], D.intercept() | D.linear("a1", "a2")
    cross = durable(L.cross_products(wide.select("imp", "a1", "a2", targets), by, terms, F.col("y")))
    fits = [
        L.fit_cross(cross, by, list(terms), estimator=L.leading_terms(d + 1)).select(*by, F.lit(d).alias("ndim"), "llf") for d in (1, 2)
    ]
    mean = fits[0].unionByName(fits[1]).groupBy("target", "ndim").agg(F.avg("llf").alias("llf"))
    return L.select_dimension(mean, ["target"]).select("target", "ndim", r4("score").alias("score"))


@query(
    "mixed_suffstats",
    f"""WITH {FRAME} SELECT imp, mom, ID, count(*) AS n, round(sum(age_cen), 6) + 0.0 AS a, round(sum(age_cen*age_cen), 6) AS aa,
    round(sum(pc0), 6) + 0.0 AS u_pc0, round(sum(age_cen*pc0), 6) + 0.0 AS w_pc0, round(sum(age_x), 6) + 0.0 AS u_age_x,
    round(sum(age_cen*age_x), 6) + 0.0 AS w_age_x, round(sum(sbp), 6) AS u_y, round(sum(age_cen*sbp), 6) + 0.0 AS w_y
    FROM frame GROUP BY imp, mom, ID""",
)
def mixed_suffstats(spark, sf_dir):
    s = X.subject_stats(frame(spark, sf_dir), ["imp"], two_slopes(), F.col("sbp"))
    return s.select(
        "imp", "mom", "ID", "n", r6("a").alias("a"), r6("aa").alias("aa"),
        r6(F.col("u")[2]).alias("u_pc0"), r6(F.col("w")[2]).alias("w_pc0"), r6(F.col("u")[1]).alias("u_age_x"),
        r6(F.col("w")[1]).alias("w_age_x"), r6(F.col("u")[3]).alias("u_y"), r6(F.col("w")[3]).alias("w_y"),
    )


# Contrasts -----------------------------------------------------------------------------------

FIVE = ("SBP_MEAN", "T_use", "Temp", "School", "Wealth_Z")


def exposure_fit(df, by):
    """A coefficient vector and covariance over the five exposure terms that SQL can compute too:
    means over 100 and covariance of the mean of five cohort columns."""
    x = [F.col(c) for c in FIVE]
    n = F.count("*")
    for c in FIVE:
        df = df.where(F.col(c).isNotNull())
    return df.groupBy(*by).agg(
        F.array(*[F.avg(c) / 100.0 for c in x]).alias("est"),
        F.array(*[F.array(*[F.covar_samp(a, b) / n for b in x]) for a in x]).alias("cov"),
    )


def five_sql(by: str, src: str = "clean") -> str:
    cells = [f"avg({c})/100.0::DOUBLE AS c{i}" for i, c in enumerate(FIVE)]
    cells += [f"covar_samp({a}, {b})/count(*) AS v{i}{j}" for i, a in enumerate(FIVE) for j, b in enumerate(FIVE)]
    cond = " AND ".join(f"{c} IS NOT NULL" for c in FIVE)
    return f"five AS (SELECT {by}, {', '.join(cells)} FROM {src} WHERE {cond} GROUP BY {by})"


DOT = " + ".join(f"u{i}*c{i}" for i in range(5))
QUAD = " + ".join(f"u{i}*u{j}*v{i}{j}" for i in range(5) for j in range(5))


def contrast_sql() -> str:
    cells = []
    for size, step, unit in (("Ht", 5.0, "cm"), ("BMI", 3.0, "kg/m^2")):
        for sign, mark in ((-1, f"{size}:-{step:g}{unit}"), (0, f"{size}:0"), (1, f"{size}:+{step:g}{unit}")):
            hx = f"{sign * step}::DOUBLE"
            first, last = (hx, f"{hx}*score") if size == "Ht" else ("0.0::DOUBLE", "0.0::DOUBLE")
            second, fifth = ("0.0::DOUBLE", "0.0::DOUBLE") if size == "Ht" else (hx, f"{hx}*score")
            cells.append(
                f"SELECT '{size}' AS size, {hx} AS shift, '{mark}' AS mark, pat, label, short, {first} AS u0, {second} AS u1, "
                f"score - ref AS u2, {last} AS u3, {fifth} AS u4 FROM pats_, (SELECT score AS ref FROM pats_ WHERE pat = 3)"
            )
    return f"""{CLEAN}, {MOMENTS}, {PATTERN_SQL}, {five_sql('Female')}, cell AS ({' UNION ALL '.join(cells)}),
    con AS (SELECT Female AS female, size, shift, mark, pat, label, short, {DOT} AS est, sqrt({QUAD}) AS se FROM cell, five),
    con2 AS (SELECT *, abs(est/nullif(se, 0))/sqrt(2) AS q FROM con),
    contrast AS (SELECT *, est/nullif(se, 0) AS z, {erfc_sql('q')} AS p FROM con2)"""


def contrasts(spark, sf_dir):
    basis = written_basis(spark, sf_dir)
    pats = pattern_structs(basis)
    fits = exposure_fit(cleaned(spark, sf_dir).withColumnRenamed("Female", "female"), ["female"])
    return K.pattern_contrasts(durable(fits.withColumn("pats", pats.scalar())), ["female"])


@query(
    "growth_contrast",
    f"""WITH {contrast_sql()} SELECT female, size, shift, pat, label, round(est, 6) + 0.0 AS est, round(se, 6) AS se,
    round(z, 5) + 0.0 AS z, round(p, 6) AS p FROM contrast""",
)
def growth_contrast(spark, sf_dir):
    return contrasts(spark, sf_dir).select(
        "female", "size", "shift", "pat", "label", r6("est").alias("est"), r6("se").alias("se"), F.round("z", 5).alias("z"), r6("p").alias("p")
    )


@query(
    "contrast_ci",
    f"""WITH {contrast_sql()} SELECT female, size, shift, pat, short, round(est, 6) + 0.0 AS est,
    round(est - 1.959963984540054*se, 6) + 0.0 AS lower, round(est + 1.959963984540054*se, 6) + 0.0 AS upper FROM contrast""",
)
def contrast_ci(spark, sf_dir):
    out = K.with_interval(contrasts(spark, sf_dir))
    return out.select("female", "size", "shift", "pat", "short", *[r6(c).alias(c) for c in ("est", "lower", "upper")])


@query(
    "contrast_labels",
    f"""WITH {contrast_sql()} SELECT female, mark, pat,
    regexp_replace(split_part(mark, ':', 2), '^([1-9])', '+\\1') AS axis, replace(lower(split_part(mark, ':', 1)), 'ht', 'height') AS size_name,
    CASE WHEN female = 1 THEN 'female' ELSE 'male' END || ' subjects only, ' || short AS title,
    format('{{:.3f}} ({{:.3f}})', round(est, 6) + 0.0, round(se, 6)) AS text, lpad(pat::VARCHAR, 3, '0') AS code FROM contrast""",
)
def contrast_labels(spark, sf_dir):
    mark = F.split("mark", ":")
    return contrasts(spark, sf_dir).select(
        "female",
        "mark",
        "pat",
        F.regexp_replace(mark[1], "^([1-9])", "+$1").alias("axis"),
        F.replace(F.lower(mark[0]), F.lit("ht"), F.lit("height")).alias("size_name"),
        F.concat(F.when(F.col("female") == 1, "female").otherwise("male"), F.lit(" subjects only, "), "short").alias("title"),
        F.format_string("%.3f (%.3f)", r6("est"), r6("se")).alias("text"),
        F.lpad(F.col("pat").cast("string"), 3, "0").alias("code"),
    )


@query(
    "coef_trajectory",
    f"""WITH {CLEAN}, {MOMENTS}, {five_sql('Female')}, t AS (SELECT Female AS female, age, w*c2 AS est, sqrt(w*w*v22) AS se FROM five, loading)
    SELECT female, age, round(est, 6) + 0.0 AS est, round(se, 6) AS se, round(est - 2*se, 6) + 0.0 AS lower, round(est + 2*se, 6) + 0.0 AS upper FROM t""",
)
def coef_trajectory(spark, sf_dir):
    basis = written_basis(spark, sf_dir)
    fits = exposure_fit(cleaned(spark, sf_dir).withColumnRenamed("Female", "female"), ["female"])
    fits = fits.withColumn("terms", F.array(*[F.lit(t) for t in K.EXPOSURE_TERMS]))
    fits = L.slice_terms(fits, ["pc0"]).withColumn("b", basis.select(F.struct("ages", "loadings")).scalar())
    out = K.coefficient_trajectory(fits.select("female", "est", "cov", "b.*"), ["female"], 1)
    return out.select("female", "age", *[r6(c).alias(c) for c in ("est", "se", "lower", "upper")])


@query(
    "quad_form",
    f"""WITH {CLEAN}, {five_sql('1').replace('SELECT 1, ', 'SELECT ').replace(' GROUP BY 1', '')},
    u AS (SELECT ID, {', '.join(f'avg({c}) AS u{i}' for i, c in enumerate(FIVE))} FROM clean
      WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FIVE)} GROUP BY ID)
    SELECT ID, round({QUAD}, 4) AS q FROM u, five""",
)
def quad_form(spark, sf_dir):
    """u'Cu of every subject's mean vector."""
    df = cleaned(spark, sf_dir).select("ID", *FIVE)
    for c in FIVE:
        df = df.where(F.col(c).isNotNull())
    u = df.groupBy("ID").agg(*[F.avg(c).alias(c) for c in FIVE])
    cov = exposure_fit(df.withColumn("all", F.lit(1)), ["all"]).select("cov")
    return K.quadratic_form(u, list(FIVE), cov).select("ID", r4("q").alias("q"))


@query(
    "normal_pvalue",
    f"""WITH {CLEAN}, c AS (SELECT avg(SBP_MEAN) AS m, stddev_samp(SBP_MEAN) AS s FROM clean),
    a AS (SELECT ID, visit_id, (SBP_MEAN - m)/s AS z, abs((SBP_MEAN - m)/s)/sqrt(2) AS q FROM clean, c WHERE SBP_MEAN IS NOT NULL),
    p AS (SELECT *, {erfc_sql('q')} AS p FROM a)
    SELECT ID, visit_id, round(z, 6) + 0.0 AS z, round(CASE WHEN z >= 0 THEN 1 - p/2 ELSE p/2 END, 6) AS cdf, round(p, 6) AS p FROM p""",
)
def normal_pvalue(spark, sf_dir):
    df = C.with_centering(cleaned(spark, sf_dir).where("SBP_MEAN IS NOT NULL"), {"y": F.col("SBP_MEAN")})
    z = df.withColumn("z", (F.col("SBP_MEAN") - F.col("c.y_mean")) / F.col("c.y_sd"))
    return z.select(
        "ID", "visit_id", r6("z").alias("z"), r6(normal_cdf(F.col("z"))).alias("cdf"), r6(two_sided_p(F.col("z"))).alias("p")
    )


# Effect curves ---------------------------------------------------------------------------------

CURVE_TERMS = {
    "age_x": "SBP_MEAN", "age_x^2": "T_use", "age_x^3": "Temp", "Female:age_x": "School", "Female:age_x^2": "Wealth_Z",
    "Female:age_x^3": "HT", "Female": "WT", "lognummeas": "BMI", "Female:lognummeas": "Age", "PregMo_Use_cen": "DBP_MEAN",
    "PregMo_Use_cen^2": "lognummeas", "lactMo_Use_cen": "Breast_Stage_Use", "HT_cen": "Mom_Ht_Ave", "BMI_cen": "Dad_Ht_Ave",
}
CURVE_CENTRES = {"PregMo": "PregMo_Use", "lactMo": "lactMo_Use", "BMI": "BMI", "HT": "HT"}


def curves_sql() -> str:
    b = {t: f"avg({c})/100.0::DOUBLE AS b{i}" for i, (t, c) in enumerate(CURVE_TERMS.items())}
    n = {t: f"b{i}" for i, t in enumerate(CURVE_TERMS)}
    centres = ", ".join(f"avg({c}) AS m_{k}" for k, c in CURVE_CENTRES.items())
    t, lg = "((x - 10)/10.0::DOUBLE)", "log10(x)"
    age = f"{n['age_x']}*{t} + {n['age_x^2']}*{t}*{t} + {n['age_x^3']}*{t}*{t}*{t}"
    fem = f"{n['Female:age_x']}*{t} + {n['Female:age_x^2']}*{t}*{t} + {n['Female:age_x^3']}*{t}*{t}*{t} + {n['Female']}"
    rows = [
        ("age", "male", 10, 20, 20, age), ("age", "female", 10, 20, 20, f"{age} + {fem}"),
        ("nummeas", "male", 1, 9, 9, f"{n['lognummeas']}*{lg}"),
        ("nummeas", "female", 1, 9, 9, f"({n['lognummeas']} + {n['Female:lognummeas']})*{lg}"),
        ("pregmo", "female", 0, 8, 9, f"{n['PregMo_Use_cen']}*(x - m_PregMo) + {n['PregMo_Use_cen^2']}*(x - m_PregMo)*(x - m_PregMo)"),
        ("lactmo", "female", 0, 23, 24, f"{n['lactMo_Use_cen']}*(x - m_lactMo)"),
        ("bmi", "both", 12, 24, 13, f"{n['BMI_cen']}*(x - m_BMI)"), ("height", "both", 120, 182, 63, f"{n['HT_cen']}*(x - m_HT)"),
    ]
    parts = [
        f"SELECT site, '{c}' AS curve, '{s}' AS sex, x, {e} AS y FROM mod, (SELECT {lo}.0::DOUBLE + range*{hi - lo}.0::DOUBLE/{k - 1}.0::DOUBLE AS x FROM range({k}))"
        for c, s, lo, hi, k, e in rows
    ]
    return f"""WITH {CLEAN}, mod AS (SELECT Bamako AS site, {', '.join(b.values())}, {centres} FROM clean GROUP BY Bamako),
    raw AS ({' UNION ALL '.join(parts)})
    SELECT site, curve, sex, round(x, 6) AS x, round(y - avg(y) OVER (PARTITION BY site, curve), 6) + 0.0 AS y FROM raw"""


@query("effect_curves", curves_sql())
def effect_curves(spark, sf_dir):
    models = cleaned(spark, sf_dir).groupBy(F.col("Bamako").alias("site")).agg(
        F.create_map(*[v for t, c in CURVE_TERMS.items() for v in (F.lit(t), F.avg(c) / 100.0)]).alias("b"),
        F.create_map(*[v for t, c in CURVE_CENTRES.items() for v in (F.lit(t), F.avg(c))]).alias("c"),
    )
    out = K.effect_curves(durable(models), ["site"])
    return out.select("site", "curve", "sex", r6("x").alias("x"), r6("y").alias("y"))


# Mediation -------------------------------------------------------------------------------------

PATTERN_PAIR = (6, 0)


def pattern_pair(basis):
    """Scores of the two compared patterns as one row (p0, p1)."""
    from auxoline.functions.patterns import growth_patterns

    rows = growth_patterns(basis, [])
    a, b = PATTERN_PAIR
    return rows.agg(
        F.max(F.when(F.col("pat") == a, F.col("scores")[0])).alias("p0"),
        F.max(F.when(F.col("pat") == b, F.col("scores")[0])).alias("p1"),
    )


def mediator_rows(df):
    """One row per mediator and frame row, so both mediator models are fitted in one job."""
    pair = F.array(*[F.struct(F.lit(m).alias("mediator"), F.col(m).alias("y")) for m in ("ht_cen", "bmi_cen")])
    return df.select("*", F.inline(pair))


MEDIATORS_SQL = f"""{FRAME}, {PATTERN_SQL},
    long_ AS (SELECT *, 'ht_cen' AS mediator, ht_cen AS y FROM frame UNION ALL SELECT *, 'bmi_cen', bmi_cen FROM frame),
    {ols2('o', 'y', 'age_x', 'pc0', 'long_', 'female, mediator, imp')},
    pm AS (SELECT female, mediator, avg(b0) AS b0, avg(b1) AS b1, avg(b2) AS b2 FROM o GROUP BY female, mediator),
    pp AS (SELECT max(score) FILTER (WHERE pat = 6) AS p0, max(score) FILTER (WHERE pat = 0) AS p1 FROM pats_),
    mm AS (SELECT female, mediator, p0, p1, b0 + b1*1.1 + b2*p0 AS m1, b0 + b1*1.1 + b2*p1 AS m2 FROM pm, pp)"""


def mediator_means(spark, sf_dir, visits=None):
    """Pooled predicted mediators at the reference age under both patterns, without draws."""
    basis = written_basis(spark, sf_dir)
    df = frame(spark, sf_dir, visits=visits, basis=basis)
    fits = L.fit_linear(mediator_rows(df), ["female", "mediator", "imp"], two_slopes(), F.col("y"))
    pooled = durable(L.pooled_matrix(L.pool(fits, ["female", "mediator"]), ["female", "mediator"]))
    b = F.map_from_arrays("terms", "est")
    rows = pooled.withColumn("b", b).withColumn("p", pattern_pair(basis).select(F.struct("p0", "p1")).scalar())
    at = (M.REFERENCE_AGE - 10) / 10

    def mean(score):
        return F.col("b")["Intercept"] + at * F.col("b")["age_x"] + F.col("b")["pc0"] * score

    return rows.select("female", "mediator", "p.p0", "p.p1", mean(F.col("p.p0")).alias("m1"), mean(F.col("p.p1")).alias("m2"))


@query(
    "mediator_contrast_mean",
    f"""WITH {MEDIATORS_SQL} SELECT female, mediator, round(m1, 5) + 0.0 AS m1, round(m2, 5) + 0.0 AS m2, round(m2 - m1, 5) + 0.0 AS change FROM mm""",
)
def mediator_contrast_mean(spark, sf_dir):
    out = mediator_means(spark, sf_dir)
    r5 = lambda c: F.round(c, 5)
    return out.select("female", "mediator", r5("m1").alias("m1"), r5("m2").alias("m2"), r5(F.col("m2") - F.col("m1")).alias("change"))


@query(
    "resid_corr",
    f"""WITH {MEDIATORS_SQL},
    first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY imp, ID ORDER BY datecomb, visit_id) AS r FROM frame) WHERE r = 1),
    res AS (SELECT f.female, imp, ht_cen - (h.b0 + h.b1*1.1 + h.b2*pc0) AS eh, bmi_cen - (b.b0 + b.b1*1.1 + b.b2*pc0) AS eb
      FROM first_ f JOIN pm h ON h.female = f.female AND h.mediator = 'ht_cen' JOIN pm b ON b.female = f.female AND b.mediator = 'bmi_cen')
    SELECT female, imp, count(*) AS n, round(corr(eh, eb), 6) + 0.0 AS r FROM res GROUP BY female, imp""",
)
def resid_corr(spark, sf_dir):
    """Correlation of the two mediators' residuals at the first visits, age set to the reference age."""
    df = frame(spark, sf_dir, reused=True)
    by = ["female", "mediator"]
    fits = L.fit_linear(mediator_rows(df), [*by, "imp"], two_slopes(), F.col("y"))
    coef = L.pooled_coefficients(L.pool(fits, by), by).groupBy("female").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "mediator", "term"), "est"))).alias("b")
    )
    first = M.at_reference_age(M.first_rows(df, ["female"])).join(durable(coef), "female")

    def resid(m):
        fit = F.col("b")[f"{m}|Intercept"] + F.col("b")[f"{m}|age_x"] * F.col("age_x") + F.col("b")[f"{m}|pc0"] * F.col("pc0")
        return F.col(m) - fit

    pair = first.select("female", "imp", resid("ht_cen").alias("eh"), resid("bmi_cen").alias("eb"))
    return pair.groupBy("female", "imp").agg(F.count("*").alias("n"), r6(F.corr("eh", "eb")).alias("r"))


def effect_vectors_sql(src: str, by: str) -> str:
    effects = {
        "indirect through height": ("dh", "0", "0", "p1*h1 - p0*h0", "0"),
        "indirect through BMI": ("0", "db", "0", "0", "p1*b1 - p0*b0"),
        "overall indirect": ("dh", "db", "0", "p1*h1 - p0*h0", "p1*b1 - p0*b0"),
        "direct": ("0", "0", "p1 - p0", "0", "0"),
        "total": ("dh", "db", "p1 - p0", "p1*h1 - p0*h0", "p1*b1 - p0*b0"),
    }
    parts = [
        f"SELECT *, '{k}' AS effect, " + ", ".join(f"({e})::DOUBLE AS u{i}" for i, e in enumerate(v)) + f" FROM {src}"
        for k, v in effects.items()
    ]
    return f"""eff AS ({' UNION ALL '.join(parts)}), est_ AS (SELECT {by}, effect, {DOT} AS est, sqrt({QUAD}) AS se FROM eff)"""


WIDE_MEANS = """wm AS (SELECT female, any_value(p0) AS p0, any_value(p1) AS p1,
    max(m1) FILTER (WHERE mediator = 'ht_cen') AS h0, max(m2) FILTER (WHERE mediator = 'ht_cen') AS h1,
    max(m2 - m1) FILTER (WHERE mediator = 'ht_cen') AS dh, max(m1) FILTER (WHERE mediator = 'bmi_cen') AS b0,
    max(m2) FILTER (WHERE mediator = 'bmi_cen') AS b1, max(m2 - m1) FILTER (WHERE mediator = 'bmi_cen') AS db FROM mm GROUP BY female)"""


def wide_means(means, by=("female",)):
    """Both mediators' summaries side by side, one row per model."""

    def of(mediator, col):
        return F.max(F.when(F.col("mediator") == mediator, F.col(col)))

    m = means.withColumn("d", F.col("m2") - F.col("m1"))
    return m.groupBy(*by).agg(
        F.first("p0").alias("p0"), F.first("p1").alias("p1"),
        of("ht_cen", "m1").alias("h0"), of("ht_cen", "m2").alias("h1"), of("ht_cen", "d").alias("dh"),
        of("bmi_cen", "m1").alias("b0"), of("bmi_cen", "m2").alias("b1"), of("bmi_cen", "d").alias("db"),
    )


@query(
    "mediation_effects",
    f"""WITH {MEDIATORS_SQL}, {WIDE_MEANS}, {five_sql('Female')},
    src AS (SELECT wm.*, five.* EXCLUDE (Female) FROM wm JOIN five ON five.Female = wm.female), {effect_vectors_sql('src', 'female')}
    SELECT female, effect, round(est, 4) + 0.0 AS est, round(se, 4) AS se, round(est - 2*se, 4) + 0.0 AS lower,
    round(est + 2*se, 4) + 0.0 AS upper FROM est_""",
)
def mediation_effects(spark, sf_dir):
    visits = durable(cleaned(spark, sf_dir))
    fits = exposure_fit(visits.withColumnRenamed("Female", "female"), ["female"])
    rows = wide_means(mediator_means(spark, sf_dir, visits)).join(fits, "female")
    out = M.mediation_effects(rows, ["female"])
    return out.select("female", "effect", *[r4(c).alias(c) for c in ("est", "se", "lower", "upper")])


ADJ_LEVEL = "CASE WHEN Wealth_Z IS NULL THEN 0 WHEN Mom_Ht_Ave IS NULL OR Mom_SBP_Z_Res_USE IS NULL THEN 1 WHEN Dad_Ht_Ave IS NULL OR Dad_SBP_Z_Res_USE IS NULL THEN 2 ELSE 3 END"


@query(
    "effect_grid",
    f"""WITH {MEDIATORS_SQL}, {WIDE_MEANS},
    lv AS (SELECT *, {ADJ_LEVEL} AS lvl FROM clean), ex AS (SELECT lv.*, a.range::INTEGER AS adj FROM lv, range(4) a WHERE a.range <= lvl),
    {five_sql('Female, adj', 'ex')},
    src AS (SELECT wm.*, five.* EXCLUDE (Female) FROM wm JOIN five ON five.Female = wm.female), {effect_vectors_sql('src', 'female, adj')}
    SELECT 'HT' AS var, female, adj, 'effect' AS kind, effect AS name, round(est, 4) + 0.0 AS est, round(se, 4) AS se FROM est_
    UNION ALL SELECT 'HT', f.female, a.range::INTEGER, 'change', 'change in ' || mediator, round(m2 - m1, 4) + 0.0, NULL FROM mm f, range(4) a""",
)
def effect_grid(spark, sf_dir):
    """Summary rows of the whole sex x adjustment grid: covariate sets are nested, so one pass serves all levels."""
    visits = durable(cleaned(spark, sf_dir))
    df = visits.withColumnRenamed("Female", "female")
    levels = df.withColumn("adj", F.explode(F.sequence(F.lit(0), F.expr(ADJ_LEVEL))))
    fits = exposure_fit(levels, ["female", "adj"])
    means = durable(mediator_means(spark, sf_dir, visits))
    effects = M.mediation_effects(wide_means(means).join(fits, "female"), ["female", "adj"]).select(
        "female", "adj", F.lit("effect").alias("kind"), F.col("effect").alias("name"), r4("est").alias("est"), r4("se").alias("se")
    )
    changes = means.select(
        "female", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("adj"), F.lit("change").alias("kind"),
        F.concat(F.lit("change in "), "mediator").alias("name"), r4(F.col("m2") - F.col("m1")).alias("est"),
        F.lit(None).cast("double").alias("se"),
    )
    return effects.unionByName(changes).select(F.lit("HT").alias("var"), "*")


# Operators SQL cannot express ------------------------------------------------------------------


@query("mixed_fit")
def mixed_fit(spark, sf_dir):
    """Mixed model of blood pressure per imputation: coefficients and variance ratios."""
    fits = X.fit_mixed(frame(spark, sf_dir), ["imp"], two_slopes(), F.col("sbp"))
    coef = fits.select("imp", "llf", "scale", "n", "n_subj", "n_groups", "psi_mother", "psi_subject", "psi_slope", "steps", "converged", "boundary", F.inline(F.arrays_zip("terms", "est")))
    return coef.withColumnRenamed("terms", "term")


@query("mediator_simulation")
def mediator_simulation(spark, sf_dir):
    """Simulated mediators under both patterns, per imputation and summarised."""
    basis = written_basis(spark, sf_dir)
    df = frame(spark, sf_dir, reused=True, basis=basis)
    pair = pattern_pair(basis).select(F.array("p0", "p1")).scalar()
    sims = [M.simulate_mediator(df, ["female"], m, two_slopes(), pair) for m in ("ht_cen", "bmi_cen")]
    return M.summarise_simulation(sims[0].unionByName(sims[1]), ["female"])


# Fitted chains -----------------------------------------------------------------------------------


def reread_model(spark, pooled, basis, fits, by):
    """The pooled model after a round trip through its result tables."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    write_model(pooled, basis, L.pooled_fit_stats(fits, by), path, by)
    return read_model(spark, path, by)


def exposure_terms() -> dict:
    """The outcome on age, adult size, early growth and their products."""
    size, score = D.linear("ht_cen", "bmi_cen"), D.linear("pc0")
    named = dict(zip(K.EXPOSURE_TERMS, [*size.values(), *score.values(), *D.interact(size, score).values()]))
    return D.intercept() | D.linear("age_x") | named


def fitted_exposures(spark, df, basis, estimator):
    """Pooled coefficients and covariance of the exposure terms per sex, fitted, stored and read again.

    Of iterative fits, ``converged`` tells whether all that were pooled did, and ``boundary`` whether some ended at the end of its range.
    """
    fits = durable(estimator(df, ["female", "imp"], exposure_terms(), F.col("sbp")))
    pooled = L.pooled_matrix(L.pool(fits, ["female"]), ["female"])
    model = L.slice_terms(reread_model(spark, pooled, basis, fits, ["female"]), list(K.EXPOSURE_TERMS))
    if "converged" not in fits.columns:
        return model
    return model.join(fits.groupBy("female").agg(F.every("converged").alias("converged"), F.some("boundary").alias("boundary")), "female")


@query(
    "coef_trajectory_fitted",
    f"""WITH {FRAME}, {ols2('o', 'sbp', 'age_x', 'pc0', 'frame', 'female, imp')}, {pooled_sql('o', 'female')},
    t AS (SELECT female, age, w*est_i AS est, sqrt(w*w*total) AS se FROM pool_, loading WHERE term_i = 'pc0' AND term_j = 'pc0')
    SELECT female, age, round(est, 6) + 0.0 AS est, round(se, 6) AS se, round(est - 2*se, 6) + 0.0 AS lower, round(est + 2*se, 6) + 0.0 AS upper FROM t""",
)
def coef_trajectory_fitted(spark, sf_dir):
    """The growth effect by age from fitted, pooled, stored and reread models."""
    basis = written_basis(spark, sf_dir)
    fits = durable(L.fit_linear(frame(spark, sf_dir, basis=basis), ["female", "imp"], two_slopes(), F.col("sbp")))
    model = reread_model(spark, L.pooled_matrix(L.pool(fits, ["female"]), ["female"]), basis, fits, ["female"])
    model = L.slice_terms(model, ["pc0"]).withColumn("b", basis.select(F.struct("ages", "loadings")).scalar())
    out = K.coefficient_trajectory(model.select("female", "est", "cov", "b.*"), ["female"], 1)
    return out.select("female", "age", *[r6(c).alias(c) for c in ("est", "se", "lower", "upper")])


def pattern_structs(basis):
    """All patterns with their scores as one array column."""
    sd = F.transform(G.age_variance(), lambda v: F.sqrt(v))
    return basis.withColumn("p", patterns(sd)).select(
        F.transform(
            "p",
            lambda x: F.struct(
                x["pat"].alias("pat"), x["label"].alias("label"), x["short"].alias("short"),
                F.transform("loadings", lambda w: F.aggregate(F.zip_with(w, x["values"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).alias("scores"),
            ),
        )
    )


@query("growth_contrast_fitted")
def growth_contrast_fitted(spark, sf_dir):
    """Pattern contrasts from mixed models fitted by imputation and sex, pooled, stored and reread."""
    basis = written_basis(spark, sf_dir)
    model = fitted_exposures(spark, frame(spark, sf_dir, reused=True, basis=basis), basis, X.fit_mixed)
    flags = ["converged", "boundary"]
    out = K.with_interval(K.pattern_contrasts(durable(model.withColumn("pats", pattern_structs(basis).scalar())), ["female", *flags]))
    return out.select("female", "size", "shift", "pat", "label", *[r6(c).alias(c) for c in ("est", "se", "z", "p", "lower", "upper")], *flags)


@query("mediation_effects_fitted")
def mediation_effects_fitted(spark, sf_dir):
    """Effect decomposition with mediators and outcome both fitted by imputation and sex."""
    visits, basis = durable(cleaned(spark, sf_dir)), written_basis(spark, sf_dir)
    df = frame(spark, sf_dir, reused=True, visits=visits, basis=basis)
    model = fitted_exposures(spark, df, basis, L.fit_linear)
    out = M.mediation_effects(wide_means(mediator_means(spark, sf_dir, visits)).join(model, "female"), ["female"])
    return out.select("female", "effect", *[r4(c).alias(c) for c in ("est", "se", "lower", "upper")])


@query("mixed_pool")
def mixed_pool(spark, sf_dir):
    """Mixed models of blood pressure per imputation, pooled: coefficients with their standard errors."""
    fits = X.fit_mixed(frame(spark, sf_dir), ["imp"], two_slopes(), F.col("sbp"))
    flags = fits.agg(F.every("converged").alias("converged"), F.some("boundary").alias("boundary"))
    out = L.pooled_coefficients(L.pool(fits.withColumn("model", F.lit("sbp")), ["model"]), ["model"])
    return out.withColumn("f", flags.select(F.struct("converged", "boundary")).scalar()).select("model", "term", "est", "se", "lost", "f.*")


FULL_COLUMNS = [
    "visit_id", "Female", "Male", "MomIdUnique", "SBP_MEAN", "age_x", "age_cen", "lognummeas", "temp_cen", "School", "Wealth_Z", "Breast_Stage_Use_Z",
    "log2T_use_Z", "PregMo_Use_cen", "lactMo_Use_cen", "Mom_Ht_Ave", "Mom_SBP_Z_Res_USE", "Dad_Ht_Ave", "Dad_SBP_Z_Res_USE", "HT_cen", "BMI_cen", "Village", "Year",
]


@query("mixed_fit_full")
def mixed_fit_full(spark, sf_dir):
    """The outcome model with all its covariates, villages and years, per imputation: some fifty columns."""
    visits = C.recode_village(cleaned(spark, sf_dir)).withColumns({"preg": C.fill_males_zero("PregMo_Use"), "lact": F.coalesce("lactMo_Use", F.lit(0))})
    visits = C.with_centering(visits, {"preg": F.col("preg"), "lact": F.col("lact")})
    visits = durable(visits.withColumns({"PregMo_Use_cen": F.col("preg") - F.col("c.preg_mean"), "lactMo_Use_cen": F.col("lact") - F.col("c.lact_mean")}).drop("c"))
    packed = durable(G.pack_scores(visits, scores(spark, sf_dir), FULL_COLUMNS, "SBP_MEAN"))
    factors = [D.factor(packed, "Village", 50), D.factor(packed, "Year")]
    df = G.unpack_scores(packed).withColumnRenamed("MomIdUnique", "mom")
    fits = X.fit_mixed(df, ["imp"], D.outcome_terms(["pc0"], True, True), F.col("SBP_MEAN"), factors=factors)
    coef = fits.select("imp", "llf", "scale", "n", "psi_mother", "psi_subject", "psi_slope", "converged", "boundary", F.inline(F.arrays_zip("terms", "est")))
    return coef.withColumnRenamed("terms", "term")


# Mediation grid ------------------------------------------------------------------------------------

GRID_COLUMNS = ["visit_id", "datecomb", "Female", "SBP_MEAN", "age_x", "HT_cen", "BMI_cen", "Village"]
GRID_COVARIATES = ["Wealth_Z", "PregMo_Use_cen", "lactMo_Use_cen", "stimulant", "Mom_Ht_Ave", "Mom_SBP_Z_Res_USE", "Dad_Ht_Ave", "Dad_SBP_Z_Res_USE"]
GRID_MEDIATORS = ("HT_cen", "BMI_cen")
SEXES = {0: "male", 1: "female"}


def grid_terms(mediator: str | None, female: int, adj: int) -> dict:
    """Numeric terms of a mediator's model, or of the outcome's (no mediator), at one adjustment level."""
    if mediator:
        return D.mediator_terms(mediator, SEXES[female], adj, ["pc0"])
    size, score = D.linear("HT_cen", "BMI_cen"), D.linear("pc0")
    terms = D.intercept() | D.linear("age_x") | size | score | D.interact(size, score)
    for level, names in ((1, ("Wealth_Z",)), (2, ("Mom_Ht_Ave", "Mom_SBP_Z_Res_USE")), (3, ("Dad_Ht_Ave", "Dad_SBP_Z_Res_USE"))):
        terms |= D.linear(*names) if adj >= level else {}
    return terms


def only_terms(wanted: list[str], factors: bool):
    """Least squares on some of the terms of the same cross-products, with or without the factor columns."""

    def estimator(names, xx, xy, yy, n):
        at = [i for i, t in enumerate(names) if t in wanted or (factors and "[" in t)]
        return L.least_squares([names[i] for i in at], xx[np.ix_(at, at)], xy[at], yy, n)

    return estimator


def grid_frame(spark, sf_dir):
    """The frame of the mediation grid, one row per imputation, visit and adjustment level it is complete for, and the basis of each sex."""
    visits = C.recode_village(cleaned(spark, sf_dir)).withColumns({"preg": C.fill_males_zero("PregMo_Use"), "lact": F.coalesce("lactMo_Use", F.lit(0))})
    visits = C.with_centering(visits, {"preg": F.col("preg"), "lact": F.col("lact")})
    visits = visits.withColumns({"PregMo_Use_cen": F.col("preg") - F.col("c.preg_mean"), "lactMo_Use_cen": F.col("lact") - F.col("c.lact_mean"), "stimulant": F.col("Stimulant_No_PerWeek")})
    visits = durable(visits.drop("c").where("PregMo_Use_cen IS NOT NULL"))
    growth = durable(T.growth(spark, sf_dir).join(visits.select("ID", F.col("Female").alias("female")).distinct(), "ID"))
    basis = durable(flat_basis(G.pooled_moments(growth, ["female"])))
    scores_ = G.pc_scores(growth, basis, ["female"], 1).drop("female")
    packed = G.pack_scores(visits, scores_, GRID_COLUMNS, "SBP_MEAN", GRID_COVARIATES).withColumnRenamed("Female", "female")
    packed = durable(packed.withColumn("adj", F.explode(F.sequence(F.lit(0), F.expr(ADJ_LEVEL)))))
    return G.unpack_scores(packed), basis, D.factor(packed, "Village", 50)


def grid_fits(df, village, mediators: bool):
    """Pooled models of every sex and level (and mediator): one pass of cross-products over all terms, then each model takes its own."""
    names = GRID_MEDIATORS if mediators else (None,)
    every: dict = {}
    for name in names:
        for female in SEXES:
            every |= grid_terms(name, female, 3)
    terms = {t: F.coalesce(c, F.lit(0.0)) for t, c in every.items()}
    if mediators:
        df = df.select("*", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("y")) for m in GRID_MEDIATORS])))
    else:
        df = df.withColumns({"model": F.lit("sbp"), "y": F.col("SBP_MEAN")})
    by = ["female", "adj", "model"]
    cross = durable(L.cross_products(df, [*by, "imp"], terms, F.col("y"), [village]))
    fits = None
    for name in names:
        for female in SEXES:
            for adj in range(4):
                part = cross.where((F.col("female") == female) & (F.col("adj") == adj) & (F.col("model") == (name or "sbp")))
                one = L.fit_cross(part, [*by, "imp"], list(terms), [village], only_terms(list(grid_terms(name, female, adj)), adj >= 1))
                fits = one if fits is None else fits.unionByName(one)
    return durable(L.pooled_matrix(L.pool(durable(fits), by), by)), terms


def grid_means(df, village, basis, pooled, terms):
    """Predicted mediators at the reference age under both patterns, at the other covariates' means over first visits."""
    from auxoline.functions.patterns import growth_patterns

    every = terms | village.terms()
    first = M.at_reference_age(M.first_rows(df, ["female", "adj"]))
    cells = first.groupBy("female", "adj", "imp").agg(*[F.avg(c).alias(f"x{i}") for i, c in enumerate(every.values())])
    means = cells.groupBy("female", "adj").agg(F.map_from_arrays(F.array(*[F.lit(t) for t in every]), F.array(*[F.avg(f"x{i}") for i in range(len(every))])).alias("x"))
    a, b = PATTERN_PAIR
    score = lambda pat: F.max(F.when(F.col("pat") == pat, F.col("scores")[0]))
    pair = growth_patterns(basis, ["female"]).groupBy("female").agg(score(a).alias("p0"), score(b).alias("p1"))
    rows = pooled.join(durable(means), ["female", "adj"]).join(durable(pair), "female")

    def at(p: str):
        parts = F.transform(F.arrays_zip("terms", "est"), lambda t: t["est"] * F.when(t["terms"] == "pc0", F.col(p)).otherwise(F.col("x")[t["terms"]]))
        return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)

    lower = F.lower("model").alias("mediator")
    return rows.select("female", "adj", lower, "p0", "p1", at("p0").alias("m1"), at("p1").alias("m2"))


@query("mediation_grid")
def mediation_grid(spark, sf_dir):
    """Effects of every sex and adjustment level, each with its own formulas, complete cases, villages and basis."""
    df, basis, village = grid_frame(spark, sf_dir)
    pooled, terms = grid_fits(df, village, True)
    by = ["female", "adj"]
    means = wide_means(durable(grid_means(df, village, basis, pooled, terms)), by)
    model = L.slice_terms(grid_fits(df, village, False)[0].drop("model"), list(K.EXPOSURE_TERMS))
    out = M.mediation_effects(means.join(model, by), by)
    return out.select("female", "adj", "effect", *[r4(c).alias(c) for c in ("est", "se", "lower", "upper")])
