"""Gaussian process fits, covariance surfaces and conditional draws."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from auxoline.functions.basis import bspline
from auxoline.functions.scalar import by_stratum, round_even
from auxoline.operators import growth as G
from auxoline.operators import process as P
from auxoline.operators import visits as V
from auxoline.operators.quantiles import exact_quantiles
from auxoline.plans.cohort_queries import r6
from auxoline.plans.registry import query
from auxoline.plans.study_sql import GROWTH_OBS
from auxoline.session import checkpoint_dir, durable
from auxoline.sources import study_tables as T
from auxoline.sources.imputation_store import draw_into, read_drawn, token_of

SPLINE = ("b1", "b2", "b3", "b4")
BODY = P.ProcessModel(mean=SPLINE, scale=SPLINE, smooth=SPLINE)
PUBERTY = P.ProcessModel(mean=("HT",), scale=("AgeZ", "AgeZ2"), smooth=(), noise=True)


def spline_columns(df, spans: dict, age: str = "Age"):
    """b1..b4 with the knot and the bounds remembered for each sex."""
    knots = [None, None, None]
    for (female,), span in spans.items():
        hit = F.col("Female") == female
        knots = [F.when(hit, F.lit(v)) if k is None else k.when(hit, F.lit(v)) for k, v in zip(knots, span)]
    df = df.withColumns(dict(zip(("lo", "knot", "hi"), knots)))
    cols = bspline(F.col(age).cast("double"), F.col("lo"), F.col("knot"), F.col("hi"))
    return df.withColumns(dict(zip(SPLINE, cols))).drop("lo", "knot", "hi")


def age_spans(obs) -> dict:
    """Per sex: bounds that hold all its ages and the grid, with the median age between them."""
    ends = obs.groupBy("Female").agg(F.min("Age").alias("lo"), F.max("Age").alias("hi"))
    ends = {r["Female"]: (min(r["lo"], float(min(G.AGES))), max(r["hi"], float(max(G.AGES)))) for r in ends.collect()}
    return {(r["Female"],): (ends[r["Female"]][0], r["q"], ends[r["Female"]][1]) for r in exact_quantiles(obs, ["Female"], "Age", [0.5]).collect()}


def body_series(spark, sf_dir):
    """Childhood heights per subject with their designs, and the spline's bounds and knot of each sex."""
    obs = T.growth_obs(spark, sf_dir).withColumn("Age", round_even("Age", 3))
    knots = age_spans(obs)
    series = P.subject_series(spline_columns(obs, knots), ["Female"], BODY, "HT")
    return durable(series), knots


@query("gp_fit")
def gp_fit(spark, sf_dir):
    """Height in childhood: mean, log scale and log smooth each a cubic spline of age, per sex."""
    series, _ = body_series(spark, sf_dir)
    fits = P.fit_process(series, ["Female"], BODY)
    return P.fit_rows(spark, fits, ["Female"], dict(series.dtypes), BODY)


def body_draws(spark, series, knots, fits):
    """Draws completed heights on ages 1..10 for the imputations asked for."""
    strata = F.explode(F.array(*[F.lit(k[0]).cast("bigint") for k in knots]))
    ages = F.explode(F.array(*[F.lit(float(a)) for a in G.AGES]))
    grid = spark.range(1).select(strata.alias("Female")).select("Female", ages.alias("Age"))
    grid = spline_columns(grid, knots).withColumns({"ID": F.lit(0), "HT": F.lit(0.0)})
    grid = P.subject_series(grid, ["Female"], BODY, "HT").drop("ID")
    return lambda imps: P.impute_grid(series, grid, ["Female"], BODY, P.usable(fits), T.N_IMP, "HT", imps)


@query("gp_impute_grid")
def gp_impute_grid(spark, sf_dir):
    """Twenty completed trajectories per subject on ages 1..10."""
    series, knots = body_series(spark, sf_dir)
    return body_draws(spark, series, knots, P.fit_process(series, ["Female"], BODY))(None)


NOISY = P.ProcessModel(mean=(), scale=(), smooth=(), noise=True)
# Every row of each subject, and one column per grid age. A step of ``e`` eliminates a subject's first row; what it leaves is the
# covariance given the rows before, so sums over the pivots are the log determinant, the quadratic form and the conditional moments.
# Ages are rounded as decimals: on doubles round_even sees ties that are none.
WHOLE_SQL = f"""WITH RECURSIVE {GROWTH_OBS}, x AS (SELECT *, 1000*CAST(Age::VARCHAR AS DECIMAL(20, 17)) AS a FROM growth_obs),
    o AS (SELECT ID, Female, visit_id, (floor(a) + CASE WHEN a - floor(a) > 0.5 OR (a - floor(a) = 0.5 AND floor(a) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE/1000::DOUBLE AS t, HT FROM x),
    p AS (SELECT Female, avg(HT) AS b, stddev_samp(HT) AS s, var_samp(t) AS u FROM o GROUP BY Female),
    l AS (SELECT ID, Female, count(*) AS n, list(t ORDER BY t, visit_id) AS t, list(HT ORDER BY t, visit_id) AS y FROM o GROUP BY ID, Female),
    e AS (SELECT ID, Female, n, 0::DOUBLE AS logdet, 0::DOUBLE AS quad, list_transform(range(10), lambda a: 0::DOUBLE) AS z, list_transform(range(10), lambda a: 0::DOUBLE) AS w,
        list_transform(range(1, n + 1), lambda i: list_concat(
          list_transform(t, lambda x: s*s*exp(-(t[i] - x)*(t[i] - x)/(2*u))),
          [y[i] - b], list_transform(range(1, 11), lambda a: s*s*exp(-(t[i] - a)*(t[i] - a)/(2*u))))) AS m, s*s/100 AS v
      FROM l JOIN p USING (Female)
      UNION ALL
      SELECT ID, Female, n - 1, logdet + ln(d), quad + h[n + 1]*h[n + 1]/d,
        list_transform(list_zip(z, h[n + 2:n + 11]), lambda q: q[1] + q[2]*h[n + 1]/d), list_transform(list_zip(w, h[n + 2:n + 11]), lambda q: q[1] + q[2]*q[2]/d),
        list_transform(m[2:], lambda r: list_transform(list_zip(r[2:n + 11], h[2:n + 11]), lambda q: q[1] - q[2]*(r[1]/d))), v
      FROM (SELECT *, m[1] AS h, m[1][1] + v AS d FROM e WHERE n > 0)),
    k AS (SELECT ID, Female, logdet, quad, z, w FROM e WHERE n = 0)"""


def noisy_process(spark, sf_dir):
    """Childhood heights, and per sex a process whose parameters are simple moments and whose noise is a tenth of the spread."""
    obs = durable(T.growth_obs(spark, sf_dir).withColumn("Age", round_even("Age", 3)))
    moments = obs.groupBy("Female").agg(F.avg("HT").alias("b"), F.log(F.stddev_samp("HT")).alias("s"), F.log(F.var_samp("Age")).alias("u"))
    return obs, {(r["Female"],): P.ProcessFit(np.array([r["b"]]), np.array([r["s"], r["u"], r["s"] - np.log(10)])) for r in moments.collect()}


def likelihoods(obs, fits):
    """Likelihood of all heights of every subject under the given parameters, per sex: (Female, n_subj, n_obs, llf)."""
    series = durable(P.subject_series(obs, ["Female"], NOISY, "HT"))
    sums, extra = P.likelihood_sums(series, ["Female"], NOISY, {k: [f] for k, f in fits.items()}), P.within_age(obs, ["Female"], NOISY, "HT")
    rows = [(*k, float(P._unpack(sums[(*k, 0)], NOISY, f, extra[k])[0])) for k, f in fits.items()]
    values = obs.sparkSession.createDataFrame(rows, "Female bigint, llf double")
    counts = series.groupBy("Female").agg(F.count("*").alias("n_subj"), F.sum(F.aggregate("points", F.lit(0.0), lambda a, q: a + q["n"])).cast("bigint").alias("n_obs"))
    return counts.withColumn("llf", F.round(by_stratum(values, ["Female"], F.col("llf")), 3))


def conditional_means(obs, fits):
    """Mean and spread of height at ages 1..10 given all heights of a subject, under the given parameters."""
    series = P.subject_series(obs, ["Female"], NOISY, "HT")
    ones = F.array(F.lit(1.0))
    targets = F.array(*[F.struct(F.lit(float(a)).alias("t"), ones.alias("s"), ones.alias("u")) for a in G.AGES])
    asked = series.withColumn("targets", targets).withColumn("e", F.array().cast("array<array<double>>"))
    known = P.conditional_series(asked, ["Female"], NOISY, fits)
    beta = P.beta_column(fits, ["Female"])[0]
    rows = known.select("ID", beta.alias("b"), F.inline(F.arrays_zip("t", "z", "sd")))
    return rows.select("ID", F.col("t").cast("int").alias("age"), F.round(F.col("b") + F.col("z"), 2).alias("mean"), F.round("sd", 2).alias("sd"))


@query(
    "gp_llf_all_ages",
    WHOLE_SQL + """, c AS (SELECT Female, count(*) AS n_obs FROM o GROUP BY Female)
    SELECT Female, count(*) AS n_subj, any_value(n_obs) AS n_obs, round(-0.5::DOUBLE*(sum(quad + logdet) + any_value(n_obs)*ln(2*pi())), 3) AS llf FROM k JOIN c USING (Female) GROUP BY Female""",
)
def gp_llf_all_ages(spark, sf_dir):
    """Likelihood of every height of every subject under fixed parameters, per sex."""
    return likelihoods(*noisy_process(spark, sf_dir))


@query(
    "gp_conditional_mean_all_ages",
    WHOLE_SQL + """ SELECT ID, age::INTEGER AS age, round(b + z[age], 2) AS mean, round(sqrt(greatest(s*s - w[age], 0)), 2) AS sd FROM k JOIN p USING (Female), range(1, 11) AS g(age)""",
)
def gp_conditional_mean_all_ages(spark, sf_dir):
    """Mean and spread of height at ages 1..10 given all of a subject's heights, under fixed parameters."""
    return conditional_means(*noisy_process(spark, sf_dir))


@query("fpca_from_draws")
def fpca_from_draws(spark, sf_dir):
    """Completed trajectories drawn into a store, read back by its manifest, and decomposed: loadings per sex."""
    series, knots = body_series(spark, sf_dir)
    fits = P.fit_process(series, ["Female"], BODY)
    path, token = f"{checkpoint_dir(spark).rstrip('/')}/imputed-{uuid.uuid4().hex}", token_of(sf_dir, BODY, {k: (f.beta, f.theta) for k, f in fits.items()})
    draw_into(spark, path, "HT", T.N_IMP, token, body_draws(spark, series, knots, fits))
    back = read_drawn(spark, path, "HT", token).withColumnRenamed("Female", "female")
    basis = G.fpca(G.pooled_moments(back.select("female", "imp", "ID", "age", "value"), ["female"]), ["female"], 1)
    return G.loading_rows(basis, ["female"])


def puberty_visits(spark, sf_dir):
    """Visits at or above age 8 with the near values carried over and age z-scored by sex."""
    visits = V.nearest_fill(T.visits_ts(spark, sf_dir), "y", 1).drop("y", "gap_days").withColumnRenamed("y_filled", "y")
    visits = visits.where((F.col("Age") >= 8) & F.col("HT").isNotNull()).withColumn("Age", round_even("Age", 3))
    stats = visits.groupBy("Female").agg(F.avg("Age").alias("m"), F.stddev_samp("Age").alias("s"))
    own = by_stratum(stats, ["Female"], F.struct("m", "s"))
    scaled = visits.withColumn("AgeZ", (F.col("Age") - own["m"]) / own["s"])
    return durable(scaled.withColumn("AgeZ2", F.col("AgeZ") * F.col("AgeZ")))


def puberty_fit(visits):
    series = P.subject_series(visits, ["Female"], PUBERTY, "y")
    extra = P.within_age(visits, ["Female"], PUBERTY, "y")
    return P.fit_process(series, ["Female"], PUBERTY, extra)


@query("gp_fit_visits")
def gp_fit_visits(spark, sf_dir):
    """Irregular visits: mean on height, log scale quadratic in z-scored age, constant smooth, noise."""
    visits = puberty_visits(spark, sf_dir)
    return P.fit_rows(spark, puberty_fit(visits), ["Female"], dict(visits.dtypes), PUBERTY)


@query("gp_impute_missing")
def gp_impute_missing(spark, sf_dir):
    """Twenty draws at every visit where the value is still missing."""
    visits = puberty_visits(spark, sf_dir)
    return P.impute_missing(visits, ["Female"], PUBERTY, "y", P.usable(puberty_fit(visits)), T.N_IMP, "y")


@query(
    "gp_cov_surface",
    f"""WITH {GROWTH_OBS}, p AS (SELECT Female AS female, ln(stddev_samp(HT)) AS a0, ln(var_samp(Age)) AS g0 FROM growth_obs GROUP BY Female),
    g AS (SELECT female, range AS i, 1 + range*9.0::DOUBLE/99.0::DOUBLE AS t, a0, g0 FROM p, range(100)),
    e AS (SELECT female, i, t, exp(a0 + 0.05*(t - 5)) AS s, exp(g0 + 0.1*(t - 5)) AS u FROM g),
    k AS (SELECT a.female, a.i, b.i AS j, a.s*b.s*pow(a.u*b.u, 0.25)/sqrt((a.u + b.u)/2)*exp(-(a.t - b.t)*(a.t - b.t)/(a.u + b.u)) AS c,
      a.s AS s1, b.s AS s2 FROM e a JOIN e b ON a.female = b.female)
    SELECT female, i, j, round(c, 5) AS cov, round(c/(s1*s2), 6) AS cor FROM k""",
)
def gp_cov_surface(spark, sf_dir):
    """Covariance and correlation of a process on a 100-point age grid, per sex."""
    scale = T.growth_obs(spark, sf_dir).groupBy(F.col("Female").alias("female")).agg(
        F.log(F.stddev_samp("HT")).alias("a0"), F.log(F.var_samp("Age")).alias("g0")
    )
    index = F.expr("sequence(0L, 99L)")
    cells = durable(scale).select("female", "a0", "g0", F.explode(index).alias("i")).select("*", F.explode(index).alias("j"))

    def at(k):
        t = 1 + F.col(k) * 9.0 / 99.0
        return t, F.exp(F.col("a0") + 0.05 * (t - 5)), F.exp(F.col("g0") + 0.1 * (t - 5))

    (t1, s1, u1), (t2, s2, u2) = at("i"), at("j")
    cov = P.kernel_column(t1, t2, s1, s2, u1, u2)
    return cells.select("female", "i", "j", F.round(cov, 5).alias("cov"), r6(cov / (s1 * s2)).alias("cor"))
