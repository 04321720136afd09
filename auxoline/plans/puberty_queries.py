"""Puberty processes with a design of their own for each sex, and their draws in the analysis frame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from auxoline.functions.scalar import by_stratum
from auxoline.operators import growth as G
from auxoline.operators import process as P
from auxoline.operators import visits as V
from auxoline.plans.cohort_queries import cleaned
from auxoline.plans.registry import query
from auxoline.plans.spec_queries import CARRY_DAYS, MIN_PUBERTY_AGE, PUBERTY
from auxoline.plans.study_sql import CLEAN
from auxoline.session import durable
from auxoline.sources import study_tables as T

SEX = {0: "boys", 1: "girls"}
#: The union of both sexes' covariates. A column that only one sex has is zero for the other, whose coefficient then stays zero: both are
#: one model and advance in the same jobs.
SHARED = [c for c in PUBERTY["Breast_Stage_Use_Z"][1] if c in PUBERTY["log2T_use_Z"][1]]
OWN = {f"{c}_{SEX[female]}": (c, female) for female, covariates in PUBERTY.values() for c in covariates if c not in SHARED}
MODEL = P.ProcessModel(mean=(*SHARED, *OWN), scale=("AgeZ", "AgeZ2"), smooth=(), noise=True)


def puberty_cohort(spark, sf_dir):
    """Visits of age 8 or more whose covariates are known: ``value`` is breast stage for girls and testosterone for boys, carried over 90 days; age z-scored by sex."""
    covariates = sorted({c for _, cs in PUBERTY.values() for c in cs})
    visits = durable(cleaned(spark, sf_dir).select("ID", "visit_id", "datecomb", "Female", "Age", *covariates, *PUBERTY).where(f"Age >= {MIN_PUBERTY_AGE}"))
    value, known = None, None
    for var, (female, needs) in PUBERTY.items():
        hit = F.col("Female") == female
        complete = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in needs))
        value = F.when(hit, F.col(var)) if value is None else value.when(hit, F.col(var))
        known = F.when(hit, complete) if known is None else known.when(hit, complete)
    filled = V.nearest_fill(visits.withColumn("value", value), "value", CARRY_DAYS).drop("value", "gap_days").withColumnRenamed("value_filled", "value")
    visits = durable(filled.where(known).withColumns({name: F.when(F.col("Female") == female, F.col(c)).otherwise(0.0) for name, (c, female) in OWN.items()}))
    own = by_stratum(visits.groupBy("Female").agg(F.avg("Age").alias("m"), F.stddev_samp("Age").alias("s")), ["Female"], F.struct("m", "s"))
    scaled = visits.withColumn("AgeZ", (F.col("Age") - own["m"]) / own["s"])
    return durable(scaled.withColumn("AgeZ2", F.col("AgeZ") * F.col("AgeZ")))


def puberty_fits(visits):
    series = P.subject_series(visits, ["Female"], MODEL, "value")
    return P.fit_process(series, ["Female"], MODEL, P.within_age(visits, ["Female"], MODEL, "value"))


@query("gp_fit_puberty")
def gp_fit_puberty(spark, sf_dir):
    """Puberty by sex: girls' mean on height and weight, boys' on height, weight and BMI; log scale quadratic in z-scored age, constant smooth, noise."""
    visits = puberty_cohort(spark, sf_dir)
    rows = P.fit_rows(spark, puberty_fits(visits), ["Female"], dict(visits.dtypes), MODEL)
    for name, (_, female) in OWN.items():
        rows = rows.where(~((F.col("term") == name) & (F.col("Female") != female)))
    return rows


#: Parameters at which the likelihood is checked, beside each sex's mean, spread and age variance.
SLOPES = {"HT": 0.01, "WT": -0.02, "BMI_boys": 0.03}
SCALES = {"AgeZ": 0.1, "AgeZ2": -0.05}


@query(
    "gp_llf_puberty",
    f"""WITH RECURSIVE {CLEAN},
    c AS (SELECT ID, visit_id, datecomb, Female, Age, HT, WT, BMI, CASE WHEN Female = 1 THEN Breast_Stage_Use_Z ELSE log2T_use_Z END AS y0 FROM clean WHERE Age >= {MIN_PUBERTY_AGE}),
    near AS (SELECT a.ID, a.visit_id, min({{'g': abs(date_diff('day', b.datecomb, a.datecomb)), 'd': b.datecomb, 'v': b.visit_id, 'y': b.y0}}) AS n FROM c a JOIN c b
      ON a.ID = b.ID AND a.y0 IS NULL AND b.y0 IS NOT NULL AND abs(date_diff('day', b.datecomb, a.datecomb)) < {CARRY_DAYS} GROUP BY a.ID, a.visit_id),
    v AS (SELECT c.*, coalesce(y0, n.y) AS y FROM c LEFT JOIN near USING (ID, visit_id) WHERE HT IS NOT NULL AND WT IS NOT NULL AND (Female = 1 OR BMI IS NOT NULL)),
    z AS (SELECT Female, avg(Age) AS ma, stddev_samp(Age) AS sa FROM v GROUP BY Female),
    p AS (SELECT Female, avg(y) AS b, stddev_samp(y) AS s, var_samp(Age) AS u FROM v WHERE y IS NOT NULL GROUP BY Female),
    o AS (SELECT v.ID, v.Female, visit_id, Age AS t, y - (b + {SLOPES['HT']}*HT + ({SLOPES['WT']})*WT + CASE WHEN v.Female = 0 THEN {SLOPES['BMI_boys']}*BMI ELSE 0 END) AS r,
      s*exp({SCALES['AgeZ']}*(Age - ma)/sa + ({SCALES['AgeZ2']})*((Age - ma)/sa)*((Age - ma)/sa)) AS sd, u, s*s/4 AS noise
      FROM v JOIN z ON z.Female = v.Female JOIN p ON p.Female = v.Female WHERE y IS NOT NULL),
    l AS (SELECT ID, Female, any_value(u) AS u, any_value(noise) AS noise, count(*) AS n, list(t ORDER BY t, visit_id) AS t, list(r ORDER BY t, visit_id) AS r, list(sd ORDER BY t, visit_id) AS sd FROM o GROUP BY ID, Female),
    e AS (SELECT ID, Female, n, noise, 0::DOUBLE AS logdet, 0::DOUBLE AS quad,
        list_transform(range(1, n + 1), lambda i: list_concat(list_transform(list_zip(t, sd), lambda x: sd[i]*x[2]*exp(-(t[i] - x[1])*(t[i] - x[1])/(2*u))), [r[i]])) AS m FROM l
      UNION ALL
      SELECT ID, Female, n - 1, noise, logdet + ln(d), quad + h[n + 1]*h[n + 1]/d,
        list_transform(m[2:], lambda q: list_transform(list_zip(q[2:n + 1], h[2:n + 1]), lambda w: w[1] - w[2]*(q[1]/d)))
      FROM (SELECT *, m[1] AS h, m[1][1] + noise AS d FROM e WHERE n > 0)),
    k AS (SELECT Female, count(*) AS n_subj, sum(quad + logdet) AS q FROM e WHERE n = 0 GROUP BY Female), g AS (SELECT Female, count(*) AS n_obs FROM o GROUP BY Female)
    SELECT Female, n_subj, n_obs, round(-0.5::DOUBLE*(q + n_obs*ln(2*pi())), 3) AS llf FROM k JOIN g USING (Female)""",
)
def gp_llf_puberty(spark, sf_dir):
    """Likelihood of every observed or carried puberty value under fixed parameters, both sexes' designs in one job."""
    visits = puberty_cohort(spark, sf_dir)
    seen = visits.where("value IS NOT NULL")
    moments = seen.groupBy("Female").agg(F.avg("value").alias("b"), F.log(F.stddev_samp("value")).alias("s"), F.log(F.var_samp("Age")).alias("u"))
    fits = {}
    for r in moments.collect():
        beta = [r["b"], *[SLOPES[c] if c not in OWN or OWN[c][1] == r["Female"] else 0.0 for c in MODEL.mean]]
        fits[(r["Female"],)] = P.ProcessFit(np.array(beta), np.array([r["s"], *[SCALES[c] for c in MODEL.scale], r["u"], r["s"] - np.log(2)]))
    series = durable(P.subject_series(visits, ["Female"], MODEL, "value"))
    sums, extra = P.likelihood_sums(series, ["Female"], MODEL, {k: [f] for k, f in fits.items()}), P.within_age(visits, ["Female"], MODEL, "value")
    rows = [(*k, float(P._unpack(sums[(*k, 0)], MODEL, f, extra[k])[0])) for k, f in fits.items()]
    values = spark.createDataFrame(rows, f"Female {dict(visits.dtypes)['Female']}, llf double")
    counts = series.groupBy("Female").agg(F.count("*").alias("n_subj"), F.sum(F.aggregate("points", F.lit(0.0), lambda a, q: a + q["n"])).cast("bigint").alias("n_obs"))
    return counts.withColumn("llf", F.round(by_stratum(values, ["Female"], F.col("llf")), 3))


@query("puberty_frame")
def puberty_frame(spark, sf_dir):
    """Every visit of the cohort in every imputation, with missing puberty values drawn from the fitted process; the other sex's variable is zero."""
    visits = puberty_cohort(spark, sf_dir)
    fills = durable(P.impute_missing(visits, ["Female"], MODEL, "value", P.usable(puberty_fits(visits)), T.N_IMP, "puberty"))
    imps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(T.N_IMP - 1).cast("bigint"))).alias("imp")
    frame = visits.select("ID", "visit_id", "Female", "value", imps)
    for var, (female, _) in PUBERTY.items():
        own = F.when(F.col("Female") == female, F.col("value"))
        frame = G.merge_fills(frame.withColumn(var, own), fills.where(F.col("Female") == female), var, 1 - female)
    return frame.select("imp", "ID", "visit_id", "Female", *PUBERTY)
