"""Trajectories, moments, functional PCA, scores and the frames built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from auxoline.functions.basis import bspline
from auxoline.functions.patterns import growth_patterns as make_patterns
from auxoline.operators import growth as G
from auxoline.operators import summaries as S
from auxoline.operators import visits as V
from auxoline.operators.quantiles import exact_quantiles
from auxoline.plans.cohort_queries import cleaned, r6
from auxoline.plans.registry import query
from auxoline.plans.study_sql import CLEAN, COHORT, GROWTH, GROWTH_OBS
from auxoline.session import durable
from auxoline.sources import study_tables as T

WIDE = ", ".join(f"max(value) FILTER (WHERE age = {a}) AS a{a}" for a in G.AGES)


def moments_sql(key: str = "", source: str = "growth") -> str:
    """CTEs full, mom, mn, loading, scores; ``key`` is an optional stratum column with a trailing comma."""
    using = f"({key}imp, ID)"
    on_key = f"({key}age)"
    return f"""
    done AS (SELECT {key}imp, ID FROM {source} GROUP BY {key}imp, ID HAVING count(*) = 10),
    full_ AS (SELECT * FROM {source} JOIN done USING {using}),
    covk AS (SELECT {key}imp, a.age AS i, b.age AS j, covar_samp(a.value, b.value) AS c
             FROM full_ a JOIN full_ b USING {using} GROUP BY ALL),
    mom AS (SELECT {key}i, j, avg(c) AS cov FROM covk GROUP BY ALL),
    mn AS (SELECT {key}age, avg(m) AS mean FROM (SELECT {key}imp, age, avg(value) AS m FROM full_ GROUP BY ALL) GROUP BY ALL),
    loading AS (SELECT {key}i AS age, 1/(10*sqrt(cov)) AS w, cov AS v FROM mom WHERE i = j),
    scores AS (SELECT {key}imp, ID, sum((value - mean)*w) AS pc0 FROM full_ JOIN mn USING {on_key} JOIN loading USING {on_key}
               GROUP BY {key}imp, ID)"""


MOMENTS = GROWTH + "," + moments_sql()


def moments(spark, sf_dir):
    return G.pooled_moments(T.growth(spark, sf_dir), [])


def flat_basis(moments):
    """One component weighting every age by 1 / (10 SD): exact in SQL, so it feeds the checked queries."""
    flat = F.transform(G.age_variance(), lambda v: 1.0 / (10.0 * F.sqrt(v)))
    return moments.withColumn("loadings", F.array(flat))


def written_basis(spark, sf_dir):
    return durable(flat_basis(moments(spark, sf_dir)))


def scores(spark, sf_dir, basis=None):
    return G.pc_scores(T.growth(spark, sf_dir), written_basis(spark, sf_dir) if basis is None else basis, [], 1)


@query("growth_view", f"WITH {GROWTH} SELECT imp, ID, age, round(value, 6) AS value FROM growth")
def growth_view(spark, sf_dir):
    return T.growth(spark, sf_dir).select("imp", "ID", "age", r6("value").alias("value"))


@query(
    "growth_wide",
    f"WITH {GROWTH} SELECT imp, ID, " + ", ".join(f"round(max(value) FILTER (WHERE age = {a}), 6) AS a{a}" for a in G.AGES)
    + " FROM growth GROUP BY imp, ID HAVING count(*) = 10",
)
def growth_wide(spark, sf_dir):
    wide = G.trajectories(T.growth(spark, sf_dir), [])
    return wide.select("imp", "ID", *[r6(f"a{a}").alias(f"a{a}") for a in G.AGES])


@query("growth_long", f"WITH {MOMENTS} SELECT imp, ID, age, round(value, 6) AS value FROM full_")
def growth_long(spark, sf_dir):
    long = G.to_long(G.trajectories(T.growth(spark, sf_dir), []), ["imp", "ID"])
    return long.select("imp", "ID", "age", r6("value").alias("value"))


def growth_with_sex(spark, sf_dir):
    """Trajectories of the subjects of each sex in the analysis cohort."""
    sex = cleaned(spark, sf_dir).select("ID", "Female").distinct()
    return T.growth(spark, sf_dir).join(sex, "ID").withColumnRenamed("Female", "female")


BY_SEX = CLEAN + "," + GROWTH + ", growth_sex AS (SELECT g.*, s.Female AS female FROM growth g JOIN (SELECT DISTINCT ID, Female FROM clean) s USING (ID))"


@query("growth_by_sex", f"WITH {BY_SEX} SELECT female, imp, ID, age, round(value, 6) AS value FROM growth_sex")
def growth_by_sex(spark, sf_dir):
    return growth_with_sex(spark, sf_dir).select("female", "imp", "ID", "age", r6("value").alias("value"))


@query(
    "pooled_moments",
    f"""WITH {MOMENTS} SELECT i AS age_i, j AS age_j, round(cov, 6) AS cov, round(mean, 6) AS mean_i
    FROM mom JOIN mn ON mn.age = mom.i""",
)
def pooled_moments(spark, sf_dir):
    rows = moments(spark, sf_dir).select("ages", F.inline(F.arrays_zip(F.col("ages").alias("age_i"), "mean", "cov")))
    cells = rows.select("age_i", "mean", F.inline(F.arrays_zip(F.col("ages").alias("age_j"), "cov")))
    return cells.select("age_i", "age_j", r6("cov").alias("cov"), r6("mean").alias("mean_i"))


def leading_sql(key: str = "") -> str:
    """Leading eigenvector of the penalised correlation by repeated squaring of a shifted matrix."""
    on = f"a.{key[:-2]} = b.{key[:-2]} AND " if key else ""
    a_key = f"a.{key}" if key else ""
    second = "(VALUES " + ", ".join(
        f"({r}, {r + k}, {v}::DOUBLE)" for r in range(1, 9) for k, v in enumerate((1, -2, 1))
    ) + ") f(r, c, v)"
    using = f"USING ({key[:-2]})" if key else "ON TRUE"
    steps = [
        f"""pen AS (SELECT a.c AS i, b.c AS j, sum(a.v*b.v) AS p FROM {second} , {second.replace(' f(', ' g(')} WHERE f.r = g.r GROUP BY ALL)"""
        .replace("a.c", "f.c").replace("b.c", "g.c").replace("a.v*b.v", "f.v*g.v"),
        f"""sds AS (SELECT {key}i, sqrt(cov) AS s FROM mom WHERE i = j),
        q0 AS MATERIALIZED (SELECT {('m.' + key) if key else ''}m.i, m.j, m.cov/(x.s*y.s) - 0.2*coalesce(p.p, 0) + CASE WHEN m.i = m.j THEN 3.2 ELSE 0 END AS v
          FROM mom m JOIN sds x ON x.i = m.i {f'AND x.{key[:-2]} = m.{key[:-2]}' if key else ''}
          JOIN sds y ON y.i = m.j {f'AND y.{key[:-2]} = m.{key[:-2]}' if key else ''}
          LEFT JOIN pen p ON p.i = m.i AND p.j = m.j)""",
    ]
    for k in range(8):
        steps.append(
            f"""r{k} AS MATERIALIZED (SELECT {a_key}a.i, b.j, sum(a.v*b.v) AS v FROM q{k} a JOIN q{k} b ON {on}a.j = b.i GROUP BY ALL),
            q{k + 1} AS MATERIALIZED (SELECT {('r.' + key) if key else ''}i, j, v/t AS v FROM r{k} r JOIN
              (SELECT {key}sum(v) AS t FROM r{k} WHERE i = j {'GROUP BY ALL' if key else ''}) tr {using})"""
        )
    steps.append(
        f"""best AS (SELECT {key}arg_max(j, v) AS j FROM q8 WHERE i = j {'GROUP BY ALL' if key else ''}),
        raw AS (SELECT {('q.' + key) if key else ''}q.i AS age, q.v FROM q8 q JOIN best b ON b.j = q.j {f'AND b.{key[:-2]} = q.{key[:-2]}' if key else ''}),
        nrm AS (SELECT {key}sqrt(sum(v*v)) AS n, CASE WHEN count(*) FILTER (WHERE v < 0) > count(*) FILTER (WHERE v > 0) THEN -1 ELSE 1 END AS sg
                FROM raw {'GROUP BY ALL' if key else ''}),
        lead_ AS (SELECT {('raw.' + key) if key else ''}age, sg*v/n/s AS loading FROM raw JOIN nrm {using} JOIN sds ON sds.i = raw.age
                {f'AND sds.{key[:-2]} = raw.{key[:-2]}' if key else ''})"""
    )
    return ", ".join(steps)


@query("fpca_loadings", f"WITH {MOMENTS}, {leading_sql()} SELECT age, 0 AS pc, round(loading, 6) + 0.0 AS loading FROM lead_")
def fpca_loadings(spark, sf_dir):
    basis = G.fpca(moments(spark, sf_dir), [], 1)
    return G.loading_rows(basis, []).select("age", "pc", r6("loading").alias("loading"))


@query(
    "fpca_loadings_by_sex",
    f"WITH {BY_SEX}, {moments_sql('female, ', 'growth_sex')}, {leading_sql('female, ')} "
    "SELECT female, age, 0 AS pc, round(loading, 6) + 0.0 AS loading FROM lead_",
)
def fpca_loadings_by_sex(spark, sf_dir):
    basis = G.fpca(G.pooled_moments(growth_with_sex(spark, sf_dir), ["female"]), ["female"], 1)
    return G.loading_rows(basis, ["female"]).select("female", "age", "pc", r6("loading").alias("loading"))


@query("pc_scores", f"WITH {MOMENTS} SELECT imp, ID, round(pc0, 6) + 0.0 AS pc0 FROM scores")
def pc_scores(spark, sf_dir):
    return scores(spark, sf_dir).select("imp", "ID", r6("pc0").alias("pc0"))


FRAME_COLUMNS = ["visit_id", "datecomb", "Female", "MomIdUnique", "SBP_MEAN", "age_x", "age_cen", "HT_cen", "BMI_cen", "Wealth_Z"]

FRAME = (
    CLEAN + "," + MOMENTS + """,
    cen AS (SELECT avg(HT) AS mh, avg(BMI) AS mb, avg(Age) AS ma FROM clean),
    frame AS (SELECT s.imp, c.ID, c.visit_id, c.datecomb, c.Female AS female, c.MomIdUnique AS mom, c.SBP_MEAN AS sbp,
      (c.Age - 10)/10.0::DOUBLE AS age_x, c.Age - ma AS age_cen, c.HT - mh AS ht_cen, c.BMI - mb AS bmi_cen, c.Wealth_Z AS wealth_z, s.pc0
      FROM clean c JOIN scores s ON s.ID = c.ID, cen
      WHERE c.SBP_MEAN IS NOT NULL AND c.HT IS NOT NULL AND c.BMI IS NOT NULL AND c.Wealth_Z IS NOT NULL AND c.Age IS NOT NULL)"""
)


def packed_frame(spark, sf_dir, visits=None, basis=None):
    visits = cleaned(spark, sf_dir) if visits is None else visits
    df = G.pack_scores(visits, scores(spark, sf_dir, basis), FRAME_COLUMNS, "SBP_MEAN")
    return df.withColumnsRenamed(
        {"Female": "female", "MomIdUnique": "mom", "SBP_MEAN": "sbp", "HT_cen": "ht_cen", "BMI_cen": "bmi_cen", "Wealth_Z": "wealth_z"}
    )


def frame(spark, sf_dir, reused: bool = False, visits=None, basis=None):
    """The complete-case analysis frame, one row per imputation and visit.

    A query that reads it more than once has it written in packed form, one row per visit; one that has the cleaned visits or
    the basis already hands them in.
    """
    packed = packed_frame(spark, sf_dir, visits, basis)
    return G.unpack_scores(durable(packed) if reused else packed)


@query(
    "analysis_frame",
    f"""WITH {FRAME} SELECT imp, ID, visit_id, female, mom, round(sbp, 6) AS sbp, round(age_x, 6) + 0.0 AS age_x,
    round(ht_cen, 6) + 0.0 AS ht_cen, round(bmi_cen, 6) + 0.0 AS bmi_cen, round(wealth_z, 6) + 0.0 AS wealth_z,
    round(pc0, 6) + 0.0 AS pc0 FROM frame""",
)
def analysis_frame(spark, sf_dir):
    cols = ["sbp", "age_x", "ht_cen", "bmi_cen", "wealth_z", "pc0"]
    return frame(spark, sf_dir).select("imp", "ID", "visit_id", "female", "mom", *[r6(c).alias(c) for c in cols])


# Steps from the cleaned cohort to the analysis frame, each on top of those before it.
FRAME_STEPS = (
    ("analysis cohort", "TRUE"),
    ("blood pressure", "SBP_MEAN IS NOT NULL"),
    ("height and BMI", "HT IS NOT NULL AND BMI IS NOT NULL"),
    ("wealth", "Wealth_Z IS NOT NULL"),
    ("complete growth", "has_growth"),
)


@query(
    "analysis_funnel",
    f"""WITH {CLEAN}, {GROWTH}, done AS (SELECT DISTINCT ID FROM (SELECT imp, ID FROM growth GROUP BY imp, ID HAVING count(*) = 10)),
    w AS (SELECT *, ID IN (SELECT ID FROM done) AS has_growth FROM clean) """
    + " UNION ALL ".join(
        f"SELECT {i} AS step, '{label}' AS label, count(DISTINCT ID) AS subjects, count(*) AS records FROM w WHERE "
        + " AND ".join(f"({c})" for _, c in FRAME_STEPS[: i + 1])
        for i, (label, _) in enumerate(FRAME_STEPS)
    ),
)
def analysis_funnel(spark, sf_dir):
    """Subjects and records left on the way to the analysis frame, counted per subject first."""
    have = G.trajectories(T.growth(spark, sf_dir), []).select("ID").distinct().withColumn("has_growth", F.lit(True))
    visits = cleaned(spark, sf_dir).select("ID", "SBP_MEAN", "HT", "BMI", "Wealth_Z").join(have, "ID", "left").fillna(False, ["has_growth"])
    conditions = [" AND ".join(f"({c})" for _, c in FRAME_STEPS[: i + 1]) for i in range(len(FRAME_STEPS))]
    per_subject = visits.groupBy("ID").agg(*[F.count_if(F.expr(c)).alias(f"n{i}") for i, c in enumerate(conditions)])
    rows = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.count_if(F.col(f"n{i}") > 0).alias("subjects"), F.sum(f"n{i}").alias("records"))
        for i, (label, _) in enumerate(FRAME_STEPS)
    ])
    return per_subject.agg(rows.alias("r")).select(F.inline("r"))


@query(
    "not_imputed_subjects",
    f"WITH {CLEAN}, {GROWTH} SELECT DISTINCT ID, Female AS female FROM clean WHERE ID NOT IN (SELECT ID FROM growth)",
)
def not_imputed_subjects(spark, sf_dir):
    subjects = cleaned(spark, sf_dir).select("ID", F.col("Female").alias("female")).distinct()
    imputed = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("ID")).distinct()
    return subjects.join(imputed, "ID", "left_anti")


@query(
    "imputed_overlay",
    f"""WITH {GROWTH}, {GROWTH_OBS},
    pick AS (SELECT Female, ID FROM (SELECT Female, ID, row_number() OVER (PARTITION BY Female ORDER BY ID) AS r
      FROM (SELECT DISTINCT o.Female, o.ID FROM growth_obs o WHERE ID IN (SELECT ID FROM growth))) WHERE r <= 21),
    mean_ AS (SELECT ID % 2 AS Female, age, avg(value) AS value FROM growth GROUP BY ALL)
    SELECT Female AS female, ID, 'draw ' || imp AS kind, age::DOUBLE AS age, round(value, 6) AS value FROM pick JOIN growth USING (ID) WHERE imp < 5
    UNION ALL SELECT p.Female, ID, 'mean', age::DOUBLE, round(value, 6) FROM pick p JOIN mean_ m ON m.Female = p.Female
    UNION ALL SELECT o.Female, ID, 'observed', round(Age, 6), round(HT, 6) FROM pick JOIN growth_obs o USING (ID)""",
)
def imputed_overlay(spark, sf_dir):
    """Observed points, five draws and the mean curve of the first 21 subjects per sex."""
    growth, obs = T.growth(spark, sf_dir), T.growth_obs(spark, sf_dir)
    have = obs.select("Female", "ID").join(growth.select("ID").distinct(), "ID", "left_semi")
    pick = V.first_subjects(have, "Female", 21)
    draws = growth.where("imp < 5").join(pick, "ID").select(
        "Female", "ID", F.concat(F.lit("draw "), F.col("imp")).alias("kind"), F.col("age").cast("double").alias("age"), "value"
    )
    mean = growth.groupBy((F.col("ID") % 2).alias("Female"), "age").agg(F.avg("value").alias("value"))
    means = pick.join(mean, "Female").select("Female", "ID", F.lit("mean").alias("kind"), F.col("age").cast("double"), "value")
    points = obs.join(pick, ["Female", "ID"]).select(
        "Female", "ID", F.lit("observed").alias("kind"), r6("Age").alias("age"), F.col("HT").alias("value")
    )
    out = draws.unionByName(means).unionByName(points)
    return out.select(F.col("Female").alias("female"), "ID", "kind", "age", r6("value").alias("value"))


@query(
    "two_level_moments",
    f"""WITH {MOMENTS}, w AS (SELECT imp, age, avg(value) AS m, var_pop(value) AS v FROM full_ GROUP BY ALL)
    SELECT age, round(avg(m), 6) AS mean, round(avg(v), 6) AS var_within, round(var_pop(m), 6) AS var_between FROM w GROUP BY age""",
)
def two_level_moments(spark, sf_dir):
    long = G.to_long(G.trajectories(T.growth(spark, sf_dir), []), ["imp", "ID"])
    out = S.two_level_moments(long, ["imp", "age"], ["age"], "value")
    return out.select("age", r6("mean").alias("mean"), r6("var_within").alias("var_within"), r6("var_between").alias("var_between"))


PATTERN_SQL = """pats AS (SELECT * FROM (VALUES
  (0, 'Always above mean (Z=1 throughout)', '1→1', 1.0::DOUBLE, 1.0::DOUBLE), (1, 'High catch up (Z goes from 0 to 1)', '0→1', 0, 1),
  (2, 'High catch down (Z goes from 1 to 0)', '1→0', 1, 0), (3, 'Always at mean (Z=0 throughout)', '0→0', 0, 0),
  (4, 'Catch up (Z goes from -1 to 0)', '-1→0', -1, 0), (5, 'Catch down (Z goes from 0 to -1)', '0→-1', 0, -1),
  (6, 'Always below mean (Z=-1 throughout)', '-1→-1', -1, -1)) t(pat, label, short, z0, z1)),
patv AS (SELECT pat, label, short, age, (z0 + (z1 - z0)*(age - 1)/9.0::DOUBLE)*sqrt(v) AS value, w FROM pats, loading),
pats_ AS (SELECT pat, label, short, sum(value*w) AS score FROM patv GROUP BY ALL)"""


@query(
    "growth_patterns",
    f"WITH {MOMENTS}, {PATTERN_SQL} SELECT pat, label, age, round(value, 6) + 0.0 AS value FROM patv",
)
def growth_patterns(spark, sf_dir):
    rows = make_patterns(flat_basis(moments(spark, sf_dir)), [])
    out = rows.select("pat", "label", F.inline(F.arrays_zip(F.col("ages").alias("age"), F.col("values").alias("value"))))
    return out.select("pat", "label", "age", r6("value").alias("value"))


@query("pattern_scores", f"WITH {MOMENTS}, {PATTERN_SQL} SELECT pat, label, round(score, 6) + 0.0 AS score FROM pats_")
def pattern_scores(spark, sf_dir):
    rows = make_patterns(flat_basis(moments(spark, sf_dir)), [])
    return rows.select("pat", "label", r6(F.col("scores")[0]).alias("score"))


def _spline_sql() -> str:
    knots = ["1.0::DOUBLE"] * 4 + ["k"] + ["10.0::DOUBLE"] * 4

    def div(top, bottom, f):
        return f"coalesce(({top})/nullif({bottom}, 0), 0)*({f})"

    spans = {3: "Age >= 1 AND Age < k", 4: "Age >= k AND Age <= 10"}
    steps = ["d0 AS (SELECT *, " + ", ".join(f"CASE WHEN {spans[i]} THEN 1.0::DOUBLE ELSE 0 END AS s0_{i}" if i in spans else f"0.0::DOUBLE AS s0_{i}" for i in range(8)) + " FROM growth_obs, knot)"]
    for d in range(1, 4):
        cols = ", ".join(
            div(f"Age - {knots[i]}", f"{knots[i + d]} - {knots[i]}", f"s{d - 1}_{i}")
            + " + "
            + div(f"{knots[i + d + 1]} - Age", f"{knots[i + d + 1]} - {knots[i + 1]}", f"s{d - 1}_{i + 1}")
            + f" AS s{d}_{i}"
            for i in range(8 - d)
        )
        steps.append(f"d{d} AS (SELECT *, {cols} FROM d{d - 1})")
    return ", ".join(steps)


SPLINE = GROWTH_OBS + ", knot AS (SELECT median(Age) AS k FROM growth_obs), " + _spline_sql()


def with_basis(obs, lo: float = 1.0, hi: float = 10.0, age: str = "Age"):
    """Adds b1..b4; the interior knot is the exact median age of the rows."""
    obs = obs.withColumn("knot", exact_quantiles(obs, [], age, [0.5]).select("q").scalar())
    cols = bspline(F.col(age), F.lit(lo), F.col("knot"), F.lit(hi))
    return obs.withColumns({f"b{i + 1}": c for i, c in enumerate(cols)})


@query(
    "bspline_basis",
    f"""WITH {SPLINE} SELECT ID, visit_id, round(Age, 6) AS age, """
    + ", ".join(f"round(s3_{i}, 6) + 0.0 AS b{i}" for i in range(1, 5)) + " FROM d3",
)
def bspline_basis(spark, sf_dir):
    df = with_basis(T.growth_obs(spark, sf_dir))
    return df.select("ID", "visit_id", r6("Age").alias("age"), *[r6(f"b{i}").alias(f"b{i}") for i in range(1, 5)])
