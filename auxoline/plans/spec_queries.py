"""Functional components keyed by variable and sex, and grids of model specifications on their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from auxoline.functions.patterns import growth_patterns
from auxoline.operators import clean as C
from auxoline.operators import contrasts as K
from auxoline.operators import design as D
from auxoline.operators import growth as G
from auxoline.operators import linear as L
from auxoline.operators import mediation as M
from auxoline.operators import mixed as X
from auxoline.operators import specs as S
from auxoline.operators import summaries as S0
from auxoline.operators import visits as V
from auxoline.plans.cohort_queries import BODY_SIZES, LEVEL_COLUMNS, SPEC_BP, cleaned
from auxoline.plans.growth_queries import moments_sql
from auxoline.plans.model_queries import PATTERN_PAIR, effect_vectors_sql, wide_means
from auxoline.plans.registry import query
from auxoline.plans.study_sql import CLEAN, GROWTH_VARS
from auxoline.session import durable
from auxoline.sources import study_tables as T

SEXES = ("female", "male")


# The keyed basis and its scores ------------------------------------------------------------------


def _product(a: str, b: str, out: str) -> str:
    return f"{out} AS MATERIALIZED (SELECT a.k, a.i, b.j, sum(a.v*b.v) AS v FROM {a} a JOIN {b} b ON a.k = b.k AND a.j = b.i GROUP BY ALL)"


def power_sql(start: str, out: str, squarings: int) -> str:
    """Leading eigenvector of the matrix ``start`` (k, i, j, v) per key by repeated squaring: ``out`` (k, i, v, value), unit length and leaning to plus."""
    steps, q = [], start
    for n in range(squarings):
        steps.append(_product(q, q, f"{out}r{n}"))
        steps.append(f"{out}q{n} AS MATERIALIZED (SELECT r.k, i, j, v/t AS v FROM {out}r{n} r JOIN (SELECT k, sum(v) AS t FROM {out}r{n} WHERE i = j GROUP BY k) USING (k))")
        q = f"{out}q{n}"
    return ", ".join(steps) + f""",
    {out}c AS (SELECT k, arg_max(j, v) AS j FROM {q} WHERE i = j GROUP BY k),
    {out}u AS (SELECT q.k, q.i, q.v FROM {q} q JOIN {out}c c ON c.k = q.k AND c.j = q.j),
    {out}n AS (SELECT k, sqrt(sum(v*v)) AS n, CASE WHEN count(*) FILTER (WHERE v < 0) > count(*) FILTER (WHERE v > 0)
      OR (count(*) FILTER (WHERE v < 0) = count(*) FILTER (WHERE v > 0) AND sum(v) < 0) THEN -1 ELSE 1 END AS sg FROM {out}u GROUP BY k),
    {out}v AS MATERIALIZED (SELECT k, i, sg*v/n AS v FROM {out}u JOIN {out}n USING (k)),
    {out} AS MATERIALIZED (SELECT v.k, v.i, v.v, e.value FROM {out}v v JOIN
      (SELECT a.k, sum(a.v*m.v*b.v) AS value FROM {out}v a JOIN {start} m ON m.k = a.k AND m.i = a.i JOIN {out}v b ON b.k = m.k AND b.i = m.j GROUP BY a.k) e ON e.k = v.k)"""


def keyed_sql(names: tuple[str, ...], second: bool) -> str:
    """CTEs clean, growth_k (k = variable and stratum), lead1 (and lead2), load_ (k, pc, age, w) and pcs (k, imp, ID, pc0, pc1)."""
    some = ", ".join(f"'{v}'" for v in names)
    pen = "pen AS (SELECT a.c AS i, b.c AS j, sum(a.v*b.v) AS p FROM d2 a JOIN d2 b ON a.r = b.r GROUP BY ALL)"
    d2 = "d2 AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, {r + k}, {v}::DOUBLE)" for r in range(1, 9) for k, v in enumerate((1, -2, 1))) + ") f(r, c, v))"
    parts = [
        CLEAN,
        GROWTH_VARS,
        f"""growth_k AS (SELECT var || '|' || s.stratum AS k, imp, g.ID, age, value FROM growth_vars g JOIN (SELECT DISTINCT ID, lower(Sex) AS stratum FROM clean
        UNION ALL SELECT DISTINCT ID, 'both' FROM clean) s ON s.ID = g.ID WHERE var IN ({some}))""",
        moments_sql("k, ", "growth_k"),
        d2,
        pen,
        "sds AS (SELECT k, i, sqrt(cov) AS s FROM mom WHERE i = j)",
        # Shifted so that all eigenvalues are positive.
        """pq AS MATERIALIZED (SELECT m.k, m.i, m.j, m.cov/(x.s*y.s) - 0.2*coalesce(p.p, 0) + CASE WHEN m.i = m.j THEN 3.2 ELSE 0 END AS v
        FROM mom m JOIN sds x ON x.k = m.k AND x.i = m.i JOIN sds y ON y.k = m.k AND y.i = m.j LEFT JOIN pen p ON p.i = m.i AND p.j = m.j)""",
        power_sql("pq", "lead1", 9),
    ]
    load = "SELECT l.k, 0 AS pc, l.i AS age, l.v/s.s AS w FROM lead1 l JOIN sds s ON s.k = l.k AND s.i = l.i"
    if second:
        parts.append("pq2 AS MATERIALIZED (SELECT m.k, m.i, m.j, m.v - a.value*a.v*b.v AS v FROM pq m JOIN lead1 a ON a.k = m.k AND a.i = m.i JOIN lead1 b ON b.k = m.k AND b.i = m.j)")
        parts.append(power_sql("pq2", "lead2", 14))
        load += " UNION ALL SELECT l.k, 1, l.i, l.v/s.s FROM lead2 l JOIN sds s ON s.k = l.k AND s.i = l.i"
    parts.append(f"load_ AS MATERIALIZED ({load})")
    parts.append(
        """pcs AS MATERIALIZED (SELECT f.k, imp, ID, sum((value - mean)*w) FILTER (WHERE pc = 0) AS pc0, sum((value - mean)*w) FILTER (WHERE pc = 1) AS pc1
        FROM full_ f JOIN mn ON mn.k = f.k AND mn.age = f.age JOIN load_ l ON l.k = f.k AND l.age = f.age GROUP BY f.k, imp, ID)"""
    )
    return ", ".join(parts)


def keyed(spark, sf_dir, visits, names=BODY_SIZES, ndim: int = 2):
    """The table of bases by variable and sex, and the scores of everyone on theirs and on the common one.

    Trajectories are written once; scores are one pass over them, cheaper than rows twice as many would be to write and read.
    """
    strata = visits.select("ID", F.lower("Sex").alias("stratum")).distinct()
    wide = durable(G.keyed_trajectories(T.growth_vars(spark, sf_dir, names), strata))
    basis = durable(G.keyed_basis(wide, ndim))
    return basis, G.keyed_scores(wide, basis, ndim)


@query(
    "fpca_keyed",
    f"""WITH {keyed_sql(BODY_SIZES, True)} SELECT split_part(k, '|', 1) AS var, split_part(k, '|', 2) AS stratum, d.ndim::INTEGER AS ndim, pc::INTEGER AS pc, age::INTEGER AS age,
    round(w, 5) + 0.0 AS loading FROM load_, (SELECT unnest([1, 2]) AS ndim) d WHERE pc < d.ndim""",
)
def fpca_keyed(spark, sf_dir):
    """Smoothed components of six body sizes, for each sex and both, in one and two dimensions."""
    basis = keyed(spark, sf_dir, cleaned(spark, sf_dir))[0]
    each = basis.select("var", "stratum", "ages", F.explode(F.array(F.lit(1), F.lit(2))).alias("ndim"), "loadings")
    rows = each.select("var", "stratum", "ndim", "ages", F.posexplode(F.slice("loadings", F.lit(1), F.col("ndim"))).alias("pc", "w"))
    cells = rows.select("var", "stratum", "ndim", "pc", F.inline(F.arrays_zip(F.col("ages").alias("age"), F.col("w").alias("loading"))))
    return cells.select("var", "stratum", "ndim", "pc", "age", F.round("loading", 5).alias("loading"))


@query(
    "pc_scores_fpca",
    f"""WITH {keyed_sql(BODY_SIZES, True)} SELECT split_part(k, '|', 1) AS var, split_part(k, '|', 2) AS stratum, imp, ID, round(pc0, 4) + 0.0 AS pc0, round(pc1, 4) + 0.0 AS pc1 FROM pcs""",
)
def pc_scores_fpca(spark, sf_dir):
    """Scores of every completed trajectory on the smoothed components of its variable, of its subject's sex and of both."""
    scores = keyed(spark, sf_dir, cleaned(spark, sf_dir))[1]
    return scores.select("var", "stratum", "imp", "ID", F.round("pc0", 4).alias("pc0"), F.round("pc1", 4).alias("pc1"))


# Specifications ------------------------------------------------------------------------------------

OPTIONAL_OUTCOME = ["Wealth_Z_2", "Mom_BMI", "Mom_Ht_Ave", "Mom_SBP_Z_Res_USE"]
FATHER = ["Dad_BMI", "Dad_Ht_Ave", "Dad_SBP_Z_Res_USE"]
PRESSURE = {"sbp": "SBP_MEAN", "dbp": "DBP_MEAN"}


def spec_visits(spark, sf_dir):
    """The cleaned visits with every column that a specification may take."""
    visits = C.recode_village(cleaned(spark, sf_dir)).withColumns({"preg": C.fill_males_zero("PregMo_Use"), "lact": F.coalesce("lactMo_Use", F.lit(0))})
    visits = C.with_centering(visits, {"preg": F.col("preg"), "lact": F.col("lact")})
    sex = {"female": "Female", "male": "Male"}
    return durable(
        visits.withColumns(
            {
                "PregMo_Use_cen": F.col("preg") - F.col("c.preg_mean"), "lactMo_Use_cen": F.col("lact") - F.col("c.lact_mean"), "stimulant": F.col("Stimulant_No_PerWeek"),
                "age_x2": F.col("age_x") * F.col("age_x"), "age_x3": F.col("age_x") * F.col("age_x") * F.col("age_x"), "stratum": F.lower("Sex"),
                **{f"{s}_{c}": F.col(f) * F.col(c) for s, f in sex.items() for c in ("age_x", "lognummeas", "Breast_Stage_Use_Z", "log2T_use_Z")},
            }
        )
        .withColumns({"female_age_x2": F.col("Female") * F.col("age_x2"), "female_age_x3": F.col("Female") * F.col("age_x3"), "PregMo_Use_cen2": F.col("PregMo_Use_cen") * F.col("PregMo_Use_cen")})
        .drop("c")
    )


VISIT_SQL = """m0 AS (SELECT *, CASE WHEN Female = 0 THEN coalesce(PregMo_Use, 0) ELSE PregMo_Use END AS preg, coalesce(lactMo_Use, 0) AS lact, lower(Sex) AS stratum,
      (Age - 10)/10.0::DOUBLE AS age_x FROM clean),
    cen AS (SELECT avg(HT) AS mh, avg(BMI) AS mb, avg(preg) AS mp, avg(lact) AS ml, avg(Temp) AS mt FROM m0),
    vis AS (SELECT m0.*, HT - mh AS HT_cen, BMI - mb AS BMI_cen, preg - mp AS PregMo_Use_cen, lact - ml AS lactMo_Use_cen, Temp - mt AS temp_cen,
      Stimulant_No_PerWeek AS stimulant, age_x*age_x AS age_x2, age_x*age_x*age_x AS age_x3, (preg - mp)*(preg - mp) AS PregMo_Use_cen2 FROM m0, cen)"""

#: Frames of the study: the covariates of the outcome model, and of the mediation levels by sex.
LATTICE_SETS = {
    **{(f"outcome {bp}", "both", f): [PRESSURE[bp], "lognummeas", "Temp", "School", "Wealth_Z_2", "log2T_use_Z", "Breast_Stage_Use_Z", "preg", "Village", *OPTIONAL_OUTCOME[1:], *(FATHER if f else [])] for bp in SPEC_BP for f in (0, 1)},
    **{("mediation", sex, adj): ["SBP_MEAN", *[c for level in LEVEL_COLUMNS[sex][: adj + 1] for c in level]] for sex in SEXES for adj in range(4)},
}


def _lattice_sql() -> str:
    parts = []
    for (frame, sex, level), columns in LATTICE_SETS.items():
        cond = " AND ".join(f"{c} IS NOT NULL" for c in columns)
        parts.append(
            f"SELECT stratum, '{frame}' AS frame, '{sex}' AS sex, {level} AS level, {len(columns)} AS n_columns, count(*) FILTER (WHERE {cond}) AS n_complete, "
            f"count(DISTINCT CASE WHEN {cond} THEN ID END) AS n_subjects FROM vis GROUP BY stratum"
        )
    return f"WITH {CLEAN}, {VISIT_SQL} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE sex = 'both' OR sex = stratum"


@query("complete_case_lattice", _lattice_sql())
def complete_case_lattice(spark, sf_dir):
    """Rows and subjects of each sex that are complete in every covariate set of the outcome and mediation models, from one aggregation by null pattern."""
    visits = cleaned(spark, sf_dir).withColumns({"preg": C.fill_males_zero("PregMo_Use"), "stratum": F.lower("Sex")})
    out = S.lattice(visits, LATTICE_SETS, ["frame", "sex", "level"], by=["stratum"])
    return out.where("sex = 'both' OR sex = stratum").select("stratum", "frame", "sex", "level", "n_columns", "n_complete", "n_subjects")


GRID_VARS = ("HT", "WT")
SIZE = ["HT_cen", "BMI_cen"]


def mediation_specs() -> list[S.Spec]:
    """Outcome and mediator models of every sex and adjustment level, on the frame of that level."""
    out = []
    for sex in SEXES:
        for adj in range(4):
            needs = ["SBP_MEAN", "HT_cen", "BMI_cen", "age_x", "PregMo_Use_cen"]
            needs += [c for c, level in (("Wealth_Z", 1), ("Mom_Ht_Ave", 2), ("Mom_SBP_Z_Res_USE", 2), ("Dad_Ht_Ave", 3), ("Dad_SBP_Z_Res_USE", 3)) if adj >= level]
            covariates = needs[5:]
            where = {"stratum": sex}
            out.append(S.Spec((sex, adj, "SBP_MEAN"), "SBP_MEAN", S.score_terms(["age_x", *SIZE, *covariates], 1, SIZE), tuple(needs), where))
            for mediator in SIZE:
                own = ["age_x", "age_x2", "age_x3"]
                own += (["Wealth_Z"] + (["PregMo_Use_cen", "PregMo_Use_cen2", "lactMo_Use_cen"] if sex == "female" and mediator == "BMI_cen" else []) + (["stimulant"] if sex == "male" else [])) if adj else []
                own += ["Mom_Ht_Ave"] if adj >= 2 else []
                own += ["Dad_Ht_Ave"] if adj >= 3 else []
                out.append(S.Spec((sex, adj, mediator), mediator, S.score_terms(own, 1), tuple(needs), where))
    return out


def outcome_specs() -> list[S.Spec]:
    """Pressure x dimension x control for current size x father, with all covariates of the outcome model."""
    base = ["Female", "age_x", "age_x2", "age_x3", "lognummeas", "female_age_x", "female_age_x2", "female_age_x3", "female_lognummeas", "temp_cen", "School"]
    base += ["Wealth_Z_2", "female_Breast_Stage_Use_Z", "male_log2T_use_Z", "PregMo_Use_cen", "PregMo_Use_cen2", "lactMo_Use_cen", "Mom_BMI", "Mom_Ht_Ave", "Mom_SBP_Z_Res_USE"]
    out = []
    for bp in SPEC_BP:
        for ndim in (1, 2):
            for control in (0, 1):
                for father in (0, 1):
                    columns = base + (FATHER if father else []) + (SIZE if control else [])
                    out.append(S.Spec((bp, ndim, control, father), PRESSURE[bp], S.score_terms(columns, ndim, SIZE if control else []), ("HT_cen", "BMI_cen")))
    return out


def solve_sql(grid: list[S.Spec], axes: list[str], names: tuple[str, ...], ndim: int, match: str, by: str = "k, imp") -> str:
    """CTE fits (by..., axes..., term, est, v, n, scale, llf) of every specification by Gauss-Jordan elimination of its normal equations.

    ``match`` joins visits (v) and scores (p) where both are of one stratum."""
    columns = sorted({c for s in grid for c in s.needed()} | set())
    scored = [(c, k) for c in sorted({c for s in grid for c, k in s.terms.values() if k is not None}) for k in range(ndim)]
    every = [("1", None), *[(c, None) for c in columns], *scored]
    x = [("1.0::DOUBLE" if c == "1" else f"coalesce({c}, 0)::DOUBLE") + ("" if k is None else f"*pc{k}") for c, k in every]
    p = len(every)
    pairs = [f"sum(x{min(i, j)}*x{max(i, j)})" for i in range(p) for j in range(p)]
    needs = {}
    for s in grid:
        needs.setdefault(frozenset(s.needed()), len(needs))
    frames = " UNION ALL ".join(f"SELECT *, {n} AS need FROM scored WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in sorted(need)) for need, n in needs.items())
    cells = []
    for s in grid:
        at = [every.index(t) for t in [*s.terms.values(), (s.outcome, None)]]
        q = len(at)
        rows = ", ".join("[" + ", ".join(f"s[{i * p + j + 1}]" for j in at) + ", " + ", ".join(f"{float(a == b)}::DOUBLE" for b in range(q - 1)) + "]" for a, i in enumerate(at[:-1]))
        keep = " AND ".join([f"need = {needs[frozenset(s.needed())]}", *[f"{k} = '{v}'" for k, v in s.where.items()]])
        head = ", ".join(f"{v!r} AS {a}" for a, v in zip(axes, s.axes, strict=True))
        terms = ", ".join(f"'{t}'" for t in s.terms)
        cells.append(f"SELECT {by}, {head}, [{terms}] AS terms, {q - 1} AS p, n, s[{at[-1] * p + at[-1] + 1}] AS yy, [{rows}] AS a0 FROM sums_ WHERE {keep}")
    return f"""scored AS (SELECT v.*, p.* EXCLUDE (ID), {', '.join(f'{e} AS x{i}' for i, e in enumerate(x))} FROM vis v JOIN pcs p ON p.ID = v.ID AND {match}),
    framed AS ({frames}),
    sums_ AS MATERIALIZED (SELECT {by}, stratum, need, count(*) AS n, [{', '.join(pairs)}] AS s FROM framed GROUP BY {by}, stratum, need),
    cells AS MATERIALIZED ({' UNION ALL '.join(cells)}),
    gj AS (SELECT *, 1 AS step, a0 AS a FROM cells UNION ALL SELECT * EXCLUDE (step, a), step + 1,
      list_transform(a, lambda r, i: CASE WHEN i = step THEN list_transform(r, lambda e: e/r[step]) ELSE list_transform(r, lambda e, j: e - r[step]*a[step][j]/a[step][step]) END)
      FROM gj WHERE step <= p),
    done_ AS (SELECT *, list_transform(a, lambda r: r[p + 1]) AS est, yy - list_sum(list_transform(a0, lambda r, i: r[p + 1]*a[i][p + 1])) AS rss FROM gj WHERE step = p + 1),
    fits AS (SELECT {by}, {', '.join(axes)}, n, rss/(n - p) AS scale, -n/2.0::DOUBLE*(ln(2*pi()*rss/n) + 1) AS llf, unnest(list_zip(terms, est, list_transform(a, lambda r, i: rss/(n - p)*r[p + 1 + i]))) AS t FROM done_)"""


def pooled_grid(fits, by: list[str], axes: list[str]):
    """Pooled coefficients of every cell with the mean log-likelihood and rows of its fits."""
    keys = [*by, *axes]
    pooled = L.pooled_coefficients(L.pool(fits, keys), keys)
    stats = fits.groupBy(*keys).agg(F.avg("n").alias("n"), F.avg("llf").alias("llf"))
    return pooled.join(stats, keys)


POOL_SQL = """avg(t[2]) AS est, avg(t[3]) AS within, coalesce(var_samp(t[2]), 0) AS between_, count(*) AS m, avg(n) AS n, avg(llf) AS llf"""


@query(
    "model_grid",
    f"""WITH RECURSIVE {keyed_sql(GRID_VARS, False)}, {VISIT_SQL},
    {solve_sql(mediation_specs(), ["sex", "adj", "outcome"], GRID_VARS, 1, "split_part(p.k, '|', 2) = v.stratum")},
    g AS (SELECT split_part(k, '|', 1) AS var, sex, adj, outcome, t[1] AS term, {POOL_SQL} FROM fits GROUP BY ALL)
    SELECT var, sex, adj::INTEGER AS adj, outcome, term, round(est, 4) + 0.0 AS est, round(sqrt(within + (1 + 1.0::DOUBLE/m)*between_), 4) AS se, round(n, 3) AS n FROM g""",
)
def model_grid(spark, sf_dir):
    """Outcome and mediator models of variable x sex x adjustment level on that variable's and sex's own components, pooled over imputations."""
    visits = spec_visits(spark, sf_dir)
    scores = keyed(spark, sf_dir, visits, GRID_VARS, 1)[1].where(f"stratum <> '{G.EVERYONE}'")
    axes = ["sex", "adj", "outcome"]
    # A subject has one sex: the stratum of its scores is that of its visits.
    fits = durable(S.fit_specs(visits, scores.drop("stratum"), ["var", "imp"], ["stratum"], axes, mediation_specs(), 1))
    out = pooled_grid(fits, ["var"], axes)
    return out.select("var", *axes, "term", F.round("est", 4).alias("est"), F.round("se", 4).alias("se"), F.round("n", 3).alias("n"))


@query(
    "outcome_grid",
    f"""WITH RECURSIVE {keyed_sql(BODY_SIZES, True)}, {VISIT_SQL.replace("FROM m0, cen)", ", Female*age_x AS female_age_x, Female*(age_x*age_x) AS female_age_x2, Female*(age_x*age_x*age_x) AS female_age_x3, Female*lognummeas AS female_lognummeas, Female*Breast_Stage_Use_Z AS female_Breast_Stage_Use_Z, Male*log2T_use_Z AS male_log2T_use_Z FROM m0, cen)")},
    {solve_sql(outcome_specs(), ["bp", "ndim", "control", "father"], BODY_SIZES, 2, "split_part(p.k, '|', 2) = 'both'").replace("GROUP BY k, imp, stratum, need", "GROUP BY k, imp, need").replace("SELECT k, imp, stratum, need, count", "SELECT k, imp, need, count")},
    g AS (SELECT split_part(k, '|', 1) AS var, bp, ndim, control, father, t[1] AS term, {POOL_SQL} FROM fits GROUP BY ALL)
    SELECT var, bp, ndim::INTEGER AS ndim, control::INTEGER AS control, father::INTEGER AS father, term, round(est, 4) + 0.0 AS est,
    round(sqrt(within + (1 + 1.0::DOUBLE/m)*between_), 4) AS se, round(n, 3) AS n, round(llf, 2) AS llf FROM g""",
)
def outcome_grid(spark, sf_dir):
    """The outcome model of six body sizes x pressure x dimension x control for current size x father, each with its own covariates and complete cases, pooled."""
    visits = spec_visits(spark, sf_dir)
    scores = keyed(spark, sf_dir, visits, BODY_SIZES, 2)[1].where(f"stratum = '{G.EVERYONE}'").drop("stratum")
    axes = ["bp", "ndim", "control", "father"]
    fits = durable(S.fit_specs(visits, scores, ["var", "imp"], [], axes, outcome_specs(), 2))
    out = pooled_grid(fits, ["var"], axes)
    return out.select("var", *axes, "term", F.round("est", 4).alias("est"), F.round("se", 4).alias("se"), F.round("n", 3).alias("n"), F.round("llf", 2).alias("llf"))


@query(
    "coef_trajectory_fpca",
    f"""WITH RECURSIVE {keyed_sql(GRID_VARS, False)}, {VISIT_SQL},
    {solve_sql(mediation_specs(), ["sex", "adj", "outcome"], GRID_VARS, 1, "split_part(p.k, '|', 2) = v.stratum")},
    g AS (SELECT k, split_part(k, '|', 1) AS var, sex, adj, {POOL_SQL} FROM fits WHERE outcome = 'SBP_MEAN' AND t[1] = 'pc0' GROUP BY ALL),
    c AS (SELECT var, sex, adj, age, w*est AS est, abs(w)*sqrt(within + (1 + 1.0::DOUBLE/m)*between_) AS se FROM g JOIN load_ l ON l.k = g.k AND pc = 0)
    SELECT var, sex, adj::INTEGER AS adj, age::INTEGER AS age, round(est, 5) + 0.0 AS est, round(se, 5) AS se, round(est - 2*se, 5) + 0.0 AS lower, round(est + 2*se, 5) + 0.0 AS upper FROM c""",
)
def coef_trajectory_fpca(spark, sf_dir):
    """The growth effect by age from models on smoothed components, per variable, sex and adjustment level."""
    visits = spec_visits(spark, sf_dir)
    basis, scores = keyed(spark, sf_dir, visits, GRID_VARS, 1)
    axes = ["sex", "adj", "outcome"]
    grid = [s for s in mediation_specs() if s.outcome == "SBP_MEAN"]
    fits = durable(S.fit_specs(visits, scores.where(f"stratum <> '{G.EVERYONE}'").drop("stratum"), ["var", "imp"], ["stratum"], axes, grid, 1))
    keys = ["var", "sex", "adj"]
    model = L.slice_terms(L.pooled_matrix(L.pool(fits, keys), keys), ["pc0"])
    own = basis.select("var", F.col("stratum").alias("sex"), "ages", "loadings")
    out = K.coefficient_trajectory(model.join(own, ["var", "sex"]), keys, 1)
    return out.select(*keys, "age", *[F.round(c, 5).alias(c) for c in ("est", "se", "lower", "upper")])


# Mixed models on the keyed components ---------------------------------------------------------------

MIXED_COLUMNS = ["SBP_MEAN", "age_x", "age_cen", "HT_cen", "BMI_cen", "Wealth_Z"]


def mixed_visits(spark, sf_dir):
    """Complete visits of the mixed models, by subject and mother."""
    visits = spec_visits(spark, sf_dir)
    for c in MIXED_COLUMNS:
        visits = visits.where(F.col(c).isNotNull())
    return visits.withColumn("mom", F.col("MomIdUnique")), visits


@query("select_dim_fitted")
def select_dim_fitted(spark, sf_dir):
    """Dimension of early growth by the mixed models' likelihood, per body size and control for current size (mean over imputations, 3 a dimension).

    One- and two-dimensional models, with and without current size, are column subsets of the same subject sums and step together.
    """
    visits, every = mixed_visits(spark, sf_dir)
    scores = keyed(spark, sf_dir, every, BODY_SIZES, 2)[1].where(f"stratum = '{G.EVERYONE}'")
    terms = D.intercept() | D.linear("age_x", *SIZE)
    specs = {f"{n}|{int(c)}": ["Intercept", "age_x", *(SIZE if c else []), *[f"pc{k}" for k in range(n)]] for n in (1, 2) for c in (False, True)}
    fits = X.fit_scored(visits, scores, ["var", "imp"], terms, F.col("SBP_MEAN"), ["pc0", "pc1"], specs)
    axes = F.split("spec", "[|]")
    fits = durable(fits.withColumns({"ndim": axes[0].cast("int"), "control": axes[1].cast("int")}))
    mean = fits.groupBy("var", "control", "ndim").agg(F.avg("llf").alias("llf"))
    flags = fits.groupBy("var", "control").agg(F.every("converged").alias("converged"), F.some("boundary").alias("boundary"))
    return L.select_dimension(mean, ["var", "control"]).join(flags, ["var", "control"]).select("var", "control", "ndim", F.round("score", 4).alias("score"), "converged", "boundary")


#: Variance ratios (mother, subject) at which the closed-form likelihood is tabulated.
RATIOS = [(m, s) for m in (0.0, 0.25, 1.0) for s in (0.1, 0.5, 2.0)]


@query(
    "mixed_llf_intercept",
    f"""WITH RECURSIVE {keyed_sql(GRID_VARS, False)}, {VISIT_SQL},
    x AS (SELECT p.k, p.imp, v.ID, coalesce(MomIdUnique, -1 - v.ID) AS mom, [1.0::DOUBLE, age_x, pc0, SBP_MEAN] AS z FROM vis v JOIN pcs p ON p.ID = v.ID
      WHERE split_part(k, '|', 2) = 'both' AND {' AND '.join(f'{c} IS NOT NULL' for c in MIXED_COLUMNS if c != 'age_cen')}),
    su AS (SELECT k, imp, mom, ID, count(*) AS n, [{', '.join(f'sum(z[{i}])' for i in range(1, 5))}] AS u,
      [{', '.join('[' + ', '.join(f'sum(z[{i}]*z[{j}])' for j in range(1, 5)) + ']' for i in range(1, 5))}] AS zz FROM x GROUP BY ALL),
    ra AS (SELECT * FROM (VALUES {', '.join(f'({m}::DOUBLE, {s}::DOUBLE)' for m, s in RATIOS)}) t(pm, ps)),
    so AS (SELECT k, imp, pm, ps, mom, n, n/(1 + n*ps) AS a, ln(1 + n*ps) AS l, list_transform(u, lambda v: v/(1 + n*ps)) AS b,
      list_transform(zz, lambda r, i: list_transform(r, lambda v, j: v - ps/(1 + n*ps)*u[i]*u[j])) AS z FROM su, ra),
    mo AS (SELECT k, imp, pm, ps, mom, sum(n) AS n, sum(a) AS a, sum(l) AS l, [{', '.join(f'sum(b[{i}])' for i in range(1, 5))}] AS b,
      [{', '.join('[' + ', '.join(f'sum(z[{i}][{j}])' for j in range(1, 5)) + ']' for i in range(1, 5))}] AS z FROM so GROUP BY ALL),
    mz AS (SELECT k, imp, pm, ps, n, l + ln(1 + pm*a) AS l, list_transform(z, lambda r, i: list_transform(r, lambda v, j: v - pm/(1 + pm*a)*b[i]*b[j])) AS z FROM mo),
    tz AS MATERIALIZED (SELECT k, imp, pm, ps, sum(n) AS n, sum(l) AS l, [{', '.join('[' + ', '.join(f'sum(z[{i}][{j}])' for j in range(1, 5)) + ']' for i in range(1, 5))}] AS z FROM mz GROUP BY ALL),
    ge AS (SELECT *, 1 AS step, z AS a FROM tz UNION ALL SELECT * EXCLUDE (step, a), step + 1,
      list_transform(a, lambda r, i: CASE WHEN i <= step THEN r ELSE list_transform(r, lambda e, j: e - r[step]*a[step][j]/a[step][step]) END) FROM ge WHERE step <= 3)
    SELECT split_part(k, '|', 1) AS var, imp, pm AS psi_mother, ps AS psi_subject, n::BIGINT AS n, round(a[4][4]/n, 4) AS scale,
      round(-0.5::DOUBLE*(n*(ln(2*pi()*a[4][4]/n) + 1) + l), 3) AS llf FROM ge WHERE step = 4""",
)
def mixed_llf_intercept(spark, sf_dir):
    """Likelihood of blood pressure with intercepts of mothers and subjects at fixed variance ratios, in closed form, per body size and imputation."""
    visits, every = mixed_visits(spark, sf_dir)
    scores = keyed(spark, sf_dir, every, GRID_VARS, 1)[1].where(f"stratum = '{G.EVERYONE}'")
    stats = X.scored_stats(visits, scores, ["var", "imp"], D.intercept() | D.linear("age_x"), F.col("SBP_MEAN"), ["pc0"])
    out = X.intercept_likelihood(stats, ["var", "imp"], spark.createDataFrame(RATIOS, "psi_mother double, psi_subject double"), 4)
    return out.select("var", "imp", "psi_mother", "psi_subject", "n", F.round("scale", 4).alias("scale"), F.round("llf", 3).alias("llf"))


# What imputation starts from -----------------------------------------------------------------------

#: Body sizes imputed up to this age, puberty from that age on, and the covariates of each puberty variable by sex.
MAX_BODY_AGE, MIN_PUBERTY_AGE, CARRY_DAYS = 11, 8, 90
PUBERTY = {"Breast_Stage_Use_Z": (1, ["HT", "WT"]), "log2T_use_Z": (0, ["HT", "WT", "BMI"])}
IMPUTED_SIZES = ("HT", "WT", "BMI")


def funnel_steps() -> list[tuple[dict, str]]:
    """Names and condition of every step, for each imputed variable and sex it is imputed for."""
    out = []

    def chain(var, female, steps):
        cond = f"Female = {female}"
        for i, (label, more) in enumerate(steps):
            cond = f"{cond} AND {more}"
            out.append(({"var": var, "female": female, "step": i, "label": label}, cond))

    for var in IMPUTED_SIZES:
        for female in (0, 1):
            chain(var, female, [("loaded", "TRUE"), ("subjects with blood pressure", f"has_sbp AND Age IS NOT NULL AND {var} IS NOT NULL"), ("younger ages", f"Age <= {MAX_BODY_AGE}")])
    for var, (female, others) in PUBERTY.items():
        known = " AND ".join(f"{c} IS NOT NULL" for c in others)
        chain(var, female, [("loaded", "TRUE"), ("old enough", f"Age >= {MIN_PUBERTY_AGE}"), ("covariates known", known), ("used to fit", f"{var}_filled")])
    return out


def _funnel_sql() -> str:
    near = "".join(
        f""", EXISTS (SELECT 1 FROM clean o WHERE o.ID = c.ID AND o.{v} IS NOT NULL AND o.Age >= {MIN_PUBERTY_AGE} AND o.Female = c.Female
        AND abs(date_diff('day', o.datecomb, c.datecomb)) < {CARRY_DAYS}) AS {v}_filled"""
        for v in PUBERTY
    )
    rows = " UNION ALL ".join(
        f"SELECT '{n['var']}' AS var, {n['female']} AS female, {n['step']} AS step, '{n['label']}' AS label, count(*) AS records, count(DISTINCT ID) AS subjects FROM c WHERE {cond}"
        for n, cond in funnel_steps()
    )
    return f"WITH {CLEAN}, s AS (SELECT DISTINCT ID FROM clean WHERE SBP_MEAN IS NOT NULL), c AS (SELECT c.*, c.ID IN (SELECT ID FROM s) AS has_sbp{near} FROM clean c) {rows}"


@query("imputation_funnels", _funnel_sql())
def imputation_funnels(spark, sf_dir):
    """Records and subjects left at each step before body sizes and puberty are imputed; a puberty value is known if another lies within 90 days."""
    visits = durable(cleaned(spark, sf_dir).select("ID", "visit_id", "datecomb", "Female", "Age", "SBP_MEAN", *IMPUTED_SIZES, *PUBERTY))
    old = visits.where(f"Age >= {MIN_PUBERTY_AGE}")
    for var in PUBERTY:
        filled = V.nearest_fill(old.select("ID", "visit_id", "datecomb", var), var, CARRY_DAYS)
        visits = visits.join(filled.select("ID", "visit_id", F.col(f"{var}_filled").isNotNull().alias(f"{var}_filled")), ["ID", "visit_id"], "left")
    have = visits.groupBy("ID").agg(F.bool_or(F.col("SBP_MEAN").isNotNull()).alias("has_sbp"))
    out = S0.step_counts(visits.join(have, "ID"), [(n, F.expr(c)) for n, c in funnel_steps()])
    return out.select("var", "female", "step", "label", "records", "subjects")


# Mediation on the keyed components ------------------------------------------------------------------

LEVEL_NEEDS = {adj: next(s.needs for s in mediation_specs() if s.axes[1] == adj) for adj in range(4)}
MEAN_COLUMNS = ["Wealth_Z", "PregMo_Use_cen", "PregMo_Use_cen2", "lactMo_Use_cen", "stimulant", "Mom_Ht_Ave", "Dad_Ht_Ave"]
AT_AGE = (M.REFERENCE_AGE - 10) / 10
AT_REFERENCE = {"Intercept": 1.0, "age_x": AT_AGE, "age_x2": AT_AGE * AT_AGE, "age_x3": AT_AGE * AT_AGE * AT_AGE}


def reference_design(visits, scores, keys: list[str], strata: list[str]):
    """(keys but the imputation..., strata..., adj, x): covariates' means over the first visits of each level's frame, by name, and the terms at the reference age.

    A subject's first complete visit of each level is found once; scores only say in which imputations the subject is.
    """
    levels = F.array_compact(F.array(*[F.when(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in need)), F.lit(adj)) for adj, need in LEVEL_NEEDS.items()]))
    complete = visits.select("ID", *strata, "datecomb", "visit_id", *MEAN_COLUMNS, F.explode(levels).alias("adj"))
    first = complete.groupBy("ID", *strata, "adj").agg(F.min_by(F.struct(*MEAN_COLUMNS), F.struct("datecomb", "visit_id")).alias("r")).select("ID", *strata, "adj", "r.*")
    each = first.join(scores.select(*keys, "ID"), "ID").groupBy(*keys, *strata, "adj").agg(*[F.avg(c).alias(c) for c in MEAN_COLUMNS])
    outer = [k for k in keys if k != "imp"]
    names = F.array(*[F.lit(c) for c in (*AT_REFERENCE, *MEAN_COLUMNS)])
    return each.groupBy(*outer, *strata, "adj").agg(F.map_from_arrays(names, F.array(*[F.lit(v) for v in AT_REFERENCE.values()], *[F.avg(c) for c in MEAN_COLUMNS])).alias("x"))


def _mediation_sql() -> str:
    names = list(K.EXPOSURE_TERMS)
    at = {t: f"list_position(terms, '{t}')" for t in names}
    est = ", ".join(f"est[{at[t]}] AS e{i}" for i, t in enumerate(names))
    cov = ", ".join(f"rss/(n - p)*a[{at[s]}][p + 1 + {at[t]}] AS w{i}{j}" for i, s in enumerate(names) for j, t in enumerate(names))
    pooled = ", ".join([f"avg(e{i}) AS c{i}" for i in range(5)] + [f"avg(w{i}{j}) + (1 + 1.0::DOUBLE/count(*))*coalesce(covar_samp(e{i}, e{j}), 0) AS v{i}{j}" for i in range(5) for j in range(5)])
    firsts = " UNION ALL ".join(
        f"SELECT * FROM (SELECT {adj} AS adj, vis.*, row_number() OVER (PARTITION BY ID ORDER BY datecomb, visit_id) AS r FROM vis WHERE {' AND '.join(f'{c} IS NOT NULL' for c in need)}) WHERE r = 1"
        for adj, need in LEVEL_NEEDS.items()
    )
    terms = " UNION ALL ".join(
        [f"SELECT k, adj, '{t}' AS term, {v!r}::DOUBLE AS x FROM xm" for t, v in AT_REFERENCE.items()] + [f"SELECT k, adj, '{c}', {c} FROM xm" for c in MEAN_COLUMNS]
    )
    return f"""WITH RECURSIVE {keyed_sql(GRID_VARS, False)}, {VISIT_SQL},
    {solve_sql(mediation_specs(), ["sex", "adj", "outcome"], GRID_VARS, 1, "split_part(p.k, '|', 2) = v.stratum")},
    ex AS (SELECT k, adj, {est}, {cov} FROM done_ WHERE outcome = 'SBP_MEAN'),
    po AS (SELECT k, adj, {pooled} FROM ex GROUP BY k, adj),
    md AS (SELECT k, adj, outcome, t[1] AS term, avg(t[2]) AS est FROM fits WHERE outcome <> 'SBP_MEAN' GROUP BY ALL),
    fi AS ({firsts}),
    xi AS (SELECT p.k, f.adj, p.imp, {', '.join(f'avg({c}) AS {c}' for c in MEAN_COLUMNS)} FROM fi f JOIN pcs p ON p.ID = f.ID AND split_part(p.k, '|', 2) = f.stratum GROUP BY ALL),
    xm AS (SELECT k, adj, {', '.join(f'avg({c}) AS {c}' for c in MEAN_COLUMNS)} FROM xi GROUP BY ALL),
    xt AS ({terms}),
    pt AS (SELECT l.k, -sum(sqrt(m.cov)*l.w) AS p0, sum(sqrt(m.cov)*l.w) AS p1 FROM load_ l JOIN mom m ON m.k = l.k AND m.i = l.age AND m.j = l.age GROUP BY l.k),
    mm AS (SELECT md.k, md.adj, outcome, any_value(p0) AS p0, any_value(p1) AS p1, sum(est*CASE WHEN md.term = 'pc0' THEN p0 ELSE x END) AS m1,
      sum(est*CASE WHEN md.term = 'pc0' THEN p1 ELSE x END) AS m2 FROM md JOIN pt ON pt.k = md.k LEFT JOIN xt ON xt.k = md.k AND xt.adj = md.adj AND xt.term = md.term GROUP BY md.k, md.adj, outcome),
    wm AS (SELECT k, adj, any_value(p0) AS p0, any_value(p1) AS p1, max(m1) FILTER (WHERE outcome = 'HT_cen') AS h0, max(m2) FILTER (WHERE outcome = 'HT_cen') AS h1,
      max(m2 - m1) FILTER (WHERE outcome = 'HT_cen') AS dh, max(m1) FILTER (WHERE outcome = 'BMI_cen') AS b0, max(m2) FILTER (WHERE outcome = 'BMI_cen') AS b1,
      max(m2 - m1) FILTER (WHERE outcome = 'BMI_cen') AS db FROM mm GROUP BY k, adj),
    src AS (SELECT wm.*, po.* EXCLUDE (k, adj) FROM wm JOIN po ON po.k = wm.k AND po.adj = wm.adj), {effect_vectors_sql('src', 'k, adj')}
    SELECT split_part(k, '|', 1) AS var, split_part(k, '|', 2) AS sex, adj::INTEGER AS adj, effect, round(est, 3) + 0.0 AS est, round(se, 3) AS se,
    round(est - 2*se, 3) + 0.0 AS lower, round(est + 2*se, 3) + 0.0 AS upper FROM est_"""


@query("mediation_effects_fpca", _mediation_sql())
def mediation_effects_fpca(spark, sf_dir):
    """Indirect, direct and total effects of variable x sex x adjustment level: outcome and mediators fitted on smoothed components, each level with its own rows and covariates."""
    visits = spec_visits(spark, sf_dir)
    basis, every = keyed(spark, sf_dir, visits, GRID_VARS, 1)
    scores = every.where(f"stratum <> '{G.EVERYONE}'").drop("stratum")
    axes, by = ["sex", "adj", "outcome"], ["var", "sex", "adj"]
    fits = durable(S.fit_specs(visits, scores, ["var", "imp"], ["stratum"], axes, mediation_specs(), 1))
    pooled = durable(L.pooled_matrix(L.pool(fits, ["var", *axes]), ["var", *axes]))
    x = reference_design(visits, scores, ["var", "imp"], ["stratum"]).withColumnRenamed("stratum", "sex")
    a, b = PATTERN_PAIR
    score = lambda pat: F.max(F.when(F.col("pat") == pat, F.col("scores")[0]))
    pair = growth_patterns(basis, ["var", "stratum"]).groupBy("var", F.col("stratum").alias("sex")).agg(score(a).alias("p0"), score(b).alias("p1"))
    rows = pooled.where("outcome <> 'SBP_MEAN'").join(durable(x), by).join(durable(pair), ["var", "sex"])

    def at(p: str):
        parts = F.transform(F.arrays_zip("terms", "est"), lambda t: t["est"] * F.when(t["terms"] == "pc0", F.col(p)).otherwise(F.col("x")[t["terms"]]))
        return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)

    means = rows.select(*by, F.lower("outcome").alias("mediator"), "p0", "p1", at("p0").alias("m1"), at("p1").alias("m2"))
    model = L.slice_terms(pooled.where("outcome = 'SBP_MEAN'").drop("outcome"), list(K.EXPOSURE_TERMS))
    out = M.mediation_effects(wide_means(means, by).join(model, by), by)
    return out.select(*by, "effect", *[F.round(c, 3).alias(c) for c in ("est", "se", "lower", "upper")])
