"""Mediation: mediator models at the reference age, simulated patterns, effect decomposition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auxoline.functions.normal import keyed_normal
from auxoline.functions.scalar import dot, quad
from auxoline.operators import linear as L

REFERENCE_AGE = 21


def at_reference_age(df: DataFrame, age: int = REFERENCE_AGE) -> DataFrame:
    return df.withColumn("age_x", F.lit((age - 10) / 10))


def first_rows(frame: DataFrame, by: list[str], order=("datecomb", "visit_id")) -> DataFrame:
    """The first visit per subject within each replicate, by aggregation."""
    keys = [*by, "imp", "ID"]
    rest = [c for c in frame.columns if c not in keys]
    picked = frame.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(*keys, "r.*")


def design_moments(first: DataFrame, by: list[str], terms: dict[str, Column]) -> DataFrame:
    """Mean and population covariance of the design over the subjects of each replicate.

    Predictions are linear in the design, so these moments give the mean and variance over
    subjects for any coefficients; drawing coefficients needs no further pass over subjects.
    """
    p = len(terms)
    x = first.select(*by, "imp", *[c.alias(f"x{i}") for i, c in enumerate(terms.values())])
    return x.groupBy(*by, "imp").agg(
        F.count("*").alias("subjects"),
        F.array(*[F.avg(f"x{i}") for i in range(p)]).alias("xm"),
        F.array(*[F.covar_pop(f"x{i}", f"x{j}") for i in range(p) for j in range(i, p)]).alias("xc"),
    )


def simulate_mediator(
    frame: DataFrame,
    by: list[str],
    mediator: str,
    terms: dict[str, Column],
    pattern_scores: Column,
    factors=(),
    draw: bool = True,
    common_draws: bool = False,
    reference_age: int = REFERENCE_AGE,
) -> DataFrame:
    """Predicted mediator under two patterns, per replicate.

    Coefficients are drawn from the normal around the pooled fit with normals keyed by (imputation,
    mediator, pattern, term); each pattern has its own draw unless ``common_draws``. Returns
    (by..., imp, mediator, m1, m2, v1, v2, dm, dv): means and variances over subjects (residual scale
    added to v1 and v2) and mean and variance of the difference. ``pattern_scores`` is an array of
    the two scores that replace the first component.
    """
    if not by:
        raise ValueError("name the columns that identify a model")
    names = list(terms) + [t for f in factors for t in f.terms()]
    all_terms = dict(terms) | {k: c for f in factors for k, c in f.terms().items()}
    fits = L.fit_linear(frame, [*by, "imp"], terms, F.col(mediator), list(factors))
    pooled = L.pooled_matrix(L.pool(fits, by), by)
    scale = fits.groupBy(*by).agg(F.avg("scale").alias("scale"))
    first = at_reference_age(first_rows(frame, by), reference_age)
    moments = design_moments(first, by, all_terms)

    def noise(pattern: int) -> Column:
        tag = "1" if common_draws else str(pattern)
        normals = [keyed_normal(F.col("imp"), mediator, tag, t) if draw else F.lit(0.0) for t in names]
        return F.array(*normals)

    joined = moments.withColumns({"e1": noise(1), "e2": noise(2), "pc": pattern_scores})
    joined = joined.join(pooled, by).join(scale, by)
    at_pc = names.index("pc0")
    p = len(names)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                cov = np.array([np.asarray(line, dtype=float) for line in r["cov"]])
                root = np.linalg.cholesky(cov) if draw else np.zeros((p, p))
                xm = np.asarray(r["xm"], dtype=float)
                xc = np.zeros((p, p))
                xc[np.triu_indices(p)] = r["xc"]
                xc = xc + np.triu(xc, 1).T
                xc[at_pc, :] = xc[:, at_pc] = 0.0  # every subject gets the pattern's score
                b = [np.asarray(r["est"]) + root @ np.asarray(e) for e in (r["e1"], r["e2"])]
                means, variances = [], []
                for k in range(2):
                    at = xm.copy()
                    at[at_pc] = r["pc"][k]
                    means.append(float(at @ b[k]))
                    variances.append(float(b[k] @ xc @ b[k]))
                d = b[1] - b[0]
                rows.append(
                    {k: r[k] for k in (*by, "imp")}
                    | {"mediator": mediator, "m1": means[0], "m2": means[1], "v1": variances[0] + r["scale"]}
                    | {"v2": variances[1] + r["scale"], "dm": means[1] - means[0], "dv": float(d @ xc @ d)}
                )
            yield pd.DataFrame(rows, columns=[*by, "imp", "mediator", "m1", "m2", "v1", "v2", "dm", "dv"])

    types = dict(moments.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in (*by, "imp"))
    return joined.mapInPandas(run, f"{head}, mediator string, m1 double, m2 double, v1 double, v2 double, dm double, dv double")


def summarise_simulation(sim: DataFrame, by: list[str]) -> DataFrame:
    """Over replicates: mean of the means, mean of the variances, population variance of the means."""
    return sim.groupBy(*by, "mediator").agg(
        F.avg("m1").alias("m1"),
        F.avg("m2").alias("m2"),
        F.avg("v1").alias("within1"),
        F.avg("v2").alias("within2"),
        F.avg("dm").alias("change"),
        F.sqrt(F.var_pop("dm") + F.avg("dv")).alias("change_se"),
    )


def mediation_effects(rows: DataFrame, by: list[str]) -> DataFrame:
    """Indirect, direct and total effects with bands of two standard errors.

    ``rows`` holds per model ``est`` and ``cov`` in the order of EXPOSURE_TERMS, the scores ``p0, p1`` of
    the two patterns, and the summaries of both mediators: ``h0, h1, dh`` (height) and ``b0, b1, db`` (BMI).
    """
    c = F.col
    zero = F.lit(0.0)
    dh, db, dp = c("dh"), c("db"), c("p1") - c("p0")
    hx = c("p1") * c("h1") - c("p0") * c("h0")
    bx = c("p1") * c("b1") - c("p0") * c("b0")
    vectors = {
        "indirect through height": (dh, zero, zero, hx, zero),
        "indirect through BMI": (zero, db, zero, zero, bx),
        "overall indirect": (dh, db, zero, hx, bx),
        "direct": (zero, zero, dp, zero, zero),
        "total": (dh, db, dp, hx, bx),
    }
    effects = F.array(*[F.struct(F.lit(k).alias("effect"), F.array(*v).alias("u")) for k, v in vectors.items()])
    out = rows.select(*by, "est", "cov", F.inline(effects)).select(
        *by, "effect", dot("u", "est").alias("est"), F.sqrt(quad(F.col("u"), F.col("cov"))).alias("se")
    )
    return out.withColumns({"lower": c("est") - 2 * c("se"), "upper": c("est") + 2 * c("se")})
