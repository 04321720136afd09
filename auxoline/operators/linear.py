"""Least squares for every replicate at once, from distributed cross-products, and pooling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auxoline.operators.design import Factor

FIT_FIELDS = "terms array<string>, est array<double>, cov array<array<double>>, scale double, n bigint, llf double"


def cross_products(df: DataFrame, by: list[str], terms: dict[str, Column], y: Column, factors: list[Factor] = ()) -> DataFrame:
    """X'X (upper triangle by rows), X'y, y'y and n per key and factor cell, in one aggregation."""
    names, cells = list(terms), [f.column for f in factors]
    design = df.select(*by, *cells, *[c.alias(f"x{i}") for i, c in enumerate(terms.values())], y.cast("double").alias("y"))
    p = len(names)
    xx = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(p) for j in range(i, p)]
    xy = [F.sum(F.col(f"x{i}") * F.col("y")) for i in range(p)]
    return design.groupBy(*by, *cells).agg(
        F.count("*").alias("n"),
        F.array(*xx).alias("xx"),
        F.array(*xy).alias("xy"),
        F.sum(F.col("y") * F.col("y")).alias("yy"),
    )


def normal_equation_rows(cross: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Cross-products as rows (by..., term_i, term_j, v), including the outcome ``y``."""
    p = len(names)
    pairs = [(names[i], names[j]) for i in range(p) for j in range(i, p)]
    rows = [F.struct(F.lit(a).alias("term_i"), F.lit(b).alias("term_j"), F.col("xx")[k].alias("v")) for k, (a, b) in enumerate(pairs)]
    rows += [F.struct(F.lit(a).alias("term_i"), F.lit("y").alias("term_j"), F.col("xy")[i].alias("v")) for i, a in enumerate(names)]
    rows += [F.struct(F.lit("y").alias("term_i"), F.lit("y").alias("term_j"), F.col("yy").alias("v"))]
    return cross.select(*by, "n", F.inline(F.array(*rows)))


def _symmetric(upper, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = upper
    return out + np.triu(out, 1).T


def assemble(pdf: pd.DataFrame, names: list[str], factors: list[Factor]):
    """Full X'X, X'y, y'y, n and term names from the cells of one key."""
    p = len(names)
    labels = [(f, v) for f in factors for v in f.levels if v != f.reference]
    all_names = names + [f"{f.column}[{v}]" for f, v in labels]
    q = len(all_names)
    xx, xy, yy, n = np.zeros((q, q)), np.zeros(q), 0.0, 0
    for row in pdf.to_dict("records"):
        s, t = _symmetric(row["xx"], p), np.asarray(row["xy"], dtype=float)
        d = np.array([float(row[f.column] == v) for f, v in labels])
        xx[:p, :p] += s
        xy[:p] += t
        if labels:
            ones, y_ones = s[0], t[0]  # the intercept is the first term
            xx[:p, p:] += np.outer(ones, d)
            xx[p:, :p] += np.outer(d, ones)
            xx[p:, p:] += row["n"] * np.outer(d, d)
            xy[p:] += d * y_ones
        yy += row["yy"]
        n += int(row["n"])
    return all_names, xx, xy, yy, n


def least_squares(names, xx, xy, yy, n) -> dict:
    """Coefficients, covariance, residual scale and log-likelihood from the normal equations."""
    inv = np.linalg.pinv(xx, hermitian=True)
    est = inv @ xy
    rss = max(yy - est @ xy, 0.0)
    rank = np.linalg.matrix_rank(xx, hermitian=True)
    scale = rss / (n - rank) if n > rank else float("nan")
    llf = -0.5 * n * (np.log(2 * np.pi * rss / n) + 1.0) if rss > 0 else float("nan")
    return {"terms": list(names), "est": est, "cov": scale * inv, "scale": scale, "n": n, "llf": llf}


def fit_cross(cross: DataFrame, by: list[str], names: list[str], factors: list[Factor] = (), estimator: Callable[..., dict] = least_squares) -> DataFrame:
    """Solve every key from its cross-products: one small group per key reaches Python."""
    names, factors = list(names), list(factors)
    types = dict(cross.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in by] + [FIT_FIELDS])

    def solve(key, pdf):
        r = estimator(*assemble(pdf, names, factors))
        row = dict(zip(by, key)) | {k: r[k] for k in ("terms", "scale", "n", "llf")}
        row |= {"est": [float(v) for v in r["est"]], "cov": [[float(v) for v in line] for line in r["cov"]]}
        return pd.DataFrame([row])

    return cross.groupBy(*by).applyInPandas(solve, schema)


def leading_terms(k: int) -> Callable[..., dict]:
    """Least squares on the first ``k`` terms of the same cross-products."""

    def estimator(names, xx, xy, yy, n):
        return least_squares(names[:k], xx[:k, :k], xy[:k], yy, n)

    return estimator


def fit_linear(
    df: DataFrame,
    by: list[str],
    terms: dict[str, Column],
    y: Column,
    factors: list[Factor] = (),
    estimator: Callable[..., dict] = least_squares,
) -> DataFrame:
    """One row per key with coefficients and covariance; every key is fitted in the same job.

    ``estimator`` gets term names, X'X, X'y, y'y and n of one key and may be replaced by
    any estimator that works from those; it never sees the rows themselves.
    """
    return fit_cross(cross_products(df, by, terms, y, factors), by, list(terms), factors, estimator)


def coef_rows(fits: DataFrame, by: list[str]) -> DataFrame:
    """(by..., term, est, se, scale) per replicate."""
    e = fits.select(*by, "scale", "cov", F.posexplode(F.arrays_zip("terms", "est")).alias("i", "t"))
    return e.select(*by, F.col("t.terms").alias("term"), F.col("t.est").alias("est"), F.sqrt(F.col("cov")[F.col("i")][F.col("i")]).alias("se"), "scale")


def pool(fits: DataFrame, by: list[str]) -> DataFrame:
    """Multiple-imputation pooling of every coefficient pair.

    Rows (by..., i, j, term_i, term_j, m, est_i, within, between, total, lost): ``between`` is
    the sample covariance of the estimates over replicates, ``total`` is
    within + (1 + 1/m) between and ``lost`` the fraction of missing information.
    """
    a = fits.select(*by, "terms", "est", "cov", F.posexplode("terms").alias("i", "term_i"))
    b = a.select(*by, "est", "cov", "i", "term_i", F.posexplode("terms").alias("j", "term_j"))
    pairs = b.select(
        *by, "i", "j", "term_i", "term_j",
        F.col("est")[F.col("i")].alias("e_i"), F.col("est")[F.col("j")].alias("e_j"),
        F.col("cov")[F.col("i")][F.col("j")].alias("c"),
    )
    moments = pairs.groupBy(*by, "i", "j", "term_i", "term_j").agg(
        F.count("*").alias("m"),
        F.avg("e_i").alias("est_i"),
        F.avg("c").alias("within"),
        F.coalesce(F.covar_samp("e_i", "e_j"), F.lit(0.0)).alias("between"),
    )
    extra = (1 + F.lit(1.0) / F.col("m")) * F.col("between")
    return moments.withColumns(
        {"total": F.col("within") + extra, "lost": F.try_divide(extra, F.col("within") + extra)}
    )


def pooled_coefficients(pooled: DataFrame, by: list[str]) -> DataFrame:
    return pooled.where("i = j").select(
        *by, F.col("term_i").alias("term"), F.col("est_i").alias("est"), F.sqrt("total").alias("se"), "lost"
    )


def pooled_matrix(pooled: DataFrame, by: list[str]) -> DataFrame:
    """One row per key: ``terms``, ``est`` and the full covariance ``cov``, in term order.

    Every pair has its own average of the estimates, and these differ in the last bits where replicates were added up in another
    order: they are no key. The estimate is the diagonal pair's, as in :func:`pooled_coefficients`.
    """
    rows = pooled.groupBy(*by, "i", "term_i").agg(
        F.max(F.when(F.col("i") == F.col("j"), F.col("est_i"))).alias("est_i"),
        F.transform(F.array_sort(F.collect_list(F.struct("j", "total"))), lambda x: x["total"]).alias("row"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("i", "term_i", "est_i", "row")))
    packed = rows.groupBy(*by).agg(ordered.alias("r"))
    return packed.select(
        *by,
        F.transform("r", lambda x: x["term_i"]).alias("terms"),
        F.transform("r", lambda x: x["est_i"]).alias("est"),
        F.transform("r", lambda x: x["row"]).alias("cov"),
    )


def pooled_fit_stats(fits: DataFrame, by: list[str]) -> DataFrame:
    """Mean log-likelihood and scale over the replicates."""
    return fits.groupBy(*by).agg(F.count("*").alias("m"), F.avg("llf").alias("llf"), F.avg("scale").alias("scale"))


def slice_terms(packed: DataFrame, terms: list[str]) -> DataFrame:
    """Coefficients and covariance of the named terms, in the order asked for."""
    wanted = F.array(*[F.lit(t) for t in terms])
    at = F.transform(wanted, lambda t: F.array_position("terms", t).cast("int"))
    keep = [c for c in packed.columns if c not in ("terms", "est", "cov")]
    sliced = packed.select(*keep, "est", "cov", at.alias("at"))
    return sliced.select(
        *keep,
        wanted.alias("terms"),
        F.transform("at", lambda i: F.element_at("est", i)).alias("est"),
        F.transform("at", lambda i: F.transform("at", lambda j: F.element_at(F.element_at("cov", i), j))).alias("cov"),
    )


def select_dimension(scores: DataFrame, by: list[str], penalty: float = 3.0) -> DataFrame:
    """Score = mean log-likelihood - penalty * (position of the dimension); the first best one wins."""
    scored = scores.withColumn("score", F.col("llf") - penalty * (F.col("ndim") - 1))
    best = F.max_by(F.struct("ndim", "score"), F.struct(F.col("score"), -F.col("ndim")))
    return scored.groupBy(*by).agg(best.alias("b")).select(*by, "b.ndim", "b.score")


def only_row(value: Column) -> Column:
    """Aggregate: the value of the only row; an error if there are several."""
    return F.when(F.count("*") <= 1, F.first(value)).otherwise(F.raise_error(F.lit("one row is expected here, a table with several was given")))


def linear_predictor(design: DataFrame, ids: list[str], terms: dict[str, Column], fit: DataFrame) -> DataFrame:
    """Fitted value of each design row under one pooled model, matched by term name; several models are an error."""
    f = fit.agg(only_row(F.map_from_arrays("terms", "est")).alias("b")).scalar()
    total = F.lit(0.0)
    for name, col in terms.items():
        total = total + col * f[name]
    return design.select(*ids, total.alias("fitted"))
