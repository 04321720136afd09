"""Completed growth trajectories: long and wide forms, moments, functional PCA, scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from auxoline.functions.scalar import by_stratum
from auxoline.operators.linear import only_row
from auxoline.operators.summaries import complete_cases

# The age grid and the weight of the second-difference penalty.
AGES = tuple(range(1, 11))
SMOOTHING = 0.2


def trajectories(growth: DataFrame, by: list[str], ages=AGES) -> DataFrame:
    """One row per trajectory with columns ``a<age>``; incomplete trajectories are dropped.

    One aggregation, where a pivot would first group by age too: rows that lie by subject already are not shuffled.
    """
    wide = growth.groupBy(*by, "imp", "ID").agg(*[F.max(F.when(F.col("age") == a, F.col("value"))).alias(f"a{a}") for a in ages])
    for a in ages:
        wide = wide.where(F.col(f"a{a}").isNotNull())
    return wide


def to_long(wide: DataFrame, ids: list[str], prefix: str = "a") -> DataFrame:
    """Wide age columns back to rows (ids..., age, value)."""
    values = [c for c in wide.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    long = wide.unpivot(ids, values, "column", "value")
    return long.select(*ids, F.substring("column", len(prefix) + 1, 9).cast("int").alias("age"), "value")


def trajectory_sums(wide: DataFrame, by: list[str], ages=AGES) -> DataFrame:
    """n, sums and sums of products (upper triangle) of complete trajectories per (by..., imp).

    Plain sums of products keep the aggregation buffer at one number per pair, where ``covar_samp`` would keep four.
    """
    names = [f"a{a}" for a in ages]
    return wide.groupBy(*by, "imp").agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)],
        *[F.expr(f"sum({names[i]} * {names[j]})").alias(f"q{i}_{j}") for i in range(len(names)) for j in range(i, len(names))],
    )


def moments_of_sums(sums: DataFrame, by: list[str], ages=AGES) -> DataFrame:
    """``ages``, ``mean`` and ``cov`` per stratum: moments within each imputation, averaged over imputations."""
    p = len(ages)
    pooled = sums.groupBy(*by).agg(
        *[F.expr(f"avg(s{i} / n)").alias(f"m{i}") for i in range(p)],
        *[F.expr(f"avg((q{i}_{j} - s{i} * s{j} / n) / nullif(n - 1, 0))").alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)],
    )
    cov = F.array(*[F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") for j in range(p)]) for i in range(p)])
    mean = F.array(*[F.col(f"m{i}") for i in range(p)])
    return pooled.select(*by, F.array(*[F.lit(a) for a in ages]).alias("ages"), mean.alias("mean"), cov.alias("cov"))


def pooled_moments(growth: DataFrame, by: list[str], ages=AGES) -> DataFrame:
    """Mean and covariance within each imputation, averaged over imputations: one row per stratum.

    All imputations and strata are aggregated in one pass with map-side combine.
    """
    return moments_of_sums(trajectory_sums(trajectories(growth, by, ages), by, ages), by, ages)


# Keyed bases ---------------------------------------------------------------------------------

#: The stratum that holds everyone.
EVERYONE = "both"


def keyed_trajectories(growth: DataFrame, strata: DataFrame, ages=AGES) -> DataFrame:
    """Complete trajectories of every variable, (var, imp, ID, a1, ...), with the ``stratum`` of their subject.

    ``growth``: var, imp, ID, age, value; ``strata``: ID, stratum (one row per subject; others drop out).
    """
    return trajectories(growth, ["var"], ages).join(strata.select("ID", "stratum"), "ID")


def keyed_basis(wide: DataFrame, ndim: int, ages=AGES) -> DataFrame:
    """Smoothed components of every variable in every stratum and in all together, as one table of matrices.

    One row per (var, stratum): ages, mean, cov, loadings (ndim x ages), eigenvalues; a basis of fewer dimensions is the first
    rows of it. Trajectories are summed once by stratum; the sums of everyone are sums of those few rows.
    """
    sums = trajectory_sums(wide, ["var", "stratum"], ages)
    either = sums.withColumn("stratum", F.explode(F.array("stratum", F.lit(EVERYONE))))
    added = [c for c in sums.columns if c not in ("var", "stratum", "imp")]
    total = either.groupBy("var", "stratum", "imp").agg(*[F.sum(c).alias(c) for c in added])
    return fpca(moments_of_sums(total, ["var", "stratum"], ages), ["var", "stratum"], ndim)


def keyed_scores(wide: DataFrame, basis: DataFrame, ndim: int, ages=AGES) -> DataFrame:
    """Scores on the basis of the subject's stratum and on everyone's, in one pass: var, stratum, imp, ID, pc0, ...

    The table of matrices is read as one scalar map, so trajectories are neither joined nor shuffled for it.
    """
    both = wide.withColumn("stratum", F.explode(F.array("stratum", F.lit(EVERYONE))))
    both = both.withColumn("b", by_stratum(basis, ["var", "stratum"], F.struct("mean", "loadings")))
    return both.select("var", "stratum", "imp", "ID", *_scores(ndim, ages))


def _scores(ndim: int, ages) -> list:
    """pc0, ... of a wide trajectory from the struct ``b`` of its basis."""
    mean, loadings = F.col("b.mean"), F.col("b.loadings")

    def score(k: int):
        total = F.lit(0.0)
        for i, a in enumerate(ages):
            total = total + (F.col(f"a{a}") - mean[i]) * loadings[k][i]
        return total.alias(f"pc{k}")

    return [score(k) for k in range(ndim)]


def age_variance():
    """Diagonal of the pooled covariance."""
    return F.transform(F.col("cov"), lambda row, i: F.element_at(row, (i + 1).cast("int")))


def smooth_components(cov: np.ndarray, ndim: int, weight: float = SMOOTHING):
    """Leading eigenvectors of the penalised correlation, in units of the age SDs."""
    sd = np.sqrt(np.diag(cov))
    second = np.diff(np.eye(len(sd)), n=2, axis=0)
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd) - weight * second.T @ second)
    values, vectors = values[::-1][:ndim], vectors[:, ::-1][:, :ndim]
    if (values < 0).any():
        raise ValueError("a kept component has a negative eigenvalue")
    balance = (vectors > 0).sum(axis=0) - (vectors < 0).sum(axis=0)
    lean = np.where(balance != 0, balance, vectors.sum(axis=0))
    vectors = np.where(lean < 0, -vectors, vectors)
    return values, vectors / sd[:, None]


def fpca(moments: DataFrame, by: list[str], ndim: int) -> DataFrame:
    """Smoothed functional PCA of every stratum: adds ``loadings`` (ndim x ages) and ``eigenvalues``.

    The input holds one small row per stratum, so only p x p matrices reach Python.
    """

    def solve(batches):
        for pdf in batches:
            loadings, values = [], []
            for cov in pdf["cov"]:
                v, load = smooth_components(np.array([np.asarray(r, dtype=float) for r in cov]), ndim)
                loadings.append([list(map(float, load[:, k])) for k in range(ndim)])
                values.append(list(map(float, v)))
            yield pdf.assign(loadings=pd.Series(loadings, index=pdf.index), eigenvalues=pd.Series(values, index=pdf.index))

    vector = ArrayType(DoubleType())
    schema = StructType(list(moments.schema.fields)).add("loadings", ArrayType(vector)).add("eigenvalues", vector)
    return moments.mapInPandas(solve, schema)


def loading_rows(basis: DataFrame, by: list[str]) -> DataFrame:
    """Loadings as rows (by..., age, pc, loading)."""
    per_pc = basis.select(*by, "ages", F.posexplode("loadings").alias("pc", "w"))
    return per_pc.select(*by, "pc", F.inline(F.arrays_zip("ages", "w"))).select(
        *by, F.col("ages").alias("age"), "pc", F.col("w").alias("loading")
    )


def pc_scores(growth: DataFrame, basis: DataFrame, by: list[str], ndim: int, ages=AGES) -> DataFrame:
    """(x - mean) . loadings of every complete trajectory: (by..., imp, ID, pc0, ...)."""
    wide = trajectories(growth, by, ages)
    if by:
        wide = wide.withColumn("b", by_stratum(basis, by, F.struct("mean", "loadings")))
    else:
        wide = wide.withColumn("b", basis.agg(only_row(F.struct("mean", "loadings")).alias("b")).scalar())
    return wide.select(*by, "imp", "ID", *_scores(ndim, ages))


def pack_scores(visits: DataFrame, scores: DataFrame, columns: list[str], outcome: str, extra: list[str] = ()) -> DataFrame:
    """Visits complete in ``columns`` with their subject's scores of all imputations packed in one array (``draws``); ``extra`` columns may be null.

    Scores are packed to one row per subject (at most one entry per imputation) before the
    join, so the join moves each visit once and not once per imputation.
    """
    pcs = [c for c in scores.columns if c not in ("imp", "ID")]
    packed = scores.groupBy("ID").agg(F.collect_list(F.struct("imp", *pcs)).alias("draws"))
    usable = complete_cases(visits.select("ID", *columns, *extra), [outcome, *columns])
    return usable.join(packed, "ID", "left")


def unpack_scores(packed: DataFrame) -> DataFrame:
    """One row per imputation and visit; visits of subjects without scores drop out."""
    return packed.select("*", F.inline("draws")).drop("draws")


def attach_scores(visits: DataFrame, scores: DataFrame, columns: list[str], outcome: str) -> DataFrame:
    return unpack_scores(pack_scores(visits, scores, columns, outcome))


def merge_fills(frame: DataFrame, fills: DataFrame, value: str, other_sex: int) -> DataFrame:
    """Imputed values of a puberty variable put where it is missing, per imputation and visit.

    The variable is zero for the sex it does not apply to (``Female == other_sex``).
    """
    drawn = fills.select("imp", "ID", "visit_id", F.col("value").alias("_fill"))
    joined = frame.join(drawn, ["imp", "ID", "visit_id"], "left")
    merged = F.when(F.col("Female") == other_sex, 0.0).otherwise(F.coalesce(value, "_fill"))
    return joined.withColumn(value, merged).drop("_fill")
