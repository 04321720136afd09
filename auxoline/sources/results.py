"""Tables the study writes and reads back: imputed data, centring constants, model results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auxoline.operators.growth import AGES


def write_imputed(df: DataFrame, path: str, var: str) -> None:
    """Completed data sets of one variable, one folder per variable and imputation; folders that are there already are replaced."""
    tagged = df.withColumn("var", F.lit(var)).hint("rebalance", "imp")
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("var", "imp").parquet(path)


def read_imputed(spark: SparkSession, path: str, var: str | None = None, imp: int | None = None) -> DataFrame:
    """All imputations, or one variable or imputation: folders that do not match are not read."""
    df = spark.read.parquet(path).withColumn("imp", F.col("imp").cast("bigint"))
    if var is not None:
        df = df.where(F.col("var") == var)
    if imp is not None:
        df = df.where(F.col("imp") == imp)
    return df


def wide_trajectories(df: DataFrame, var: str, ages=AGES) -> DataFrame:
    """One row per imputation and subject: ID, <var>1.., Mean1.. ."""
    wide = df.groupBy("imp", "ID").pivot("age", list(ages)).agg(F.max("value").alias("v"), F.max("mean").alias("m"))
    return wide.select(
        "imp", "ID", *[F.col(f"{a}_v").alias(f"{var}{a}") for a in ages], *[F.col(f"{a}_m").alias(f"Mean{a}") for a in ages]
    )


def write_wide_csv(df: DataFrame, path: str, var: str) -> None:
    """The wide form as CSV, one folder per imputation."""
    wide_trajectories(df, var).write.mode("overwrite").partitionBy("imp").option("header", True).csv(path)


def write_summary_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_centering(rows: DataFrame, path: str) -> None:
    """(name, mean, sd) as JSON lines."""
    rows.write.mode("overwrite").json(path)


def read_centering(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, mean double, sd double").json(path)


def write_model(pooled: DataFrame, basis: DataFrame, fit: DataFrame, path: str, by: list[str]) -> None:
    """A fitted model as tables: coef, vcov, loading, agevar and fit.

    ``pooled`` is one row per model with terms, est and cov; ``basis`` one row per stratum.
    """
    from auxoline.operators.growth import age_variance, loading_rows

    terms = pooled.select(*by, "terms", F.posexplode(F.arrays_zip("terms", "est", "cov")).alias("i", "t"))
    coef = terms.select(*by, "i", F.col("t.terms").alias("term"), F.col("t.est").alias("est"))
    vcov = terms.select(*by, "i", "terms", F.col("t.terms").alias("term_i"), F.posexplode("t.cov").alias("j", "v"))
    vcov = vcov.select(*by, "i", "j", "term_i", F.col("terms")[F.col("j")].alias("term_j"), "v")
    strata = [c for c in by if c in basis.columns]
    agevar = basis.withColumn("var", age_variance()).select(*strata, F.inline(F.arrays_zip(F.col("ages").alias("age"), F.col("var").alias("v"))))
    tables = {"coef": coef, "vcov": vcov, "loading": loading_rows(basis, strata), "agevar": agevar, "fit": fit}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Coefficients and covariance packed to one row per model again, in term order."""
    coef, vcov = spark.read.parquet(f"{path}/coef"), spark.read.parquet(f"{path}/vcov")
    rows = vcov.groupBy(*by, "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("row"))
    packed = coef.join(rows, [*by, "i"]).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "term", "est", "row"))).alias("r"))
    return packed.select(
        *by,
        F.transform("r", lambda x: x["term"]).alias("terms"),
        F.transform("r", lambda x: x["est"]).alias("est"),
        F.transform("r", lambda x: x["row"]).alias("cov"),
    )
