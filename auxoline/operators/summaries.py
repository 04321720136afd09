"""Grouped summaries: age by sex, per-subject counts, null profile, table 1, quantile pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auxoline.functions.scalar import round_even
from auxoline.operators.quantiles import exact_quantiles
from auxoline.session import durable


def age_sex_stats(df: DataFrame, variables: list[str]) -> DataFrame:
    """n, mean and sample SD of each variable by whole age (half to even) and sex."""
    keyed = df.withColumn("age", round_even("Age", 0).cast("int")).where("age IS NOT NULL AND Female IS NOT NULL")
    wide = keyed.groupBy("age", "Female").agg(
        F.array(
            *[
                F.struct(
                    F.lit(v).alias("var"),
                    F.count(v).alias("n"),
                    F.avg(v).alias("mean"),
                    F.stddev_samp(v).alias("sd"),
                )
                for v in variables
            ]
        ).alias("stats")
    )
    return wide.select("age", "Female", F.inline("stats"))


def centering(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Mean and sample SD of each column as rows (name, mean, sd)."""
    stats = [
        F.struct(F.lit(k).alias("name"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"))
        for k, c in columns.items()
    ]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def subject_counts(df: DataFrame, by: list[str], variable: str) -> DataFrame:
    """Usable rows per subject."""
    return df.where(F.col(variable).isNotNull()).groupBy(*by).agg(F.count("*").alias(f"n_{variable}"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null")) for c in columns]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with no missing value in ``columns`` (default all), as one predicate per column.

    Separate predicates reach the scan and either side of a join; ``dropna`` is one
    predicate over all columns and stays where it is.
    """
    for c in columns or df.columns:
        df = df.where(F.col(f"`{c}`").isNotNull())
    return df


def model_sizes(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Observations, distinct subjects and distinct mothers of a fitted frame.

    Subjects are counted from one row per subject, mothers from one row per mother,
    so a subject or mother with very many visits is reduced before any shuffle.
    """
    by = by or []
    per_subject = df.groupBy(*by, "MomIdUnique", "ID").agg(F.count("*").alias("n"))
    per_mother = per_subject.groupBy(*by, "MomIdUnique").agg(F.sum("n").alias("n"), F.count("*").alias("subjects"))
    return per_mother.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n_obs"),
        F.coalesce(F.sum("subjects"), F.lit(0).cast("bigint")).alias("n_subjects"),
        F.count("MomIdUnique").alias("n_mothers"),
    )


def end_visits(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """First and last row per subject, tagged ``Visit``, from one aggregation (no sort, no window)."""
    row, key = F.struct(*columns), F.struct(*order)
    ends = df.groupBy("ID").agg(F.min_by(row, key).alias("first"), F.max_by(row, key).alias("last"))
    tagged = F.array(
        F.struct(F.lit("first").alias("Visit"), F.col("first").alias("r")),
        F.struct(F.lit("last").alias("Visit"), F.col("last").alias("r")),
    )
    return ends.select("ID", F.inline(tagged)).select("ID", "Visit", "r.*")


def table_one(df: DataFrame, variables: list[str], order: list[str]) -> DataFrame:
    """N (nulls included), mean, 10 % and 90 % points at the first and last visit, by sex.

    The end visits (two rows per subject) are written once: three passes read them.
    """
    ends = durable(end_visits(df, ["Female", *variables], order))
    long = ends.select(
        "Visit",
        "Female",
        F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables])),
    )
    keys = ["Visit", "Female", "variable"]
    basic = long.groupBy(*keys).agg(F.count("*").alias("N"), F.avg("x").alias("Mean"))
    tails = exact_quantiles(long, keys, "x", [0.1, 0.9])
    tails = tails.groupBy(*keys).agg(
        F.max(F.when(F.col("p") == 0.1, F.col("q"))).alias("q10"),
        F.max(F.when(F.col("p") == 0.9, F.col("q"))).alias("q90"),
    )
    return basic.join(tails, keys, "left")


def two_level_moments(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """Mean and population variance within each replicate, then of those over replicates."""
    within = df.groupBy(*inner).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    return within.groupBy(*outer).agg(
        F.avg("m").alias("mean"), F.avg("v").alias("var_within"), F.var_pop("m").alias("var_between")
    )


def step_counts(df: DataFrame, steps: list[tuple[dict, Column]], subject: str = "ID") -> DataFrame:
    """Rows and subjects that meet each condition, one row per step with its names: counted per subject first, in one aggregation."""
    per_subject = df.groupBy(subject).agg(*[F.count_if(ok).alias(f"n{i}") for i, (_, ok) in enumerate(steps)])
    cells = [
        F.struct(*[F.lit(v).alias(k) for k, v in names.items()], F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias("records"), F.count_if(F.col(f"n{i}") > 0).alias("subjects"))
        for i, (names, _) in enumerate(steps)
    ]
    return per_subject.agg(F.array(*cells).alias("s")).select(F.inline("s"))
