"""Exact grouped quantiles without sorting a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACCURACY = 10_000
BAND = 1e-3  # ten times the rank error of the sketch


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per key, as ``(keys..., p, n, q)``.

    A sketch first brackets each quantile between two observed values; the rows below
    the bracket are only counted, and only the distinct values inside it (some 0.2 % of a group's) are ranked. The
    answer is exact: the sketch decides what is ranked, never what is returned, and a rank outside its bracket is an
    error. Where the band around a quantile holds fewer than two ranks the bracket is the whole group, which then has at most
    2 / BAND rows. Meant for few groups (sexes, ages, measures): the brackets of all groups travel as one scalar.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    ends = [q for p in probs for q in (max(p - BAND, 0.0), min(p + BAND, 1.0))]
    bounds = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        F.percentile_approx("v", ends, ACCURACY).alias("cut"),
    )
    narrow = F.col("n") * BAND < 2
    brackets = F.array(
        *[
            F.struct(
                F.lit(p).alias("p"),
                F.when(narrow, F.col("least")).otherwise(F.col("cut")[2 * i]).alias("lo"),
                F.when(narrow, F.col("most")).otherwise(F.col("cut")[2 * i + 1]).alias("hi"),
            )
            for i, p in enumerate(probs)
        ]
    )
    # One small entry per group, read as a scalar: the rows themselves are never joined or moved.
    key = F.struct(F.lit(0).alias("all"), *keys)
    table = bounds.agg(
        F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.struct("n", brackets.alias("b")).alias("e")))).alias("t")
    ).scalar()
    counted = (
        rows.withColumn("e", F.try_element_at(table, key))
        .select(*keys, "v", F.col("e.n").alias("n"), F.inline("e.b"))
        .where("v <= hi")
        .groupBy(*keys, "p", "n", F.expr("CASE WHEN v >= lo THEN v END").alias("v"))
        .agg(F.count("*").alias("c"))
    )
    w = Window.partitionBy(*keys, "p").orderBy(F.col("v").asc_nulls_first())
    upto = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("upto", upto)
    at = (F.col("n") - 1) * F.col("p")
    lower = F.floor(at)

    def value_at(rank):
        hit = (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
        return F.max(F.when(hit, F.col("v")))

    found = ranked.groupBy(*keys, "p", "n").agg(value_at(lower).alias("v0"), value_at(F.least(lower + 1, F.col("n") - 1)).alias("v1"))
    inside = F.when(F.col("v0").isNull() | F.col("v1").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket"))).otherwise(F.lit(0.0))
    return found.select(*keys, "p", "n", (F.col("v0") + (at - lower) * (F.col("v1") - F.col("v0")) + inside).alias("q"))
