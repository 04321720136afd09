"""Missing values behave as the study needs, not as SQL defaults would have it."""

import math

import duckdb
from pyspark.sql import functions as F

from auxoline.functions.normal import erfc_sql, two_sided_p
from auxoline.functions.scalar import differs, is_member, nan_to_null, round_even, zscore
from auxoline.operators import summaries as S


def test_inequality_keeps_missing(spark):
    df = spark.createDataFrame([(1, 4), (2, 3), (3, None)], "ID int, flag int")
    assert {r.ID for r in df.where(differs("flag", 4)).collect()} == {2, 3}


def test_membership_of_missing_is_false(spark):
    df = spark.createDataFrame([(2,), (3,), (None,)], "code int")
    assert [r[0] for r in df.select(is_member("code", (2, 4))).collect()] == [True, False, False]


def test_missing_group_keys_are_dropped(spark):
    df = spark.createDataFrame([(1.2, 1, 5.0), (None, 1, 6.0), (1.4, None, 7.0)], "Age double, Female int, HT double")
    rows = S.age_sex_stats(df, ["HT"]).collect()
    assert [(r["age"], r["Female"], r["n"]) for r in rows] == [(1, 1, 1)]


def test_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (3.5,)], "x double")
    assert [r[0] for r in df.select(round_even("x", 0)).collect()] == [0.0, 2.0, 2.0, 4.0]


def test_log_of_non_positive_is_missing(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (8.0,)], "x double")
    out = df.select(F.log2("x").alias("l"))
    assert [r.l for r in out.collect()] == [None, None, 3.0]
    assert out.agg(F.avg("l")).first()[0] == 3.0


def test_zero_over_zero_is_missing(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "est double, se double")
    z = F.try_divide("est", "se")
    assert df.select(z, two_sided_p(z)).first()[0] is None
    assert df.select(two_sided_p(z)).first()[0] is None


def test_sd_of_one_row_is_missing_and_nan_is_null(spark):
    df = spark.createDataFrame([(1.0, 1, float("nan")), (1.0, 1, 2.0)], "Age double, Female int, HT double")
    row = S.age_sex_stats(nan_to_null(df), ["HT"]).first()
    assert (row["n"], row["mean"], row["sd"]) == (1, 2.0, None)


def test_zero_spread_gives_missing_zscore(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    assert df.select(zscore("x", F.lit(1.0), F.lit(0.0))).first()[0] is None


def test_complete_cases_and_null_profile(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, 2.0), (3, 3.0, 3.0)], "ID int, a double, b double")
    assert [r.ID for r in S.complete_cases(df).collect()] == [3]
    assert {r.ID for r in S.complete_cases(df, ["a"]).collect()} == {1, 3}
    assert {r["column"]: r["n_null"] for r in S.null_profile(df, ["ID", "a", "b"]).collect()} == {"ID": 0, "a": 1, "b": 1}


def test_p_values_to_double_precision(spark):
    """Column and SQL text against the C library, far into the tail."""
    values = [v / 16 for v in range(-640, 641)] + [0.662, -0.663, 5.656, 5.657, 38.1, -39.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "z double")
    text = f"SELECT z, {erfc_sql('q')} AS p FROM (SELECT z, abs(z)/sqrt(2.0::DOUBLE) AS q FROM (SELECT unnest({values}::DOUBLE[]) AS z))"
    sql = dict(duckdb.connect().execute(text).fetchall())
    for r in df.select("z", two_sided_p(F.col("z")).alias("p")).collect():
        if r.z is None:
            assert r.p is None
            continue
        want = math.erfc(abs(r.z) / math.sqrt(2))
        for got in (r.p, sql[r.z]):
            assert abs(got - want) <= 1e-13 * want + 1e-300
