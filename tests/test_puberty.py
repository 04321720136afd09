"""Designs of their own for each stratum of a process, and draws in the analysis frame."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from auxoline.operators import process as P
from auxoline.plans import puberty_queries as Q


def test_a_stratum_without_a_column_is_fitted_as_if_alone(spark):
    rng, rows = np.random.default_rng(2), []
    for i in range(60):
        level = rng.normal()
        for _ in range(rng.integers(2, 6)):
            t, a, b = rng.uniform(8, 14), rng.normal(), rng.normal()
            rows.append((i % 2, i, round(float(t), 3), float(a), float(b) if i % 2 == 0 else 0.0, float(1 + 0.5 * a + (0.7 * b if i % 2 == 0 else 0) + level + 0.4 * rng.normal())))
    obs = spark.createDataFrame(rows, "Female long, ID long, Age double, a double, b double, y double")

    def fits(df, mean):
        model = P.ProcessModel(mean=mean, scale=(), smooth=(), noise=True)
        return P.fit_process(P.subject_series(df, ["Female"], model, "y"), ["Female"], model, P.within_age(df, ["Female"], model, "y"))

    both, alone = fits(obs, ("a", "b")), fits(obs.where("Female = 1"), ("a",))
    assert both[1,].beta[2] == 0.0 and abs(both[0,].beta[2] - 0.7) < 0.3
    assert both[1,].llf == pytest.approx(alone[1,].llf, abs=1e-6)
    assert both[1,].beta[:2] == pytest.approx(alone[1,].beta, abs=1e-5)


def test_fits_and_frame(spark):
    sf = "/root/testdata/sf0.01"
    terms = {(r.Female, r.term) for r in entry.queries()["gp_fit_puberty"](spark, sf).collect() if r.part == "mean"}
    assert terms == {(0, "Intercept"), (0, "HT"), (0, "WT"), (0, "BMI_boys"), (1, "Intercept"), (1, "HT"), (1, "WT")}
    visits = Q.puberty_cohort(spark, sf)
    frame = entry.queries()["puberty_frame"](spark, sf)
    names = {1: "Breast_Stage_Use_Z", 0: "log2T_use_Z"}
    own = F.when(F.col("Female") == 1, F.col(names[1])).otherwise(F.col(names[0]))
    other = F.when(F.col("Female") == 1, F.col(names[0])).otherwise(F.col(names[1]))
    checked = frame.join(visits.select("ID", "visit_id", "value"), ["ID", "visit_id"]).agg(
        F.count("*").alias("n"), F.count_if(own.isNull()).alias("open"), F.count_if(other != 0).alias("other"), F.count_if(F.col("value").isNotNull() & (own != F.col("value"))).alias("changed"), F.count_distinct("imp").alias("imps")
    ).first()
    assert (checked.n, checked.open, checked.other, checked.changed, checked.imps) == (20 * visits.count(), 0, 0, 0, 20)
