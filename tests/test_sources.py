import gzip

import pytest
from pyspark.sql import functions as F

from auxoline.operators import clean as C
from auxoline.operators import growth as G
from auxoline.operators import linear as L
from auxoline.sources import cohort_file, results
from auxoline.sources import study_tables as T


def write_cohort(path, rows, drop=()):
    cols = [c for c in reversed(cohort_file.COHORT_TYPES) if c not in drop]
    lines = [",".join([*cols, "unused"])]
    for r in rows:
        lines.append(",".join([str(r.get(c, "")) for c in cols] + ["x"]))
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines) + "\n")


BASE = {"ID": "7.0", "datecomb": "2020-03-01", "Age_Yrs": 5.0, "Sex": 1, "Ht_Ave_Use": 110.5, "SBP_MEAN": 90, "Bamako": 0, "BMI": 15, "Temp": 20, "T_use": 2, "Breast_Stage_Use": 1}


def test_cohort_file(spark, tmp_path):
    path = str(tmp_path / "cohort.csv.gz")
    write_cohort(path, [BASE, BASE | {"datecomb": "2020-02-01", "Ht_Lag_Flag": 4, "lactMo_Use": 3, "lactmo_Use": 9, "WT": "NaN", "F0_MomID.Unique": "12"}])
    df = cohort_file.ingest_cohort(spark, path, str(tmp_path / "cohort"))
    a, b = df.orderBy("visit_id").collect()
    assert (a.ID, a.Sex, a.Ht_Ave_Use, a.Ht_Lag_Flag, a.WT) == (7, 1, 110.5, None, None)
    assert (b.WT, b.lactMo_Use, b.lactmo_mediation, b["F0_MomID.Unique"], str(b.datecomb)) == (None, 3.0, 9.0, 12, "2020-02-01")
    clean = C.clean(df).collect()
    assert [(r.ID, r.Sex, r.HT, r.MomIdUnique) for r in clean] == [(7, "Male", 110.5, None)]


def test_cohort_file_refuses_bad_input(spark, tmp_path):
    path = str(tmp_path / "bad.csv.gz")
    write_cohort(path, [BASE], drop=("HAZ",))
    with pytest.raises(ValueError, match="HAZ"):
        cohort_file.read_cohort_csv(spark, path)
    path = str(tmp_path / "noid.csv.gz")
    write_cohort(path, [BASE | {"ID": ""}])
    with pytest.raises(Exception, match="a visit has no ID"):
        cohort_file.read_cohort_csv(spark, path).collect()


def test_imputed_tables(spark, sf, tmp_path):
    path = str(tmp_path / "imputed")
    df = T.growth(spark, sf).withColumn("mean", F.lit(1.0)).where("imp < 3")
    results.write_imputed(df, path, "HT")
    results.write_imputed(df.withColumn("value", -F.col("value")), path, "WT")
    assert results.read_imputed(spark, path).count() == 2 * df.count()
    one = results.read_imputed(spark, path, "WT", 2)
    assert one.where("value < 0").count() == df.where("imp = 2").count() == one.count()
    assert "PartitionFilters: [isnotnull(var" in one._jdf.queryExecution().executedPlan().toString()
    csv = str(tmp_path / "wide")
    results.write_wide_csv(df, csv, "HT")
    wide = spark.read.option("header", True).csv(csv)
    assert {"ID", "HT1", "HT10", "Mean1", "Mean10", "imp"} <= set(wide.columns)
    assert wide.count() == df.select("imp", "ID").distinct().count()


def test_centering_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("age", 10.5, 2.25), ("HT", 140.0, None)], "name string, mean double, sd double")
    results.write_centering(df, str(tmp_path / "c"))
    assert sorted(results.read_centering(spark, str(tmp_path / "c")).collect()) == sorted(df.collect())


def test_model_roundtrip(spark, tmp_path):
    rows = [("female", ["b", "a", "c"], [1.0, 2.0, 3.0], [[1.0, 0.1, 0.2], [0.1, 2.0, 0.3], [0.2, 0.3, 3.0]])]
    pooled = spark.createDataFrame(rows, "sex string, terms array<string>, est array<double>, cov array<array<double>>")
    basis = spark.createDataFrame(
        [("female", [1, 2], [0.5, 0.5], [[4.0, 1.0], [1.0, 9.0]], [[0.1, 0.2]])],
        "sex string, ages array<int>, mean array<double>, cov array<array<double>>, loadings array<array<double>>",
    )
    fit = spark.createDataFrame([("female", -10.0, 2.0)], "sex string, llf double, scale double")
    path = str(tmp_path / "model")
    results.write_model(pooled, basis, fit, path, ["sex"])
    assert results.read_model(spark, path, ["sex"]).collect() == pooled.collect()
    assert sorted(tuple(r) for r in spark.read.parquet(path + "/agevar").collect()) == [("female", 1, 4.0), ("female", 2, 9.0)]
    assert sorted(tuple(r) for r in spark.read.parquet(path + "/loading").collect()) == [("female", 1, 0, 0.1), ("female", 2, 0, 0.2)]
    cut = L.slice_terms(results.read_model(spark, path, ["sex"]), ["c", "b"]).first()
    assert (cut.est, cut.cov) == ([3.0, 1.0], [[3.0, 0.2], [0.2, 1.0]])


def test_long_and_wide_are_inverse(spark, sf):
    growth = T.growth(spark, sf).select("imp", "ID", "age", "value")
    back = G.to_long(G.trajectories(growth, []), ["imp", "ID"])
    assert back.exceptAll(growth).count() == 0 and growth.exceptAll(back).count() == 0
