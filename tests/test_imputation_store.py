"""The imputation store: what is finished is never drawn again, what is torn is never read."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from auxoline.operators import process as P
from auxoline.sources import imputation_store as I


def files(path):
    return sorted(str(f) for f in Path(path).rglob("*"))


class Drawer:
    def __init__(self, spark, size=0.0):
        self.spark, self.size, self.asked = spark, size, []

    def __call__(self, imps):
        self.asked.append(list(imps))
        rows = [(i, s, a, self.size + i + 10.0 * s + a) for i in imps for s in range(3) for a in (1, 2)]
        return self.spark.createDataFrame(rows, "imp long, ID long, age int, value double")


def read(spark, path, token=None):
    return sorted(map(tuple, I.read_drawn(spark, path, "HT", token).select("imp", "ID", "age", "value").collect()))


def test_a_rerun_writes_nothing(spark, tmp_path):
    path, draw = str(tmp_path / "store"), Drawer(spark)
    assert I.draw_into(spark, path, "HT", 4, "t1", draw) == [0, 1, 2, 3]
    before, rows = files(path), read(spark, path, "t1")
    assert len(rows) == 24
    assert I.draw_into(spark, path, "HT", 4, "t1", draw) == [] and draw.asked == [[0, 1, 2, 3]]
    assert files(path) == before and read(spark, path) == rows
    # More imputations, and another variable, leave what is there.
    assert I.draw_into(spark, path, "HT", 6, "t1", draw) == [4, 5]
    assert I.draw_into(spark, path, "WT", 2, "t1", draw) == [0, 1]
    assert [r for r in read(spark, path, "t1") if r[0] < 4] == rows and len(read(spark, path)) == 36


def test_a_torn_write_is_not_read(spark, tmp_path):
    path = str(tmp_path / "store")

    class Torn(Drawer):
        def __call__(self, imps):
            bad = F.when(F.col("ID") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("value"))
            return super().__call__(imps).repartition(3, "ID").withColumn("value", bad)

    with pytest.raises(Exception, match="lost"):
        I.draw_into(spark, path, "HT", 2, "t1", Torn(spark))
    # A run that died between data and manifest leaves a complete folder that nothing names.
    Drawer(spark, 900.0)([0, 1]).write.partitionBy("imp").parquet(f"{path}/data/HT-orphan")
    with pytest.raises(ValueError, match="no finished"):
        I.read_drawn(spark, path, "HT")
    assert I.draw_into(spark, path, "HT", 2, "t1", Drawer(spark)) == [0, 1]
    assert {r[3] < 900 for r in read(spark, path)} == {True} and len(read(spark, path)) == 12


def test_other_parameters_are_drawn_anew(spark, tmp_path):
    path = str(tmp_path / "store")
    I.draw_into(spark, path, "HT", 2, "old", Drawer(spark))
    assert I.missing(spark, path, "HT", 2, "new") == [0, 1]
    I.draw_into(spark, path, "HT", 2, "new", Drawer(spark, 100.0))
    assert all(r[3] >= 100 for r in read(spark, path)) and read(spark, path) == read(spark, path, "new")
    with pytest.raises(ValueError):
        read(spark, path, "old")


def test_tokens():
    fit = P.ProcessFit(np.array([1.0, 2.0]), np.array([0.5]))
    same, other = P.ProcessFit(np.array([1.0, 2.0]), np.array([0.5])), P.ProcessFit(np.array([1.0, 2.0]), np.array([0.5 + 1e-15]))
    assert I.token_of({(0,): fit, (1,): other}) == I.token_of({(1,): other, (0,): same})
    assert I.token_of({(0,): fit}) != I.token_of({(0,): other}) and I.token_of([1, 2]) != I.token_of([12])


def test_some_imputations_are_those_of_all(spark):
    df = spark.range(3).withColumnRenamed("id", "ID")
    every = df.select("ID", P.normals("x", [0, 1, 2, 3], F.lit(5)).alias("e")).orderBy("ID").collect()
    some = df.select("ID", P.normals("x", [3, 1], F.lit(5)).alias("e")).orderBy("ID").collect()
    assert [[r.e[3], r.e[1]] for r in every] == [r.e for r in some]
