"""The cohort file: gzip CSV with header in, typed and clustered Parquet out."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from auxoline.functions.scalar import nan_to_null

# Columns of the cohort file and their types.
COHORT_TYPES = {
    "ID": "bigint",
    "datecomb": "date",
    "Age_Yrs": "double",
    "Sex": "int",
    **dict.fromkeys(["Ht_Ave_Use", "WT", "BMI", "HAZ", "WAZ", "BAZ", "BMI_18", "SBP_MEAN", "DBP_MEAN"], "double"),
    **dict.fromkeys(["Ht_Lag_Flag", "Bamako", "ReproStat_Corr", "Village", "Year"], "int"),
    **dict.fromkeys(
        ["T_use", "Breast_Stage_Use", "Stimulant_No_PerWeek", "lognummeas_BASE10", "Temp", "School_Use", "Wealth_Z",
         "Wealth_Z_2", "PregMo_Use", "lactMo_Use", "lactmo_Use", "no_lactmo_info"],
        "double",
    ),
    "F0_MomID.Unique": "bigint",
    **dict.fromkeys(
        ["F0_Mom_BMI", "F0_Dad_BMI", "F0_Mom_Ht_Ave", "F0_Dad_Ht_Ave", "F0_Mom_SBP_Z_Res_USE", "F0_Dad_SBP_Z_Res_USE"], "double"
    ),
}


# Two file columns differ by case only; the one used by the mediation models gets its own name here.
WORKING_NAMES = {"lactmo_Use": "lactmo_mediation"}


def read_cohort_csv(spark: SparkSession, path: str) -> DataFrame:
    """The file with declared types; columns are matched by name, whatever their order.

    Whole numbers written as floats ("12.0") are accepted, "NaN" and blanks are null, a visit
    without an ID is an error. ``visit_id`` numbers the rows in file order and breaks ties.
    """
    header = next(csv.reader([spark.read.text(path).first()[0]]))
    missing = [c for c in COHORT_TYPES if c not in header]
    if missing:
        raise ValueError(f"columns not in the file: {missing}")
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(header))])
    raw = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)

    def typed(name: str, kind: str):
        col = F.col(f"c{header.index(name)}")
        if kind in ("int", "bigint"):
            col = F.when(F.lower(col) != "nan", col).cast("double")
        return col.cast(kind).alias(WORKING_NAMES.get(name, name))

    df = raw.select(F.monotonically_increasing_id().alias("visit_id"), *[typed(c, t) for c, t in COHORT_TYPES.items()])
    known = F.when(F.col("ID").isNull(), F.raise_error(F.lit("a visit has no ID")).cast("bigint")).otherwise(F.col("ID"))
    return nan_to_null(df).withColumn("ID", known)


def ingest_cohort(spark: SparkSession, csv_path: str, parquet_path: str) -> DataFrame:
    """Read the file once and store it as Parquet, rows of one subject close together.

    A gzip file is one split, so the rows are spread by subject before anything else;
    ``rebalance`` splits a subject with very many rows over several files.
    """
    df = read_cohort_csv(spark, csv_path).hint("rebalance", "ID").sortWithinPartitions("ID", "datecomb", "visit_id")
    df.write.mode("overwrite").parquet(parquet_path)
    return spark.read.parquet(parquet_path)
