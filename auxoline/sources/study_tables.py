"""The four study tables, derived from the driver's parquet tables.

``cohort``      visits (orders) of subjects (customers), one mother per three subjects
``growth``      completed trajectories: imputation x subject x age 1..10
``visits_ts``   irregular visits with a partly missing value
``growth_obs``  irregular childhood observations
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auxoline.session import spread

N_IMP = 20
#: Events whose imputations one task derives: a row per imputation and body size comes of each.
EVENTS_A_TASK = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Columns that need the per-visit averages of the line items.
BODY_COLUMNS = ("Ht_Ave_Use", "WT", "BMI", "T_use")

HEIGHT = "(80 + 3.0D * q)"
WEIGHT = "(10 + 200.0D * tax + q)"
MOTHER = "CAST(floor(c_custkey / 3.0D) AS BIGINT)"
BIRTH = "date_add(DATE '1985-01-01', CAST((c_custkey * 37) % 3650 AS INT))"

COHORT_COLUMNS = {
    "ID": "c_custkey",
    "visit_id": "o_orderkey",
    "datecomb": "CAST(o_orderdate AS DATE)",
    "Age_Yrs": f"datediff(CAST(o_orderdate AS DATE), {BIRTH}) / 365.25D",
    "Sex": "CASE WHEN o_orderkey % 17 = 0 THEN 1 - c_custkey % 2 ELSE c_custkey % 2 END",
    "Ht_Ave_Use": HEIGHT,
    "WT": WEIGHT,
    "BMI": f"{WEIGHT} / pow({HEIGHT} / 100.0D, 2.0D)",
    "SBP_MEAN": "CASE WHEN o_orderstatus <> 'P' THEN 90 + o_totalprice / 10000.0D END",
    "DBP_MEAN": "CASE WHEN o_orderstatus <> 'P' THEN 50 + o_totalprice / 20000.0D END",
    "Ht_Lag_Flag": "CASE WHEN NOT startswith(o_orderpriority, '5') THEN CAST(substring(o_orderpriority, 1, 1) AS INT) END",
    "Bamako": "c_nationkey % 3",
    "Village": "c_nationkey + 1",
    "ReproStat_Corr": "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 5 END",
    "Breast_Stage_Use": "CASE WHEN o_orderkey % 9 <> 0 THEN CAST(1 + o_orderkey % 5 AS DOUBLE) END",
    "T_use": "CASE WHEN o_orderkey % 11 <> 0 THEN 1 + 100.0D * disc END",
    "PregMo_Use": "CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 9 END",
    "lactMo_Use": "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 24 END",
    "no_lactmo_info": "CASE WHEN o_orderkey % 8 = 0 THEN 1 END",
    "Stimulant_No_PerWeek": "CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 4 END",
    "Wealth_Z": "CASE WHEN o_orderkey % 19 <> 0 THEN c_acctbal / 1000.0D END",
    "Temp": "20 + o_orderkey % 15",
    "School": "o_orderkey % 13",
    "Year": "year(CAST(o_orderdate AS DATE))",
    "lognummeas_BASE10": "log10(1.0D + o_orderkey % 9)",
    "MomIdUnique": MOTHER,
    "Mom_Ht_Ave": f"150 + {MOTHER} % 20",
    "Dad_Ht_Ave": "CASE WHEN c_custkey % 10 <> 0 THEN 160 + c_custkey % 25 END",
    "Mom_SBP_Z_Res_USE": f"CASE WHEN {MOTHER} % 12 <> 0 THEN (({MOTHER} * 7) % 21 - 10) / 10.0D END",
    "Wealth_Z_2": "CASE WHEN o_orderkey % 23 <> 0 THEN (c_acctbal + 50 * (o_orderkey % 7)) / 1000.0D END",
    "Mom_BMI": f"CASE WHEN {MOTHER} % 14 <> 0 THEN 18 + ({MOTHER} * 5 % 31) / 3.0D END",
    "Dad_BMI": "CASE WHEN c_custkey % 11 <> 0 THEN 19 + (c_custkey * 7 % 29) / 4.0D END",
    "Dad_SBP_Z_Res_USE": "CASE WHEN c_custkey % 15 <> 0 THEN ((c_custkey * 3) % 21 - 10) / 10.0D END",
}


def cohort(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Cohort visits; pass ``columns`` to skip the line-item join where it is not needed."""
    wanted = list(COHORT_COLUMNS) if columns is None else columns
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    visits = orders.join(customer, F.expr("o_custkey = c_custkey"))
    if any(c in BODY_COLUMNS for c in wanted):
        lines = (
            table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey")
            .agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"))
        )
        visits = visits.join(lines, F.expr("l_orderkey = o_orderkey"), "left")
    return visits.selectExpr(*[f"{COHORT_COLUMNS[c]} AS {c}" for c in wanted])


DAY = "datediff(CAST(ts AS DATE), DATE '2024-01-01')"
AGE_BIN = f"1 + CAST(floor({DAY} / 3.0D) AS INT)"


def _left_out_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """imp, ID, age and z: imputation k averages a subject's events of one age bin, leaving out residue class k.

    One pass sums each residue class; every imputation is then total minus class,
    so the events are read and shuffled once instead of once per imputation. Class sums are
    placed by subject, so that what is derived per subject later need not be shuffled again.
    """
    events = table(spark, sf_dir, "events")
    sums = (
        events.selectExpr("user_id AS ID", f"{AGE_BIN} AS age", f"event_id % {N_IMP} AS k", "value")
        .groupBy("ID", "age", "k")
        .agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    )
    classes = (
        spread(sums, "ID", least=events.count() // EVENTS_A_TASK + 1)
        .groupBy("ID", "age")
        .agg(
            F.sum("s").alias("s"),
            F.sum("n").alias("n"),
            F.expr("map_from_entries(collect_list(struct(k, struct(s, n))))").alias("left_out"),
        )
    )
    return (
        classes.selectExpr("*", f"explode(sequence(0L, {N_IMP - 1}L)) AS imp")
        .selectExpr("imp", "ID", "age", "s", "n", "try_element_at(left_out, imp) AS o")
        .selectExpr("imp", "ID", "age", "s - coalesce(o.s, 0D) AS s", "n - coalesce(o.n, 0) AS n")
        .where("n > 0")
        .selectExpr("imp", "ID", "age", "s / n AS z")
    )


GROWTH_HEIGHT = "50 + 6.0D * age + 0.2D * z + ((ID * 7) % 13 - 6) * (0.5D + 0.1D * age)"
GROWTH_WEIGHT = "4 + 2.5D * age + 0.02D * z * (1 + 0.1D * age) + ((ID * 11) % 17 - 8) * (0.1D + 0.03D * age)"
# The other body sizes from height and weight: index, and distances from a standard in its units.
GROWTH_DERIVED = {
    "HT": "ht",
    "WT": "wt",
    "BMI": "wt / pow(ht / 100.0D, 2.0D)",
    "HAZ": "(ht - (50 + 6.0D * age)) / (2 + 0.3D * age)",
    "WAZ": "(wt - (4 + 2.5D * age)) / (0.8D + 0.25D * age)",
    "BAZ": "(wt / pow(ht / 100.0D, 2.0D) - 15) / (1.5D + 0.1D * age)",
}


def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed height trajectories: imp, ID, age, value."""
    return _left_out_means(spark, sf_dir).selectExpr("imp", "ID", "age", f"{GROWTH_HEIGHT} AS value")


def growth_vars(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(GROWTH_DERIVED)) -> DataFrame:
    """Completed trajectories of several body sizes: var, imp, ID, age, value."""
    sizes = _left_out_means(spark, sf_dir).selectExpr("imp", "ID", "age", f"{GROWTH_HEIGHT} AS ht", f"{GROWTH_WEIGHT} AS wt")
    each = ", ".join(f"'{v}', {GROWTH_DERIVED[v]}" for v in names)
    return sizes.selectExpr(f"stack({len(names)}, {each}) AS (var, value)", "imp", "ID", "age").select("var", "imp", "ID", "age", "value")


def visits_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS ID",
        "event_id AS visit_id",
        "CAST(ts AS DATE) AS datecomb",
        f"8 + {DAY} * 0.4D AS Age",
        "user_id % 2 AS Female",
        "100 + 0.1D * value AS HT",
        "CASE WHEN event_type NOT IN ('error', 'signup', 'view') THEN value / 100.0D END AS y",
    )


def growth_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "user_id AS ID",
            "event_id AS visit_id",
            "user_id % 2 AS Female",
            f"1 + 0.3D * ({DAY} + (hour(ts) * 60 + minute(ts)) / 1440.0D) AS Age",
            f"60 + 6.0D * ({DAY} / 3.0D) + ((user_id * 7) % 13 - 6) + 0.02D * value AS HT",
        )
    )
