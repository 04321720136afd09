"""Cleaning of the cohort visits: modal sex, renames, subject rules, z-scores, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auxoline.functions.scalar import differs, is_member, round_even, zscore
from auxoline.session import durable

# Fixed value: last age of the childhood window.
MAX_AGE = 10

# Working name <- cohort file name.
RENAMES = {
    "HT": "Ht_Ave_Use",
    "School": "School_Use",
    "lognummeas": "lognummeas_BASE10",
    "Mom_BMI": "F0_Mom_BMI",
    "Dad_BMI": "F0_Dad_BMI",
    "MomIdUnique": "F0_MomID.Unique",
    "Mom_Ht_Ave": "F0_Mom_Ht_Ave",
    "Dad_Ht_Ave": "F0_Dad_Ht_Ave",
    "Mom_SBP_Z_Res_USE": "F0_Mom_SBP_Z_Res_USE",
    "Dad_SBP_Z_Res_USE": "F0_Dad_SBP_Z_Res_USE",
}

# Reproductive status codes.
PREGNANT_CODES = (2, 4)
LACTATING_CODES = (3,)


def early_height() -> Column:
    return F.col("Ht_Ave_Use").isNotNull() & (round_even("Age_Yrs", 3) <= MAX_AGE + 1)


def has_sbp() -> Column:
    return F.col("SBP_MEAN").isNotNull()


def lag_ok() -> Column:
    return differs("Ht_Lag_Flag", 4)


def row_ok() -> Column:
    """The two row filters: lag flag not 4, Bamako 0 or 1."""
    return lag_ok() & is_member("Bamako", (0, 1))


def rename_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({old: new for new, old in RENAMES.items() if old in df.columns})


def by_sex_counts(df: DataFrame, facts: dict[str, Column] | None = None) -> DataFrame:
    """Per (subject, sex): visits, earliest visit and any extra aggregates, all map-side combined."""
    return df.groupBy("ID", "Sex").agg(
        F.count("*").alias("n"),
        F.min(F.struct("datecomb", "visit_id")).alias("first"),
        *[c.alias(k) for k, c in (facts or {}).items()],
    )


def _most_frequent() -> Column:
    """Highest count; ties go to the sex recorded at the earliest visit."""
    order = F.struct(F.col("n"), -F.unix_date("first.datecomb"), -F.col("first.visit_id"))
    return F.max_by("Sex", F.when(F.col("Sex").isNotNull(), order))


def modal_sex(df: DataFrame) -> DataFrame:
    """One sex per subject."""
    return by_sex_counts(df).groupBy("ID").agg(_most_frequent().alias("Sex"))


def repair_sex(df: DataFrame) -> DataFrame:
    """Every visit gets its subject's modal sex; the recorded one stays as ``Sex_recorded``."""
    return df.withColumnRenamed("Sex", "Sex_recorded").join(modal_sex(df), "ID")


def recode_sex(df: DataFrame) -> DataFrame:
    """0/1 code to label and to the two dummies."""
    return df.withColumns(
        {
            "Female": F.when(F.col("Sex") == 0, 1).when(F.col("Sex") == 1, 0),
            "Male": F.when(F.col("Sex") == 0, 0).when(F.col("Sex") == 1, 1),
            "Sex": F.when(F.col("Sex") == 0, "Female").when(F.col("Sex") == 1, "Male"),
        }
    )


def scaled_columns() -> dict[str, Column]:
    """Columns that are z-scored or centred, by the name of their constants."""
    return {
        "log2T_use": F.log2("T_use"),
        "Breast_Stage_Use": F.col("Breast_Stage_Use"),
        "Age": round_even("Age_Yrs", 3),
        "HT": F.col("Ht_Ave_Use"),
        "BMI": F.col("BMI"),
        "Temp": F.col("Temp").cast("double"),
    }


def subject_facts(df: DataFrame) -> DataFrame:
    """Everything the subject rules, the modal sex and the centring constants need.

    One aggregation over the visits; per subject it keeps the rule flags and, over the
    rows the row filters leave, count, sum and sum of squares of every scaled column.
    """
    flags = {"early_height": early_height(), "any_sbp": has_sbp(), "sbp_in_kept": has_sbp() & row_ok()}
    sums: dict[str, Column] = {}
    for name, col in scaled_columns().items():
        x = F.when(row_ok(), col)
        sums |= {f"{name}_n": F.count(x), f"{name}_s": F.sum(x), f"{name}_q": F.sum(x * x)}
    per_sex = by_sex_counts(df, {k: F.max(c) for k, c in flags.items()} | sums)
    return per_sex.groupBy("ID").agg(
        _most_frequent().alias("Sex"),
        *[F.max(k).alias(k) for k in flags],
        *[F.sum(k).alias(k) for k in sums],
    )


def constants(facts: DataFrame, names) -> Column:
    """Mean and sample SD of scaled columns over the subjects in ``facts``, as one struct subquery."""
    pairs = []
    for k in names:
        n, s, q = (F.sum(f"{k}_{x}") for x in "nsq")
        pairs += [
            F.try_divide(s, n).alias(f"{k}_mean"),
            F.sqrt(F.greatest(F.try_divide(q - F.try_divide(s * s, n), n - 1), F.lit(0.0))).alias(f"{k}_sd"),
        ]
    return facts.agg(F.struct(*pairs).alias("c")).scalar()


def with_centering(df: DataFrame, columns: dict[str, Column], name: str = "c") -> DataFrame:
    """Adds one struct column holding mean and sample SD of every entry of ``columns``.

    The constants are one scalar subquery, carried as a column so that it is planned
    once however many expressions read it.
    """
    pairs = []
    for key, col in columns.items():
        pairs += [F.avg(col).alias(f"{key}_mean"), F.stddev_samp(col).alias(f"{key}_sd")]
    return df.withColumn(name, df.agg(F.struct(*pairs).alias("c")).scalar())


def clean(cohort: DataFrame) -> DataFrame:
    """The analysis cohort.

    Order of the steps: modal sex; subjects with a height by ``MAX_AGE + 1``;
    subjects with a blood pressure; lag flag not 4; Bamako 0 or 1; z-scores over
    the rows left; subjects that still have a blood pressure; centred columns over the rows left then.

    The visits are read twice: once for the per-subject facts, which are written, and
    once for the rows themselves. Rules, sex and constants all come from the facts.
    """
    facts = durable(subject_facts(cohort)).where("early_height AND any_sbp")
    kept = facts.where("sbp_in_kept")
    rows = cohort.where(row_ok()).drop("Sex").join(kept.select("ID", "Sex"), "ID")
    rows = rename_columns(recode_sex(rows)).withColumns(
        {"Age": round_even("Age_Yrs", 3), "log2T_use": F.log2("T_use")}
    )
    scaled = {"log2T_use_Z": "log2T_use", "Breast_Stage_Use_Z": "Breast_Stage_Use", "AgeZ": "Age"}
    centred = {"age_cen": "Age", "HT_cen": "HT", "BMI_cen": "BMI", "temp_cen": "Temp"}
    rows = rows.withColumns({"z": constants(facts, scaled.values()), "c": constants(kept, centred.values())})
    return rows.withColumns(
        {
            **{z: zscore(x, F.col(f"z.{x}_mean"), F.col(f"z.{x}_sd")) for z, x in scaled.items()},
            **{m: F.col(x) - F.col(f"c.{x}_mean") for m, x in centred.items()},
            "age_x": (F.col("Age") - 10) / 10.0,
            "Pregnant": is_member("ReproStat_Corr", PREGNANT_CODES),
            "Lactating": is_member("ReproStat_Corr", LACTATING_CODES),
            "Stimulant_No_PerWeek": F.coalesce("Stimulant_No_PerWeek", F.lit(0)),
        }
    ).drop("z", "c")


def get_data(cohort: DataFrame, female: int, var: str, others: list[str] | None = None) -> DataFrame:
    """Data for imputing ``var`` in one sex."""
    return cohort.where(F.col("Female") == female).select("ID", "Age", "AgeZ", var, *(others or []))


FUNNEL_STEPS = (
    "original file",
    "height by age 11",
    "any blood pressure",
    "height lag flag not 4",
    "Bamako 0 or 1",
    "blood pressure among the rows left",
)


def cohort_funnel(cohort: DataFrame) -> DataFrame:
    """Subjects and records left after every cleaning step, from one pass.

    Rows are first counted per subject (map-side combined), so the subject counts
    need no distinct and no step needs a job of its own.
    """
    per_subject = cohort.groupBy("ID").agg(
        F.count("*").alias("n_all"),
        F.max(early_height()).alias("early"),
        F.max(has_sbp()).alias("sbp"),
        F.count_if(lag_ok()).alias("n_lag"),
        F.count_if(row_ok()).alias("n_bamako"),
        F.max(row_ok() & has_sbp()).alias("sbp_left"),
    )
    early = F.col("early")
    both = early & F.col("sbp")
    zero = F.lit(0).cast("bigint")
    left = [
        F.col("n_all"),
        F.when(early, F.col("n_all")).otherwise(zero),
        F.when(both, F.col("n_all")).otherwise(zero),
        F.when(both, F.col("n_lag")).otherwise(zero),
        F.when(both, F.col("n_bamako")).otherwise(zero),
        F.when(both & F.col("sbp_left"), F.col("n_bamako")).otherwise(zero),
    ]
    totals = per_subject.agg(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("step"),
                    F.lit(label).alias("label"),
                    F.count_if(n > 0).alias("subjects"),
                    F.coalesce(F.sum(n), zero).alias("records"),
                )
                for i, (label, n) in enumerate(zip(FUNNEL_STEPS, left))
            ]
        ).alias("steps")
    )
    return totals.select(F.inline("steps"))


def fill_stimulant(col="Stimulant_No_PerWeek") -> Column:
    return F.coalesce(col, F.lit(0))


def fill_males_zero(col: str) -> Column:
    """Missing for males means zero; missing for females stays missing."""
    return F.when((F.col("Female") == 0) & F.col(col).isNull(), 0).otherwise(F.col(col))


def fill_lactation(col: str, no_info: str) -> Column:
    """Zero where value and information flag are both missing, and for all males."""
    both_missing = F.col(no_info).isNull() & F.col(col).isNull()
    return F.when(both_missing | (F.col("Female") == 0), 0).otherwise(F.col(col))


def recode_village(df: DataFrame) -> DataFrame:
    """Bamako 1 is village 50; visits with no village are dropped."""
    village = F.when(F.col("Bamako") == 1, 50).otherwise(F.col("Village"))
    return df.withColumn("Village", village.cast("int")).where(F.col("Village").isNotNull())


def subjects_with(df: DataFrame, condition: Column) -> DataFrame:
    """All rows of the subjects that have at least one row meeting ``condition``."""
    return df.join(df.where(condition).select("ID").distinct(), "ID", "left_semi")
