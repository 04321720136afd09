"""Scans, projections, filters, joins and summaries over the cohort visits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auxoline.functions.scalar import from_zscore, is_member, round_even, zscore
from auxoline.operators import clean as C
from auxoline.operators import summaries as S
from auxoline.operators import visits as V
from auxoline.plans.registry import query
from auxoline.plans.study_sql import CLEAN, COHORT, VISITS
from auxoline.session import durable
from auxoline.sources import study_tables as T


def r6(col):
    return F.round(col, 6)


def cleaned(spark, sf_dir) -> DataFrame:
    """The analysis cohort. Cleaning reads the visits twice, so they are joined to their line items once and written."""
    return C.clean(durable(T.cohort(spark, sf_dir)))


def named(spark, sf_dir, columns=None) -> DataFrame:
    """Visits with recorded sex, working names and rounded age, before any filter."""
    df = C.recode_sex(C.rename_columns(T.cohort(spark, sf_dir, columns)))
    return df.withColumn("Age", round_even("Age_Yrs", 3)) if "Age_Yrs" in df.columns else df


@query(
    "cohort_view",
    f"""WITH {COHORT} SELECT ID, visit_id, datecomb, round(Age_Yrs, 6) AS age_yrs, Sex AS sex, round(Ht_Ave_Use, 6) AS ht,
    round(WT, 6) AS wt, round(BMI, 6) AS bmi, round(SBP_MEAN, 6) AS sbp, round(DBP_MEAN, 8) AS dbp, Ht_Lag_Flag AS lag_flag,
    Bamako AS bamako, Village AS village, ReproStat_Corr AS repro, Breast_Stage_Use AS breast, round(T_use, 6) AS t_use,
    PregMo_Use AS pregmo, lactMo_Use AS lactmo, no_lactmo_info, Stimulant_No_PerWeek AS stimulant,
    round(Wealth_Z, 6) AS wealth_z, Temp AS temp, School AS school, Year AS year, round(lognummeas_BASE10, 6) AS lognummeas,
    MomIdUnique AS mom, Mom_Ht_Ave AS mom_ht, Dad_Ht_Ave AS dad_ht, Mom_SBP_Z_Res_USE AS mom_sbp,
    Dad_SBP_Z_Res_USE AS dad_sbp FROM cohort""",
)
def cohort_view(spark, sf_dir):
    return T.cohort(spark, sf_dir).select(
        "ID", "visit_id", "datecomb", r6("Age_Yrs").alias("age_yrs"), F.col("Sex").alias("sex"),
        r6("Ht_Ave_Use").alias("ht"), r6("WT").alias("wt"), r6("BMI").alias("bmi"),
        r6("SBP_MEAN").alias("sbp"), F.round("DBP_MEAN", 8).alias("dbp"), F.col("Ht_Lag_Flag").alias("lag_flag"),
        F.col("Bamako").alias("bamako"), F.col("Village").alias("village"), F.col("ReproStat_Corr").alias("repro"),
        F.col("Breast_Stage_Use").alias("breast"), r6("T_use").alias("t_use"), F.col("PregMo_Use").alias("pregmo"),
        F.col("lactMo_Use").alias("lactmo"), "no_lactmo_info", F.col("Stimulant_No_PerWeek").alias("stimulant"),
        r6("Wealth_Z").alias("wealth_z"), F.col("Temp").alias("temp"), F.col("School").alias("school"),
        F.col("Year").alias("year"), r6("lognummeas_BASE10").alias("lognummeas"), F.col("MomIdUnique").alias("mom"),
        F.col("Mom_Ht_Ave").alias("mom_ht"), F.col("Dad_Ht_Ave").alias("dad_ht"),
        F.col("Mom_SBP_Z_Res_USE").alias("mom_sbp"), F.col("Dad_SBP_Z_Res_USE").alias("dad_sbp"),
    )


@query(
    "recode_sex",
    f"""WITH {COHORT} SELECT ID, visit_id, CASE WHEN Sex = 0 THEN 'Female' ELSE 'Male' END AS sex,
    (1 - Sex)::INTEGER AS female, Sex::INTEGER AS male FROM cohort""",
)
def recode_sex(spark, sf_dir):
    df = C.recode_sex(T.cohort(spark, sf_dir, ["ID", "visit_id", "Sex"]))
    return df.select("ID", "visit_id", F.col("Sex").alias("sex"), F.col("Female").alias("female"), F.col("Male").alias("male"))


@query(
    "age_round",
    f"""WITH {COHORT} SELECT ID, visit_id, round_even(Age_Yrs, 3) AS age, round_even(Age_Yrs, 0)::INTEGER AS whole_age
    FROM cohort""",
)
def age_round(spark, sf_dir):
    df = T.cohort(spark, sf_dir, ["ID", "visit_id", "Age_Yrs"])
    return df.select(
        "ID", "visit_id", round_even("Age_Yrs", 3).alias("age"), round_even("Age_Yrs", 0).cast("int").alias("whole_age")
    )


@query(
    "repro_flags",
    f"""WITH {COHORT} SELECT ID, visit_id, coalesce(ReproStat_Corr IN (2, 4), FALSE) AS pregnant,
    coalesce(ReproStat_Corr IN (3), FALSE) AS lactating FROM cohort""",
)
def repro_flags(spark, sf_dir):
    return T.cohort(spark, sf_dir, ["ID", "visit_id", "ReproStat_Corr"]).select(
        "ID",
        "visit_id",
        is_member("ReproStat_Corr", C.PREGNANT_CODES).alias("pregnant"),
        is_member("ReproStat_Corr", C.LACTATING_CODES).alias("lactating"),
    )


@query(
    "fill_rules",
    f"""WITH {COHORT} SELECT ID, visit_id, coalesce(Stimulant_No_PerWeek, 0) AS stimulant,
    CASE WHEN Sex = 1 AND PregMo_Use IS NULL THEN 0 ELSE PregMo_Use END AS pregmo_model,
    coalesce(PregMo_Use, 0) AS pregmo_mediation, coalesce(lactMo_Use, 0) AS lactmo_model,
    CASE WHEN Sex = 1 THEN 0 WHEN no_lactmo_info IS NULL AND lactMo_Use IS NULL THEN 0 ELSE lactMo_Use END
      AS lactmo_mediation FROM cohort""",
)
def fill_rules(spark, sf_dir):
    df = named(
        spark, sf_dir, ["ID", "visit_id", "Sex", "Stimulant_No_PerWeek", "PregMo_Use", "lactMo_Use", "no_lactmo_info"]
    )
    zero = F.lit(0)
    return df.select(
        "ID",
        "visit_id",
        C.fill_stimulant().alias("stimulant"),
        C.fill_males_zero("PregMo_Use").alias("pregmo_model"),
        F.coalesce("PregMo_Use", zero).alias("pregmo_mediation"),
        F.coalesce(C.fill_males_zero("lactMo_Use"), zero).alias("lactmo_model"),
        C.fill_lactation("lactMo_Use", "no_lactmo_info").alias("lactmo_mediation"),
    )


@query(
    "village_recode",
    f"""WITH {COHORT} SELECT ID, visit_id, (CASE WHEN Bamako = 1 THEN 50 ELSE Village END)::INTEGER AS village FROM cohort
    WHERE Bamako = 1 OR Village IS NOT NULL""",
)
def village_recode(spark, sf_dir):
    df = C.recode_village(T.cohort(spark, sf_dir, ["ID", "visit_id", "Bamako", "Village"]))
    return df.select("ID", "visit_id", F.col("Village").alias("village"))


@query(
    "cohort_funnel",
    f"""WITH {CLEAN},
    f AS (SELECT 0 AS step, 'original file' AS label, ID FROM named
      UNION ALL SELECT 1, 'height by age 11', ID FROM s1 UNION ALL SELECT 2, 'any blood pressure', ID FROM s2
      UNION ALL SELECT 3, 'height lag flag not 4', ID FROM s3 UNION ALL SELECT 4, 'Bamako 0 or 1', ID FROM s4
      UNION ALL SELECT 5, 'blood pressure among the rows left', ID FROM clean)
    SELECT step, label, count(DISTINCT ID) AS subjects, count(*) AS records FROM f GROUP BY step, label""",
)
def cohort_funnel(spark, sf_dir):
    cols = ["ID", "Age_Yrs", "Ht_Ave_Use", "SBP_MEAN", "Ht_Lag_Flag", "Bamako"]
    return C.cohort_funnel(T.cohort(spark, sf_dir, cols))


@query(
    "age_window",
    f"""WITH {COHORT}, a AS (SELECT ID, visit_id, round_even(Age_Yrs, 3) AS age, round(Ht_Ave_Use, 6) AS ht FROM cohort)
    SELECT 'childhood' AS age_window, * FROM a WHERE age <= 11
    UNION ALL SELECT 'puberty', * FROM a WHERE age >= 8""",
)
def age_window(spark, sf_dir):
    df = T.cohort(spark, sf_dir, ["ID", "visit_id", "Age_Yrs", "Ht_Ave_Use"]).select(
        "ID", "visit_id", round_even("Age_Yrs", 3).alias("age"), r6("Ht_Ave_Use").alias("ht")
    )
    windows = F.array(
        F.when(F.col("age") <= C.MAX_AGE + 1, "childhood"), F.when(F.col("age") >= 8, "puberty")
    )
    return df.select(F.explode(F.array_compact(windows)).alias("age_window"), "*")


@query(
    "stratum_counts",
    f"""WITH {CLEAN} SELECT Female AS female, count(*) AS n_obs, count(DISTINCT ID) AS n_subjects FROM clean GROUP BY Female""",
)
def stratum_counts(spark, sf_dir):
    per_subject = cleaned(spark, sf_dir).groupBy("Female", "ID").agg(F.count("*").alias("n"))
    return per_subject.groupBy(F.col("Female").alias("female")).agg(
        F.sum("n").alias("n_obs"), F.count("*").alias("n_subjects")
    )


MODEL_COLUMNS = ["Ht_Ave_Use", "SBP_MEAN", "T_use", "Wealth_Z", "Dad_Ht_Ave"]


@query(
    "complete_cases",
    f"""WITH {COHORT} SELECT ID, visit_id, round(Ht_Ave_Use, 6) AS ht, round(SBP_MEAN, 6) AS sbp, round(T_use, 6) AS t_use,
    round(Wealth_Z, 6) AS wealth_z, Dad_Ht_Ave AS dad_ht FROM cohort WHERE Ht_Ave_Use IS NOT NULL AND SBP_MEAN IS NOT NULL
    AND T_use IS NOT NULL AND Wealth_Z IS NOT NULL AND Dad_Ht_Ave IS NOT NULL""",
)
def complete_cases(spark, sf_dir):
    df = S.complete_cases(T.cohort(spark, sf_dir, ["ID", "visit_id", *MODEL_COLUMNS]))
    return df.select(
        "ID", "visit_id", r6("Ht_Ave_Use").alias("ht"), r6("SBP_MEAN").alias("sbp"), r6("T_use").alias("t_use"),
        r6("Wealth_Z").alias("wealth_z"), F.col("Dad_Ht_Ave").alias("dad_ht"),
    )


@query(
    "complete_cases_subset",
    f"""WITH {COHORT} SELECT ID, visit_id, round(Ht_Ave_Use, 6) AS ht, round(WT, 6) AS wt, round(BMI, 6) AS bmi,
    round(T_use, 6) AS t_use FROM cohort WHERE Ht_Ave_Use IS NOT NULL AND WT IS NOT NULL AND BMI IS NOT NULL""",
)
def complete_cases_subset(spark, sf_dir):
    df = T.cohort(spark, sf_dir, ["ID", "visit_id", "Ht_Ave_Use", "WT", "BMI", "T_use"])
    return S.complete_cases(df, ["Ht_Ave_Use", "WT", "BMI"]).select(
        "ID", "visit_id", r6("Ht_Ave_Use").alias("ht"), r6("WT").alias("wt"), r6("BMI").alias("bmi"), r6("T_use").alias("t_use")
    )


@query(
    "get_data",
    f"""WITH {CLEAN} SELECT ID, Age AS age, round(AgeZ, 6) AS age_z, round(HT, 6) AS ht, round(SBP_MEAN, 6) AS sbp
    FROM clean WHERE Female = 1""",
)
def get_data(spark, sf_dir):
    df = C.get_data(cleaned(spark, sf_dir), 1, "HT", ["SBP_MEAN"])
    return df.select(
        "ID", F.col("Age").alias("age"), r6("AgeZ").alias("age_z"), r6("HT").alias("ht"), r6("SBP_MEAN").alias("sbp")
    )


@query(
    "ref_age_frame",
    f"""WITH {CLEAN} SELECT ID, visit_id, age AS age, round((21 - 10)/10.0::DOUBLE, 6) AS age_x, round(HT, 6) AS ht
    FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY datecomb, visit_id) AS r FROM clean) WHERE r = 1""",
)
def ref_age_frame(spark, sf_dir):
    first = V.pick_visit(cleaned(spark, sf_dir).select("ID", "visit_id", "datecomb", "Age", "HT"))
    return first.select("ID", "visit_id", F.col("Age").alias("age"), r6(F.lit((21 - 10) / 10)).alias("age_x"), r6("HT").alias("ht"))


@query(
    "semi_early_height",
    f"""WITH {COHORT} SELECT ID, visit_id, round(Age_Yrs, 6) AS age_yrs, round(Ht_Ave_Use, 6) AS ht FROM cohort WHERE ID IN
    (SELECT ID FROM cohort WHERE Ht_Ave_Use IS NOT NULL AND round_even(Age_Yrs, 3) <= 11)""",
)
def semi_early_height(spark, sf_dir):
    df = T.cohort(spark, sf_dir, ["ID", "visit_id", "Age_Yrs", "Ht_Ave_Use"])
    kept = C.subjects_with(df, C.early_height())
    return kept.select("ID", "visit_id", r6("Age_Yrs").alias("age_yrs"), r6("Ht_Ave_Use").alias("ht"))


@query(
    "outcome_count_join",
    f"""WITH {CLEAN}, n AS (SELECT ID, count(SBP_MEAN) AS n_sbp FROM clean GROUP BY ID)
    SELECT clean.ID, visit_id, Age AS age, round(HT, 6) AS ht, n_sbp FROM clean JOIN n ON n.ID = clean.ID
    WHERE n_sbp > 0 AND HT IS NOT NULL AND Age <= 11""",
)
def outcome_count_join(spark, sf_dir):
    """The frame a body-size process is fitted to: usable rows of subjects with an outcome."""
    df = cleaned(spark, sf_dir).select("ID", "visit_id", "Age", "HT", "SBP_MEAN")
    counts = S.subject_counts(df, ["ID"], "SBP_MEAN").withColumnRenamed("n_SBP_MEAN", "n_sbp")
    kept = S.complete_cases(df.drop("SBP_MEAN")).where(F.col("Age") <= C.MAX_AGE + 1).join(counts, "ID")
    return kept.select("ID", "visit_id", F.col("Age").alias("age"), r6("HT").alias("ht"), "n_sbp")


@query(
    "modal_sex",
    f"""WITH {CLEAN} SELECT c.ID, c.visit_id, c.Sex AS recorded, m.Sex AS sex, c.Sex <> m.Sex AS repaired
    FROM cohort c JOIN modal m ON m.ID = c.ID""",
)
def modal_sex(spark, sf_dir):
    df = C.repair_sex(T.cohort(spark, sf_dir, ["ID", "visit_id", "datecomb", "Sex"]))
    return df.select(
        "ID",
        "visit_id",
        F.col("Sex_recorded").alias("recorded"),
        F.col("Sex").alias("sex"),
        (F.col("Sex_recorded") != F.col("Sex")).alias("repaired"),
    )


def centred_columns():
    """Every quantity that is centred or z-scored somewhere in the study."""
    return {
        "log2T_use": F.col("log2T_use"),
        "Breast_Stage_Use": F.col("Breast_Stage_Use"),
        "age": F.col("Age"),
        "BMI": F.col("BMI"),
        "HT": F.col("HT"),
        "temp": F.col("Temp"),
        "lactMo": F.coalesce("lactMo_Use", F.lit(0)),
        "PregMo": C.fill_males_zero("PregMo_Use"),
    }


CENTRED_SQL = {
    "log2T_use": "log2T_use",
    "Breast_Stage_Use": "Breast_Stage_Use",
    "age": "Age",
    "BMI": "BMI",
    "HT": "HT",
    "temp": "Temp",
    "lactMo": "coalesce(lactMo_Use, 0)",
    "PregMo": "CASE WHEN Female = 0 AND PregMo_Use IS NULL THEN 0 ELSE PregMo_Use END",
}


@query(
    "centering",
    f"WITH {CLEAN} "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS name, round(avg({e}), 6) AS mean, round(stddev_samp({e}), 6) AS sd FROM clean"
        for k, e in CENTRED_SQL.items()
    ),
)
def centering(spark, sf_dir):
    df = S.centering(cleaned(spark, sf_dir), centred_columns())
    return df.select("name", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query(
    "zscores",
    f"""WITH {CLEAN}, m AS (SELECT avg(HT) AS m_ht, avg(BMI) AS m_bmi, avg(Temp) AS m_temp, avg(Age) AS m_age FROM clean)
    SELECT ID, visit_id, round(log2T_use_Z, 6) + 0.0 AS log2t_z, round(Breast_Stage_Use_Z, 6) + 0.0 AS breast_z,
    round(AgeZ, 6) + 0.0 AS age_z, round(HT - m_ht, 6) + 0.0 AS ht_cen, round(BMI - m_bmi, 6) + 0.0 AS bmi_cen,
    round(Temp - m_temp, 6) + 0.0 AS temp_cen, round(Age - m_age, 6) + 0.0 AS age_cen FROM clean, m""",
)
def zscores(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    return df.select(
        "ID",
        "visit_id",
        r6("log2T_use_Z").alias("log2t_z"),
        r6("Breast_Stage_Use_Z").alias("breast_z"),
        r6("AgeZ").alias("age_z"),
        *[r6(c).alias(c.lower()) for c in ("HT_cen", "BMI_cen", "temp_cen", "age_cen")],
    )


@query(
    "log_roundtrip",
    f"""WITH {CLEAN}, c AS (SELECT avg(log2T_use) AS m, stddev_samp(log2T_use) AS s FROM clean)
    SELECT ID, visit_id, round(log2T_use, 6) + 0.0 AS log2t, round(pow(2, (log2T_use - m)/s*s + m), 6) AS t_back,
    round(pow(10, lognummeas), 6) AS nummeas FROM clean, c""",
)
def log_roundtrip(spark, sf_dir):
    df = C.with_centering(cleaned(spark, sf_dir), {"t": F.col("log2T_use")})
    mean, sd = F.col("c.t_mean"), F.col("c.t_sd")
    z = df.withColumn("z", zscore("log2T_use", mean, sd))
    return z.select(
        "ID",
        "visit_id",
        r6("log2T_use").alias("log2t"),
        r6(F.pow(F.lit(2.0), from_zscore("z", mean, sd))).alias("t_back"),
        r6(F.pow(F.lit(10.0), "lognummeas")).alias("nummeas"),
    )


@query(
    "age_sex_stats",
    f"""WITH {CLEAN}, u AS (
      SELECT round_even(Age, 0)::INTEGER AS age, Female AS female, 'BMI' AS var, BMI AS x FROM clean UNION ALL
      SELECT round_even(Age, 0)::INTEGER, Female, 'WT', WT FROM clean UNION ALL
      SELECT round_even(Age, 0)::INTEGER, Female, 'HT', HT FROM clean)
    SELECT var, age, female, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd
    FROM u GROUP BY var, age, female""",
)
def age_sex_stats(spark, sf_dir):
    df = S.age_sex_stats(cleaned(spark, sf_dir), ["BMI", "WT", "HT"])
    return df.select("var", "age", F.col("Female").alias("female"), "n", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query(
    "subject_counts",
    f"""WITH {CLEAN} SELECT ID, Female AS female, count(*) AS n_ht FROM clean WHERE HT IS NOT NULL AND Age <= 11
    GROUP BY ID, Female""",
)
def subject_counts(spark, sf_dir):
    df = cleaned(spark, sf_dir).where(F.col("Age") <= C.MAX_AGE + 1)
    counts = S.subject_counts(df, ["ID", "Female"], "HT")
    return counts.select("ID", F.col("Female").alias("female"), F.col("n_HT").alias("n_ht"))


PROFILED = [
    "SBP_MEAN", "HT", "Ht_Lag_Flag", "ReproStat_Corr", "T_use", "PregMo_Use", "lactMo_Use", "no_lactmo_info",
    "Wealth_Z", "Dad_Ht_Ave", "Mom_SBP_Z_Res_USE", "Dad_SBP_Z_Res_USE", "Breast_Stage_Use_Z", "log2T_use_Z", "Village",
]


@query(
    "null_profile",
    f"WITH {CLEAN} "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM clean" for c in PROFILED),
)
def null_profile(spark, sf_dir):
    return S.null_profile(cleaned(spark, sf_dir), PROFILED)


@query(
    "model_sizes",
    f"""WITH {CLEAN} SELECT Female AS female, count(*) AS n_obs, count(DISTINCT ID) AS n_subjects,
    count(DISTINCT MomIdUnique) AS n_mothers FROM clean WHERE HT IS NOT NULL AND SBP_MEAN IS NOT NULL AND T_use IS NOT NULL
    AND Wealth_Z IS NOT NULL AND Dad_Ht_Ave IS NOT NULL GROUP BY Female""",
)
def model_sizes(spark, sf_dir):
    cols = ["HT", "SBP_MEAN", "T_use", "Wealth_Z", "Dad_Ht_Ave"]
    df = S.complete_cases(cleaned(spark, sf_dir), cols)
    return S.model_sizes(df, ["Female"]).withColumnRenamed("Female", "female")


@query(
    "first_visit",
    f"""WITH {CLEAN} SELECT ID, visit_id, datecomb, Age AS age, round(SBP_MEAN, 6) AS sbp FROM
    (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY datecomb, visit_id) AS r FROM clean WHERE SBP_MEAN IS NOT NULL)
    WHERE r = 1""",
)
def first_visit(spark, sf_dir):
    df = cleaned(spark, sf_dir).where(C.has_sbp()).select("ID", "visit_id", "datecomb", "Age", "SBP_MEAN")
    return V.pick_visit(df).select("ID", "visit_id", "datecomb", F.col("Age").alias("age"), r6("SBP_MEAN").alias("sbp"))


@query(
    "last_visit",
    f"""WITH {CLEAN} SELECT ID, visit_id, datecomb, Age AS age, round(HT, 6) AS ht FROM
    (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY Age DESC, visit_id DESC) AS r FROM clean) WHERE r = 1""",
)
def last_visit(spark, sf_dir):
    df = cleaned(spark, sf_dir).select("ID", "visit_id", "datecomb", "Age", "HT")
    last = V.pick_visit(df, last=True, order=("Age", "visit_id"))
    return last.select("ID", "visit_id", "datecomb", F.col("Age").alias("age"), r6("HT").alias("ht"))


@query(
    "baseline_carry",
    f"""WITH {CLEAN}, b AS (SELECT ID, arg_min(Wealth_Z, (datecomb, visit_id)) FILTER (WHERE Wealth_Z IS NOT NULL) AS w,
      arg_min(Village, (datecomb, visit_id)) FILTER (WHERE Village IS NOT NULL) AS v,
      arg_min(T_use, (datecomb, visit_id)) FILTER (WHERE T_use IS NOT NULL) AS t FROM clean GROUP BY ID)
    SELECT clean.ID, visit_id, round(w, 6) AS wealth_z, v AS village, round(t, 6) AS t_use FROM clean JOIN b ON b.ID = clean.ID""",
)
def baseline_carry(spark, sf_dir):
    df = cleaned(spark, sf_dir).select("ID", "visit_id", "datecomb", "Wealth_Z", "Village", "T_use")
    out = V.baseline_carry(df, ["Wealth_Z", "Village", "T_use"])
    return out.select(
        "ID", "visit_id", r6("Wealth_Z").alias("wealth_z"), F.col("Village").alias("village"), r6("T_use").alias("t_use")
    )


# What a visit needs to enter the analysis.
ANALYSIS_SQL = "SBP_MEAN IS NOT NULL AND HT IS NOT NULL AND BMI IS NOT NULL AND Wealth_Z IS NOT NULL AND Age IS NOT NULL"

TABLE_ONE = {
    "Age": "Age", "SBP_MEAN": "SBP_MEAN", "HT": "HT", "BMI": "BMI", "School": "School", "NumMeas": "pow(10, lognummeas)",
    "temp": "Temp", "Wealth_Z": "Wealth_Z", "Breast_Stage": "Breast_Stage_Use", "Testosterone": "pow(2, log2T_use)",
}


@query(
    "table_one",
    f"""WITH {CLEAN}, cc AS (SELECT * FROM clean WHERE {ANALYSIS_SQL}),
    e AS (SELECT 'first' AS visit, * FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY Age, visit_id) AS r FROM cc)
          WHERE r = 1 UNION ALL
          SELECT 'last', * FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY Age DESC, visit_id DESC) AS r FROM cc)
          WHERE r = 1),
    u AS ("""
    + " UNION ALL ".join(f"SELECT visit, Female AS female, '{k}' AS variable, ({e})::DOUBLE AS x FROM e" for k, e in TABLE_ONE.items())
    + """) SELECT visit, female, variable, count(*) AS n, round(avg(x), 6) + 0.0 AS mean,
    round(quantile_cont(x, 0.1), 6) + 0.0 AS q10, round(quantile_cont(x, 0.9), 6) + 0.0 AS q90
    FROM u GROUP BY visit, female, variable""",
)
def table_one(spark, sf_dir):
    """The visits that enter the analysis, summarised at each subject's first and last of them."""
    df = cleaned(spark, sf_dir).where(ANALYSIS_SQL).select(
        "ID", "visit_id", "Female", "Age", "SBP_MEAN", "HT", "BMI", "School",
        F.pow(F.lit(10.0), "lognummeas").alias("NumMeas"), F.col("Temp").alias("temp"), "Wealth_Z",
        F.col("Breast_Stage_Use").alias("Breast_Stage"), F.pow(F.lit(2.0), "log2T_use").alias("Testosterone"),
    )
    t = S.table_one(df, list(TABLE_ONE), ["Age", "visit_id"])
    return t.select(
        F.col("Visit").alias("visit"), F.col("Female").alias("female"), "variable", F.col("N").alias("n"),
        r6("Mean").alias("mean"), r6("q10").alias("q10"), r6("q90").alias("q90"),
    )


def _nearest_sql(limit: int) -> str:
    return f"""WITH {VISITS},
    obs AS (SELECT ID, datecomb, visit_id, y FROM visits_ts WHERE y IS NOT NULL),
    near AS (SELECT m.ID, m.visit_id, arg_min({{'y': o.y, 'gap': abs(date_diff('day', o.datecomb, m.datecomb))}},
        (abs(date_diff('day', o.datecomb, m.datecomb)), o.datecomb, o.visit_id)) AS hit
      FROM visits_ts m JOIN obs o ON o.ID = m.ID AND abs(date_diff('day', o.datecomb, m.datecomb)) < {limit}
      WHERE m.y IS NULL GROUP BY m.ID, m.visit_id)
    SELECT v.ID, v.visit_id, v.datecomb, round(v.y, 6) AS y, round(coalesce(v.y, hit.y), 6) AS y_filled,
      hit.gap::INTEGER AS gap_days
    FROM visits_ts v LEFT JOIN near USING (ID, visit_id)"""


def _nearest(limit: int):
    def run(spark, sf_dir):
        df = T.visits_ts(spark, sf_dir).select("ID", "visit_id", "datecomb", "y")
        out = V.nearest_fill(df, "y", limit)
        return out.select("ID", "visit_id", "datecomb", r6("y").alias("y"), r6("y_filled").alias("y_filled"), "gap_days")

    return run


query("asof_nearest_fill", _nearest_sql(1))(_nearest(1))
query("asof_nearest_fill_3_days", _nearest_sql(3))(_nearest(3))
query("asof_nearest_fill_90_days", _nearest_sql(90))(_nearest(90))


LEVEL_COLUMNS = {
    "female": [["Age", "BMI", "HT", "MomIdUnique", "Village"], ["Wealth_Z", "PregMo_Use", "lactMo_Use"],
               ["Mom_Ht_Ave", "Mom_SBP_Z_Res_USE"], ["Dad_Ht_Ave", "Dad_SBP_Z_Res_USE"]],
    "male": [["Age", "BMI", "HT", "MomIdUnique", "Village"], ["Wealth_Z", "Stimulant_No_PerWeek"],
             ["Mom_Ht_Ave", "Mom_SBP_Z_Res_USE"], ["Dad_Ht_Ave", "Dad_SBP_Z_Res_USE"]],
}


def level_columns(sex: str, adj: int) -> list[str]:
    """Columns of a nested adjustment level 0..3."""
    return [c for level in LEVEL_COLUMNS[sex][: adj + 1] for c in level]


def _level_sql() -> str:
    parts = []
    for female, sex in ((1, "female"), (0, "male")):
        for adj in range(4):
            cols = ["SBP_MEAN", *level_columns(sex, adj)]
            cond = " AND ".join(f"{c} IS NOT NULL" for c in cols)
            parts.append(
                f"SELECT '{sex}' AS sex, {adj} AS adj, {len(cols)} AS n_columns, count(*) AS n_complete, "
                f"count(DISTINCT ID) AS n_subjects FROM clean WHERE Female = {female} AND {cond}"
            )
    return f"WITH {CLEAN} " + " UNION ALL ".join(parts)


def complete_by_level(df: DataFrame, specs: list[dict]) -> DataFrame:
    """Complete rows and subjects of many column sets in one pass: counted per subject first."""
    flags = []
    for s in specs:
        ok = F.col("Female") == s["female"]
        for c in s["columns"]:
            ok = ok & F.col(c).isNotNull()
        flags.append(ok)
    per_subject = df.groupBy("ID").agg(*[F.count_if(ok).alias(f"n{i}") for i, ok in enumerate(flags)])
    rows = F.array(
        *[
            F.struct(
                *[F.lit(v).alias(k) for k, v in s.items() if k not in ("columns", "female")],
                F.lit(len(s["columns"])).alias("n_columns"),
                F.sum(f"n{i}").alias("n_complete"),
                F.count_if(F.col(f"n{i}") > 0).alias("n_subjects"),
            )
            for i, s in enumerate(specs)
        ]
    )
    return per_subject.agg(rows.alias("r")).select(F.inline("r"))


@query("covariate_levels", _level_sql())
def covariate_levels(spark, sf_dir):
    specs = [
        {"sex": sex, "adj": adj, "female": female, "columns": ["SBP_MEAN", *level_columns(sex, adj)]}
        for female, sex in ((1, "female"), (0, "male"))
        for adj in range(4)
    ]
    return complete_by_level(cleaned(spark, sf_dir), specs)


# The axes of the study grid.
BODY_SIZES = ("HT", "WT", "HAZ", "WAZ", "BAZ", "BMI")
SPEC_BP = ("sbp", "dbp")


def spec_frame(spark) -> DataFrame:
    """Literal grid of variable x pressure x dimension x control x father, without a join."""
    axes = {
        "var": BODY_SIZES,
        "bp": SPEC_BP,
        "ndim": (1, 2),
        "controlcbs": (False, True),
        "dadbp": (False, True),
    }
    df = spark.range(1)
    for name, values in axes.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df.drop("id")


@query(
    "spec_grid",
    f"""WITH {CLEAN}, v AS (SELECT unnest(['HT','WT','HAZ','WAZ','BAZ','BMI']) AS var), b AS (SELECT unnest(['sbp','dbp']) AS bp),
    d AS (SELECT unnest([1, 2]) AS ndim), c AS (SELECT unnest([false, true]) AS controlcbs), f AS (SELECT unnest([false, true]) AS dadbp),
    n AS (SELECT b.bp, c.controlcbs, f.dadbp, count(*) AS n_obs FROM clean, b, c, f
      WHERE (CASE WHEN b.bp = 'sbp' THEN SBP_MEAN ELSE DBP_MEAN END) IS NOT NULL AND lognummeas IS NOT NULL
      AND (NOT c.controlcbs OR (HT IS NOT NULL AND BMI IS NOT NULL))
      AND (NOT f.dadbp OR (Dad_Ht_Ave IS NOT NULL AND Dad_SBP_Z_Res_USE IS NOT NULL)) GROUP BY ALL)
    SELECT v.var, bp, d.ndim, controlcbs, dadbp, n_obs FROM n, v, d""",
)
def spec_grid(spark, sf_dir):
    """Every cell of the grid with the rows its covariates leave; rows are counted once per distinct frame."""
    df = cleaned(spark, sf_dir)
    body = F.col("HT").isNotNull() & F.col("BMI").isNotNull()
    dad = F.col("Dad_Ht_Ave").isNotNull() & F.col("Dad_SBP_Z_Res_USE").isNotNull()
    base = F.col("lognummeas").isNotNull()
    cells = F.array(
        *[
            F.struct(
                F.lit(bp).alias("bp"),
                F.lit(c).alias("controlcbs"),
                F.lit(d).alias("dadbp"),
                F.count_if(base & F.col(y).isNotNull() & (body if c else F.lit(True)) & (dad if d else F.lit(True))).alias("n_obs"),
            )
            for bp, y in (("sbp", "SBP_MEAN"), ("dbp", "DBP_MEAN"))
            for c in (False, True)
            for d in (False, True)
        ]
    )
    counts = df.agg(cells.alias("r")).select(F.inline("r"))
    grid = spec_frame(spark).join(counts, ["bp", "controlcbs", "dadbp"])
    return grid.select("var", "bp", "ndim", "controlcbs", "dadbp", "n_obs")
