"""The study tables once more, as DuckDB common table expressions for the oracles."""

LINES = """li AS (SELECT l_orderkey, avg(l_quantity) AS q, avg(l_discount) AS disc, avg(l_tax) AS tax
            FROM lineitem GROUP BY l_orderkey)"""

COHORT = LINES + """,
cohort0 AS (SELECT c_custkey AS ID, o_orderkey AS visit_id, CAST(o_orderdate AS DATE) AS datecomb,
  date_diff('day', (DATE '1985-01-01' + CAST((c_custkey*37) % 3650 AS INTEGER)), CAST(o_orderdate AS DATE))
    / 365.25::DOUBLE AS Age_Yrs,
  CASE WHEN o_orderkey % 17 = 0 THEN 1 - c_custkey % 2 ELSE c_custkey % 2 END AS Sex,
  80 + 3.0::DOUBLE*q AS Ht_Ave_Use,
  10 + 200.0::DOUBLE*tax + q AS WT,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 90 + o_totalprice/10000.0::DOUBLE END AS SBP_MEAN,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 50 + o_totalprice/20000.0::DOUBLE END AS DBP_MEAN,
  CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE CAST(substr(o_orderpriority,1,1) AS INT) END AS Ht_Lag_Flag,
  c_nationkey % 3 AS Bamako, c_nationkey + 1 AS Village,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 5 END AS ReproStat_Corr,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (1 + o_orderkey % 5)::DOUBLE END AS Breast_Stage_Use,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 1 + 100.0::DOUBLE*disc END AS T_use,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 9 END AS PregMo_Use,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 24 END AS lactMo_Use,
  CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE NULL END AS no_lactmo_info,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 4 END AS Stimulant_No_PerWeek,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE c_acctbal/1000.0::DOUBLE END AS Wealth_Z,
  20 + (o_orderkey % 15) AS Temp, o_orderkey % 13 AS School, year(CAST(o_orderdate AS DATE))::INTEGER AS Year,
  log10(1.0::DOUBLE + o_orderkey % 9) AS lognummeas_BASE10,
  CAST(floor(c_custkey/3.0::DOUBLE) AS BIGINT) AS MomIdUnique,
  150 + (CAST(floor(c_custkey/3.0::DOUBLE) AS BIGINT) % 20) AS Mom_Ht_Ave,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE (c_acctbal + 50*(o_orderkey % 7))/1000.0::DOUBLE END AS Wealth_Z_2,
  CASE WHEN CAST(floor(c_custkey/3.0::DOUBLE) AS BIGINT) % 14 = 0 THEN NULL ELSE 18 + (CAST(floor(c_custkey/3.0::DOUBLE) AS BIGINT)*5 % 31)/3.0::DOUBLE END AS Mom_BMI,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 19 + (c_custkey*7 % 29)/4.0::DOUBLE END AS Dad_BMI,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 160 + (c_custkey % 25) END AS Dad_Ht_Ave
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey),
cohort AS (SELECT *, WT / pow(Ht_Ave_Use/100.0::DOUBLE, 2) AS BMI,
  CASE WHEN MomIdUnique % 12 = 0 THEN NULL ELSE ((MomIdUnique*7) % 21 - 10)/10.0::DOUBLE END AS Mom_SBP_Z_Res_USE,
  CASE WHEN ID % 15 = 0 THEN NULL ELSE ((ID*3) % 21 - 10)/10.0::DOUBLE END AS Dad_SBP_Z_Res_USE
  FROM cohort0)"""

# The cleaning steps: modal sex, renames, subject and row filters, z-scores, flags and fills.
CLEAN = COHORT + """,
sexn AS (SELECT ID, Sex, count(*) AS n, min(datecomb) AS d FROM cohort GROUP BY ID, Sex),
sexv AS (SELECT s.ID, s.Sex, s.n, s.d, min(c.visit_id) AS v FROM sexn s
         JOIN cohort c ON c.ID = s.ID AND c.Sex = s.Sex AND c.datecomb = s.d GROUP BY s.ID, s.Sex, s.n, s.d),
modal AS (SELECT ID, Sex FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY n DESC, d, v) AS r FROM sexv)
          WHERE r = 1),
named AS (SELECT c.* EXCLUDE (Sex), (1 - m.Sex)::INTEGER AS Female, m.Sex::INTEGER AS Male,
            CASE WHEN m.Sex = 0 THEN 'Female' ELSE 'Male' END AS Sex,
            round_even(Age_Yrs, 3) AS Age, Ht_Ave_Use AS HT, lognummeas_BASE10 AS lognummeas
          FROM cohort c JOIN modal m ON m.ID = c.ID),
s1 AS (SELECT * FROM named WHERE ID IN (SELECT ID FROM named WHERE HT IS NOT NULL AND Age <= 11)),
s2 AS (SELECT * FROM s1 WHERE ID IN (SELECT ID FROM s1 WHERE SBP_MEAN IS NOT NULL)),
s3 AS (SELECT * FROM s2 WHERE Ht_Lag_Flag IS DISTINCT FROM 4),
s4 AS (SELECT * FROM s3 WHERE Bamako IN (0, 1)),
consts AS (SELECT avg(log2(T_use)) AS m_t, stddev_samp(log2(T_use)) AS s_t,
             avg(Breast_Stage_Use) AS m_b, stddev_samp(Breast_Stage_Use) AS s_b,
             avg(Age) AS m_a, stddev_samp(Age) AS s_a FROM s4),
clean AS (SELECT s4.* EXCLUDE (Stimulant_No_PerWeek), coalesce(Stimulant_No_PerWeek, 0) AS Stimulant_No_PerWeek,
            log2(T_use) AS log2T_use, (log2(T_use) - m_t)/s_t AS log2T_use_Z,
            (Breast_Stage_Use - m_b)/s_b AS Breast_Stage_Use_Z, (Age - m_a)/s_a AS AgeZ,
            coalesce(ReproStat_Corr IN (2, 4), FALSE) AS Pregnant, coalesce(ReproStat_Corr IN (3), FALSE) AS Lactating
          FROM s4, consts WHERE ID IN (SELECT ID FROM s4 WHERE SBP_MEAN IS NOT NULL))"""

GROWTH = """growth AS (
SELECT imp, ID, age, 50 + 6.0::DOUBLE*age + 0.2::DOUBLE*z + ((ID*7) % 13 - 6)*(0.5::DOUBLE + 0.1::DOUBLE*age) AS value
FROM (SELECT k AS imp, user_id AS ID,
        1 + CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))/3.0::DOUBLE) AS INT) AS age,
        avg(value) AS z
      FROM events CROSS JOIN (SELECT range AS k FROM range(20)) r
      WHERE event_id % 20 <> k GROUP BY ALL) t)"""

# Several body sizes: the same averages, height and weight, and what follows from them.
GROWTH_VARS = """growth_z AS (
SELECT k AS imp, user_id AS ID, 1 + CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))/3.0::DOUBLE) AS INT) AS age, avg(value) AS z
FROM events CROSS JOIN (SELECT range AS k FROM range(20)) r WHERE event_id % 20 <> k GROUP BY ALL),
growth_hw AS (SELECT imp, ID, age, 50 + 6.0::DOUBLE*age + 0.2::DOUBLE*z + ((ID*7) % 13 - 6)*(0.5::DOUBLE + 0.1::DOUBLE*age) AS ht,
  4 + 2.5::DOUBLE*age + 0.02::DOUBLE*z*(1 + 0.1::DOUBLE*age) + ((ID*11) % 17 - 8)*(0.1::DOUBLE + 0.03::DOUBLE*age) AS wt FROM growth_z),
growth_vars AS (SELECT 'HT' AS var, imp, ID, age, ht AS value FROM growth_hw UNION ALL SELECT 'WT', imp, ID, age, wt FROM growth_hw
  UNION ALL SELECT 'BMI', imp, ID, age, wt/pow(ht/100.0::DOUBLE, 2) FROM growth_hw
  UNION ALL SELECT 'HAZ', imp, ID, age, (ht - (50 + 6.0::DOUBLE*age))/(2 + 0.3::DOUBLE*age) FROM growth_hw
  UNION ALL SELECT 'WAZ', imp, ID, age, (wt - (4 + 2.5::DOUBLE*age))/(0.8::DOUBLE + 0.25::DOUBLE*age) FROM growth_hw
  UNION ALL SELECT 'BAZ', imp, ID, age, (wt/pow(ht/100.0::DOUBLE, 2) - 15)/(1.5::DOUBLE + 0.1::DOUBLE*age) FROM growth_hw)"""

VISITS = """visits_ts AS (
SELECT user_id AS ID, event_id AS visit_id, CAST(ts AS DATE) AS datecomb,
  8 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))*0.4::DOUBLE AS Age, user_id % 2 AS Female,
  100 + 0.1::DOUBLE*value AS HT,
  CASE WHEN event_type IN ('error','signup','view') THEN NULL ELSE value/100.0::DOUBLE END AS y
FROM events)"""

GROWTH_OBS = """growth_obs AS (
SELECT user_id AS ID, event_id AS visit_id, user_id % 2 AS Female,
  1 + 0.3::DOUBLE*(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + (hour(ts)*60 + minute(ts))/1440.0::DOUBLE) AS Age,
  60 + 6.0::DOUBLE*(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))/3.0::DOUBLE) + ((user_id*7) % 13 - 6)
    + 0.02::DOUBLE*value AS HT
FROM events)"""
