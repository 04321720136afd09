import datetime as dt
import random

from pyspark.sql import functions as F

from auxoline.operators import clean as C
from auxoline.operators import visits as V

DAY0 = dt.date(2020, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def visits(spark, rows):
    return spark.createDataFrame([(i, v, day(d), y) for i, v, d, y in rows], "ID long, visit_id long, datecomb date, y double")


def fills(df, limit):
    return {(r.ID, r.visit_id): r.y_filled for r in V.nearest_fill(df, "y", limit).collect()}


def test_fill_rules(spark):
    """Same-day first row wins, ties go to the earlier date, a gap equal to the limit stays open."""
    df = visits(spark, [(1, 1, 10, 5.0), (1, 2, 10, 6.0), (1, 3, 10, None), (1, 4, 14, None), (1, 5, 18, 7.0), (1, 6, 30, None)])
    out = fills(df, 12)
    assert (out[(1, 3)], out[(1, 4)], out[(1, 6)]) == (5.0, 5.0, None)
    assert out[(1, 1)] == 5.0 and out[(1, 2)] == 6.0


def test_fills_do_not_chain(spark):
    df = visits(spark, [(1, 1, 0, 1.0), (1, 2, 60, None), (1, 3, 120, None)])
    out = fills(df, 90)
    assert out[(1, 2)] == 1.0 and out[(1, 3)] is None


def brute(rows, limit):
    out = {}
    for i, v, d, y in rows:
        if y is not None:
            out[(i, v)] = y
            continue
        near = [(abs(d - d2), d2, v2, y2) for i2, v2, d2, y2 in rows if i2 == i and y2 is not None and abs(d - d2) < limit]
        out[(i, v)] = min(near)[3] if near else None
    return out


def test_fill_matches_brute_force_with_a_hot_subject(spark):
    rng = random.Random(3)
    rows = [(1 if k % 3 == 0 else rng.randrange(2, 9), k, rng.randrange(400), rng.choice([None, None, round(rng.random(), 3)])) for k in range(700)]
    for limit in (1, 2, 7, 90):
        assert fills(visits(spark, rows), limit) == brute(rows, limit)


def test_modal_sex_ties_go_to_the_earliest_visit(spark):
    rows = [(1, 1, day(5), 0), (1, 2, day(1), 1), (1, 3, day(9), 0), (1, 4, day(7), 1), (2, 5, day(1), 0), (2, 6, day(2), None), (2, 7, day(0), None)]
    df = spark.createDataFrame(rows, "ID long, visit_id long, datecomb date, Sex long")
    assert {r.ID: r.Sex for r in C.modal_sex(df).collect()} == {1: 1, 2: 0}


def test_first_last_and_baseline(spark):
    df = visits(spark, [(1, 2, 3, None), (1, 1, 3, 4.0), (1, 3, 9, 8.0), (2, 4, 1, None)])
    assert {r.ID: r.visit_id for r in V.pick_visit(df).collect()} == {1: 1, 2: 4}
    assert {r.ID: r.visit_id for r in V.pick_visit(df, last=True).collect()} == {1: 3, 2: 4}
    carried = {r.visit_id: r.y for r in V.baseline_carry(df, ["y"]).collect()}
    assert carried == {1: 4.0, 2: 4.0, 3: 4.0, 4: None}


def test_first_subjects(spark):
    df = spark.createDataFrame([(s, i) for s in (0, 1) for i in range(50) if i % 2 == s], "Female int, ID long")
    out = V.first_subjects(df.union(df), "Female", 3)
    assert sorted((r.Female, r.ID) for r in out.collect()) == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3), (1, 5)]


def test_funnel_removes_subjects_again_after_row_filters(spark):
    rows = [
        (1, 5.0, 100.0, 90.0, 1, 0), (1, 6.0, 101.0, None, 2, 1),
        (2, 5.0, 100.0, 90.0, 4, 0), (2, 6.0, 100.0, None, None, 0),
        (3, 12.0, 100.0, 90.0, 1, 0),
        (4, 5.0, 100.0, None, 1, 0),
    ]
    df = spark.createDataFrame(rows, "ID long, Age_Yrs double, Ht_Ave_Use double, SBP_MEAN double, Ht_Lag_Flag int, Bamako int")
    out = {r.step: (r.subjects, r.records) for r in C.cohort_funnel(df).collect()}
    assert out == {0: (4, 6), 1: (3, 5), 2: (2, 4), 3: (2, 3), 4: (2, 3), 5: (1, 2)}


def test_clean_keeps_the_funnel_rows(spark, sf):
    from auxoline.plans.cohort_queries import cleaned
    from auxoline.sources import study_tables as T

    df = cleaned(spark, sf)
    last = C.cohort_funnel(T.cohort(spark, sf)).where("step = 5").first()
    assert (df.select("ID").distinct().count(), df.count()) == (last.subjects, last.records)
    assert df.where(F.col("AgeZ").isNull()).count() == 0
